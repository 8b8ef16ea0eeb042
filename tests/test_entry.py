from conftest import SF001


def test_entry_and_catalogue(spark):
    import __spark_entry__ as entry
    df = entry.entry(spark)
    assert df.count() > 0
    assert set(df.columns) == {"conv_id", "turn", "dist"}
    qs, os_ = entry.queries(), entry.oracle_sql()
    assert set(os_) <= set(qs)
    assert len(qs) >= 60


def test_generation_counts(spark):
    import __spark_entry__ as entry
    qs = entry.queries()
    n = qs["gen_paraphrases"](spark, SF001).count()
    p = qs["gen_paraphrases_parity"](spark, SF001).count()
    assert (n, p) == (48, 42)
