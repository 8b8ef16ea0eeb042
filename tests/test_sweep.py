"""The sweep scores the candidates of a configuration once."""

from qaspark.plans import pipelines as P


def test_candidates_are_scored_once_a_configuration(spark, tmp_path, monkeypatch):
    turns = [(c, t, "user" if t % 2 == 0 else "assistant", f"w{c} w{t} w{c + t}") for c in range(6) for t in range(8)]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    seen = spark.sparkContext.accumulator(0)
    words = [(f"w{i}", [float(i % 5) + 1, float(i % 3), 1.0]) for i in range(14)]
    vectors = spark.createDataFrame(words, "token string, vec array<double>")
    kept = P.turn_vectors(spark, str(tmp_path), vectors, [0.0, 0.0, 0.0])

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    held = P.materialize(kept, "turns")
    prepared = {"vectors": vectors, "unknown": [0.0, 0.0, 0.0], "turns": held.mapInArrow(count, held.schema)}
    got = P.evaluate_config(spark, str(tmp_path), "main", 0, prepared=prepared).collect()
    assert len(got) == 1 and got[0]["total"] == 24 and got[0]["stage"] == 0
    assert seen.value == 2 * len(turns)  # once for the questions, once for the answers
