import random

import pytest
from llm_fixtures import docs_of  # noqa: F401
from pyspark.sql import functions as F

from qaspark.llm import suffix_array, suffix_dedup


def brute(texts, length):
    """Removed byte flags of each text."""
    seen = {}
    for k, t in enumerate(texts):
        raw = (t or "").encode()
        for p in range(len(raw) - length + 1):
            seen.setdefault(raw[p:p + length], []).append((k, p))
    flags = [bytearray(len((t or "").encode())) for t in texts]
    for places in seen.values():
        if len(places) > 1:
            for k, p in places:
                flags[k][p:p + length] = b"\x01" * length
    return flags


def test_suffix_ranks_equal_sorted_suffixes(spark):
    rng = random.Random(1)
    strings = [[rng.randint(1, 3) for _ in range(rng.randint(1, 60))] for _ in range(40)]
    strings += [strings[0], strings[1][3:], [1] * 50, [1] * 50, [2]]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(strings)], "sid long, t array<long>")
    before = suffix_array.BUCKET_ROWS
    suffix_array.BUCKET_ROWS = 200  # several buckets
    try:
        got = suffix_array.suffix_ranks(rows, 5).collect()
    finally:
        suffix_array.BUCKET_ROWS = before
    want = sorted((s[p:] + [i - (1 << 62)], i, p) for i, s in enumerate(strings) for p in range(len(s)))
    assert [(r.sid, r.pos) for r in sorted(got, key=lambda r: r["rank"])] == [(i, p) for _, i, p in want]
    pre = {}
    for i, s in enumerate(strings):
        for p in range(len(s) - 4):
            pre.setdefault(tuple(s[p:p + 5]), []).append((i, p))
    twins = {x for v in pre.values() if len(v) > 1 for x in v}
    assert {(r.sid, r.pos) for r in got if r.twin} == twins


@pytest.mark.parametrize("seed", [1, 2])
def test_remove_repeats_against_brute_force(spark, docs_of, seed):
    rng = random.Random(seed)
    word = lambda a, n: "".join(rng.choice(a) for _ in range(n))
    pool = [word("abcdé ", rng.randint(30, 160)) for _ in range(8)]
    texts = []
    for _ in range(60):
        t = word("abcdé ", rng.randint(0, 60))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(pool)
            a = rng.randint(0, 20)
            t += p[a:len(p) - rng.randint(0, 20)] + word("abcdé ", rng.randint(0, 30))
        texts.append(t)
    texts += [None, "", "x", texts[0], "a" * 300, "ab" * 100, texts[5][10:], pool[0] * 3]
    length = 40
    out = suffix_dedup.remove_repeats(docs_of(list(enumerate(texts))), length=length, window=20, gram=8, steps=(8, 2))
    flags = brute(texts, length)
    for r in out.collect():
        raw, f = (texts[r.doc_id] or "").encode(), flags[r.doc_id]
        assert r.n_bytes == len(raw) and r.n_removed == sum(f)
        assert bytes(r.kept) == bytes(b for b, x in zip(raw, f, strict=True) if not x)
        assert r.n_spans == sum(x and not (k and f[k - 1]) for k, x in enumerate(f))
        assert sum(s.end - s.start for s in r.spans) == r.n_removed


def test_repeated_rows_nulls_and_empty_tables(spark, docs_of):
    t = "".join(chr(97 + i * 7 % 26) + str(i) for i in range(300))
    out = suffix_dedup.remove_repeats(docs_of([(1, t), (1, t), (None, "short"), (2, None)]))
    got = sorted((r.doc_id or 0, r.n_removed) for r in out.collect())
    assert got == [(0, 0), (1, len(t)), (1, len(t)), (2, 0)]
    assert suffix_dedup.remove_repeats(docs_of([]).where(F.lit(False))).count() == 0


def test_whole_documents_against_brute_force(spark):
    """Production parameters over the whole small table."""
    import hashlib

    import pandas as pd
    from llm_fixtures import SF001

    from qaspark.llm import queries
    docs = pd.read_parquet(f"{SF001}/documents.parquet")
    flags = brute(docs.text.tolist(), 400)
    want = {}
    for i, t, f in zip(docs.doc_id, docs.text, flags, strict=True):
        raw = (t or "").encode()
        kept = bytes(b for b, x in zip(raw, f, strict=True) if not x)
        want[i] = (len(raw), sum(f), sum(x and not (k and f[k - 1]) for k, x in enumerate(f)), hashlib.sha256(kept).hexdigest())
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.QUERIES["op5_suffix_dedup"](spark, SF001).collect()}
    assert got == want and sum(w[1] for w in want.values()) > 0
