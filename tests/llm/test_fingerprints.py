import hashlib

import numpy as np
import pandas as pd
from llm_fixtures import SF001, docs_of  # noqa: F401
from pyspark.sql import functions as F

from qaspark.llm import fingerprints as fp
from qaspark.llm import queries

SF = SF001.replace("sf0.001", "sf0.01")


def sets(p):
    return [set(p.digest[p.of == i].tolist()) for i in range(len(p.n))]


def words(rng, n):
    return " ".join("".join(rng.choice(list("abcdefg"), 5)) for _ in range(n))


def test_peeling_recovers_exactly_the_differing_digests():
    rng = np.random.RandomState(1)
    base = [words(rng, n) for n in (0, 1, 5, 60, 400, 3000)]
    other = ["", "x", base[2], base[3] + " more words here", words(rng, 350), base[5][:9000] + words(rng, 40) + base[5][9000:]]
    a, b = fp.paragraphs_of(base), fp.paragraphs_of(other)
    for x, y in ((a, b), (b, a), (a, a)):
        pair, digest, sign = fp.differences(x, y, 3)
        want = [s ^ t for s, t in zip(sets(x), sets(y), strict=True)]
        for i, (s, t) in enumerate(zip(sets(x), sets(y), strict=True)):
            assert set(digest[(pair == i) & (sign == 1)].tolist()) == s - t
            assert set(digest[(pair == i) & (sign == -1)].tolist()) == t - s
        share = [1 - len(w) / max(1, len(s) + len(t)) for w, s, t in zip(want, sets(x), sets(y), strict=True)]
        assert fp.likeness(x, y).tolist() == share
    assert fp.likeness(a, a).tolist() == [1.0] * 6


def test_a_sketch_that_is_too_small_says_so():
    rng = np.random.RandomState(2)
    p = fp.paragraphs_of([words(rng, 500), "one"])
    s = fp.Sketch(2, 12)
    s.add(p.of, p.digest, 1)
    assert s.peel()[3].tolist() == [False, True]


def test_paragraphs_depend_on_the_text_alone():
    rng = np.random.RandomState(3)
    texts = ["", "\n", "a\n\na", "ü" * 500, words(rng, 30), "x" * 1000 + "\n" + words(rng, 9), "\0\0 a \0"]
    alone = [sets(fp.paragraphs_of([t]))[0] for t in texts]
    assert sets(fp.paragraphs_of(texts)) == alone
    assert sets(fp.paragraphs_of(texts[::-1])) == alone[::-1]
    assert [len(s) for s in alone[:3]] == [0, 2, 4 - 1]
    assert all(len(s) == n for s, n in zip(alone, fp.paragraphs_of(texts).n.tolist(), strict=True))  # repeats are numbered


def brute(rows):
    out = {}
    rows = sorted(rows)
    for k, (i, t) in enumerate(rows):
        e = fp.edit(t, rows[(k + 1) % len(rows)][1])
        out[i] = (len(t), hashlib.sha256(e.encode()).hexdigest(), e, rows[(k + 1) % len(rows)][1])
    return out


def test_query_equals_brute_force(spark):
    t = pd.read_parquet(f"{SF}/documents.parquet")
    texts = t.text.fillna("").to_list()
    want = brute(list(zip(t.doc_id, texts, strict=True)))
    got = queries.QUERIES["op13_fingerprints"](spark, SF).toPandas()
    assert sorted(got.doc_id) == sorted(t.doc_id)
    by_id = dict(zip(t.doc_id, texts, strict=True))
    for r in got.itertuples():
        n, sha, edited, following = want[r.doc_id]
        assert (r.n_chars, r.edited_sha256) == (n, sha)
        a, e, f = (sets(fp.paragraphs_of([x]))[0] for x in (by_id[r.doc_id], edited, following))
        assert abs(r.near_edited - (1 - len(a ^ e) / max(1, len(a) + len(e)))) < 1e-12
        assert abs(r.near_next - (1 - len(a ^ f) / max(1, len(a) + len(f)))) < 1e-12
    known = got.assign(t=got.doc_id.map(by_id)).groupby("t").fingerprint.nunique()
    assert known.max() == 1 and got.fingerprint.nunique() == t.text.fillna("").nunique()
    assert (got.near_edited > got.near_next).mean() > 0.95


def test_order_edges(spark, docs_of, monkeypatch):
    rows = [(5, "five five"), (1, None), (2, ""), (3, "x y z"), (3, "x y z"), (None, "nobody"), (-4, "minus"), (9, "l" * 300_000)]
    plain = {-4: "minus", 1: "", 2: "", 3: "x y z", 5: "five five", 9: "l" * 300_000, 1 << 62: "nobody"}
    want = brute(list(plain.items()))
    got = fp.compare_with_next(docs_of(rows)).collect()
    assert len(got) == 7  # a repeated row is one document
    for r in got:
        assert (r.n_chars, r.edited_sha256) == want[1 << 62 if r.doc_id is None else r.doc_id][:2]
    one = fp.compare_with_next(docs_of([(4, "abcd")])).collect()
    assert [(r.near_next, r.edited_sha256) for r in one] == [(1.0, hashlib.sha256(b"abab").hexdigest())]
    assert fp.compare_with_next(docs_of(rows).where(F.lit(False))).collect() == []


def test_one_id_with_a_third_of_all_rows(spark, docs_of):
    rows = [(i, f"text {i} " * 5) for i in range(200)] + [(77, f"other {i}") for i in range(60)] + [(150, "copied")] * 150
    held = sorted({(i, t) for i, t in rows})
    docs = docs_of(rows)
    order = [(r.ord, r.th, r.text) for r in fp.in_order(docs).where("not tail").distinct().orderBy("part", "ord", "th").collect()]
    assert [o for o, _, _ in order] == sorted(i for i, _ in held) and len(order) == len(held)
    want = {(i, hashlib.sha256(fp.edit(t, order[(k + 1) % len(order)][2]).encode()).hexdigest()) for k, (i, _, t) in enumerate(order)}
    got = [(r.doc_id, r.edited_sha256) for r in fp.compare_with_next(docs).collect()]
    assert len(got) == len(held) and set(got) == want


def test_operators_keep_the_columns(spark, docs_of):
    docs = docs_of([(1, "a b c"), (2, None)]).withColumn("fingerprint", F.lit(3)).withColumn("other", F.lit("a b c"))
    out = {r.doc_id: r for r in fp.fingerprint(docs).collect()}
    assert out[1].source == "src0" or out[1].source is None
    assert out[1].fingerprint != out[2].fingerprint
    both = {r.doc_id: r for r in fp.compare(docs, "text", "other").collect()}
    assert (both[1].likeness, both[1].only_left, both[2].likeness, both[2].only_left) == (1.0, [], 0.0, [])
    assert len(both[2].only_right) >= 1
