import random
import re
import string

from llm_fixtures import docs_of  # noqa: F401
from pyspark.sql import functions as F

from qaspark.llm import line_dedup, quality_rules

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SPACE = " \t\n\x0b\x0c\r"


def texts_with_edges(rng, n=60):
    vocab = ["the", "Of", "naïve", "x#y", "$$$", "漢字", "a", "long-ish", "ÀB"]
    out = []
    for _ in range(n):
        lines = [" ".join(rng.choice(vocab) for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(0, 9))]
        lines += [rng.choice(["Common Footer Line", " common footer line\t", "", "\x0b"]) for _ in range(rng.randint(0, 2))]
        out.append("\n".join(lines))
    return out + [None, "", "\n\n", " ", "a b c a b c a b c", "w " * 20000, "z\n" * 3000, out[0], "ÀÉ LINE of text", "àé line of text"]


def measures(t):
    t = t or ""
    w = WORDS.findall(t)
    grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    many = {g for g in set(grams) if grams.count(g) > 1} if len(grams) < 2000 else set(grams)
    at = {i + k for i, g in enumerate(grams) if g in many for k in range(3)}
    full = [x for x in t.split("\n") if WORDS.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(full) - len(set(full)), len(at), len(full))


def test_measures_against_brute_force(spark, docs_of):
    texts = texts_with_edges(random.Random(2))
    got = {r.doc_id: r for r in quality_rules.measure(docs_of(list(enumerate(texts))), keep=("doc_id",)).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.n_lines) == measures(t), i


def test_host_verdict_spares_documents_that_pass_every_rule(spark):
    good = " ".join(f"word{i}" for i in range(60))
    noisy = " ".join(f"w{i}#" for i in range(60))
    rows = [(i, good, "clean.org") for i in range(40)] + [(100 + i, noisy, "bad.org") for i in range(40)]
    rows += [(200, good, "bad.org"), (201, noisy, "clean.org"), (202, noisy, None), (203, "few words", "clean.org"), (None, good, "clean.org")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r.doc_id: r.kept for r in quality_rules.judge(docs).collect()}
    assert kept[0] and kept[200] and kept[201] and kept[202] and kept[None]
    assert not kept[100] and not kept[203]
    before = quality_rules.BROADCAST_HOSTS
    quality_rules.BROADCAST_HOSTS = -1  # the salted join gives the same
    try:
        assert {r.doc_id: r.kept for r in quality_rules.judge(docs).collect()} == kept
    finally:
        quality_rules.BROADCAST_HOSTS = before
    assert quality_rules.judge(docs.where(F.lit(False))).count() == 0


def test_rates_shrink_towards_the_mean(spark):
    rows = [(f"h{k}", 60, 300, 0, 0, 60 if k % 2 and i < 9 else 0, 1) for k in range(20) for i in range(10)] + [("one", 60, 300, 0, 0, 60, 1)]
    m = spark.createDataFrame(rows, "source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long")
    r = {x.source: x.rate_base for x in quality_rules.host_rates(m, "source").collect()}
    assert 0 < r["h0"] < 0.45 < r["h1"] < 0.9 and r["one"] < 1


def key(line):
    return line.strip(SPACE).translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))


def dedup(rows, min_chars=10):
    first = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            k = key(x)
            first[k] = min(first.get(k, 1 << 63), (1 << 63) - 1 if i is None else i)
    out = []
    for i, t in rows:
        o = (1 << 63) - 1 if i is None else i
        lines = (t or "").split("\n")
        keep = [x for x in lines if len(key(x)) < min_chars or o <= first[key(x)]]
        out.append((o, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return sorted(out)


def test_line_dedup_against_brute_force(spark, docs_of):
    texts = texts_with_edges(random.Random(3))
    rows = list(enumerate(texts)) + [(3, texts[3]), (3, "another text\nof the same id"), (None, texts[4]), (None, None)]
    for n_batches, fanout in ((1, 2), (5, 2)):
        out = line_dedup.dedup_lines(docs_of(rows), n_batches=n_batches, fanout=fanout)
        got = sorted(((1 << 63) - 1 if r.doc_id is None else r.doc_id, r.n_lines, r.n_dropped, r.text) for r in out.collect())
        assert got == dedup(rows)
        assert {"lang", "source", "ord"} <= set(out.columns)


def test_runs_are_compacted_and_an_empty_table_passes(spark, docs_of):
    runs = line_dedup.LineRuns(spark, fanout=2, buckets=3)
    for b in range(5):
        text = "\n".join(f"line number {i} of all" for i in range(b * 10, b * 10 + 15))
        runs.add(line_dedup.line_occurrences(docs_of([(b, text)])))
    assert [len(x) for x in runs.levels] == [1, 0, 1]  # 5 = 4 + 1
    keys = runs.all()
    assert keys.count() == keys.select("h1", "h2").distinct().count() == 55
    assert line_dedup.dedup_lines(docs_of([]).where(F.lit(False))).count() == 0
