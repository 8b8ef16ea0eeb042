import random
import re

import pandas as pd
from llm_fixtures import SF001, docs_of  # noqa: F401
from pyspark.sql import functions as F

from qaspark.llm import components, ngram_join, queries, substring_dedup

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(t, n=5):
    w = WORDS.findall(t or "")
    return frozenset(tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def all_links(texts, threshold=0.8):
    """Sets, and the pairs of different sets within the threshold."""
    sets = {i: shingles(t) for i, t in texts.items()}
    kinds = sorted(set(sets.values()), key=len)
    links = set()
    for a, x in enumerate(kinds):
        for y in kinds[a + 1:]:
            if x and len(x) >= threshold * len(y):
                both = len(x & y)
                if both >= threshold * (len(x) + len(y) - both) - 1e-9:
                    links.add((x, y))
    return sets, links


def classes(texts, sets, links):
    up = {s: s for s in sets.values()}

    def find(s):
        while up[s] != s:
            s = up[s]
        return s

    for x, y in links:
        up[find(x)] = find(y)
    first = {}
    for i in sorted(texts):
        first.setdefault(find(sets[i]), i)
    return {i: first[find(sets[i])] for i in texts}


def check_join(texts, got):
    sets, links = all_links(texts)
    count = {}
    for x, y in links:
        count[x] = count.get(x, 0) + 1
        count[y] = count.get(y, 0) + 1
    own = classes(texts, sets, links)
    for i in texts:
        r = got[i]
        assert r.class_id == own[i], i
        assert r.n_links == count.get(sets[i], 0), i
        assert r.n_copies == sum(s == sets[i] for s in sets.values())


def test_join_against_all_pairs_on_documents(spark):
    texts = pd.read_parquet(f"{SF001.replace('0.001', '0.01')}/documents.parquet").set_index("doc_id").text.to_dict()
    got = {r.doc_id: r for r in queries.QUERIES["op6_ngram_jaccard"](spark, SF001.replace("0.001", "0.01")).collect()}
    check_join(texts, got)


def test_join_of_a_large_group_in_blocks(spark, docs_of):
    rng = random.Random(6)
    base = [f"w{rng.randint(0, 5000)}" for _ in range(150)]
    texts = {}
    for i in range(90):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = f"n{rng.randint(0, 99)}"
        texts[i] = " ".join(w)
    texts |= {100: None, 101: "", 102: " \t ", 103: "one two", 104: "two one", 105: "one two", 106: "x " * 30_000, 107: "x " * 29_999}
    before = ngram_join.BLOCK_NODES
    ngram_join.BLOCK_NODES = 16
    try:
        out = ngram_join.near_duplicates(docs_of(list(texts.items()))).collect()
    finally:
        ngram_join.BLOCK_NODES = before
    check_join(texts, {r.ord: r for r in out})


def test_one_document_of_each_class_stays(spark, docs_of):
    base = " ".join(f"word{i}" for i in range(80))
    rows = [(5, base), (3, base), (9, base + " tail"), (1, "other text of some words here"), (None, base), (7, None), (8, None), (3, base)]
    out = ngram_join.drop_near_duplicates(docs_of(rows).withColumn("node", F.lit("x"))).collect()
    assert sorted(r.doc_id for r in out) == [1, 3, 7]  # wordless texts are copies; a repeated row is one document
    bare = [(None, base), (None, base + " tail"), (None, "tail " + base), (None, None), (None, "")] + [(i, "") for i in range(50)]
    out = ngram_join.drop_near_duplicates(docs_of(bare)).collect()
    assert sorted((r.text or "")[:5] for r in out) == ["", (out[0].text or out[1].text)[:5]] and len(out) == 2
    assert ngram_join.drop_near_duplicates(docs_of([]).where(F.lit(False))).count() == 0


def test_bands_reach_the_recall():
    bands, rows = ngram_join.choose_bands(0.8, 0.9999)
    assert 1 - (1 - 0.8 ** rows) ** bands >= 0.9999 and bands * rows <= 200


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(60)] + [(rng.randint(100, 200), rng.randint(100, 200)) for _ in range(60)] + [(300, 300 + i) for i in range(1, 50)]
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in edges for x in (a, b) if a != b}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def slow_chunks(raw):
    """Ends of the chunks of one text, byte by byte."""
    h, out, last_hit, start, hits = 0, [], -100, 0, []
    for i, b in enumerate(raw):
        h = ((h << 1) + int(substring_dedup._GEAR[b])) & 0xFFFF
        hits.append(h < (1 << 16) // substring_dedup.MEAN_CHUNK)
    for i in range(len(raw)):
        small = hits[i] and not any(hits[max(0, i - substring_dedup.MIN_CHUNK + 1):i])
        if i + 1 == len(raw) or small and raw[i + 1] & 0xC0 != 0x80:
            for e in range(start + substring_dedup.MAX_CHUNK, i + 1, substring_dedup.MAX_CHUNK):
                while e < i + 1 and raw[e] & 0xC0 == 0x80:
                    e += 1
                out.append(e)
            out.append(i + 1)
            start = i + 1
    return sorted(set(out))


def slow_dedup(rows, min_run=96):
    """Runs of chunks, as few as reach ``min_run`` bytes, go where an earlier place holds them."""
    seen, out = set(), {}
    order = sorted(range(len(rows)), key=lambda k: (1 << 63) - 1 if rows[k][0] is None else rows[k][0])
    for k in order:
        raw = (rows[k][1] or "").encode()
        gone = bytearray(len(raw))
        ends = slow_chunks(raw)
        for a in [0, *ends[:-1]]:
            e = next((e for e in ends if e - a >= min_run), None)
            if e is None:
                continue
            if raw[a:e] in seen:
                gone[a:e] = b"\1" * (e - a)
            seen.add(raw[a:e])
        spans = sum(x and not (i and gone[i - 1]) for i, x in enumerate(gone))
        out[k] = (bytes(b for b, x in zip(raw, gone, strict=True) if not x).decode(), len(raw), spans)
    return out


def test_substrings_against_brute_force(spark, docs_of):
    rng = random.Random(8)
    words = lambda n: " ".join("".join(rng.choice("abcdefgé漢") for _ in range(rng.randint(2, 9))) for _ in range(n))
    passages = [words(70) for _ in range(4)]
    rows = [(i, words(rng.randint(0, 80)) + " " + rng.choice(passages) + " " + words(rng.randint(0, 60))) for i in range(30)]
    rows += [(40, None), (41, ""), (42, "é"), (43, "a" * 5000), (44, "漢" * 3000), (45, rows[0][1]), (None, rows[1][1]), (46, passages[0] * 3)]
    got = {r.doc_id: r for r in substring_dedup.dedup_substrings(docs_of(rows).withColumn("n_bytes", F.lit("x"))).collect()}
    want = slow_dedup(rows)
    for k, (i, _) in enumerate(rows):
        text, n, spans = want[k]
        assert (got[i].text, got[i].n_bytes, got[i].n_spans) == (text, n, spans), i
        assert got[i].n_removed == n - len(text.encode())
    for p in passages:  # no passage is left whole twice
        assert sum(p in r.text for r in got.values() if r.doc_id != 46) <= 1
    assert substring_dedup.dedup_substrings(docs_of([]).where(F.lit(False))).count() == 0


def test_what_goes_is_repeated_as_a_whole(spark, docs_of):
    """Chunks that other documents hold, in another order, are no reason to cut."""
    rng = random.Random(10)
    words = lambda n: " ".join("".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(3, 8))) for _ in range(n))
    phrases = [words(9) for _ in range(12)]
    rows = [(i, p) for i, p in enumerate(phrases)]  # every phrase alone, under 96 bytes
    rows += [(100 + i, " ".join(rng.sample(phrases, 12))) for i in range(8)]
    passage = words(60)
    rows += [(200, words(30) + " " + passage), (201, words(20) + " " + passage + " " + words(20)), (None, passage + "!"), (None, passage + "?")]
    out = substring_dedup.dedup_substrings(docs_of(rows)).collect()
    texts, text_of = sorted((r.text for r in out), key=len), dict(rows)
    seen = ""
    for r in sorted((r for r in out if r.doc_id is not None), key=lambda r: r.doc_id):
        raw, kept = text_of[r.doc_id], r.text
        if r.n_removed:  # cut out in one piece that an earlier text holds
            assert r.n_spans > 1 or any(raw[:a] + raw[a + r.n_removed:] == kept and raw[a:a + r.n_removed] in seen for a in range(len(raw)))
        seen += raw + "\n"
    assert all(r.n_removed == 0 for r in out if r.doc_id is not None and r.doc_id < 100)
    assert sum(passage in t for t in texts) == 1


def test_chunks_resist_insertions():
    rng = random.Random(9)
    raw = bytes(rng.choice(b"abcdefgh ") for _ in range(20_000))
    cut = lambda x: {x[a:b] for a, b in zip([0, *slow_chunks(x)], slow_chunks(x), strict=False)}
    a, b = cut(raw), cut(raw[:7000] + b"inserted" + raw[7000:])
    assert len(a & b) >= len(a) - 3
