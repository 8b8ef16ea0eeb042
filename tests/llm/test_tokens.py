import base64
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from llm_fixtures import docs_of  # noqa: F401
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from qaspark.llm import bpe, packing

ODD = [None, "", " ", "\n\n\n", "a" * 5000, "é漢字🙂 x", "don't  stop\t\n 12345 ...!!", "\x1c\x1d a\x85b　c", "<|endoftext|>", "क़ख़, İ.", "ab " * 9000]


def texts(n=300):
    rng = random.Random(4)
    pool = "abcdefghiABC äßéñ 0123'!#\n\t漢字🙂"
    return ODD + ["".join(rng.choice(pool) for _ in range(rng.randint(0, 200))) for _ in range(n)]


@pytest.mark.parametrize("name", ["byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken"])
def test_coder_equals_the_library(name):
    path = P.path(name)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    ref = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own = bpe.coder(path, P.PATTERN)
    for t in texts():
        ids = own.encode(t or "")
        assert ids == ref.encode_ordinary(t or "")
        assert own.decode(ids) == (t or "").encode()


def test_documents_round_trip(spark, docs_of):
    rows = [(i if i % 7 else None, t) for i, t in enumerate(texts(40))] + [(1, "again"), (1, "again")]
    docs = docs_of(rows).withColumn("ids", F.lit("clash"))
    out = bpe.decode_documents(bpe.encode_documents(docs)).collect()
    assert len(out) == len(rows)
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in out)
    digest = bpe.token_digests(docs).collect()
    assert sorted(r.n_tokens for r in digest) == sorted(len(r.ids) for r in out)
    assert bpe.token_digests(docs.where(F.lit(False))).count() == 0


def test_words_equal_the_library():
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    tok.encode_special_tokens = True
    given = [t or "" for t in texts()] + ["a" + chr(c) + "b, " + chr(c) + "." for c in range(0x80, 0x3000)]
    both = [packing.word_coder(P.path("word_bpe_49k.json"), c).encode(given) for c in (False, True)]
    assert both[0] == both[1]
    for t, raw in zip(given, both[0], strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids


def check_packing(rows, docs, capacity):
    by_piece, seqs = {}, {}
    for r in rows:
        assert 0 < r.length <= capacity and (r.length == capacity or r.piece >= 0)
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_piece.setdefault(r.doc_id, []).append((r.piece, r.start, r.length))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(seqs), sum(r.length for r in rows)


def test_packing_ids_places_and_sequences(spark, docs_of):
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    tok.encode_special_tokens = True
    given = texts(200)
    out = packing.pack_documents(docs_of(list(enumerate(given))), capacity=64, with_ids=True, group_items=40).collect()
    check_packing(out, given, 64)
    for i, t in enumerate(given):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        parts = sorted((r.piece, r.start, bytes(r.ids), r.ids_crc32) for r in out if r.doc_id == i)
        want = [np.array(ids[a:a + 64], "<u4").tobytes() for a in range(0, len(ids), 64)]
        assert [(n, 64 * n, w, zlib.crc32(w)) for n, w in enumerate(want)] == parts


def test_few_sequences_and_groups_cost_little(spark):
    rng = np.random.RandomState(1)
    n = np.minimum(4095, 1 + rng.lognormal(6.3, 1.0, 3000)).astype(int)
    cut = spark.createDataFrame([(i, i, 0, 0, int(x), 0) for i, x in enumerate(n)],
                                "doc_id long, uid long, piece int, start long, length long, ids_crc32 long").repartition(3)
    for group in (10_000, 300):
        used, tokens = check_packing(packing.pack_pieces(cut, group_items=group).collect(), None, 4096)
        assert used <= 1.02 * tokens / 4096 + 1
    assert packing.pack_pieces(cut.where(F.lit(False))).count() == 0


def test_sum_of_squares_takes_the_smallest_sum():
    lengths = np.array([5, 3, 6, 2, 7, 3, 4, 1, 1, 9, 10])
    seq, off = packing.sum_of_squares(lengths, 10)
    gaps, order = {}, sorted(range(len(lengths)), key=lambda i: -lengths[i])
    square = lambda g: sum(list(g.values()).count(x) ** 2 for x in set(g.values()) if 0 < x < 10)
    for i in order:
        if off[i] == 0:
            assert seq[i] not in gaps
        else:
            assert gaps[seq[i]] == 10 - off[i]
        options = [square(gaps | {b: g - lengths[i]}) for b, g in gaps.items() if g >= lengths[i]] + [square(gaps | {-1: 10 - lengths[i]})]
        gaps[seq[i]] = gaps.get(seq[i], 10) - lengths[i]
        assert square(gaps) == min(options)
