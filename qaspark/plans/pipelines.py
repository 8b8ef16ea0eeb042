"""End-to-end plans: featurize -> (CCA) -> score -> rank -> evaluate, and the
experiment sweep over embeddings and CCA stages.

The fixture task: every user turn of a conversation is a question; its
candidate answers are the assistant turn that follows it (correct) and the
assistant turns two turns before and after (incorrect) - explicit equi-joins,
never all pairs of a conversation.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qaspark.functions import text as T
from qaspark.functions.vector import cosine_distance
from qaspark.operators import cca as CCA
from qaspark.operators import coverage as C
from qaspark.operators import evaluate as E
from qaspark.operators import features as FT
from qaspark.operators import generate as G
from qaspark.operators import neighbors as NB
from qaspark.operators import vectors as VEC
from qaspark.operators import vocab as VO
from qaspark.session import materialize
from qaspark.sources import fixtures as X

FEATURES = FT.KINDS
CANDIDATE_OFFSETS = (0, -2, 2)


def embedding(spark: SparkSession, d: str, name: str) -> DataFrame:
    """Word-vector tables of the sweep: the fixture vectors, the two models,
    and the main model expanded through the other one."""
    if name == "vectors":
        return X.word_vectors(spark, d)
    if name == "main":
        return X.model_main(spark, d)
    if name == "other":
        return X.model_other(spark, d)
    if name == "expanded":
        lab = X.clustered(spark, d).select("token", "label")
        e = NB.expand_vocabulary(X.clustered(spark, d).select("token"), X.model_main(spark, d),
                                 X.model_other(spark, d), lab)
        return e.select("token", "vec")
    raise ValueError(name)


def unknown_of(spark: SparkSession, d: str, vectors: DataFrame) -> list[float]:
    counts = X.corpus_token_counts(spark, d)
    return VEC.unknown_values(counts, vectors, VEC.width(vectors))


def sentences(spark: SparkSession, d: str) -> DataFrame:
    """Every conversation turn once: ``(conv_id, turn, role, tokens)``."""
    conv = X._turns(spark, d)
    return conv.select("conv_id", "turn", "role",
                       F.when(F.col("role") == "assistant", T.answer_tokens("text"))
                       .otherwise(T.split_ws("text")).alias("tokens"))


def token_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Tokenised QA pairs ``(row_id, q, a)`` of the n-gram features."""
    return X.qa_pairs(spark, d).select(X.line_key(F.col("conv_id"), F.col("turn")).alias("row_id"),
                                       T.split_ws(T.tokenize("q")).alias("q"), T.answer_tokens(T.tokenize("a")).alias("a"))


def pair_vocab(spark: SparkSession, d: str, kind: str) -> DataFrame:
    """The n-gram vocabulary ``(side, token, idx)`` of the QA pairs, kept as an artifact."""
    def build(s, dd):
        grams = G.with_ngrams(token_pairs(s, dd), "q", FT.NGRAM_KINDS[kind])
        return VO.build_vocab(VO.side_tokens(grams, {"q": "q", "a": "a"}))

    return X.artifact(spark, d, f"pair-vocab-{kind}", build)


def featurize(spark: SparkSession, d: str, kind: str, vectors: DataFrame | None = None,
              unknown: Sequence[float] | None = None) -> DataFrame:
    """Feature dispatcher over the QA pairs: n-gram kinds give sparse long
    form ``(row_id, side, idx, cnt)``; ``avg`` / ``holographic`` give
    ``(conv_id, turn, qv, av)``."""
    pairs = X.qa_pairs(spark, d)
    if kind in FT.NGRAM_KINDS:
        return FT.featurize(token_pairs(spark, d), kind, {"q": "q", "a": "a"}, vocab=pair_vocab(spark, d, kind))
    vectors = vectors if vectors is not None else X.word_vectors(spark, d)
    unknown = unknown if unknown is not None else unknown_of(spark, d, vectors)
    s = pairs.select(F.struct("conv_id", "turn").alias("row_id"), T.split_ws("q").alias("q"), T.answer_tokens("a").alias("a"))
    v = FT.featurize(s, kind, {"q": "q", "a": "a"}, vectors=vectors, unknown=unknown)
    return VEC.pivot_sides(v.select("row_id.*", "side", "vec"), ["conv_id", "turn"], {"qv": "q", "av": "a"})


def turn_vectors(spark: SparkSession, d: str, vectors: DataFrame, unknown: Sequence[float]) -> DataFrame:
    """Mean vector of every turn, computed once (then joined to candidates)."""
    return VEC.sentence_vectors(sentences(spark, d), ["conv_id", "turn"], "tokens", vectors, unknown)


def candidates(spark: SparkSession, d: str) -> DataFrame:
    """``(conv_id, turn, aturn, label)``: question turn, candidate answer turn."""
    p = X.qa_pairs(spark, d).select("conv_id", "turn")
    ans = X._turns(spark, d).filter(F.col("role") == "assistant").select("conv_id", F.col("turn").alias("aturn"))
    out = None
    for off in CANDIDATE_OFFSETS:
        c = p.select("conv_id", "turn", (F.col("turn") + 1 + off).alias("aturn"),
                     F.lit(1 if off == 0 else 0).alias("label"))
        c = c.join(ans, ["conv_id", "aturn"])
        out = c if out is None else out.unionByName(c)
    return out


def score_candidates(spark: SparkSession, d: str, vectors: DataFrame, unknown: Sequence[float],
                     model: CCA.CCAModel | None = None, para: CCA.CCAModel | None = None,
                     turns: DataFrame | None = None) -> DataFrame:
    """Predictions ``(line_no, q, answer, dist)`` and labels for every candidate.
    Each turn is projected once, before the candidate join."""
    tv = turns if turns is not None else turn_vectors(spark, d, vectors, unknown)
    if model is not None:
        qm = model.q if para is None else np.hstack([para.q, para.a]) @ model.q
        qv = CCA.project(tv, "vec", [qm], "pv").select("conv_id", "turn", F.col("pv").alias("qv"))
        av = CCA.project(tv, "vec", [model.a], "pv").select("conv_id", F.col("turn").alias("aturn"),
                                                             F.col("pv").alias("av"))
    else:
        qv = tv.select("conv_id", "turn", F.col("vec").alias("qv"))
        av = tv.select("conv_id", F.col("turn").alias("aturn"), F.col("vec").alias("av"))
    c = X.artifact(spark, d, "candidates", candidates).join(qv, ["conv_id", "turn"]).join(av, ["conv_id", "aturn"])
    return c.select(
        X.line_key(F.col("conv_id"), F.col("turn"), F.col("aturn")).alias("line_no"),
        X.line_key(F.col("conv_id"), F.col("turn")).alias("q"),
        X.line_key(F.col("conv_id"), F.col("aturn")).alias("answer"),
        F.coalesce(cosine_distance("qv", "av"), F.lit(2.0)).alias("dist"), "label")


def evaluate_config(spark: SparkSession, d: str, emb: str = "vectors", stage: int = 0,
                    direction: str = "asc", prepared: dict | None = None) -> DataFrame:
    """Statistics record for one embedding and CCA stage (0, 1 or 2).
    ``prepared`` (from :func:`prepare`) shares per-embedding work between stages."""
    p = prepared or prepare(spark, d, emb, stages=(stage,))
    vectors, unknown = p["vectors"], p["unknown"]
    model = para = None
    if stage >= 1:
        g = p["grams"] if "grams" in p else CCA.gram_sums(p["features"], "qv", "av", full_qq=stage == 2)
        if not g["n"]:
            raise ValueError("no pairs to train on")
        if stage == 2:
            para = p["para"]
            model = CCA.two_stage_from_grams(g, para)
        else:
            model = CCA.fit_from_grams(g["qa"], np.diagonal(g["qq"]) if len(g["qq"]) > 1 else g["qq"][0], g["aa"][0], g["n"])
    # Written once: predictions, labels and questions are read from it several times each.
    sc = materialize(score_candidates(spark, d, vectors, unknown, model, para, turns=p.get("turns")), "scored")
    preds = sc.select("line_no", "q", "answer", "dist")
    labels = sc.select("q", "answer", "label")
    qs = sc.select("q").distinct()
    questions = qs.select(F.col("q").alias("pos"), "q")
    st = E.stats(preds, labels, questions, direction)
    return st.select(F.lit(emb).alias("embedding"), F.lit(stage).alias("stage"), "*")


def prepare(spark: SparkSession, d: str, emb: str, stages=(1, 2)) -> dict:
    """Per-embedding inputs shared by every stage: vector table (written once),
    UNKNOWN vector, QA features, turn vectors, and the paraphrase model."""
    vectors = materialize(embedding(spark, d, emb), f"emb-{emb}")
    unknown = unknown_of(spark, d, vectors)
    out = {"vectors": vectors, "unknown": unknown,
           "turns": materialize(turn_vectors(spark, d, vectors, unknown), f"turns-{emb}")}
    if any(st >= 1 for st in stages):
        out["features"] = materialize(featurize(spark, d, "avg", vectors, unknown), f"feat-{emb}")
    if 2 in stages:
        out["para"] = CCA.fit(materialize(paraphrase_features(spark, d, vectors, unknown), f"para-{emb}"), "qv", "av")
    return out


def paraphrase_features(spark: SparkSession, d: str, vectors: DataFrame, unknown: Sequence[float]) -> DataFrame:
    p = X.paraphrase_pairs(spark, d)
    p = p.select("conv_id", "turn", T.split_ws(T.no_symbol("q1")).alias("t1"), T.split_ws(T.no_symbol("q2")).alias("t2"))
    s = VEC.long_sides(p, ["conv_id", "turn"], {1: "t1", 2: "t2"})
    v = VEC.sentence_vectors(s, ["conv_id", "turn", "side"], "tokens", vectors, unknown)
    return VEC.pivot_sides(v, ["conv_id", "turn"], {"qv": 1, "av": 2})


def training_pairs(spark: SparkSession, d: str, dataset: str) -> DataFrame | None:
    """Keys of the pairs a data set trains on: ``full`` (None, all pairs) or
    ``filtered`` (pairs that pass the coverage filter)."""
    if dataset == "full":
        return None
    if dataset != "filtered":
        raise ValueError(f"unknown data set {dataset}")
    pairs = (X.qa_pairs(spark, d).withColumn("qt", T.split_ws(F.lower("q")))
             .withColumn("at", T.answer_tokens(F.lower("a"))))
    return C.filter_covered(pairs, ["conv_id", "turn"], ["qt", "at"], X.covered_tokens(spark, d)).select("conv_id", "turn")


def sweep(spark: SparkSession, d: str, embeddings: Sequence[str] = ("main", "other", "expanded"),
          stages: Sequence[int] = (1, 2), datasets: Sequence[str] = ("full", "filtered")) -> DataFrame:
    """The experiment grid: statistics rows for every (data set, embedding,
    stage). The candidates and the keys of the data sets are written once; the vectors, turns and paraphrase
    model of an embedding are shared, and one scan of its features gives the Gram sums of all data sets, from
    which every model is solved. Each configuration scores its candidates once."""
    out = None
    kept = {ds: training_pairs(spark, d, ds) for ds in datasets}
    keys = {ds: pairs if pairs is None else materialize(pairs, f"pairs-{ds}") for ds, pairs in kept.items()}
    for emb in embeddings:
        prepared = prepare(spark, d, emb, stages)
        grams = dataset_grams(prepared["features"], keys) if any(st >= 1 for st in stages) else {}
        for ds in datasets:
            own = prepared | ({"grams": grams[ds]} if grams else {})
            for st in stages:
                r = evaluate_config(spark, d, emb, st, prepared=own).withColumn("dataset", F.lit(ds))
                out = r if out is None else out.unionByName(r)
    return out


def dataset_grams(features: DataFrame, keys: dict[str, DataFrame | None]) -> dict[str, dict]:
    """Gram sums of the pairs of each data set (None: all), in one pass over the features."""
    written = features
    for ds, kept in keys.items():
        if kept is None:
            features = features.withColumn(f"in_{ds}", F.lit(True))
        else:
            features = (features.join(kept.select("conv_id", "turn", F.lit(True).alias(f"in_{ds}")).distinct(), ["conv_id", "turn"], "left")
                        .withColumn(f"in_{ds}", F.coalesce(f"in_{ds}", F.lit(False))))
    sums = CCA.gram_sums_by(features, "qv", "av", [f"in_{ds}" for ds in keys], full_qq=True, sized=written)
    return {ds: sums[f"in_{ds}"] for ds in keys}
