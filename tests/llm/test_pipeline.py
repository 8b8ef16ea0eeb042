import os
import random
import subprocess
import sys

import corpus_pipeline
import pandas as pd
from test_duplicates import all_links, classes, slow_dedup
from test_quality_lines import dedup, measures

from qaspark.llm import queries


def test_pipeline_against_brute_force(spark, tmp_path):
    rng = random.Random(12)
    words = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 9))) for _ in range(n))
    passage, footer = words(90), "All rights reserved by the authors"
    texts = {i: "\n".join([words(rng.randint(20, 60)), words(40), footer]) for i in range(40)}
    texts |= {50 + i: texts[i] + "\n" + words(3) for i in range(6)}  # near copies
    texts |= {60 + i: words(60) + " " + passage + " " + words(50) for i in range(5)}
    texts |= {200 + i: texts[2] for i in range(1000)}  # copies that line dedup empties
    texts |= {70: None, 71: "", 72: "few words", 73: "again and " * 80, 74: texts[1]}
    frame = pd.DataFrame({"doc_id": list(texts), "text": list(texts.values()), "lang": "en",
                          "source": [f"s{i % 3}" for i in range(len(texts))], "n_chars": [len(t or "") for t in texts.values()]})
    frame.to_parquet(tmp_path / "documents.parquet")

    kept = {i: t for i, t in texts.items() if (m := measures(t))[0] >= 50 and 100 * m[4] <= 50 * m[0]}
    kept = {o: t for o, _, _, t in dedup(list(kept.items()))}
    own = classes(kept, *all_links(kept))
    kept = {i: t for i, t in kept.items() if own[i] == i}
    rows = sorted(kept.items())
    cut = slow_dedup(rows)
    kept = {rows[k][0]: cut[k][0] for k in cut}

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == list(frame.columns), name
        docs = corpus_pipeline.materialize(docs, "test")
    assert {r.doc_id: r.text for r in docs.collect()} == kept
    assert all(r.n_chars == len(r.text) for r in docs.collect())

    out = queries.QUERIES["pipeline"](spark, str(tmp_path)).toPandas()
    assert set(out.doc_id) == set(kept)
    assert all(g.sort_values("offset").offset.tolist() == [0, *g.sort_values("offset").length.cumsum().tolist()[:-1]] for _, g in out.groupby("sequence_id"))


def test_the_rest_works_without_this_package(tmp_path):
    root = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    for name in os.listdir(root):
        if name not in ("qaspark", "corpus_pipeline.py", ".git"):
            os.symlink(os.path.join(root, name), tmp_path / name)
    os.mkdir(tmp_path / "qaspark")
    for name in os.listdir(os.path.join(root, "qaspark")):
        if name not in ("llm", "__pycache__"):
            os.symlink(os.path.join(root, "qaspark", name), tmp_path / "qaspark" / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 60 and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    # From a copy: a symbolic link would lead Python back to the whole tree.
    (tmp_path / "__spark_entry__.py").unlink()
    (tmp_path / "__spark_entry__.py").write_text(open(os.path.join(root, "__spark_entry__.py")).read())
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})


def test_queries_are_registered():
    names = set(queries.QUERIES)
    assert {n.split("_")[0] for n in names} == {f"op{i}" for i in range(1, 14)} | {"pipeline"}
    assert set(queries.ORACLES) <= names
