import os
import subprocess
import sys

import pytest
from conftest import SF001

import qaspark
from qaspark import session

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(qaspark.__file__)))


def test_workers_find_the_package_from_another_folder(tmp_path):
    code = f"""
import sys
sys.path.insert(0, {ROOT!r})
from qaspark import get_spark
import __spark_entry__ as e
spark = get_spark(master="local[2]", driver_memory="2g")
q = e.queries()
for name in ("gram_qa", "cca_scores", "project_concat", "holographic_features"):
    assert q[name](spark, {SF001!r}).count() > 0, name
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=env, timeout=300)


def test_work_dir_is_stable_and_never_local_on_a_cluster(spark, monkeypatch):
    assert session.work_dir(spark) == session.work_dir(spark)
    assert session.scratch_path(spark, "x").startswith(session.work_dir(spark))
    monkeypatch.setattr(session, "is_local", lambda s: False)

    class Bare:  # a session that names no shared folder
        conf = type("C", (), {"get": staticmethod(lambda k, d=None: d)})
        sparkContext = type("S", (), {"getCheckpointDir": staticmethod(lambda: None)})

    with pytest.raises(RuntimeError):
        session.work_dir(Bare)


def test_shuffle_files_go_when_a_table_is_written(spark, tmp_path):
    from pyspark.sql import functions as F

    from qaspark import session

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    seen = []

    class Watched:
        """``write`` sees the setting while it runs only."""
        sparkSession = spark

        @property
        def write(self):
            seen.append(spark.conf.get(key))
            return spark.range(9).groupBy((F.col("id") % 2).alias("k")).count().write

    session.write(Watched(), f"{tmp_path}/t")
    assert seen == ["true"] and spark.conf.get(key) == before and spark.read.parquet(f"{tmp_path}/t").count() == 2


def test_temporary_folders_go_at_the_end(spark, tmp_path, monkeypatch):
    import os

    from qaspark import session

    monkeypatch.setattr(session, "work_dir", lambda _: str(tmp_path))
    kept = session.materialize(spark.range(3), "kept")
    try:
        with session.temporary(spark):
            session.materialize(spark.range(3), "outer")
            with session.temporary(spark):
                session.materialize(spark.range(3), "inner")
            assert sorted(x.rpartition("-")[0] for x in os.listdir(tmp_path)) == ["kept", "outer"]
            raise KeyError
    except KeyError:
        pass
    assert [x.rpartition("-")[0] for x in os.listdir(tmp_path)] == ["kept"] and kept.count() == 3
