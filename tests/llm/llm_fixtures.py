"""Imported by the tests of this folder."""

import pytest

SF001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents-like frame of (doc_id, text) rows; extra columns clash on purpose."""
    def make(rows, parts: int = 3):
        data = [(i, t, "en", f"src{k % 3}" if k % 5 else None, 1, 7) for k, (i, t) in enumerate(rows)]
        frame = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_lines int, ord int")
        return frame.repartition(parts)
    return make
