import pytest


@pytest.fixture
def docs(spark):
    """Builds documents (doc_id, text, source) with two more columns of clashing names."""

    def make(rows):
        rows = [(i, t, s, "x", 1) for i, t, s in ((*r, "s")[:3] for r in rows)]
        return spark.createDataFrame(rows, "doc_id long, text string, source string, id string, n long")

    return make


@pytest.fixture
def scratch(spark):
    from logbrook.llm.scratch import Scratch

    return Scratch(spark, "test")
