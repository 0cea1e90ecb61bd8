import pytest

from flowloom.llm import queries

DOC = "doc_id long, text string, lang string, source string, n_chars long, score string, tk string, spans string"


@pytest.fixture(autouse=True)
def reached(spark):
    queries.reach(spark)


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text) with further columns whose names the operators use themselves."""

    def build(*rows, source=lambda i: f"s{i % 3}"):
        return spark.createDataFrame(
            [(d, t, "en", source(i), len(t or ""), "own", "own", "own") for i, (d, t) in enumerate(rows)], DOC)

    return build


def words(n, seed):
    return [f"w{(i * 7919 + seed * 104729) % 9973}" for i in range(n)]
