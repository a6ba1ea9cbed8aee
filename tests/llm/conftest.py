import pytest
from odd_rows import CLASHING, ODD_ROWS


@pytest.fixture(scope="session")
def odd_docs(spark):
    rows = [(i, t, "en", "s", None if t is None else len(t), *["clash"] * len(CLASHING)) for i, t in ODD_ROWS]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)
    return spark.createDataFrame(rows, schema).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def docs_of(spark):
    def make(rows):
        return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")

    return make
