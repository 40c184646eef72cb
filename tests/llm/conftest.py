import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def docs(spark):
    """A documents table of (doc_id, text) or longer rows."""
    def build(rows, ddl=DOCS):
        full = [(*r, *(None,) * (5 - len(r))) for r in rows]
        return spark.createDataFrame(full, ddl)
    return build


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
