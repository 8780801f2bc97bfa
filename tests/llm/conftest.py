import pytest

from skein.llm.common import ship

DOCS = "doc_id long, text string, lang string, source string, n_chars long, h string, n_tokens int"


@pytest.fixture(scope="session")
def docs(spark):
    """documents from texts; extra columns carry names that operators use inside."""
    ship(spark)

    def make(texts, ids=None, langs=None):
        rows = [(i if ids is None else ids[i], t, None if langs is None else langs[i], "s", None, "x", 1) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, DOCS)

    return make
