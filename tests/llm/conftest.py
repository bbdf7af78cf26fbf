import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture()
def docs_of(spark):
    """Documents from texts (ids from 0), or from (id, text) pairs; further columns clash on purpose."""

    def make(texts, extra=False):
        rows = [(t if isinstance(t, tuple) else (i, t)) for i, t in enumerate(texts)]
        d = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOCS)
        if extra:
            d = d.selectExpr("*", "1 as row", "'x' as kept", "2 as n_words", "3 as words", "4 as removed", "5 as component_id", "6 as length", "'y' as labels", "7 as score")
        return d

    return make
