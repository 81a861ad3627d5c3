import pytest

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def docs(spark):
    """Documents from texts, or from (id, text) pairs; extra columns have names that operators use inside."""

    def make(texts):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        extra = [(i, t, "en", "s", None if t is None else len(t), 1, "x", None) for i, t in rows]
        return spark.createDataFrame(extra, DOC + ", _id int, _h string, score double")

    return make
