import pytest


@pytest.fixture
def documents(spark):
    """A documents table of (doc_id, text) pairs, with columns whose names operators might use inside."""

    def make(rows, source="s"):
        made = [(i, t, "en", s[0] if s else source, len(t) if t is not None else None, "keep me", 7) for i, t, *s in rows]
        return spark.createDataFrame(made, "doc_id bigint, text string, lang string, source string, n_chars bigint, th string, id int")

    return make
