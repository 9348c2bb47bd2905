import pytest


@pytest.fixture
def docs(spark):
    """Documents from (id, text) pairs, or (id, text, lang)."""

    def make(*rows):
        return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")

    return make
