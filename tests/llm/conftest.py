import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, Size string, slot string"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) or (doc_id, text, source) rows, with extra columns of clashing names."""

    def build(rows, parts=3):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None, "x", None) for r in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(parts)

    return build
