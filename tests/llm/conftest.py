import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Documents from (doc_id, text) or (doc_id, text, source)."""

    def make(*rows):
        return spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "s", 0) for r in rows], SCHEMA)

    return make


@pytest.fixture
def clashing(docs):
    """The same documents with columns named like the operators' own."""

    def add(frame, *names):
        for name in names:
            frame = frame.withColumn(name, frame.lang)
        return frame

    return add
