import pytest


@pytest.fixture
def documents(spark):
    def make(rows, extra=""):
        """rows: doc_id, text, source, and what ``extra`` names."""
        return spark.createDataFrame([(r[0], r[1], "en", r[2], len(r[1] or ""), *r[3:]) for r in rows], "doc_id long, text string, lang string, source string, n_chars long" + extra)

    return make


@pytest.fixture
def awkward(documents):
    """Nulls, empty and very long texts, ties and repeated rows."""
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    return documents([(1, None, "a"), (2, "", None), (3, long, "a"), (4, "tie", "b"), (5, "tie", "b"), (6, "same row", "a"), (6, "same row", "a"), (None, "no id", "a"), (7, " \n\t\n", "b"), (8, "Ünïcödé ß 漢字 🙂", "c")])
