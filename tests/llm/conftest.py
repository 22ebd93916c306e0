import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use for themselves; each holds its own name.
CLASHING = ("_text", "_digest", "_order", "_host", "_lines", "_lost", "_spans", "_n_words", "id", "_row")


@pytest.fixture(scope="session")
def documents(spark):
    """Builds a documents table with clashing extra columns from (doc_id, text[, source])."""

    def make(rows):
        full = [(r[0], r[1], None, r[2] if len(r) > 2 else "a", None, *CLASHING) for r in rows]
        return spark.createDataFrame(full, COLUMNS + "".join(f", {c} string" for c in CLASHING))

    return make
