import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, key long, first long, class_id long, component long, kept boolean, n long, task long, ids string, v string, start_word long, end_word long"


@pytest.fixture(scope="session")
def documents(spark):
    """Rows of (doc_id, text[, lang, source]) as documents with extra columns whose names operators use inside."""

    def make(rows):
        full = [(*r, *[None] * (4 - len(r)), len(r[1]) if r[1] is not None else None, *["x" if c.split()[1] == "string" else True if c.split()[1] == "boolean" else 7 for c in SCHEMA.split(", ")[5:]]) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture(scope="session")
def vocab():
    import public_tokenizers as P

    return P
