"""Small tables for the training-data operators."""

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    def make(rows):
        """rows: texts, or (doc_id, text[, lang[, source]])."""
        full = []
        for k, r in enumerate(rows):
            r = (k, r) if r is None or isinstance(r, str) else r
            r = (*r, None, None)[:4] if len(r) < 4 else r
            full.append((r[0], r[1], r[2], r[3], None if r[1] is None else len(r[1])))
        return spark.createDataFrame(full, SCHEMA)

    return make
