from __future__ import annotations

import pytest

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text) or longer tuples, spread over some partitions."""

    def make(rows, partitions=3):
        filled = []
        for row in rows:
            doc_id, text, *rest = row
            lang, source = (list(rest) + ["en", "web"][len(rest) :])[:2]
            filled.append((doc_id, text, lang, source, len(text) if text is not None else None))
        return spark.createDataFrame(filled, DOCUMENT).repartition(partitions)

    return make
