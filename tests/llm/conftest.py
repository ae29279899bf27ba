import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[2]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]


@pytest.fixture(scope="session")
def make(spark):
    """Rows → DataFrame with a DDL schema, over several partitions."""

    def table(rows, schema, parts=3):
        return spark.createDataFrame(rows, schema).repartition(parts) if rows else spark.createDataFrame([], schema)

    return table


DOCS = "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, slot string, spans string"


@pytest.fixture(scope="session")
def docs(make):
    """Rows of (doc_id, text[, lang[, source]]) → documents with columns whose names clash with results."""

    def table(rows):
        full = [(r + (None,) * 4)[:4] for r in rows]
        return make([(i, t, l, s, len(t or ""), "mine", "mine", "mine") for i, t, l, s in full], DOCS)

    return table
