"""Small tables for the tests of the training-data operators."""

from __future__ import annotations

import os

import pytest

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, source="s", first=0):
    """A documents table of ``texts`` (or of (doc_id, text) pairs)."""
    rows = [t if isinstance(t, tuple) else (first + i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame([(i, t, "en", source, len(t or "")) for i, t in rows], DOCUMENT)
