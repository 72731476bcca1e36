from __future__ import annotations

import pytest
from pyspark.sql import functions as F

#: Names that operators use inside; extra columns of these names must do no harm.
CLASHING = (
    "id bits tile own quad bytes size block other component node u v m task nth number before length offset sequence_id words gated"
    " detections host path decided n verdict fold gram weight score page digest payload original record_id value findings part"
    " slice sums pooled quality gone_id query query_id tile query_block row rank edits start"
).split()


@pytest.fixture
def crowded():
    """The frame with an extra column for every name that operators use inside."""

    def add(df):
        taken = {c.lower() for c in df.columns}
        return df.select("*", *(F.lit("x").alias(name) for name in dict.fromkeys(CLASHING) if name not in taken))

    return add


@pytest.fixture
def make_docs(spark):
    """Documents from (doc_id, text) pairs."""

    def build(*pairs):
        rows = [(doc, text, "en", None, None if text is None else len(text)) for doc, text in pairs]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")

    return build


@pytest.fixture
def odd_docs(make_docs):
    """Nulls in any column, empty and very long texts, ties and repeated rows."""
    long_text = "one very long text with the same few words " * 20_000
    return make_docs(
        (None, None), (None, "no id"), (1, None), (2, ""), (3, " \n\t "), (4, "same words here today"), (5, "same words here today"),
        (5, "same words here today"), (6, long_text), (7, "Été 字 \U0001f600"), (8, "\x00 \x1c odd \x85 blanks"),
    )
