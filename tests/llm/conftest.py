"""Small tables with the awkward cases every operator must take: nulls, empty and long texts, ties, repeated rows,
an empty table, and extra columns whose names clash with the operators' own."""

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = "doc_id long, text string, score double, row string, component_id long, kept boolean, n_tokens long, part int"


@pytest.fixture(scope="session")
def make(spark):
    def docs(texts, schema=SCHEMA):
        """One row per (id, text); the other columns are null."""
        n = len(schema.split(",")) - 2
        return spark.createDataFrame([(i, t, *[None] * n) for i, t in texts], schema)
    return docs


@pytest.fixture(scope="session")
def awkward():
    """(id, text) rows: null id, null and empty texts, blanks, a repeated row, one id with two texts, a very long text."""
    return [(1, "one two three four five six seven"), (2, None), (3, ""), (4, " \n\t "), (1, "one two three four five six seven"),
            (5, "First line here\nOne two three"), (5, "another text of document five"), (None, "a text without an id"),
            (6, "word " * 30_000), (7, "Ünïcödé 日本語 ✓ Ünïcödé"), (8, "x" * 5000)]
