import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from (doc_id, text) or (doc_id, text, source) rows."""

    def make(rows, extra=False):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DOC)
        if extra:  # columns whose names clash with those that operators use inside
            for name in ("id", "fp", "key", "shard", "size", "piece", "keep_id", "__id", "score", "word", "label"):
                df = df.selectExpr("*", f"1 as `{name}`")
        return df

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Null and empty texts, null ids, ties, repeated rows and a very long text."""
    long_text = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
    return [(1, None), (2, ""), (3, " \t\n"), (4, "One two three"), (4, "One two three"), (5, "one TWO three"), (6, long_text), (7, long_text + " end"), (None, "one two three"), (8, "é Ünïcode\x0bwords\x1chere")]
