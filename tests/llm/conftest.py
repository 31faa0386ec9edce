import pytest

ODD = [
    (1, None), (2, ""), (3, " \t\n\x0b"), (4, "one"), (5, "one two three four"), (6, "ONE two three four"), (7, "naïve café 漢字 🙂 \x1c\x85 end"),
    (8, "word " * 30_000), (8, "word " * 30_000), (9, "a  b\n\n c \n"), (None, "lost its number"), (10, "tab\tline\nline\nline"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, blanks, one very long text, a repeated row, a missing id, and columns whose names our operators use too."""
    rows = [(i, t, "en" if (i or 0) % 2 else None, None if i == 4 else "s", len(t or ""), "x", 1, i) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, counts string, size int, `a.b` long")


@pytest.fixture(scope="session")
def empty(spark, odd):
    return spark.createDataFrame([], odd.schema)


@pytest.fixture(scope="session")
def documents(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")
