import pytest
from pyspark.sql import functions as F

#: Columns whose names the operators use inside.
CLASHING = ["key", "rid", "hash", "band", "src", "size", "body", "row", "words", "text_key", "tkey", "hits", "label", "kept", "class_id", "_keep_rid", "_leak_key"]

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed: int, n: int) -> str:
    """n words that only this seed has."""
    return " ".join(f"{WORDS[(seed * 7 + i * 5) % len(WORDS)]}{seed}x{i}" for i in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and blank texts, repeated rows, one very long text, other scripts."""
    long_text = "\n".join(prose(900 + i, 400) for i in range(30))
    rows = [(1, prose(1, 60), "en", "a", 300), (1, prose(1, 60), "en", "a", 300), (2, prose(1, 60), "en", "b", None),
            (3, "", "en", "a", 0), (4, None, None, None, None), (None, prose(2, 40), None, None, None), (None, None, None, None, None),
            (5, " \t\n ", "en", "b", 4), (6, "one two", "en", "b", 7), (7, long_text, "en", "c", len(long_text)), (8, "é😀 ß Ελλάδα 日本語 " * 30, "xx", "c", 5),
            (9, "!!! *** $$$", "en", None, 11), (6, "one two three", "en", "b", 13)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *[F.lit(f"x-{c}").alias(c) for c in CLASHING]).cache()


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


def rows_of(df):
    return [tuple(r) for r in df.collect()]
