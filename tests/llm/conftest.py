import pytest

BASE = ("The quick brown fox jumps over the lazy dog while seven wise owls watch from a tall oak tree near the old stone bridge and "
        "count the boats that pass below on their way to the distant harbour town where lanterns burn all night long for late sailors")  # fmt: skip


@pytest.fixture(scope="session")
def base():
    return BASE


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns whose names clash with the operators' own."""
    words = BASE.split()
    rows = [
        (1, BASE, "en", "s1"), (2, BASE, "en", "s1"), (2, BASE, "en", "s1"), (3, BASE.replace("seven", "eight"), "en", "s2"), (4, "", "en", "s2"), (5, None, None, None), (6, "one", "de", "s3"), (7, "ONE", "de", "s3"),
        (8, "  \n\t ", "en", "s1"), (9, "word " * 30_000, "en", "s1"), (None, "no id at all here", "en", "s2"), (10, "Ünï çödé\x00 Ω " + "日本語 " * 20, "xx", None), (11, " ".join(reversed(words)), "en", "s1"), (12, "a\n\nb\n", "en", "s4"),
    ]
    rows = [(*r, len(r[1] or ""), "x", 1, b"y", 0.5) for r in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _hit string, size int, _set binary, score double")


@pytest.fixture(scope="session")
def empty_docs(odd_docs):
    return odd_docs.limit(0)
