import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

LOREM = " ".join(f"word{i % 97}x{i // 7}" for i in range(120))


def doc(i, text, source="a", lang="en"):
    return (i, text, lang, source, None if text is None else len(text))


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows."""
    rows = [
        doc(1, LOREM), doc(2, LOREM), doc(3, "start " + LOREM + " end"), doc(3, "start " + LOREM + " end"),
        doc(4, None), doc(5, ""), doc(6, " \n\t "), doc(None, "no id here", None, None), doc(7, "one"),
        doc(8, "é 中文 ok " * 3000, None), doc(9, "x" * 20000), doc(None, None, None, None), doc(10, "a\nb\na\nb\n" * 40),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
