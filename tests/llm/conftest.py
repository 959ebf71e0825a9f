import pytest


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and further columns whose names clash with the operators' own."""
    near = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty " * 3
    rows = [
        (1, None), (2, ""), (3, "  \n\t "), (4, "word"), (5, "A few words"), (6, "a FEW words"), (7, near), (8, near + " more"), (9, near), (9, near), (10, "x" * 60_000), (11, "many words here " * 20_000),
        (12, "[INST] <s> \\ </s> ▁ \x00 é ñ 日本 😀"), (None, "no id at all"), (None, near), (13, "  lead  and   trail  "), (14, "tail\n\nlines\r\n x\x0by\x1cz w"),
    ]
    return spark.createDataFrame([(i, t, "en", "src", 0, 1, 2, "p", 3, 4) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, start long, length long, pos string, row int, _w int").cache()


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.filter("1 = 0")
