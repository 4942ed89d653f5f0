import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Documents from (id, text) or (id, text, source), with columns whose names clash with ours."""

    def of(*rows):
        full = [(*r[:2], "en", r[2] if len(r) > 2 else "s", 0) for r in rows]
        clash = "size long, fp string, n_lines string, seq string, kept string, copies string, words string"
        return spark.createDataFrame([(*r, 1, "x", "x", "x", "x", "x", "x") for r in full], f"{DOC}, {clash}")

    return of


LONG = "This line is long enough to be the key of forty code points and more."


@pytest.fixture
def awkward():
    """NULLs in every column, empty, blank and very long texts, repeated rows."""
    long_text = "\n".join(f"word{i % 977} other{i % 31} {LONG}" for i in range(6000))
    return [
        (1, None, "a"), (2, "", "a"), (3, " \t\n", None), (4, "one", None), (None, "no id at all", "b"),
        (None, None, None), (5, LONG, "b"), (5, LONG, "b"), (6, long_text, "hot"), (7, "é" * 50 + "\nÀB", "hot"),
        (8, LONG + "\n" + LONG, "hot"), (9, "<|endoftext|> a <|endo", "hot"),
    ]
