import pytest


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with every awkward case: nulls in any column, no text, very long text, repeats, clashing names."""
    long = " ".join(f"word{i % 977} the" for i in range(40_000))
    rows = [
        (1, "A plain text about the weather in the town and the people of the town who like it.", "en", "s1"),
        (2, None, "en", "s1"), (3, "", None, "s1"), (4, "   \n\t \n", "en", None), (None, "no id at all here but some words to read", "en", "s2"),
        (5, long, "en", "s2"), (6, "same line\nsame line\nsame line", "en", "s2"), (6, "same line\nsame line\nsame line", "en", "s2"), (7, "é漢字🙂 ünï", "xx", "s3"), (8, "\0 \x0b x", "en", "s3"),
    ]
    rows = [(*r, 0, "clash", 1.5, True, "u", [1]) for r in rows]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, score string, id double, held_out boolean, words string, bands array<int>"
    )
