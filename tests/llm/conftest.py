import pytest

LINES = [f"line number {i} of the common part" for i in range(6)]
WORDS = [f"w{i}" for i in range(60)]


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls, empty, blank and very long texts, copies, near copies, repeated rows, extra columns with clashing names."""
    long_text = " ".join(f"t{i}" for i in range(30_000)) + "\n" + "\n".join(LINES)
    near = WORDS[:]
    near[30] = "other"
    rows = [
        (1, "\n".join(LINES), "en", "a"), (2, "\n".join(LINES), "en", "a"), (2, "\n".join(LINES), "en", "a"), (3, None, None, None), (4, "", "de", "b"),
        (5, "  \n\t ", "de", "b"), (6, long_text, "en", "a"), (7, " ".join(WORDS), "fr", None), (8, " ".join(near), "fr", "c"), (9, "x " + " ".join(WORDS[5:45]) + " y", "fr", "c"),
        (10, " ".join(WORDS).upper(), "fr", "c"), (None, " ".join(WORDS), "fr", "c"), (11, "tail\n" + LINES[0] + "  \n" + LINES[1].upper(), "es", "c"), (12, "one two three", "es", ""), (13, "one two three", "es", "")]
    return spark.createDataFrame([(*r, "noise", len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, TEXT string, n_chars long")


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.limit(0)
