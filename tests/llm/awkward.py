"""Rows that every operator must take: NULLs, blanks, ties, repeats, long texts, clashing names."""

DOC = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 977}x{i % 89}" for i in range(30_000))
PLAIN = " ".join(f"word{i}" for i in range(80))

ROWS = [
    (1, PLAIN, "en", "a", 10),
    (2, PLAIN, "en", "a", 10),
    (2, PLAIN, "en", "a", 10),
    (3, PLAIN.replace(" ", "  "), "en", None, 10),
    (3, "another text of the same id", None, "b", None),
    (4, None, None, None, None),
    (5, "", "en", "a", 0),
    (6, " \t\n\x0b\x0c\r ", "en", "a", 6),
    (None, PLAIN.replace("word7 ", "ward7 "), "en", "b", 10),
    (None, None, None, None, None),
    (8, LONG, "en", "c", len(LONG)),
    (9, LONG + " tail", "en", "c", len(LONG) + 5),
    (10, "é😀 ß x " * 60, "de", "", 1),
]
#: Columns whose names operators use for their own work.
CLASHES = ("n_words", "kept", "size", "id", "key", "piece", "length", "item", "bin", "words", "fail_bits", "label", "time")


def clashing(df):
    """The same rows with further columns."""
    from pyspark.sql import functions as F

    return df.withColumns({name: F.lit(f"own {name}") for name in CLASHES})
