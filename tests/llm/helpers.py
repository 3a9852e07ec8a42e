"""Small tables with everything that may go wrong in one."""

LONG = "word " * 60_000 + "end"
ODD_TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog. It was fun."),
    (2, None),
    (3, ""),
    (4, "   \n\t "),
    (5, "The quick brown fox jumps over the lazy dog. It was fun."),
    (6, LONG),
    (None, "a row without an id"),
    (5, "The quick brown fox jumps over the lazy dog. It was fun."),
    (8, "no"),
    (9, "日本語 é 😀 \x00 ▁ <s> <|endoftext|>"),
    (10, "12 + 34 = !!!"),
]


def odd_docs(spark):
    """Texts with NULL, empty, blank, very long, repeated and equal ones, and columns whose names clash with our own."""
    rows = [(i, t, "en", "s", -1.0, "x", 7, "y", 1) for i, t in ODD_TEXTS]
    return spark.createDataFrame(
        rows,
        "doc_id long, text string, lang string, source string, score double, digest string, fp int, _id string, part int",
    )


def no_docs(spark):
    return odd_docs(spark).limit(0)


def same_rows(df, rows):
    return sorted(map(tuple, df.collect()), key=str) == sorted(map(tuple, rows), key=str)
