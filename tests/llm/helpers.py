"""Small tables with nulls, ties, repeated rows, long texts and clashing column names."""

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use themselves.
CLASHING = ("digest", "size", "target", "fp", "component", "seq", "h1", "_mix_source", "_keep_id", "_line_chunks", "score", "rule", "a.b")

LONG = " ".join(f"word{i % 977}" for i in range(60_000))
LINES = "\n".join(["same line"] * 300)
ROWS = [
    (1, "One two three four five six.\nSeven eight nine ten.\nEleven twelve.\nThirteen.", "en", "a", 1),
    (2, "One two three four five six.\nSeven eight nine ten.\nEleven twelve.\nThirteen.", "en", "b", 2),
    (2, "One two three four five six.\nSeven eight nine ten.\nEleven twelve.\nThirteen.", "en", "b", 2),
    (3, None, "en", "a", None),
    (4, "", "de", None, 0),
    (5, " \n\t\n ", None, "c", 5),
    (None, "One two three four five six.\nSeven eight nine ten.\nEleven twelve.\nThirteen.", "en", "a", 1),
    (None, None, None, None, None),
    (6, LONG, "en", "a", 9),
    (7, LINES, "fr", "a", 9),
    (8, "\U0001f600 emoji ÀÉ​  it's 123 [INST] \x00 end", "xx", "d", 9),
    (9, "x" * 5000, "en", "a", 9),
]


def documents(spark, rows=ROWS, clash=False):
    df = spark.createDataFrame(rows, DOCUMENTS)
    if clash:
        from pyspark.sql import functions as F

        df = df.select("*", *[F.lit(f"own {n}").alias(n) for n in CLASHING])
    return df
