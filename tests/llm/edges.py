"""Documents with everything awkward: nulls, empty and very long texts, ties, repeated rows, extra columns."""

LONG = " ".join(f"word{i % 977}x{i % 13}" for i in range(60_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept int"
ROWS = [
    (1, None, None, None, None, None, None),
    (2, "", "en", "a", 0, 1.0, 1),
    (3, " \t\n ", "en", "a", 4, 1.0, 1),
    (4, LONG, "en", "b", len(LONG), 1.0, 1),
    (5, LONG, "en", "b", len(LONG), 1.0, 1),
    (6, "the same few words", "en", "a", 18, 1.0, 1),
    (6, "the same few words", "en", "a", 18, 1.0, 1),
    (7, "the same few words", None, None, 18, None, None),
    (None, "a row without an id stands here too", "en", "b", 35, 1.0, 0),
    (8, "12345 67890 !!! ???", "en", None, 19, 1.0, 0),
    (9, "\U0001f600 \U0001f600 émoji és ñandú", "es", "b", 17, 1.0, 0),
]


def documents(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark, rows=((4, 1, 0, "x"), (6, 0, 0, "x"), (6, 1, 0, "x"), (None, 1, 0, "x"), (8, None, None, None))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int, text string")
