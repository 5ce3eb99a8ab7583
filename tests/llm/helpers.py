import hashlib

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

#: Null, empty, blank, long and repeated texts, odd white space, non-ASCII, NUL and repeated rows.
EDGE = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, " \t\r\n\x0b\x0c ", "en", "a", 8),
    (4, "One line", "en", "b", 8),
    (4, "One line", "en", "b", 8),
    (5, "Ünïcode ÀÉ x y\u0085z \x1c \x1f end\x00nul", "fr", None, 10),
    (None, "no id here", "de", "c", 10),
    (6, "word " * 40_000, "en", "b", 200_000),
    (7, "a" * 100_000, "en", "b", 100_000),
    (8, "same text for all\nof these rows", "en", "a", 31),
    (9, "same text for all\nof these rows", "en", "a", 31),
    (10, "same text for all\nof these rows", "en", "a", 31),
]


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def docs(spark, rows=EDGE):
    return spark.createDataFrame(rows, SCHEMA)


def clashing(df):
    """With further columns whose names an operator may use itself."""
    from pyspark.sql import functions as F

    return df.withColumns({n: F.lit(i) for i, n in enumerate(("_id", "_t", "_key", "_n", "n_lines", "n_dropped", "ids", "decoded", "score", "predicted", "component_id", "fingerprint", "node", "count", "shard", "piece", "bin_id", "license", "origin", "status", "headers", "a", "b", "d", "t"))})
