"""Documents with the cases that every operator has to bear: nulls, empty and very long texts, ties, repeated rows, clashing names."""

from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"
DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        *[T.StructField(n, T.StringType()) for n in ("id", "row", "n", "key", "size", "fp", "stratum", "name", "schedule")],
    ]
)


def documents(spark, rows):
    """rows: (doc_id, text, lang, source) or shorter; the other columns clash with names that operators use inside."""
    full = [tuple(r) + (None,) * (4 - len(r)) for r in rows]
    return spark.createDataFrame([(*r, len(r[1] or ""), *["x"] * 9) for r in full], DOCS)


LONG = "lorem ipsum dolor sit amet consectetur " * 4000
ODD = [
    (1, None, None, None),
    (2, "", "en", "a"),
    (3, " \t\n ", "en", "a"),
    (4, "Same Text here", "en", "a"),
    (5, "same text HERE", "en", "b"),
    (5, "same text HERE", "en", "b"),
    (6, "SAME TEXT HEREÉ", "fr", None),
    (7, "same text hereé", "fr", None),
    (8, LONG, "en", "b"),
    (9, LONG + "end", "en", "b"),
    (10, LONG.upper(), None, "c"),
    (11, "x" * 70 + "a", "de", "c"),
    (12, "x" * 70 + "b", "de", "c"),
    (13, "\U0001f600" * 300, None, "c"),
    (14, "\U0001f600" * 300, None, "c"),
    (15, "<|endoftext|> it's NULL\x00 tab\there ▁ marked  twice ", "en", "d"),
    (None, "Same Text here", "en", "a"),
    (16, "é 　 ﬁ ΑΣ Σ x\x1cy", "el", "d"),
]
