"""Small tables with the awkward rows that every corpus operator must take."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows, extra=False):
    """(doc_id, text, source) rows as ``documents``; ``extra`` adds columns with clashing names."""
    full = [(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows]
    df = spark.createDataFrame(full, DOCS)
    if extra:
        from pyspark.sql import functions as F
        for name in ("size", "target", "score", "piece", "length", "fingerprint", "_fp", "h", "n"):
            df = df.withColumn(name, F.lit("x"))
    return df


def awkward(long_words=3000):
    text = " ".join(f"word{i % 97} tail{i % 31}" for i in range(60))
    return [(1, text, "a"), (2, text, "a"), (3, None, "b"), (4, "", None), (5, " \t\n ", "b"), (None, "no id here at all", "c"),
            (6, " ".join(f"w{i * 7919 % 1009}" for i in range(long_words)), "a"), (7, "one", "c"), (7, "one", "c"), (8, "Ünï cödé 𝄞 text ok", "b")]
