"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""

from pyspark.sql import types as T

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])

A = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
B = "die katze schläft auf dem alten sofa und träumt von fischen\nunter dem tisch liegt der hund und wartet auf den abend"

ROWS = [
    (1, A, "en", "a"), (2, A, "en", "a"), (2, A, "en", "a"), (3, A + " more", "en", "b"), (4, B, "de", None), (5, "", "en", "a"), (6, None, None, "c"),
    (None, "a text without an id", "en", "b"), (None, "a text without an id", "en", "b"), (7, " \n\t ", None, "a"), (8, "w" * 70_000 + " end", "en", "b"),
    (9, A.upper(), "en", "c"), (10, "word", "xx", "c"), (4, "the same id and another text", "en", "a"), (11, "\n\n" + B + "\n\n", "de", "a"), (12, "naïve 🙂 test  two  spaces <|endoftext|>", "en", "c"),
]


def documents(spark, rows=ROWS, extra=False):
    df = spark.createDataFrame([(i, t, g, s, len(t) if t is not None else None) for i, t, g, s in rows], DOCUMENTS)
    if extra:
        for name in ("toxicity", "contamination", "secrets", "language", "slot", "block", "place", "score", "start", "rank", "_key", "text_key", "row", "doc"):
            df = df.selectExpr("*", f"'x' AS {name}")
    return df


def empty(spark):
    return documents(spark, [])


def words(text):
    """Words between ASCII white space, with A-Z in lower case."""
    return (text or "").encode().lower().split()


def shingle_set(text, size=5):
    w = words(text)
    return set() if not w else {tuple(w)} if len(w) < size else {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}
