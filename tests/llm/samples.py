"""Small awkward tables shared by the tests of this folder."""

from pyspark.sql import types as T

CLASHES = ("row", "hash", "copy", "kept", "position", "part", "score", "size", "_id", "lines", "value")

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        *(T.StructField(c, T.StringType()) for c in CLASHES),
    ]
)

LONG = "a fairly common sentence that goes on, and on, until it ends. " * 3_000

TEXTS = [
    (1, "one line of text that is shared\nand another line, quite long enough to compare"),
    (2, "one line of text that is shared\nand another line, quite long enough to compare"),
    (3, "One line of text that is shared\n\nand another line, quite lung enough to compare"),
    (4, None),
    (5, ""),
    (6, "   \n \t"),
    (7, LONG),
    (8, LONG + "tail"),
    (9, "x" * 50_000),
    (10, "short"),
    (10, "short"),
    (10, "same id, other text"),
    (None, "a row without an id"),
    (None, "one line of text that is shared\nand another line, quite long enough to compare"),
    (11, "İstanbul ΣΑΣ don't <|endoftext|> 12 ½ 中文 \x1c é"),
]


def documents(spark, texts=TEXTS):
    rows = [
        (i, t, None if n % 5 == 0 else "en", None if n % 4 == 0 else f"s{n % 3}", None if t is None else len(t))
        + ("clash",) * len(CLASHES)
        for n, (i, t) in enumerate(texts)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
