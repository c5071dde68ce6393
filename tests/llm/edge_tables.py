"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing extra columns."""

from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])
LONG = " ".join(f"word{i % 977} and" for i in range(40_000))
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog.", "en", "src0", 44),
    (2, "The quick brown fox jumps over the lazy dog.", "en", "src0", 44),
    (3, None, "en", "src1", None),
    (4, "", None, None, 0),
    (5, " \n\t ", "de", "src2", 4),
    (6, LONG, "fr", "src0", len(LONG)),
    (7, "token = \"0123456789abcdef0123456789abcdef\" näïve ſ K 漢字 😀", "xx", "elsewhere", 50),
    (7, "token = \"0123456789abcdef0123456789abcdef\" näïve ſ K 漢字 😀", "xx", "elsewhere", 50),
    (None, "no id here", "en", "src0", 10),
    (None, None, None, None, None),
]


def docs(spark, rows=ROWS, **extra):
    from pyspark.sql import functions as F

    frame = spark.createDataFrame(rows, DOCS)
    return frame.withColumns({name: F.lit(value) for name, value in extra.items()})
