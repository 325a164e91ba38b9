"""Rows that every operator has to take: nulls in any column, empty and very long texts, ties, repeats."""

from pyspark.sql import DataFrame, SparkSession

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use themselves.
CLASHES = ("cid", "row", "doc", "n", "h", "salt", "owner", "first", "keep", "group_id", "best", "kept_id", "n_tokens", "n_rows", "take", "a", "b", "c", "root", "bucket", "score", "toxic", "parts", "draw", "key", "data")
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(60_000))


def odd(spark: SparkSession, clashing: bool = False) -> DataFrame:
    rows = [
        (1, "the quick brown fox jumps over the lazy dog", "en", "src0", 43), (1, "the quick brown fox jumps over the lazy dog", "en", "src0", 43), (2, "the quick brown fox jumps over the lazy dog", "en", "src1", 43),
        (3, None, "en", "src0", None), (4, None, None, None, None), (None, "no id here at all", "en", "src1", 17), (None, None, None, None, None), (5, "", "en", "src0", 0), (6, "", None, "src1", 0),
        (7, LONG, "en", "src0", len(LONG)), (8, LONG + " tail", "en", None, len(LONG) + 5), (9, "   \n\t ", "de", "src1", 6), (10, "x", "fr", "src0", 1), (10, "y", "fr", "src0", 1), (11, "日本語のテキスト 😀 ▁", "xx", "src1", 12), (12, "no id here at all", "en", "src0", 17),
    ]
    df = spark.createDataFrame(rows, DOCS)
    for c in CLASHES if clashing else ():
        df = df.selectExpr("*", f"concat('{c}', coalesce(doc_id, 0)) AS `{c}`")
    return df


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], DOCS)


def rows(df: DataFrame) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)
