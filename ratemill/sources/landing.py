"""Sources and sinks over files: daily fixes, intraday attempts, value series, CSV tables, payloads; write-once days and redaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratemill.functions import numbers

RESULT = "fix double, band struct<p25:double,p75:double>, dispersion double, status string, withheld boolean, available boolean, source_medians map<string,double>"
FIX = f"date string, as_of timestamp, benchmarks map<string,struct<{RESULT.replace(' double', ':double').replace(' struct', ':struct').replace(' string', ':string').replace(' boolean', ':boolean').replace(' map', ':map').replace(', ', ',')}>>, computed struct<fix:double,status:string,withheld:boolean,band:struct<p25:double,p75:double>>"
SAMPLE = "sampled_at:timestamp,value:double,benchmarks:map<string,double>,quote_time:timestamp,ok:boolean,stale:boolean,error:string,source_unit:string,health:string"
ATTEMPT = f"date string, collected_at timestamp, sources map<string,struct<sample:struct<{SAMPLE}>>>, _corrupt_record string"
SERIES = "rows array<struct<date:string,fix:string,p25:string,p75:string,status:string,withheld:string>>"


def daily_fixes(spark: SparkSession, folder: str) -> DataFrame:
    """One row per file named by a day; other names and broken files are passed over. day comes from the name."""
    named = F.regexp_extract(F.col("_metadata.file_name"), r"^([0-9]{4}(?:-[0-9]{2}){2})\.json$", 1)
    raw = spark.read.schema(T.StructType.fromDDL(FIX + ", _corrupt_record string")).option("multiLine", True).option("mode", "PERMISSIVE").json(f"{folder}/*.json")
    return raw.select("*", named.try_cast("date").alias("day")).where("day IS NOT NULL AND _corrupt_record IS NULL").drop("_corrupt_record")


def fix_rows(fixes: DataFrame) -> DataFrame:
    """day, benchmark and the columns of its result, one row each."""
    return fixes.select("day", F.explode("benchmarks").alias("benchmark", "r")).select("day", "benchmark", "r.fix", F.col("r.band.p25").alias("p25"), F.col("r.band.p75").alias("p75"), "r.dispersion", "r.status", "r.withheld", "r.available")


def attempts(spark: SparkSession, folder: str) -> DataFrame:
    """Intraday attempts with their file."""
    raw = spark.read.schema(T.StructType.fromDDL(ATTEMPT)).option("multiLine", True).json(f"{folder}/*.json")
    return raw.where("_corrupt_record IS NULL").select("date", "collected_at", "sources", F.col("_metadata.file_path").alias("file"))


def samples(attempt_rows: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """Long samples of attempts: collected_at, source (by its present name), benchmark, value, sampled_at, quote_time, ok, stale."""
    flat = attempt_rows.select("date", "collected_at", F.explode("sources").alias("name", "s")).select("date", "collected_at", "name", "s.sample.*")
    source = F.col("name")
    for old, new in (aliases or {}).items():
        source = F.when(F.col("name") == old, new).otherwise(source)
    return flat.select(F.to_date("date").alias("day"), "collected_at", source.alias("source"), F.explode("benchmarks").alias("benchmark", "value"), "sampled_at", "quote_time", F.coalesce("ok", F.lit(False)).alias("ok"), F.coalesce("stale", F.lit(False)).alias("stale"))


def series_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a published series: numbers only where positive, withheld in any spelling, rows without a date dropped."""
    r = spark.read.schema(T.StructType.fromDDL(SERIES)).option("multiLine", True).json(path).select(F.inline("rows"))
    held = F.when(F.lower(F.trim("withheld")).isin("true", "1", "yes"), True).when(F.col("withheld").isNotNull(), False)
    return r.where(F.col("date").rlike("^[0-9]{4}(?:-[0-9]{2}){2}$")).select(F.to_date("date").alias("day"), *[numbers.parse_number(F.col(c)).alias(c) for c in ("fix", "p25", "p75")], "status", held.alias("withheld"))


def value_series(spark: SparkSession, path: str) -> DataFrame:
    """day and value of a JSON array; invalid rows are dropped."""
    r = spark.read.schema(T.StructType.fromDDL("date string, value string")).option("multiLine", True).json(path)
    return r.select(F.col("date").try_cast("date").alias("day"), numbers.parse_number(F.col("value")).alias("value")).where("day IS NOT NULL AND value IS NOT NULL")


def csv_strings(spark: SparkSession, path: str) -> DataFrame:
    """A CSV table with header; every column is text until it is cast."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def payload(body: Column, names: tuple[str, ...] = ("yesterday", "lastrates")) -> Column:
    """The JSON object of a body, or that of the first script variable of these names."""
    whole = F.when(F.try_parse_json(body).isNotNull(), body)
    parts = [F.nullif(F.regexp_extract(body, rf"(?is)var\s+{n}\s*=\s*(\{{.*?\}})\s*;", 1), F.lit("")) for n in names]
    return F.coalesce(whole, *[F.when(F.try_parse_json(p).isNotNull(), p) for p in parts])


def redact(text: Column) -> Column:
    """Values of keys and tokens in URLs hidden."""
    return F.regexp_replace(text, r"(?i)([?&](?:api[_-]?key|token|key|secret|password)=)[^&#\s\"]+", "$1***")


def keyed_csv(spark: SparkSession, path: str, key: str) -> DataFrame:
    """A CSV table with one row per key in lower case, the last one of the file; rows without a key are dropped."""
    rows = csv_strings(spark, path)
    name = F.lower(F.trim(F.col(key)))
    return rows.select("*", F.monotonically_increasing_id().alias("_at")).withColumn(key, name).where(F.col(key) != "").groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), "_at").alias("r")).select(key, "r.*")


def json_text(spark: SparkSession, path: str) -> DataFrame:
    """path and body of whole JSON files; a body that is no JSON object is {}."""
    body = F.when(F.expr("schema_of_variant(try_parse_json(value)) LIKE 'OBJECT%'"), F.col("value")).otherwise("{}")
    return spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("path"), body.alias("body"))


SOURCE = "key string, platform string, handle_or_url string, signal_families string, best_usable_record_count long, last_success_at string"


def registry_sources(spark: SparkSession, path: str) -> DataFrame:
    """The sources of a registry file; none where there is no such file or it isn't one."""
    if not _exists(spark, path):
        return spark.createDataFrame([], SOURCE)
    parsed = F.from_json("body", T.StructType.fromDDL(f"sources array<struct<{SOURCE.replace(' string', ':string').replace(' long', ':bigint')}>>"))
    return json_text(spark, path).select(F.inline(parsed["sources"]))


def recent_fixes(fixes: DataFrame, days: int) -> DataFrame:
    """day, source and median of the last so many days of daily fixes, counted back from the latest."""
    newest = fixes.agg(F.max(F.when(F.col("benchmarks").isNotNull(), F.col("day"))).alias("_newest"))
    some = fixes.crossJoin(F.broadcast(newest)).where(F.col("day") > F.date_sub("_newest", days))
    return some.select("day", F.explode("benchmarks").alias("benchmark", "r")).select("day", "benchmark", F.explode("r.source_medians").alias("source", "median"))


def _path(spark: SparkSession, path: str) -> tuple[object, object]:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _exists(spark: SparkSession, path: str) -> bool:
    files, at = _path(spark, path)
    return files.exists(at)


def put_text(spark: SparkSession, path: str, body: str) -> None:
    """Writes a small document, such as a page's JSON, as one file."""
    files, at = _path(spark, path)
    out = files.create(at, True)
    out.write(bytearray(body.encode()))
    out.close()


def write_json(df: DataFrame, path: str) -> None:
    """A row per line; NULL columns are written, too."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def put_unique(spark: SparkSession, folder: str, stem: str, body: str) -> str:
    """Writes a document under stem.json, or stem-1.json, stem-2.json, ... if that is there; where it went. Attempts are never overwritten."""
    n = 0
    while _exists(spark, path := f"{folder}/{stem}{f'-{n}' if n else ''}.json"):
        n += 1
    put_text(spark, path, body)
    return path


def write_series(rows: DataFrame, folder: str, key: str, day: str) -> None:
    """The whole series by key, and the latest row of each."""
    rows.write.mode("overwrite").partitionBy(key).parquet(f"{folder}/series")
    latest = rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), day).alias("r")).select(key, "r.*")
    latest.write.mode("overwrite").parquet(f"{folder}/latest")


def write_once(df: DataFrame, folder: str, day: str) -> bool:
    """Writes the partition of a day unless it is there; whether it did."""
    path = f"{folder}/day={day}"
    if _exists(df.sparkSession, path):
        return False
    df.write.mode("errorifexists").parquet(path)
    return True


def write_csv(df: DataFrame, path: str, order: list[str]) -> None:
    """A CSV table with header in a fixed order; one file, for tables of reports."""
    df.orderBy(*order).coalesce(1).write.mode("overwrite").option("header", True).csv(path)
