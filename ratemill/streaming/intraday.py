"""Structured Streaming forms: attempts as they land, days that close once, keyed state by upsert."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ratemill.functions import times
from ratemill.operators import dedup, fix
from ratemill.sources.landing import ATTEMPT


def samples(spark: SparkSession, folder: str, like: DataFrame, files_per_batch: int | None = None) -> DataFrame:
    """A stream of the sample files that land in a folder, with the schema of like."""
    reader = spark.readStream.schema(like.schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(folder)


def landed_attempts(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """A stream of attempts, one JSON document per file, as landing.attempts() reads them."""
    reader = spark.readStream.schema(T.StructType.fromDDL(ATTEMPT)).option("multiLine", True)
    raw = (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).json(folder)
    return raw.where("_corrupt_record IS NULL").select("date", "collected_at", "sources", F.col("_metadata.file_path").alias("file"))


def flagged(stream: DataFrame) -> DataFrame:
    """Samples outside the daily window are marked stale and kept, not dropped."""
    return stream.withColumn("stale", F.col("stale") | ~times.in_window(F.col("sampled_at")))


def window_counts(stream: DataFrame, delay: str = "2 days") -> DataFrame:
    """Samples, sources and mean value per half hour that begins at :15 or :45. In append mode a window is given once, when the watermark
    has passed it, and its state is dropped."""
    w = F.window("sampled_at", "30 minutes", startTime="15 minutes")
    return stream.withWatermark("sampled_at", delay).groupBy(w, "benchmark").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("source").alias("sources"), F.avg("value").alias("mean"))


def run(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """All that is there now, batch by batch; what was done is remembered in checkpoint."""
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def keep_samples(folder: str) -> Callable[[DataFrame, int], None]:
    """Keeps the samples of every batch by day, so that a day's samples may come in any number of batches. A batch that is repeated replaces itself."""

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").partitionBy("day").parquet(f"{folder}/batch={number}")

    return each


def publish_closed(spark: SparkSession, kept: str, out: str, close_before: str) -> DataFrame:
    """Writes the fixes of every day before a date that isn't published yet, from all samples kept of it, in one job; a day that was published stays as it is. Gives
    what is published now."""
    rows = spark.read.option("basePath", kept).parquet(f"{kept}/batch=*").drop("batch").where(F.col("day") < F.lit(close_before).cast("date"))
    at = spark._jvm.org.apache.hadoop.fs.Path(out)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        rows = rows.join(spark.read.parquet(out).select("day").distinct(), "day", "left_anti")
    fixed = fix.fixes(rows)
    fixed.repartition("day").write.mode("append").partitionBy("day").parquet(out)
    return spark.read.schema(fixed.schema).parquet(out)


def upsert_table(path: str, keys: list[str], order: list[str]) -> Callable[[DataFrame, int], None]:
    """Keeps the greatest row by order of each key, in versions: each batch writes the next from the last, so a batch that is
    repeated gives the same. For tables of the size of a registry, which a batch can write whole. The last two versions stay."""

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        files = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        version = lambda n: spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v{n}")
        rows = batch
        if number:
            if not files.exists(version(number - 1)):
                raise FileNotFoundError(f"{path}/v{number - 1} is missing; its rows would be lost")
            rows = spark.read.schema(batch.schema).parquet(f"{path}/v{number - 1}").unionByName(batch)
        best = dedup.first_by(rows, keys, [*[F.col(c).desc() for c in order], *dedup.by_content(rows, [*keys, *order])])
        best.write.mode("overwrite").parquet(f"{path}/v{number}")
        if number > 1:
            files.delete(version(number - 2), True)

    return each


def current(spark: SparkSession, path: str) -> DataFrame:
    """The last version of such a table."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = [f.getPath().getName() for f in at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)]
    return spark.read.parquet(f"{path}/v{max(int(n[1:]) for n in there if n[0] == 'v')}")
