"""Queries of sources and sinks: small documents made of the nations land in the shared folder and are read back."""

from __future__ import annotations

import atexit
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratemill.plans.registry import query, table
from ratemill.session import remove, shared_folder
from ratemill.sources import landing


def _folder(spark: SparkSession) -> str:
    at = f"{shared_folder(spark)}/landed-{uuid.uuid4().hex}"
    atexit.register(remove, spark, at)
    return at


def _nations(spark: SparkSession, sf_dir: str) -> list[tuple[int, str]]:
    """The 25 nations, a dimension of fixed size, as what a collector would have fetched."""
    return sorted(tuple(r) for r in table(spark, sf_dir, "nation").select("n_nationkey", "n_name").collect())


def _fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _folder(spark)
    for k, name in _nations(spark, sf_dir):
        one = {"fix": k * 10.0 + 1, "band": {"p25": k * 10.0, "p75": k * 10.0 + 2}, "status": "Green", "withheld": k % 3 == 0, "available": k % 3 > 0, "source_medians": {"a": k * 1.0, name: k * 2.0}}
        body = json.dumps({"date": f"2024-01-{k + 1:02}", "as_of": f"2024-01-{k + 1:02}T14:20:00Z", "benchmarks": {"official": one}})
        landing.put_text(spark, f"{at}/2024-01-{k + 1:02}.json", body[: 40 if k % 5 == 4 else None])
    landing.put_text(spark, f"{at}/latest.json", "{}")
    return landing.daily_fixes(spark, at)


@query("SELECT DATE '2024-01-01' + CAST(n_nationkey AS INTEGER) AS day, 'official' AS benchmark, n_nationkey * 10.0 + 1 AS fix, n_nationkey * 10.0 AS p25, n_nationkey % 3 = 0 AS withheld FROM nation WHERE n_nationkey % 5 < 4")
def s1_daily_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days by their file names; broken files and other names are passed over."""
    return landing.fix_rows(_fixes(spark, sf_dir)).select("day", "benchmark", "fix", "p25", "withheld")


@query("SELECT DATE '2024-01-01' + CAST(n_nationkey AS INTEGER) AS day, unnest(['a', n_name]) AS source, unnest([n_nationkey * 1.0, n_nationkey * 2.0])::DOUBLE AS median FROM nation WHERE n_nationkey % 5 < 4 AND n_nationkey > 16")
def s12_recent_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landing.recent_fixes(_fixes(spark, sf_dir), 7).select("day", "source", "median")


def _attempts(spark: SparkSession, sf_dir: str) -> str:
    at = _folder(spark)
    for k, name in _nations(spark, sf_dir):
        when = f"2024-01-{k % 3 + 1:02}T{k % 24:02}:00:00Z"
        sample = {"sampled_at": when, "benchmarks": {"official": k + 0.5, "open_market": k * 3.0}, "ok": k % 4 > 0 or None, "stale": k % 5 == 0, "quote_time": None}
        body = json.dumps({"date": when[:10], "collected_at": when, "sources": {"old" if k % 2 else name: {"sample": sample}}})
        landing.put_unique(spark, at, f"{k % 4:02}", body[: 30 if k % 11 == 10 else None])
    return at


@query("SELECT concat(lpad(CAST(n_nationkey % 4 AS VARCHAR), 2, '0'), CASE WHEN n_nationkey >= 4 THEN concat('-', CAST(n_nationkey // 4 AS VARCHAR)) ELSE '' END, '.json') AS file, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL (n_nationkey % 3 * 24 + n_nationkey % 24) HOUR AS collected_at FROM nation WHERE n_nationkey % 11 < 10")
def s2_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts with their files, each under a name of its own (K3)."""
    return landing.attempts(spark, _attempts(spark, sf_dir)).select(F.element_at(F.split("file", "/"), -1).alias("file"), F.col("collected_at").cast("timestamp_ntz").alias("collected_at"))


@query("SELECT CASE WHEN n_nationkey % 2 = 1 THEN 'new' ELSE n_name END AS source, unnest(['official', 'open_market']) AS benchmark, unnest([n_nationkey + 0.5, n_nationkey * 3.0])::DOUBLE AS value, n_nationkey % 4 > 0 AS ok, n_nationkey % 5 = 0 AS stale FROM nation WHERE n_nationkey % 11 < 10")
def s4_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of attempts in rows, sources by their present names."""
    return landing.samples(landing.attempts(spark, _attempts(spark, sf_dir)), {"old": "new"}).select("source", "benchmark", "value", "ok", "stale")


@query("SELECT DATE '2024-01-01' + CAST(n_nationkey AS INTEGER) AS day, CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE n_nationkey * 1000.0 END AS fix, n_nationkey % 2 = 0 AS withheld FROM nation WHERE n_nationkey % 6 < 5")
def s6_series_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _folder(spark)
    rows = [{"date": f"2024-01-{k + 1:02}" if k % 6 < 5 else "soon", "fix": f"{k},000" if k % 4 else "-", "withheld": ("Yes" if k % 2 == 0 else "no")} for k, _ in _nations(spark, sf_dir)]
    landing.put_text(spark, f"{at}/series.json", json.dumps({"rows": rows}))
    return landing.series_rows(spark, f"{at}/series.json").select("day", "fix", "withheld")


@query("SELECT DATE '2024-01-01' + CAST(n_nationkey AS INTEGER) AS day, n_nationkey * 1.0 AS value FROM nation WHERE n_nationkey % 3 > 0 AND n_nationkey % 7 > 0")
def s5_value_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _folder(spark)
    landing.put_text(spark, f"{at}/v.json", json.dumps([{"date": f"2024-01-{k + 1:02}" if k % 3 else "x", "value": str(k) if k % 7 else "-5"} for k, _ in _nations(spark, sf_dir)]))
    return landing.value_series(spark, f"{at}/v.json")


@query("SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name, CAST(s_nationkey AS VARCHAR) AS s_nationkey FROM supplier")
def s7_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV table written in a fixed order (K2), read as text."""
    at = _folder(spark)
    landing.write_csv(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey"), f"{at}/csv", ["s_suppkey"])
    return landing.csv_strings(spark, f"{at}/csv")


@query("SELECT concat('h', CAST(s_nationkey AS VARCHAR)) AS handle, CAST(max(s_suppkey) AS VARCHAR) AS last FROM supplier GROUP BY s_nationkey")
def s8_keyed_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of rows with one key the last of the file."""
    at = _folder(spark)
    landing.write_csv(table(spark, sf_dir, "supplier").select(F.concat(F.lit(" H"), "s_nationkey").alias("handle"), F.col("s_suppkey").alias("last")), f"{at}/csv", ["last"])
    return landing.keyed_csv(spark, f"{at}/csv", "handle")


@query("SELECT n_name AS name, CASE WHEN n_nationkey % 3 = 0 THEN n_nationkey END AS n FROM nation")
def s9_json_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that are no JSON object count as an empty one."""
    at = _folder(spark)
    for k, name in _nations(spark, sf_dir):
        landing.put_text(spark, f"{at}/{name}.json", json.dumps({"n": k}) if k % 3 == 0 else "[1]" if k % 3 == 1 else "{broken")
    read = landing.json_text(spark, at)
    return read.select(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.json$", "").alias("name"), F.get_json_object("body", "$.n").cast("int").alias("n")).withColumn("name", F.replace("name", F.lit("%20"), F.lit(" ")))


@query("SELECT concat('telegram:', n_name) AS key, n_nationkey AS best FROM nation")
def s10_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry's sources, and none of one that isn't there."""
    at = _folder(spark)
    landing.put_text(spark, f"{at}/registry.json", json.dumps({"sources": [{"key": f"telegram:{name}", "best_usable_record_count": k} for k, name in _nations(spark, sf_dir)]}))
    both = landing.registry_sources(spark, f"{at}/registry.json").unionByName(landing.registry_sources(spark, f"{at}/none.json"))
    return both.select("key", F.col("best_usable_record_count").cast("int").alias("best"))


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN o_orderkey WHEN 1 THEN o_orderkey + 1 END AS v FROM orders")
def s13_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON bodies, bodies that assign an object to a variable, and others."""
    k = F.col("o_orderkey")
    body = F.when(k % 3 == 0, F.concat(F.lit('{"v": '), k, F.lit("}"))).when(k % 3 == 1, F.concat(F.lit('x(); var lastrates = {"v": '), k + 1, F.lit("};"))).otherwise("<html>")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.get_json_object(landing.payload(body), "$.v").cast("bigint").alias("v"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN n_name END AS n_name FROM nation")
def k1_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _folder(spark)
    landing.write_json(table(spark, sf_dir, "nation").select("n_nationkey", F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).alias("n_name")), f"{at}/out")
    return spark.read.schema("n_nationkey int, n_name string").json(f"{at}/out")


@query("SELECT n_nationkey, n_name FROM nation")
def k4_write_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second write of a day is refused."""
    at, n = _folder(spark), table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    assert landing.write_once(n, at, "2024-01-01") and not landing.write_once(n.limit(1), at, "2024-01-01")
    return spark.read.parquet(f"{at}/day=2024-01-01")


@query("SELECT o_orderpriority AS key, CAST(max(o_orderdate) AS DATE) AS day, arg_max(o_orderkey, o_orderdate * 1) AS v, count(*) AS n FROM (SELECT o_orderpriority, o_orderkey, epoch_us(o_orderdate) // 86400000000 * 1000000000 + o_orderkey AS o_orderdate0, o_orderdate FROM orders) GROUP BY 1".replace("arg_max(o_orderkey, o_orderdate * 1)", "arg_max(o_orderkey, o_orderdate0)"))
def k5_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A series by key and its latest rows, read back."""
    at = _folder(spark)
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("key"), F.struct(F.to_date("o_orderdate").alias("day"), F.col("o_orderkey").alias("v")).alias("at"))
    landing.write_series(rows.select("key", "at"), at, "key", "at")
    n = spark.read.parquet(f"{at}/series").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return spark.read.parquet(f"{at}/latest").join(n, "key").select("key", "at.day", "at.v", "n")


@query("SELECT c_custkey, concat('https://x.org/a?', CASE WHEN c_custkey % 2 = 0 THEN 'api_key=***&z=' ELSE 'z=' END, CAST(c_custkey AS VARCHAR)) AS url FROM customer")
def k7_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", landing.redact(F.concat(F.lit("https://x.org/a?"), F.when(k % 2 == 0, F.concat(F.lit("api_key=s3cret"), k, F.lit("&z="))).otherwise("z="), k)).alias("url"))
