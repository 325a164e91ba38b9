"""Spark sessions for the engine, and making the package importable on executors."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Bytes of an Arrow batch. Spark's own bound is 64 MB, which a worker would hold several times over.
BATCH_BYTES = 4 << 20
BATCHES, BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"

_OWN: set[str] = set()
ROOT = str(Path(__file__).resolve().parent.parent)


def ship(spark: SparkSession) -> SparkSession:
    """Lets Python workers import the package from where the driver has it (a cluster passes it by --py-files instead)."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    return bound_batches(spark)


def bound_batches(spark: SparkSession) -> SparkSession:
    """Bounds the bytes of the batches that go to Python workers, where the session has no bound of its own."""
    if spark.conf.get(BATCHES) == BATCH_DEFAULT:
        spark.conf.set(BATCHES, f"{BATCH_BYTES}b")
    return spark


def local_session(cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for one machine, as tests and the bench use it; a cluster brings its own settings."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.driver.memory", memory)
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return ship(spark)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as a full URI: spark.checkpoint.dir, or, only where that is unset and the master
    is local, as in tests, one of our own, which is removed when the driver ends. So are this application's checkpoints."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    there = sc._jsc.sc().getCheckpointDir()
    if not named and not there.isDefined():
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="ratemill-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    if not there.isDefined():
        sc.setCheckpointDir(named)
    own = sc._jsc.sc().getCheckpointDir().get()  # a folder of this application alone
    if own not in _OWN:
        _OWN.add(own)
        atexit.register(remove, spark, own)
    at = sc._jvm.org.apache.hadoop.fs.Path(named or there.get())
    uri = at.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(at).toString()
    return re.sub("^file:/+", "file:///", uri)


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder of the shared one, if the session is still there to do it."""
    sc = spark.sparkContext
    if sc._jsc is not None:
        at = sc._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)
