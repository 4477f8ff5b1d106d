"""Session defaults, scratch storage and size-checked broadcasting."""

from __future__ import annotations

import atexit
import contextlib
import io
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

#: Largest size in memory, in bytes, of a side that may be broadcast by hint, and how often the size of files counts for it.
BROADCAST_LIMIT, EXPANSION = 32 << 20, 4
#: Bytes of files from which a table is worth an exchange to give all cores work.
SPREAD_FROM = 1 << 20


def build_session(app: str = "tidelot", cores: int | str = "*", memory: str = "8g", **conf: str) -> SparkSession:
    """A local session with the settings the engine is written for; a cluster passes its own session instead."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.driver.memory": memory,
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        **conf,
    }
    return SparkSession.builder.master(f"local[{cores}]").appName(app).config(map=settings).getOrCreate()


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder of this session under the shared folder named by ``spark.checkpoint.dir``; all are deleted when the driver's process ends.

    Where that setting is unset a local session uses a folder of this machine; a session on a cluster is
    refused, as its executors could not read each other's files.
    """
    context = spark.sparkContext
    folder = getattr(context, "_tidelot_scratch", None)
    if folder is None:
        root = context.getConf().get("spark.checkpoint.dir", None)
        if not root:
            if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
                raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {context.master} share")
            root = tempfile.mkdtemp(prefix="tidelot-")
            context.setCheckpointDir(root)
        folder = f"{root.rstrip('/')}/tidelot-{uuid.uuid4().hex[:12]}"
        place = spark._jvm.org.apache.hadoop.fs.Path(folder)
        files = place.getFileSystem(spark._jsc.hadoopConfiguration())
        atexit.register(_delete, files, place)
        context._tidelot_scratch = folder
    return f"{folder}/{name}-{uuid.uuid4().hex[:12]}"


def _delete(files: Any, place: Any) -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone
        files.delete(place, True)


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan: for scans, the size of files, which are encoded and compressed."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """Hint a broadcast if the estimate, files counted `EXPANSION` times, is within the limit."""
    return F.broadcast(df) if EXPANSION * estimated_bytes(df) <= limit else df


def spread(df: DataFrame, *by: str) -> DataFrame:
    """`df` over all cores by the hash of `by`, if its files give fewer tasks than there are cores and it is large enough to matter."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if estimated_bytes(df) < SPREAD_FROM or df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *by)


def ship_package(spark: SparkSession) -> None:
    """Give this package to the session's Python workers, once, wherever they run and whatever their path holds."""
    context = spark.sparkContext
    if getattr(context, "_tidelot_shipped", False):
        return
    package = Path(__file__).parent
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f"{package.name}/{f.relative_to(package)}")
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{scratch_dir(spark, 'package')}/{package.name}.zip")
    stream = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place, True)
    try:
        stream.write(bytearray(raw.getvalue()))
    finally:
        stream.close()
    context.addPyFile(place.toString())
    context._tidelot_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def listing(spark: SparkSession, path: str) -> tuple:
    """Names, sizes and times of a table's files: what tells whether it changed."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(place)
    return tuple((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in files)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a plan once to scratch storage and read it back: cuts lineage, survives lost executors, serves several readers."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Staging:
    """Tables that are needed until a block ends: written under scratch storage like `materialise`, deleted together."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, scratch_dir(spark, name)

    def __enter__(self) -> Staging:
        return self

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def write_all(self, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """Several tables at once, as jobs side by side."""
        return at_once({n: lambda n=n, df=df: self.write(df, n) for n, df in tables.items()})

    def __exit__(self, *error: object) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def at_once(jobs: dict[str, Callable[[], Any]]) -> dict[str, Any]:
    """Results of independent jobs, run side by side: small jobs wait for each other's start-up otherwise."""
    inherit = inheritable_thread_target(SparkSession.active())
    with ThreadPoolExecutor(min(8, max(1, len(jobs)))) as pool:
        started = {n: pool.submit(inherit(job)) for n, job in jobs.items()}
        return {n: f.result() for n, f in started.items()}
