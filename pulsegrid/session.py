"""Session defaults and stage tables."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Filters on the recording choose files before they are read.
    "spark.sql.python.filterPushdown.enabled": "true",
    # State that does not fit the heap, and `transformWithState`.
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # Segment rows hold about 600,000 samples: batches are bounded in bytes.
    "spark.sql.execution.arrow.maxBytesPerBatch": "64m",
}


def build_session(master: str | None = None, app: str = "pulsegrid", **conf: str) -> SparkSession:
    """A session with the library's defaults; `conf` keys use `_` for `.`."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **{k.replace("_", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_temporary_roots: dict[str, str] = {}


def stage_root(spark: SparkSession) -> str:
    """Shared folder for stage tables; a temporary one only where driver and executors are one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _temporary_roots:
        _temporary_roots[app] = tempfile.mkdtemp(prefix="pulsegrid-stage-")
    return _temporary_roots[app]


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once as Parquet in the shared folder and read it back.

    Cuts lineage across executor loss and, unlike a cached plan, keeps column
    pruning and filter pushdown for every later reader.
    """
    spark = df.sparkSession
    path = f"{stage_root(spark).rstrip('/')}/pulsegrid/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_stages(spark: SparkSession) -> None:
    """Remove all stage tables under the shared folder, once results that read them are written."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{stage_root(spark).rstrip('/')}/pulsegrid")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers; once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="pulsegrid-")) / "pulsegrid.zip"
    with zipfile.ZipFile(target, "w") as bundle:
        for source in sorted(package.rglob("*.py")):
            bundle.write(source, source.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)
