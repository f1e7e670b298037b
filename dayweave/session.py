"""Session settings shared by batch jobs, streams and tests."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

# Runtime settings every job relies on: UTC clocks, adaptive plans, skew splitting.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def prepare(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", app: str = "dayweave", shuffle_partitions: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return ship(prepare(spark))


_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Gives the Python workers of this session the package, once per application.

    A session started elsewhere need not have the package on its executors: Spark's own file
    server sends a zip of the sources to them.
    """
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        top = os.path.dirname(os.path.abspath(__file__))
        target = os.path.join(tempfile.mkdtemp(prefix="dayweave-code-"), "dayweave.zip")
        with zipfile.ZipFile(target, "w") as out:
            for folder, _, names in os.walk(top):
                for name in names:
                    if name.endswith(".py"):
                        path = os.path.join(folder, name)
                        out.write(path, os.path.relpath(path, os.path.dirname(top)))
        spark.sparkContext.addPyFile(target)
        _shipped.add(app)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the cluster; a scratch one only in local mode and if none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
    folder = named or tempfile.mkdtemp(prefix="dayweave-ckpt-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder in the shared checkpoint directory, which every executor and the driver see."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/dayweave/{name}-{uuid.uuid4().hex}"


def materialise(df, name: str):
    """Writes the rows to shared storage once and reads them back: no recomputation, no lineage before."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df, most_rows: int = 100_000):
    """Broadcast hint only where a count of the rows themselves proves the side small.

    For narrow rows such as bindings and members. The count stops one row past the bound; a larger
    side keeps the shuffle join.
    """
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df
