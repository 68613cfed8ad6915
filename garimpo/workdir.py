"""Materialised intermediate tables in the folder all executors share.

A plan that is read more than once, or that loops, is cut by writing a table
instead of relying on cached blocks: a lost executor then costs a re-read and
not a recomputation. The folder is the session's ``spark.checkpoint.dir``;
only where that is unset (local tests) a temporary one is chosen.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
_written: list[tuple[object, str]] = []
_tables: list[str] = []


def checkpoint_root(spark: SparkSession) -> str:
    """URI of the shared folder of this session, set up if it is missing."""
    root = spark.conf.get(_KEY, None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local"):
            raise ValueError(f"{_KEY} must name a folder that all executors share (master {master})")
        root = "file://" + tempfile.mkdtemp(prefix="garimpo-")
        spark.conf.set(_KEY, root)
    if "://" not in root and not root.startswith("file:"):
        root = "file://" + root if root.startswith("/") else root
    return root.rstrip("/")


def new_path(spark: SparkSession, label: str = "table") -> str:
    """A fresh path under the shared folder; removed when the driver exits."""
    path = f"{checkpoint_root(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(cleanup)
    _written.append((spark, path))
    return path


def materialize(df: DataFrame, label: str = "table", partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and return the table read back."""
    spark = df.sparkSession
    path = new_path(spark, label)
    writer = df.write.option("compression", "snappy")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores if it comes in fewer parts, as a table of a few small files does; else as it is.

    For tables as they are read: a plan with exchanges would be run to count its parts. A table that
    fills the cluster is never moved by this, and results don't depend on it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def bucketed(df: DataFrame, key: str, buckets: int, label: str = "table") -> DataFrame:
    """Write ``df``, already partitioned by ``key`` in that number, to the shared folder as a table bucketed by it.

    Joins and groupings by the key then move none of its rows.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    name = f"garimpo_{path.rsplit('-', 1)[1]}"
    df.write.format("parquet").option("path", path).bucketBy(buckets, key).saveAsTable(name)
    _tables.append(name)
    return spark.table(name)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a path under the shared folder, whatever file system holds it."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def cleanup() -> None:
    """Remove all tables that this driver wrote; quiet once the session is gone."""
    while _written:
        spark, path = _written.pop()
        try:
            while _tables:
                spark.sql(f"drop table if exists {_tables.pop()}")
            delete(spark, path)
        except Exception:  # the JVM may already be gone
            return


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package, once for each application.

    Spark serves the archive to the executors itself, so that no folder on
    their machines has to hold the package.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    home = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="garimpo-")) / f"{home.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(home.rglob("*.py")):
            z.write(source, Path(home.name) / source.relative_to(home))
    spark.sparkContext.addPyFile(str(archive))
    atexit.register(shutil.rmtree, archive.parent, ignore_errors=True)  # served from there while the application lives
