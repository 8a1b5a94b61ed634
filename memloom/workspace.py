"""Places for intermediate tables that every executor can reach.

On a cluster the folder is the one named in ``spark.checkpoint.dir``; only a local session without that setting
(tests, a laptop) gets a temporary folder, and a cluster without it an error.  Tables written here survive the loss
of an executor and cut lineage, so a recomputed stage never repeats the expensive part before it.
"""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOT: list[str] = []
_SHIPPED: set[str] = set()
_MADE: list[tuple[SparkSession, str]] = []


def root(spark: SparkSession) -> str:
    """The shared folder of the session: ``spark.checkpoint.dir``; where it is unset, a temporary folder of a local session."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    # The executors of a cluster don't see each other's temporary folders: rows written there would be lost.
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL_ROOT:
        _LOCAL_ROOT.append("file://" + tempfile.mkdtemp(prefix="memloom-"))
    return _LOCAL_ROOT[0]


def _forget(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session is gone; nothing is left to clean with
        pass


def _forget_all() -> None:
    while _MADE:
        _forget(*_MADE.pop())


atexit.register(_forget_all)


def materialize(df: DataFrame, name: str, *, file_format: str = "parquet", **options: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return it read back (zstd parquet if not said otherwise, removed at exit)."""
    spark = df.sparkSession
    path = f"{root(spark)}/memloom-{name}-{uuid.uuid4().hex}"
    df.write.format(file_format).options(**({"compression": "zstd"} if file_format == "parquet" else {}), **options).save(path)
    _MADE.append((spark, path))
    stored = spark.read.schema(df.schema).format(file_format).load(path)
    stored._stored_at = path
    return stored


def discard(*tables: DataFrame | None) -> None:
    """Remove tables of ``materialize`` that nothing will read any more (others are left alone)."""
    for stored in tables:
        path = stored.__dict__.pop("_stored_at", None) if stored is not None else None
        if path:
            _forget(stored.sparkSession, path)
            _MADE.remove((stored.sparkSession, path))


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of plans that nothing refers to any more: Spark removes them when the driver collects its garbage, which may be never."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def in_arrow(df: DataFrame, function, schema: str) -> DataFrame:
    """``mapInArrow`` with this package sent along to the Python workers."""
    ship_package(df.sparkSession)
    return df.mapInArrow(function, schema)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` in enough partitions for work that is heavy for its bytes (adaptive execution sizes partitions by bytes).

    The number is the session's shuffle partitions, which the cluster sets by the size of the data, and at least
    two for each core.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return df.repartition(n, *keys) if keys else df.repartition(n)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once for each application (it need not be installed there)."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    package = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="memloom-package-")
    atexit.register(shutil.rmtree, folder, True)
    sc.addPyFile(shutil.make_archive(os.path.join(folder, "memloom"), "zip", os.path.dirname(package), os.path.basename(package)))
