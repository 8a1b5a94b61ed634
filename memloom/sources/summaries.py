"""Stored run summaries."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memloom.operators.metrics import ANSWER_METRICS, EVIDENCE_METRICS

_RETRIEVAL = T.StructType([T.StructField("n_with_evidence", T.LongType()), *[T.StructField(m, T.DoubleType()) for m in EVIDENCE_METRICS]])
_GROUP = [
    T.StructField("n", T.LongType()),
    *[T.StructField(m, T.DoubleType()) for m in (*ANSWER_METRICS, "avg_memories_retrieved", "empty_retrieval_rate")],
    T.StructField("retrieval", _RETRIEVAL),
]
_RUN = T.StructType([T.StructField("combo", T.StringType()), *_GROUP, T.StructField("by_category", T.MapType(T.StringType(), T.StructType(_GROUP)))])
SUMMARY_SCHEMA = T.StructType([T.StructField("retrieval_k", T.IntegerType()), T.StructField("runs", T.ArrayType(_RUN))])


def load_runs(spark: SparkSession, run_dir: str) -> DataFrame:
    """``retrieval_k, run_pos, combo, level, category, metrics...`` of a folder's summary.json; a later run of a name wins.

    The schema is explicit, since whole means are written without a decimal point.  A folder without a summary is a
    FileNotFoundError.
    """
    path = Path(run_dir) / "summary.json"
    if not path.exists():
        raise FileNotFoundError(f"no summary.json in {run_dir}")
    raw = spark.read.schema(SUMMARY_SCHEMA).option("multiLine", True).json(str(path))
    runs = raw.select(F.coalesce("retrieval_k", F.lit(5)).alias("retrieval_k"), F.posexplode("runs").alias("run_pos", "r"))
    runs = runs.groupBy("retrieval_k", "r.combo").agg(F.max("run_pos").alias("run_pos"), F.max_by("r", "run_pos").alias("r"))
    names = ["n", *ANSWER_METRICS, "avg_memories_retrieved", "empty_retrieval_rate"]
    inner = ["n_with_evidence", *EVIDENCE_METRICS]

    def columns(of: str) -> list:
        return [*[F.col(f"{of}.{c}").alias(c) for c in names], *[F.col(f"{of}.retrieval.{c}").alias(c) for c in inner]]

    overall = runs.select("retrieval_k", "run_pos", "combo", F.lit("overall").alias("level"), F.lit(None).cast("int").alias("category"), *columns("r"))
    by = runs.select("retrieval_k", "run_pos", "combo", F.explode("r.by_category").alias("c", "g"))
    return overall.unionByName(by.select("retrieval_k", "run_pos", "combo", F.lit("category").alias("level"), F.col("c").try_cast("int").alias("category"), *columns("g")))


def latest_run(root: str) -> Path | None:
    """The newest folder under ``root``, by the time of its last change."""
    folders = [p for p in Path(root).glob("*") if p.is_dir()]
    return max(folders, key=lambda p: p.stat().st_mtime, default=None)
