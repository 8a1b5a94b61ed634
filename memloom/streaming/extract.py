"""Extraction over a stream of turns, and retrieval against a stored set of memories."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from memloom.operators.extract import extract
from memloom.operators.sparse import bm25_topk


def read_turns(spark: SparkSession, folder: str, schema) -> DataFrame:
    """Turns as files arrive in a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def deduplicated(turns: DataFrame, *, delay: str = "10 days") -> DataFrame:
    """Drops redelivered turns that come within ``delay``; the state of older ids is forgotten."""
    return turns.withColumn("_at", F.col("ingested_at").cast("timestamp")).withWatermark("_at", delay).dropDuplicatesWithinWatermark(["turn_id"]).drop("_at")


def stream_memories(turns: DataFrame, name: str, *, with_timestamp: bool = False) -> DataFrame:
    """The extractors are narrow, so they run on a stream unchanged; memories are keyed by their turn, not numbered."""
    return extract(turns, name, with_timestamp=with_timestamp, number=False).drop("mem_idx")


def answer_stream(questions: DataFrame, memories: DataFrame, sink: Callable[[DataFrame, int], None], *, k: int = 5, checkpoint: str) -> StreamingQuery:
    """Retrieves for each micro-batch of questions against the stored memories and hands the result to ``sink``."""

    def batch(rows: DataFrame, number: int) -> None:
        sink(bm25_topk(memories, rows, k), number)

    return questions.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()
