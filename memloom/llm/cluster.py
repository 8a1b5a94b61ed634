"""Clusters of near-equal texts: MinHash candidates, each verified, and the connected components of their links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.workspace import discard, in_arrow, materialize

#: Shingle length and the least similarity of two linked texts.
SHINGLE = 5
SIMILARITY = 0.8
#: MinHash: bands and rows in each; at 0.8 a pair shares a band with probability 0.9998.
BANDS, ROWS = 12, 3
#: Members of a bucket that one task compares; a larger bucket is compared chunk by chunk.
CHUNK = 1000

_RANDOM = np.random.default_rng(20)
_FACTORS = _RANDOM.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _RANDOM.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)


def shingles(text: Column) -> Column:
    """Distinct hashes of the runs of ``SHINGLE`` words; a shorter text is one shingle."""
    words = F.split(text, " ")
    starts = F.sequence(F.lit(1), F.greatest(F.size(words) - (SHINGLE - 1), F.lit(1)))
    return F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice(words, i, SHINGLE), " "))))


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each band of a text."""
    for batch in batches:
        for start in range(0, batch.num_rows, 2000):
            part = batch.slice(start, 2000)
            lists = part.column(1)
            hashes = lists.flatten().to_numpy(zero_copy_only=False).astype(np.uint64)
            sizes = np.asarray(lists.value_lengths())
            mixed = (hashes[:, None] * _FACTORS + _SHIFTS) >> np.uint64(32)
            least = np.minimum.reduceat(mixed, np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0)
            key = np.zeros((len(sizes), BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)
            for row in range(ROWS):
                key = key * np.uint64(0x9E3779B97F4A7C15) + least[:, row::ROWS]
            at = pa.array(np.repeat(np.arange(len(sizes)), BANDS))
            yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64).ravel()), part.column(0).take(at)], ["bucket", "node"])


def _linked(members: list[tuple[int, frozenset]]) -> list[tuple[int, int]]:
    """Links that connect whatever is connected among the members: each to the least of its component."""
    parts: list[list[tuple[int, frozenset]]] = []
    for node, own in members:
        apart, joined = [], [(node, own)]
        for part in parts:
            alike = False
            for _, other in part:
                both = len(own & other)
                if both and both >= SIMILARITY * (len(own) + len(other) - both):
                    alike = True
                    break
            if alike:
                joined.extend(part)
            else:
                apart.append(part)
        parts = [*apart, joined]
    links = []
    for part in parts:
        least = min(node for node, _ in part)
        links.extend((node, least) for node, _ in part if node != least)
    return links


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare the members of each bucket (or pair of chunks), which arrive one after the other."""
    key, members, links = None, [], []
    for batch in batches:
        for *at, node, hashes in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if at != key:
                links.extend(_linked(members))
                key, members = at, []
            members.append((node, frozenset(hashes)))
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], ["a", "b"])
        links = []
    links = _linked(members)
    yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], ["a", "b"])


def similar_links(texts: DataFrame) -> DataFrame:
    """``a, b``: links between the ``node`` of ``texts(node, shingles)`` by which all verified pairs are connected.

    Every two members of a bucket are compared unless a verified path joins them already; only links to the least
    member of what is connected are given, never all pairs.  A bucket beyond ``CHUNK`` members is cut into chunks and
    each two of them are compared in a group of their own, so no task holds more than two chunks.
    """
    members = materialize(in_arrow(texts.select("node", "shingles"), _buckets, "bucket bigint, node bigint"), "buckets")
    shared = members.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    mine = F.pmod(F.xxhash64("node", F.lit(7)), F.col("chunks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: F.struct(F.least(c, F.col("mine")).alias("low"), F.greatest(c, F.col("mine")).alias("high")))
    kept = members.join(shared, "bucket").withColumn("chunks", chunks).withColumn("mine", mine)
    placed = kept.select("node", "bucket", F.inline(pairs)).join(texts.select("node", "shingles"), "node")
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grouped = placed.select("bucket", "low", "high", "node", "shingles").repartition(n, "bucket", "low", "high").sortWithinPartitions("bucket", "low", "high", "node")
    links = materialize(in_arrow(grouped, _compare, "a bigint, b bigint").distinct(), "links")
    discard(members)
    return links


def components(links: DataFrame) -> DataFrame:
    """``node, root`` of every node of ``links(a, b)``: the least node of its connected component.

    Large-star and small-star steps (Kiveris et al. 2014) by turns, written after each round, until nothing moves;
    the number of rounds grows with the logarithm of a component's size, not with its diameter.
    """
    edges, before = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), None
    stored = None
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("least"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("least").alias("b")), F.struct("a", F.col("least").alias("b")))).alias("e")).select("e.*")
        moved = materialize(small.filter("a <> b").distinct(), "stars")
        after = tuple(moved.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        discard(stored)
        edges = stored = moved
        if after == before:
            return moved.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = after
