"""Filling fixed-capacity containers with the texts of a corpus.

Texts of one length are interchangeable, so a packing is a plan over the histogram of lengths, whose size is the
capacity and not the corpus.  The plan: enumerate combinations of at most three distinct lengths that fill the
window, solve by non-negative least squares how often each is to be repeated against the histogram, round down,
and pack what is left greedily, largest first.  Each text then finds its container from its rank among the texts
of its length; ranks come from counters in the reading tasks and the offsets of the tasks, so that no group of
equal lengths is ever gathered.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memloom.llm.tokenizers import TOKENIZER_DIR, encoder, rank_bytes, word_text, words
from memloom.workspace import in_arrow, materialize

#: Distinct words whose sizes a task remembers before it forgets them all.
CACHED_WORDS = 300_000
#: Second lengths tried for each first length, and rounds of the least-squares solver.
PARTNERS = 12
ROUNDS = 400


@dataclass
class Plan:
    """``k`` containers from ``base`` on take ``per`` items each of a length's ranks ``start .. start + k * per``."""

    length: np.ndarray
    start: np.ndarray
    base: np.ndarray
    per: np.ndarray
    n_containers: int


def _combinations(hist: np.ndarray, capacity: int) -> list[dict[int, int]]:
    """Combinations of up to three distinct lengths that fill the capacity exactly."""
    present = np.flatnonzero(hist[1:]) + 1
    mass = np.cumsum(hist[present] * present)
    at = np.unique(np.searchsorted(mass, np.linspace(0, mass[-1], PARTNERS + 2)[1:-1]))
    partners = present[np.minimum(at, len(present) - 1)]
    seen: set[tuple] = set()
    found: list[dict[int, int]] = []

    def keep(parts: list[tuple[int, int]]) -> None:
        combo: dict[int, int] = {}
        for length, times in parts:
            if times:
                combo[length] = combo.get(length, 0) + times
        key = tuple(sorted(combo.items()))
        if key not in seen and all(hist[x] >= n for x, n in combo.items()):
            seen.add(key)
            found.append(combo)

    for first in map(int, present[::-1]):
        most = capacity // first
        for times in sorted({most, most - 1, (most + 1) // 2, 1} - {0}):
            rest = capacity - times * first
            if rest == 0 or hist[rest]:
                keep([(first, times), (rest, 1 if rest else 0)])
            for second in map(int, partners):
                fits = rest // second
                for again in {fits, max(fits - 1, 0), (fits + 1) // 2} - {0}:
                    third = rest - again * second
                    if third >= 0 and (third == 0 or hist[third]):
                        keep([(first, times), (second, again), (third, 1 if third else 0)])
    return found


def _repeat_counts(combos: list[dict[int, int]], hist: np.ndarray) -> np.ndarray:
    """Non-negative least squares ``min |W (A x - h)|`` by multiplicative updates on the sparse columns."""
    col = np.concatenate([np.full(len(c), i) for i, c in enumerate(combos)])
    row = np.concatenate([np.fromiter(c.keys(), int) for c in combos])
    val = np.concatenate([np.fromiter(c.values(), float) for c in combos])
    weight = 1.0 / np.maximum(hist, 1.0)
    x = np.full(len(combos), hist.sum() / max(len(combos), 1) / 4.0)
    target = np.bincount(col, val * (weight * hist)[row], len(combos))
    for _ in range(ROUNDS):
        fit = np.bincount(row, val * x[col], len(hist))
        x *= target / np.maximum(np.bincount(col, val * (weight * fit)[row], len(combos)), 1e-12)
    return x


def plan_packing(histogram: np.ndarray, capacity: int) -> Plan:
    """Containers for ``histogram[length]`` items of each length from 1 to ``capacity``."""
    left = np.asarray(histogram, np.int64).copy()
    left[0] = 0
    taken = np.zeros(capacity + 1, np.int64)
    rows: list[tuple[int, int, int, int]] = []
    n = 0

    def use(combo: dict[int, int], times: int) -> None:
        nonlocal n
        for length, per in combo.items():
            rows.append((length, int(taken[length]), n, per))
            taken[length] += times * per
            left[length] -= times * per
        n += times

    if left.sum():
        combos = _combinations(left, capacity)
        if combos:
            counts = np.floor(_repeat_counts(combos, left.astype(float))).astype(np.int64)
            for i in np.argsort(-counts, kind="stable"):
                times = min(int(counts[i]), min(int(left[length]) // per for length, per in combos[i].items()))
                if times > 0:
                    use(combos[i], times)
        while left.any():
            combo: dict[int, int] = {}
            room = capacity
            for length in map(int, np.flatnonzero(left)[::-1]):
                if length <= room and (per := min(room // length, int(left[length]))):
                    combo[length] = per
                    room -= per * length
            use(combo, min(int(left[length]) // per for length, per in combo.items()))
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return Plan(table[:, 0], table[:, 1], table[:, 2], table[:, 3], n)


def containers_of(plan: Plan, lengths: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The container of the item with each rank among the items of its length."""
    stride = max(int(plan.start.max(initial=0)), int(ranks.max(initial=0))) + 1
    i = np.searchsorted(plan.length * stride + plan.start, lengths * stride + ranks, side="right") - 1
    return plan.base[i] + (ranks - plan.start[i]) // plan.per[i]


class _Sizes(dict):
    """Token count of each word key, computed when first asked for."""

    def __init__(self, encode) -> None:
        super().__init__()
        self.encode = encode

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self.encode(word_text(key)))
        return n


def _measure(ranks_of, capacity: int, id_type: pa.DataType):
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        sizes = _Sizes(encoder(ranks_of.value))
        seen = [0] * (capacity + 1)
        for batch in batches:
            ids, pieces, lengths, local = [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                n = sum(map(sizes.__getitem__, words(text.as_py() or "")))
                if len(sizes) > CACHED_WORDS:
                    sizes.clear()
                for piece in range(max(1, -(-n // capacity))):
                    length = min(capacity, n - piece * capacity)
                    ids.append(doc)
                    pieces.append(piece)
                    lengths.append(length)
                    local.append(seen[length])
                    seen[length] += 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, id_type),
                    pa.array(pieces, pa.int32()),
                    pa.array(lengths, pa.int32()),
                    pa.array([task] * len(ids), pa.int32()),
                    pa.array(local, pa.int64()),
                ],
                ["id", "piece_no", "n_tokens", "task", "local_rank"],
            )

    return measure


def pack_corpus(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, tokenizer: str = "byte_bpe_50k", tokenizer_dir: str = TOKENIZER_DIR
) -> DataFrame:
    """``id_col, piece_no, n_tokens, container`` of every text, or of every piece of a text above the capacity.

    A text longer than the capacity is cut into full pieces and one that holds the rest; any other is whole in one
    container.  Null and empty texts have no tokens and take no room: they are put into container 0.  Repeated rows
    are items of their own; an empty table gives no rows.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType
    id_type = {T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.StringType: pa.string()}[type(kind)]
    ranks = spark.sparkContext.broadcast(rank_bytes(tokenizer, tokenizer_dir))
    items = in_arrow(docs.select(id_col, text_col), _measure(ranks, capacity, id_type), f"id {kind.simpleString()}, piece_no int, n_tokens int, task int, local_rank bigint")
    items = materialize(items, "sizes")
    by_task = items.groupBy("task", "n_tokens").agg(F.count("*").alias("n"))
    before = Window.partitionBy("n_tokens").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_task.select("task", "n_tokens", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    # The histogram has at most capacity + 1 rows, whatever the corpus.
    histogram = np.zeros(capacity + 1, np.int64)
    for length, n in by_task.groupBy("n_tokens").agg(F.sum("n")).collect():
        histogram[length] = n
    plan = spark.sparkContext.broadcast(plan_packing(histogram, capacity))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, rank = batch.column(2).to_numpy().astype(np.int64), batch.column(3).to_numpy()
            container = np.zeros(len(lengths), np.int64)
            filled = lengths > 0
            if filled.any():
                container[filled] = containers_of(plan.value, lengths[filled], rank[filled])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(container)], [id_col, "piece_no", "n_tokens", "container"])

    # Offsets grow with the number of tasks: merged, not sent to every task.
    ranked = items.join(offsets.hint("merge"), ["task", "n_tokens"]).select("id", "piece_no", "n_tokens", (F.col("local_rank") + F.col("offset")).alias("rank"))
    return ranked.mapInArrow(place, f"{id_col} {kind.simpleString()}, piece_no int, n_tokens int, container bigint")


def packing_report(packed: DataFrame, *, capacity: int = 2048) -> DataFrame:
    """One row: containers, tokens, the least possible number of containers, and the share of room left."""
    per = packed.filter("n_tokens > 0").groupBy("container").agg(F.sum("n_tokens").alias("used"))
    return per.agg(
        F.count("*").alias("n_containers"),
        F.coalesce(F.sum("used"), F.lit(0)).alias("n_tokens"),
        F.ceil(F.coalesce(F.sum("used"), F.lit(0)) / F.lit(capacity)).alias("least_containers"),
        F.coalesce(F.max("used"), F.lit(0)).alias("fullest"),
        F.round(1 - F.coalesce(F.sum("used"), F.lit(0)) / (F.count("*") * F.lit(capacity)), 6).alias("room_left"),
    )
