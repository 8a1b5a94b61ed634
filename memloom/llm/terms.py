"""Frequency of every distinct term, by burst-trie counting.

Each task counts its records into a burst trie: terms are routed by their first characters to compact containers
(suffix -> counters), and a container that grows beyond ``BURST`` suffixes bursts into one container for each next
character.  The containers are written once to the shared folder.  From their sizes follow the heavy prefixes,
those above a fixed share of all entries; every term is routed by its longest heavy prefix and one character more,
so that matching subtrees of all workers meet in groups, where they are merged.  A route that still holds more than
``ROUTE_ENTRIES`` entries is split by the hash of its terms, so a group is bounded whatever the terms and the number
of tasks are: only the entries of one term, one of each trie, have to meet.  A term of which a third of all rows
consist has one entry in each trie, never one per row.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.workspace import in_arrow, materialize

#: Suffixes in a container before it bursts.
BURST = 2048
#: Terms in a task's trie before it is written out and begun anew.
TRIE_TERMS = 400_000
#: Entries of matching subtrees that a group holds; a route with more is split by hash.
ROUTE_ENTRIES = 200_000
#: Bounds of the table of heavy prefixes, which the driver sends to the tasks: how many of each length it may hold and
#: how long they are.  They decide how fine routes are before the split by hash, not how large a group is.
MAX_ROUTES = 65_536
MAX_PREFIX = 24

#: Longest runs of letters (L), numbers (N) and ``_``: Python's ``\w`` is exactly these.
TERM = re.compile(r"\w+")

CONTAINERS = "src_field string, prefix string, suffixes array<string>, totals array<bigint>, records array<bigint>, n_texts bigint"
COUNTS = "src_field string, term string, n_total bigint, n_records bigint"


class BurstTrie:
    """Occurrence and record counters of terms, in containers under adaptive prefixes."""

    def __init__(self, burst: int = BURST) -> None:
        self.burst, self.root, self.size = burst, {}, 0
        self.inner: set[int] = set()

    def add(self, term: str, total: int, records: int) -> None:
        node, depth = self.root, 0
        while id(node) in self.inner:
            if depth == len(term):
                node, depth = node.setdefault("", {}), depth
                break
            node, depth = node.setdefault(term[depth], {}), depth + 1
        suffix = term[depth:]
        counts = node.get(suffix)
        if counts is None:
            node[suffix] = [total, records]
            self.size += 1
            if len(node) > self.burst:
                self._split(node)
        else:
            counts[0] += total
            counts[1] += records

    def _split(self, node: dict) -> None:
        old = list(node.items())
        node.clear()
        self.inner.add(id(node))
        for suffix, counts in old:
            node.setdefault(suffix[:1], {})[suffix[1:]] = counts
        for key, child in node.items():
            if key and len(child) > self.burst:
                self._split(child)

    def containers(self) -> Iterator[tuple[str, dict[str, list[int]]]]:
        stack = [("", self.root)]
        while stack:
            prefix, node = stack.pop()
            if id(node) in self.inner:
                stack.extend((prefix + c, child) for c, child in node.items())
            elif node:
                yield prefix, node


def _rows(field: str, trie: BurstTrie, n_texts: int) -> pa.RecordBatch:
    columns: list[list] = [[] for _ in range(6)]
    for prefix, node in trie.containers():
        suffixes = sorted(node)
        for column, value in zip(columns, (field, prefix, suffixes, [node[s][0] for s in suffixes], [node[s][1] for s in suffixes], 0)):
            column.append(value)
    for column, value in zip(columns, (field, "", [], [], [], n_texts)):
        column.append(value)
    kinds = (pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64())
    names = [part.split()[0] for part in CONTAINERS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tries: dict[str, tuple[BurstTrie, list[int]]] = {}
    for batch in batches:
        by_field: dict[str, tuple[Counter, Counter]] = {}
        for field, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            totals, records = by_field.setdefault(field, (Counter(), Counter()))
            terms = TERM.findall(text.lower())
            totals.update(terms)
            records.update(set(terms))
            if field not in tries:
                tries[field] = (BurstTrie(), [0])
            tries[field][1][0] += 1
        for field, (totals, records) in by_field.items():
            trie, n_texts = tries[field]
            for term, total in totals.items():
                trie.add(term, total, records[term])
            if trie.size > TRIE_TERMS:
                yield _rows(field, trie, n_texts[0])
                del tries[field]
    for field, (trie, n_texts) in tries.items():
        yield _rows(field, trie, n_texts[0])


def _router(heavy: dict[str, set[str]]):
    def route(field: str, term: str) -> str:
        known, k = heavy.get(field, ()), 0
        while k < len(term) and term[:k] in known:
            k += 1
        return term[:k]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for field, prefix, suffixes, totals, records in zip(*(batch.column(i).to_pylist() for i in range(5))):
                parts: dict[str, list[int]] = {}
                if prefix in heavy.get(field, ()):
                    for i, suffix in enumerate(suffixes):
                        parts.setdefault(route(field, prefix + suffix), []).append(i)
                else:
                    parts[route(field, prefix)] = list(range(len(suffixes)))
                keys = list(parts)
                terms = [[(prefix + suffixes[i])[len(k) :] for i in parts[k]] for k in keys]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([field] * len(keys), pa.string()),
                        pa.array(keys, pa.string()),
                        pa.array(terms, pa.list_(pa.string())),
                        pa.array([[totals[i] for i in parts[k]] for k in keys], pa.list_(pa.int64())),
                        pa.array([[records[i] for i in parts[k]] for k in keys], pa.list_(pa.int64())),
                    ],
                    ["src_field", "route", "suffixes", "totals", "records"],
                )

    return split


def _split_heavy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut the subtrees of heavy routes (more than one split) by the hash of their suffixes."""
    for batch in batches:
        if max(batch.column(5).to_pylist(), default=1) <= 1:
            part = pa.array([0] * batch.num_rows, pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], part], ["src_field", "route", "suffixes", "totals", "records", "part"])
            continue
        columns: list[list] = [[] for _ in range(6)]
        for field, route, *values, splits in zip(*(batch.column(i).to_pylist() for i in range(6))):
            parts: dict[int, list[int]] = {}
            for i, suffix in enumerate(values[0]):
                parts.setdefault(zlib.crc32(suffix.encode("utf-8", "surrogatepass")) % splits, []).append(i)
            for part, chosen in parts.items():
                for column, value in zip(columns, (field, route, *([v[i] for i in chosen] for v in values), part)):
                    column.append(value)
        kinds = (pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["src_field", "route", "suffixes", "totals", "records", "part"])


def _merge(key, table):
    """Merge the matching subtrees of one route: equal suffixes add up their counters."""
    field, prefix = (k.as_py() for k in key[:2])
    flat = pa.table({name: pc.list_flatten(table.column(name)) for name in ("suffixes", "totals", "records")})
    merged = flat.group_by("suffixes").aggregate([("totals", "sum"), ("records", "sum")])
    term = pc.binary_join_element_wise(pa.scalar(prefix), merged.column("suffixes").cast(pa.string()), "")
    return pa.table(
        {
            "src_field": pa.array([field] * len(merged), pa.string()),
            "term": term,
            "n_total": merged.column("totals_sum"),
            "n_records": merged.column("records_sum"),
        }
    )


def _prefixes(prefix: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.least(F.length(prefix), F.lit(MAX_PREFIX))), lambda k: F.substring(prefix, F.lit(1), k))


def matching_subtrees(tries: DataFrame) -> DataFrame:
    """``src_field, route, suffixes, totals, records, part``: entries that belong to one route and part are merged together."""
    filled = tries.filter(F.size("suffixes") > 0)
    entries = filled.agg(F.coalesce(F.sum(F.size("suffixes")), F.lit(0))).first()[0]
    share = max(ROUTE_ENTRIES, entries // MAX_ROUTES + 1)
    weights = (
        filled.groupBy("src_field", "prefix").agg(F.sum(F.size("suffixes")).alias("n"))
        .select("src_field", F.explode(_prefixes(F.col("prefix"))).alias("prefix"), "n")
        .groupBy("src_field", "prefix").agg(F.sum("n").alias("n"))
    )
    heavy: dict[str, set[str]] = {}
    # At most entries/share <= MAX_ROUTES prefixes of each length can be heavy.
    for field, prefix, _ in weights.filter(F.col("n") > share).collect():
        heavy.setdefault(field, set()).add(prefix)
    entry = "src_field string, route string, suffixes array<string>, totals array<bigint>, records array<bigint>"
    routed = in_arrow(filled.select("src_field", "prefix", "suffixes", "totals", "records"), _router(heavy), entry)
    # The routes to split stay a table, as their number grows with the collection; it is sent to the tasks while it is small.
    splits = F.ceil(F.sum(F.size("suffixes")) / ROUTE_ENTRIES).cast("int")
    large = materialize(routed.groupBy("src_field", "route").agg(splits.alias("splits")).filter("splits > 1"), "routes")
    if large.count() <= MAX_ROUTES:
        large = F.broadcast(large)
    sized = routed.join(large, ["src_field", "route"], "left").select("src_field", "route", "suffixes", "totals", "records", F.coalesce("splits", F.lit(1)).alias("splits"))
    return in_arrow(sized, _split_heavy, f"{entry}, part int")


def count_terms(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Counts of all terms of ``texts(src_field, text)``, and the number of texts of each field.

    Null texts are no records; a text without a term is a record.  Returns
    ``(src_field, term, n_total, n_records)`` and ``(src_field, n_texts)``.
    """
    texts = texts.select("src_field", "text").filter(F.col("text").isNotNull() & F.col("src_field").isNotNull())
    tries = materialize(in_arrow(texts, _count, CONTAINERS), "tries")
    n_texts = tries.groupBy("src_field").agg(F.sum("n_texts").alias("n_texts"))
    return matching_subtrees(tries).groupBy("src_field", "route", "part").applyInArrow(_merge, COUNTS), n_texts


def one_per_record(df: DataFrame, id_col: str, text_col: str, arrived: str, src_field: str) -> DataFrame:
    """``(src_field, text)`` of each record: of rows with one id the earliest; a row with a null id is a record of its own."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(arrived).alias("at")).filter("text is not null")
    known = rows.filter("id is not null").groupBy("id").agg(F.min_by("text", F.struct(F.coalesce(F.col("at").cast("string"), F.lit("9")), "text")).alias("text"))
    return known.select("text").unionByName(rows.filter("id is null").select("text")).select(F.lit(src_field).alias("src_field"), "text")


def term_frequencies(texts: DataFrame, *, rare_records: int = 2, common_share: float = 0.1) -> DataFrame:
    """``src_field, term, n_total, n_records, mark`` of every field and distinct term.

    ``mark`` is ``rare`` up to ``rare_records`` records, else ``common`` above ``common_share`` of the field's
    records with a text, else ``usual``.  An empty table gives no rows.
    """
    counts, n_texts = count_terms(texts)
    mark = (
        F.when(F.col("n_records") <= rare_records, "rare")
        .when(F.col("n_records") > F.col("n_texts") * F.lit(common_share), "common")
        .otherwise("usual")
    )
    # One row for each field: the fields are a parameter, so this side can always be broadcast.
    return counts.join(F.broadcast(n_texts), "src_field").select("src_field", "term", "n_total", "n_records", mark.alias("mark"))
