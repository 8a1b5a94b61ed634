"""References to records that do not exist, by runs of parent keys and as-of matching.

Parent keys are integers inside a space (kind of parent, conversation, group).  Sorted keys are compressed into
runs of contiguous integers; a reference is matched as-of to the run that starts at or before its key and is an
orphan beyond that run's end.  A run also carries when its first and last key became visible, so that it settles
almost every reference in time as well; only references that fall between these two moments, or on keys with
removed rows, are checked against the single rows (again as-of, this time along the time axis).

Scale: parents and references are each combined by key before any window, so that a window holds at most ``BUCKET``
keys and runs of a space, whatever the number of rows of a key; the verdict on a key is then joined to its references
(hot keys in the tasks that hold them).  Only references that have to be checked in time are sorted by key, a hot key's
in parts of ``PART_ROWS``, to each of which the key's own rows are repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.functions.ids import DIA_ID, evidence_ids, ids_in
from memloom.operators.skew import hot_join
from memloom.workspace import materialize

#: Keys of one space are cut into buckets of so many, so that no window grows with a space.
BUCKET = 4096
#: References of one key that are checked in time in one group.
PART_ROWS = 100_000

SPACE = ["kind", "conv_id", "odd", "grp"]
NEVER = "timestamp_ntz'9999-12-31 00:00:00'"


def _fits(digits: Column) -> Column:
    return F.length(digits) <= 18


def _turn_key(dia_id: Column) -> list[Column]:
    """Space and key of a turn id: session number and turn number; ids too long for integers get a space of their own."""
    n, m = F.regexp_extract(dia_id, DIA_ID, 1), F.regexp_extract(dia_id, DIA_ID, 2)
    fits = _fits(n) & _fits(m)
    return [
        F.when(fits, F.lit("")).otherwise(dia_id).alias("odd"),
        F.when(fits, n.try_cast("bigint")).otherwise(F.lit(0)).alias("grp"),
        F.when(fits, m.try_cast("bigint")).otherwise(F.lit(0)).alias("key"),
    ]


def _session_key(n: Column) -> list[Column]:
    n = n.cast("string")
    return [
        F.when(_fits(n), F.lit("")).otherwise(n).alias("odd"),
        F.lit(0).cast("bigint").alias("grp"),
        F.when(_fits(n), n.try_cast("bigint")).otherwise(F.lit(0)).alias("key"),
    ]


def _time(c: str) -> Column:
    return F.col(c).cast("timestamp_ntz")


def parents(turns: DataFrame, sessions: DataFrame) -> DataFrame:
    """Rows that can be referred to: ``kind, conv_id, odd, grp, key, ingested_at, deleted_at`` (never = 9999)."""
    life = [F.coalesce(_time("ingested_at"), F.expr(NEVER)).alias("ingested_at"), F.coalesce(_time("deleted_at"), F.expr(NEVER)).alias("deleted_at")]
    of_turns = (
        turns.filter(F.col("conv_id").isNotNull())
        .select("conv_id", F.explode(F.array_distinct(ids_in(F.col("dia_id")))).alias("dia_id"), *life)
        .select(F.lit("turn").alias("kind"), "conv_id", *_turn_key(F.col("dia_id")), "ingested_at", "deleted_at")
    )
    of_sessions = sessions.filter(F.col("conv_id").isNotNull() & F.col("session_no").isNotNull()).select(
        F.lit("session").alias("kind"), "conv_id", *_session_key(F.col("session_no")), *life
    )
    return of_turns.unionByName(of_sessions)


def references(qa_items: DataFrame, turns: DataFrame) -> DataFrame:
    """Distinct references of each record with its arrival ``t``: redelivered rows are one record, the earliest one."""
    of_qa = qa_items.select(
        F.lit("qa_items").alias("src_table"), F.col("qid").alias("row_id"), "conv_id", F.explode(F.array_distinct(evidence_ids(F.col("evidence_dia_ids")))).alias("dia_id"), _time("ingested_at").alias("t")
    )
    of_turns = turns.select(
        F.lit("turns").alias("src_table"), F.col("turn_id").alias("row_id"), "conv_id", F.explode(F.array_distinct(ids_in(F.col("dia_id")))).alias("dia_id"), _time("ingested_at").alias("t")
    )
    rows = of_qa.unionByName(of_turns).groupBy("src_table", "row_id", "conv_id", "dia_id").agg(F.min("t").alias("t"))
    to_turn = rows.filter(F.col("src_table") == "qa_items").select("*", F.lit("turn").alias("kind"), *_turn_key(F.col("dia_id")))
    to_session = rows.filter(F.col("src_table") == "turns").select("*", F.lit("session").alias("kind"), *_session_key(F.regexp_extract("dia_id", DIA_ID, 1)))
    return to_turn.unionByName(to_session)


def lives(rows: DataFrame) -> DataFrame:
    """Rows of ``parents`` combined by key and arrival: the latest and the earliest removal of those that arrived at once."""
    return rows.groupBy(*SPACE, "key", "ingested_at").agg(F.max("deleted_at").alias("deleted_at"), F.min("deleted_at").alias("first_deleted_at"))


def key_runs(rows: DataFrame) -> DataFrame:
    """Runs of contiguous keys of ``lives``: ``SPACE, bucket, run_start, run_end, seen_from, seen_all, mixed``.

    ``seen_from`` is when the run's first row arrived, ``seen_all`` from when all its keys are there for good; a
    key with a removed row is a run by itself, with ``mixed`` set.
    """
    keys = rows.groupBy(*SPACE, "key").agg(
        F.min("ingested_at").alias("first"),
        F.min("first_deleted_at").alias("gone"),
    )
    keys = keys.select(*SPACE, "key", _bucket(F.col("key")), "first", (F.col("gone") < F.expr(NEVER)).alias("mixed"))
    order = Window.partitionBy(*SPACE, "bucket").orderBy("key")
    fresh = (F.col("key") != F.lag("key").over(order) + 1) | F.col("mixed") | F.lag("mixed").over(order)
    keys = keys.withColumn("run", F.sum(F.coalesce(fresh, F.lit(True)).cast("int")).over(order))
    return keys.groupBy(*SPACE, "bucket", "run").agg(
        F.min("key").alias("run_start"),
        F.max("key").alias("run_end"),
        F.min("first").alias("seen_from"),
        F.max("first").alias("seen_all"),
        F.max("mixed").alias("mixed"),
    ).drop("run")


def _bucket(key: Column) -> Column:
    return F.floor(key / F.lit(BUCKET)).cast("bigint").alias("bucket")


def key_verdicts(refs: DataFrame, runs: DataFrame) -> DataFrame:
    """``SPACE, key, n_refs, run`` of every key that is referred to: as-of match with the last run of its bucket that starts at or before it."""
    wanted = refs.groupBy(*SPACE, "key").agg(F.count("*").alias("n_refs"))
    run = F.struct("run_end", "seen_from", "seen_all", "mixed")
    left = runs.select(*SPACE, "bucket", F.col("run_start").alias("at"), F.lit(0).alias("side"), run.alias("run"), F.lit(None).cast("bigint").alias("n_refs"))
    right = wanted.select(*SPACE, _bucket(F.col("key")), F.col("key").alias("at"), F.lit(1).alias("side"), F.lit(None).alias("run"), "n_refs")
    order = Window.partitionBy(*SPACE, "bucket").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    matched = left.unionByName(right).withColumn("run", F.last("run", ignorenulls=True).over(order))
    return matched.filter("side = 1").select(*SPACE, F.col("at").alias("key"), "n_refs", "run")


def _match_rows(refs: DataFrame, rows: DataFrame) -> DataFrame:
    """As-of match on time: whether some row of the key is there at ``t`` (the latest removal among rows arrived by then)."""
    key = [*SPACE, "key"]
    wanted = materialize(refs.groupBy(*key).agg(F.count("*").alias("n"), F.ceil(F.count("*") / PART_ROWS).cast("int").alias("parts")), "asked")
    rows = rows.join(wanted.select(*key, "parts").hint("merge"), key)
    part = F.pmod(F.xxhash64("row_id", "dia_id"), F.col("parts")).cast("int").alias("part")
    left = rows.select(*key, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("ingested_at").alias("at"), F.lit(0).alias("side"), "deleted_at", F.lit(None).alias("ref"))
    right = hot_join(refs, wanted, key, "n", stored=True).select(*key, part, F.col("t").alias("at"), F.lit(1).alias("side"), F.lit(None).alias("deleted_at"), F.struct("src_table", "row_id", "dia_id", "t").alias("ref"))
    order = Window.partitionBy(*key, "part").orderBy(F.col("at").asc_nulls_first(), "side").rowsBetween(Window.unboundedPreceding, 0)
    matched = left.unionByName(right).withColumn("until", F.max("deleted_at").over(order)).filter("side = 1").select("ref.*", "until")
    status = F.when(F.col("until").isNull(), "late").when(F.col("until") > F.col("t"), None).otherwise("deleted")
    return matched.withColumn("status", status)


def orphan_references(qa_items: DataFrame, turns: DataFrame, sessions: DataFrame) -> DataFrame:
    """``src_table, row_id, dia_id, period_month, status`` of every reference whose record is not there.

    * Status ``missing``: no row at all; ``late``: all rows arrive after the reference; else ``deleted``.
    * Entries without an id and null entries refer to nothing; a null ``conv_id`` of the referring record makes
      its references ``missing``; parents with a null ``conv_id`` or number are nobody's parents.
    * A parent without ``ingested_at`` never arrives (its references are ``late``); a referring record without
      one precedes everything (``period_month`` null).
    * Rows of one record delivered again count once, at their earliest arrival; extra columns are not read.
    """
    rows, refs = parents(turns, sessions), references(qa_items, turns)
    refs, rows = materialize(refs, "references"), materialize(lives(rows), "lives")
    nobody = refs.filter(F.col("conv_id").isNull())
    verdicts = materialize(key_verdicts(refs.filter(F.col("conv_id").isNotNull()), key_runs(rows)), "verdicts")
    matched = hot_join(refs.filter(F.col("conv_id").isNotNull()), verdicts, [*SPACE, "key"], "n_refs", stored=True)
    matched = matched.unionByName(nobody, allowMissingColumns=True)
    beyond = F.col("run").isNull() | (F.col("key") > F.col("run.run_end"))
    early = F.col("t").isNull() | (F.col("t") < F.col("run.seen_from"))
    verdict = (
        F.when(beyond, "missing").when(early, "late").when(~F.col("run.mixed") & (F.col("t") >= F.col("run.seen_all")), "there").otherwise("ask")
    )
    matched = materialize(matched.withColumn("status", verdict).filter("status <> 'there'").drop("run"), "orphans")
    settled = matched.filter("status <> 'ask'").select("src_table", "row_id", "dia_id", "t", "status")
    asked = _match_rows(matched.filter("status = 'ask'"), rows).filter("status is not null").select("src_table", "row_id", "dia_id", "t", "status")
    return settled.unionByName(asked).select("src_table", "row_id", "dia_id", F.date_format("t", "yyyy-MM").alias("period_month"), "status")


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans per table, month and status."""
    return orphans.groupBy("src_table", "period_month", "status").agg(F.count("*").alias("n_orphans"))
