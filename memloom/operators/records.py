"""One row for each record of tables whose rows may be delivered again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.workspace import materialize

#: Repeated ids that are sent to the tasks at most; with more of them all rows are moved by id.
REPEATED_IDS = 500_000


def first_delivery(df: DataFrame, id_col: str, arrived: str) -> DataFrame:
    """Of the rows with one id the one that arrived first (ties have the same content); rows with a null id are kept.

    Partial aggregation keeps one row of an id for each task, so that an id with a third of all rows moves no more
    rows than there are tasks.
    """
    others = [c for c in df.columns if c != id_col]
    order = F.struct(F.coalesce(F.col(arrived).cast("string"), F.lit("9")))
    picked = df.filter(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min_by(F.struct(*others), order).alias("r"))
    known = picked.select(id_col, "r.*").select(*df.columns)
    return known.unionByName(df.filter(F.col(id_col).isNull()))


def first_delivery_of_few(df: DataFrame, id_col: str, arrived: str, *, repeated_ids: int | None = None) -> DataFrame:
    """The rows of ``first_delivery``, for wide stored tables of which few ids were delivered again.

    All ids are moved once, without their rows, to find those that repeat; of the rows only theirs are moved.
    """
    limit = REPEATED_IDS if repeated_ids is None else repeated_ids
    times = df.filter(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count("*").alias("n"))
    repeated = materialize(times.filter("n > 1").select(id_col), "repeated")
    if repeated.count() > limit:
        return first_delivery(df, id_col, arrived)
    marked = df.join(F.broadcast(repeated.withColumn("_again", F.lit(True))), id_col, "left")
    alone, again = marked.filter("_again is null"), marked.filter("_again")
    return alone.select(*df.columns).unionByName(first_delivery(again.select(*df.columns), id_col, arrived))
