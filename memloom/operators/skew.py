"""Joins whose left side may hold a third of its rows under one key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.workspace import materialize

#: Heaviest keys of the right side that are sent to the tasks: a fixed number of rows.
HOT_KEYS = 10_000


def hot_join(rows: DataFrame, table: DataFrame, on: list[str], weight: str, how: str = "inner", *, hot_keys: int | None = None, stored: bool = False) -> DataFrame:
    """``rows`` joined with ``table``, which has one row a key and in ``weight`` the number of ``rows`` of that key.

    A table of up to ``HOT_KEYS`` rows is broadcast.  Of a larger one the ``HOT_KEYS`` keys with most rows are joined in
    the tasks that hold the rows (a side of that fixed number of rows is broadcast); the rest is shuffled by key, and no
    key left there has more than one in ``HOT_KEYS`` of all rows.  ``table`` is read several times and should be stored;
    ``rows`` are stored here for the second case unless ``stored`` says that they are.  ``how``: ``inner`` or ``left``;
    null keys match nothing.  ``weight`` is not in the result.
    """
    limit = hot_keys or HOT_KEYS
    kept = [c for c in table.columns if c != weight]
    if table.limit(limit + 1).count() <= limit:
        return rows.join(F.broadcast(table.select(*kept)), on, how)
    rows = rows if stored else materialize(rows, "rows")
    hot = table.orderBy(F.desc(weight), *on).limit(limit).select(*kept).withColumn("_hot", F.lit(True))
    marked = rows.join(F.broadcast(hot), on, "left")
    found = marked.filter(F.col("_hot").isNotNull()).drop("_hot")
    rest = marked.filter(F.col("_hot").isNull()).select(*rows.columns).join(table.select(*kept).hint("merge"), on, how)
    return found.unionByName(rest.select(*found.columns))
