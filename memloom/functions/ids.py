"""Turn ids of the form ``Dn:m``, read out of free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the form of a turn id in evidence entries.
DIA_ID = r"D:?(\d+):(\d+)"


def _plain(digits: Column) -> Column:
    return F.regexp_replace(digits, r"^0+(?=\d)", "")


def ids_in(entry: Column) -> Column:
    """``array<string>`` of the ids in one text, in order, repeats kept, leading zeros dropped; null gives none."""
    found = F.regexp_extract_all(F.coalesce(entry, F.lit("")), F.lit(DIA_ID), F.lit(0))
    return F.transform(
        found,
        lambda x: F.concat(
            F.lit("D"), _plain(F.regexp_extract(x, DIA_ID, 1)), F.lit(":"), _plain(F.regexp_extract(x, DIA_ID, 2))
        ),
    )


def evidence_ids(entries: Column) -> Column:
    """Ids of all entries of an ``array<string>``, in order; a null array gives an empty one."""
    return F.flatten(F.transform(F.coalesce(entries, F.array().cast("array<string>")), ids_in))
