"""One row for each record, without moving the rows of ids that came once."""

import datetime

import pytest

from memloom.operators.records import first_delivery, first_delivery_of_few
from memloom.queries import memory


@pytest.mark.parametrize("limit", [None, 0])
def test_few_repeated_ids_give_the_same_rows(spark, limit):
    at = lambda h: None if h is None else datetime.datetime(2024, 1, 1, h)
    rows = [(1, "a", at(2)), (1, "b", at(1)), (2, "c", at(3)), (None, "d", at(1)), (None, "d", at(1)), (3, None, None), (3, "e", at(5)), (4, None, None)]
    df = spark.createDataFrame(rows, "id bigint, text string, at timestamp")
    got = first_delivery_of_few(df, "id", "at", repeated_ids=limit)
    assert got.columns == df.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, first_delivery(df, "id", "at").collect())) and got.count() == 6


@pytest.mark.parametrize("rows", [memory.memories, memory.questions])
def test_rows_that_came_once_are_not_moved(spark, data, rows):
    """Only rows of repeated ids are grouped: the other side of the union has no aggregate over texts."""
    plan = rows(spark, data)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    union = next(i for i, x in enumerate(plan) if "Union" in x)
    assert not any("Aggregate" in x for x in plan[: union + 1])
    first = plan[union + 1 :]
    depth = len(first[0]) - len(first[0].lstrip(" :+-"))
    first = first[: next(i for i, x in enumerate(first) if i and len(x) - len(x.lstrip(" :+-")) == depth)]
    assert any("Relation" in x for x in first) and not any("Aggregate" in x for x in first)
