"""Sparse retrieval in blocks: nothing of the size of all pairs, and the same ranks by every way of search."""

import math
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from memloom.operators import postings, sparse
from memloom.operators.answer import budgeted
from memloom.queries import memory

MEMORY = "extractor string, conv_id string, mem_idx int, text string, source_dia_ids array<string>"
QUESTION = "qid bigint, conv_id string, question string"


def tables(n_memories=400, n_questions=60, seed=3):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    text = lambda n: " ".join(["name", *draw.choices(words, range(1, 41), k=draw.randint(0, n))])
    held = [(draw.choice("ab"), draw.choice(["c", "c", "d"]), i, text(9)) for i in range(n_memories)]
    asked = [(i, draw.choice(["c", "d", None]), text(5)) for i in range(n_questions)]
    named = lambda rows, *names: pa.table({n: pa.array(c) for n, c in zip(names, zip(*rows))})
    return named(asked, "qid", "conv_id", "t"), named(held, "extractor", "conv_id", "mem_idx", "t")


@pytest.mark.parametrize("formula", ["bm25", "tfidf"])
def test_search_that_leaves_memories_out_finds_the_same(monkeypatch, formula):
    got = []
    for large in (10**9, 0):
        monkeypatch.setattr(postings, "LARGE", large)
        block = postings.Block(*tables())
        block.bm25(1.5, 0.75) if formula == "bm25" else block.tfidf()
        got.append([tuple(round(x, 9) if isinstance(x, float) else x for x in r.values()) for r in block.rows(block.best(5)).to_pylist()])
    assert got[0] == got[1] and len(got[0]) > 200


@pytest.mark.parametrize("top", [sparse.tfidf_topk, sparse.bm25_topk])
def test_no_rows_for_pairs(spark, top):
    m = spark.createDataFrame([("a", "c", i, f"name w{i}", []) for i in range(9)], MEMORY)
    plan = top(m, spark.createDataFrame([(1, "c", "name w3")], QUESTION))._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and not [x for x in plan.splitlines() if "Join" in x and "term" in x]


def test_parts_of_a_conversation_find_the_same(spark, monkeypatch):
    asked, held = tables(120, 40)
    m = spark.createDataFrame([(*r.values(), []) for r in held.to_pylist()], MEMORY)
    q = spark.createDataFrame([tuple(r.values()) for r in asked.to_pylist()], QUESTION)
    whole = sorted(map(tuple, sparse.bm25_topk(m, q).collect()))
    monkeypatch.setattr(sparse, "QUESTION_BLOCK", 5)
    assert sorted(map(tuple, sparse.bm25_topk(m, q).collect())) == whole and whole


def test_rows_of_one_key_are_one_document(spark):
    """As in the SQL: a term's frequency is counted by key and length, its documents after that."""
    m = spark.createDataFrame([("a", "c", 0, "cat dog", []), ("a", "c", 0, "cat dog", []), ("a", "c", 1, "cat", []), ("a", "c", 2, "dog", [])], MEMORY)
    got = {r.mem_idx: r.score for r in sparse.bm25_topk(m, spark.createDataFrame([(1, "c", "cat")], QUESTION)).collect()}
    idf = math.log(1 + (4 - 2 + 0.5) / 2.5)
    assert got == pytest.approx({0: idf * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 2 / 1.5)), 1: idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 / 1.5))})


@pytest.mark.parametrize("name", ["context_budget_40", "context_budget_texts", "read_records", "judge_predictions", "reader_prompts"])
def test_texts_come_with_the_search(spark, data, name):
    """No join brings texts to what was found, and no grouping puts it together again."""
    plan = memory.QUERIES[name](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("FlatMapCoGroupsInArrow")]
    assert not any(x in above for x in ("Join", "Aggregate", "Window", "Sort"))


def test_lists_hold_every_question_and_extractor(spark):
    m = spark.createDataFrame([("a", "c", 0, "cat", ["x"]), ("a", "c", 1, None, []), ("a", "c", 2, "cat dog", None)], MEMORY)
    q = spark.createDataFrame([(1, "c", "dog cat"), (2, "none", "cat"), (3, None, "cat"), (None, "c", "cat"), (4, "c", None)], QUESTION)
    got = {(r.qid, r.extractor): [(m.rank, m.text) for m in r.memories] for r in sparse.bm25_lists(m, q, ["a", "b"]).collect()}
    assert got.pop((1, "a")) == [(1, "cat dog"), (2, "cat")]
    assert sorted(got, key=str) == sorted([(1, "b"), *[(i, e) for i in (2, 3, None, 4) for e in "ab"]], key=str) and not any(got.values())


def test_budget_over_lists(spark):
    rows = [(1, 2), (2, 2), (2, 1), (3, 1)]
    lists = spark.createDataFrame([([(rank, n, "x") for rank, n in rows],)], "m array<struct<rank:int,n_words:int,text:string>>")
    kept = lambda words: [tuple(x) for x in lists.select(budgeted(F.col("m"), words)).first()[0]]
    assert [x[3] for x in kept(9)] == [2, 5, 5, 6] and len(kept(5)) == 3 and len(kept(4)) == 1 and not kept(1)
