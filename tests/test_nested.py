import json

import pytest
from pyspark.sql import functions as F

from memloom.operators.nested import NODE_COLUMNS, flat_tables, shred, unreadable


def nodes(spark, rows):
    df = spark.createDataFrame(rows, "record_id bigint, conversation string, qa string, node_key string")
    return sorted((tuple(r) for r in shred(df).select(*NODE_COLUMNS).collect()), key=str)


def test_paths_positions_and_missing_keys(spark):
    talk = {"speaker_a": "A", "session_2": [{"dia_id": "D2:1", "img_url": ["u", None, "v"]}, None, {"dia_id": None, "img_url": "w"}], "session_2_date_time": "x", "session_3": None, "session_04": []}
    qa = [{"category": 5, "evidence": ["D:8:06; D9:17", 7, None, "D8:6"]}, None, {"question": "q"}]
    got = nodes(spark, [(1, json.dumps(talk), json.dumps(qa), "clash")])
    assert ("session", "conversation/session_04", "conversation", "session_04") in [g[1:] for g in got]
    assert (1, "turn", "conversation/session_2/2", "conversation/session_2", "") in got
    assert (1, "image", "conversation/session_2/0/img_url/2", "conversation/session_2/0", "v") in got
    assert (1, "image", "conversation/session_2/2/img_url/0", "conversation/session_2/2", "w") in got
    assert [g[4] for g in got if g[1] == "evidence"] == ["D8:6", "D9:17", "D8:6"]
    assert [(g[2], g[4]) for g in got if g[1] == "qa"] == [("qa/0", "5"), ("qa/2", "")]
    assert not any("session_3" in g[2] for g in got)


@pytest.mark.parametrize("text", [None, "", "no json", '{"session_1": [{}]} trailing', '{"session_1": [', "[1, 2]", '"text"', '{"session_1": [{}]}{}', '{"a": 1}, {"session_1": []}'])
def test_texts_without_nodes(spark, text):
    assert nodes(spark, [(1, text, None, None)]) == []


def test_lone_values_wrapped_json_and_repeated_rows(spark):
    talk = json.dumps(json.dumps({"session_1": {"dia_id": "D1:1"}}))
    got = nodes(spark, [(None, talk, '{"category": "4"}', None), (2, talk, "null", None), (2, talk, "null", None)])
    assert (None, "qa", "qa/0", "qa", "4") in got
    assert got.count((2, "turn", "conversation/session_1/0", "conversation/session_1", "D1:1")) == 2


def test_every_child_has_its_parent(spark, data):
    df = shred(spark.read.parquet(f"{data}/locomo10.parquet"))
    own = df.select("record_id", F.col("node_path").alias("parent_path"))
    roots = F.col("parent_path").isin("conversation", "qa")
    assert df.filter(~roots).join(own, ["record_id", "parent_path"], "left_anti").count() == 0
    with_fields = shred(spark.read.parquet(f"{data}/locomo10.parquet"), fields=True)
    tables = flat_tables(with_fields)
    assert set(tables) == {"conversation", "session", "turn", "image", "qa", "evidence"}
    assert tables["turn"].filter("text is not null").count() > 0
    assert with_fields.filter("node_kind <> 'conversation'").count() == df.count()


def test_tables_have_every_field_and_null_kinds_never_come(spark):
    talk = {"speaker_a": "A", "place": {"x": 1}, "session_2": [{"dia_id": "D2:1", "text": "hi", "mood": 3, "tags": [1, "b"], "node_key": "clash", "none": None}], "session_2_date_time": "May", "session_12_date_time": "June", "session_1_x": "no session"}
    rows = [(1, json.dumps(talk), json.dumps([{"question": "q", "answer": 2020, "evidence": ["D2:1"]}, "text"])), (2, None, None)]
    found = shred(spark.createDataFrame(rows, "record_id bigint, conversation string, qa string"), fields=True)
    assert found.filter("node_kind is null").count() == 0
    t = {k: [r.asDict() for r in v.collect()] for k, v in flat_tables(found).items()}
    assert [(r["speaker_a"], json.loads(r["place"]), r["parent_path"]) for r in t["conversation"]] == [("A", {"x": 1}, "")] and "session_1_x" not in t["conversation"][0]
    assert [(r["node_key"], r["date_time"]) for r in t["session"]] == [("session_2", "May")]
    turn = t["turn"][0]
    assert (turn["text"], turn["mood"], json.loads(turn["tags"]), turn["field_node_key"], turn["node_key"]) == ("hi", "3", [1, "b"], "clash", "D2:1") and "none" not in turn
    assert [(r["question"], r["answer"], r["ordinal"]) for r in t["qa"]] == [("q", "2020", 0), (None, None, 1)]
    assert [(r["node_key"], r["parent_path"]) for r in t["evidence"]] == [("D2:1", "qa/0")]


def test_unreadable_texts_are_listed(spark):
    rows = [(1, "{}", "[]"), (2, "no json", None), (3, "", '[{"a": 1}'), (4, json.dumps({"session_1": [{"text": "x" * 17_000_000}]}), "[]")]
    got = {(r.record_id, r.column) for r in unreadable(spark.createDataFrame(rows, "record_id bigint, conversation string, qa string")).collect()}
    assert {(2, "conversation"), (3, "qa")} <= got <= {(2, "conversation"), (3, "qa"), (4, "conversation")}


def test_empty_table(spark):
    assert nodes(spark, []) == []
