import datetime as dt
import itertools
import random
import re

import pytest

from memloom.operators import orphans, skew
from memloom.operators.orphans import key_runs, lives, orphan_references, parents

ID = re.compile(r"D:?(\d+):(\d+)")
QA = "qid bigint, conv_id string, evidence_dia_ids array<string>, ingested_at timestamp, status string"
TURN = "turn_id bigint, conv_id string, dia_id string, ingested_at timestamp, deleted_at timestamp, bucket int"
SESSION = "conv_id string, session_no int, ingested_at timestamp, deleted_at timestamp"


def day(n):
    return None if n is None else dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def brute(qa, turns, sessions):
    ids = lambda s: {(int(a), int(b)) for a, b in ID.findall(s or "")}
    refs = {}
    for qid, conv, evidence, at, _ in qa:
        for d in set().union(*(ids(e) for e in evidence or [])):
            k = ("qa_items", qid, conv, d)
            refs[k] = min(refs.get(k, at), at)
    for tid, conv, dia, at, _, _ in turns:
        for d in ids(dia):
            k = ("turns", tid, conv, d)
            refs[k] = min(refs.get(k, at), at)
    out = set()
    for (t, i, conv, d), at in refs.items():
        if t == "qa_items":
            rows = [(a, g) for _, c, x, a, g, _ in turns if c == conv and c is not None and d in ids(x)]
        else:
            rows = [(a, g) for c, n, a, g in sessions if c == conv and c is not None and n == d[0]]
        if any(a <= at and (g is None or g > at) for a, g in rows):
            continue
        out.add((t, i, f"D{d[0]}:{d[1]}", at.strftime("%Y-%m"), "missing" if not rows else "late" if all(a > at for a, _ in rows) else "deleted"))
    return out


def run(spark, qa, turns, sessions):
    got = orphan_references(spark.createDataFrame(qa, QA), spark.createDataFrame(turns, TURN), spark.createDataFrame(sessions, SESSION)).collect()
    assert len(got) == len(set(got))
    return {tuple(r) for r in got}


@pytest.mark.parametrize("part_rows, hot_keys", [(100_000, 10_000), (7, 1)])
def test_against_brute_force(spark, monkeypatch, part_rows, hot_keys):
    """Also with half of the references on one key, split into parts."""
    monkeypatch.setattr(orphans, "BUCKET", 4)
    monkeypatch.setattr(orphans, "PART_ROWS", part_rows)
    monkeypatch.setattr(skew, "HOT_KEYS", hot_keys)
    r = random.Random(5)
    gone = lambda a: None if r.random() < 0.7 else a + r.randrange(0, 20)
    turns = []
    for i in range(250):
        a = r.randrange(60)
        g = gone(a)
        dia = r.choice([None, "", "x", f"D{r.randrange(4)}:{r.randrange(12):02d}", f"D:{r.randrange(4)}:{r.randrange(12)}; D1:1"])
        turns.append((i, r.choice(["a", "b", None]), dia, day(a), day(g), 1))
    turns += [t[:3] + (t[3] + dt.timedelta(days=9),) + t[4:] for t in turns[:40]]
    sessions = [(r.choice(["a", "b"]), r.randrange(5), day(a := r.randrange(60)), day(gone(a))) for _ in range(12)]
    qa = [(i, r.choice(["a", "b", None]), r.choice([None, [], [f"D{r.randrange(5)}:{r.randrange(14)}", None, "D3:007 D0:1"]]), day(r.randrange(80)), "s") for i in range(150)]
    qa += [(1000 + i, "a", ["D1:1"], day(r.randrange(80)), "s") for i in range(150)]
    assert run(spark, qa, turns, sessions) == brute(qa, turns, sessions)


@pytest.mark.parametrize("hot_keys", [1, 100])
def test_hot_keys_join_like_any(spark, hot_keys):
    rows = spark.createDataFrame([(i, "hot" if i % 2 else f"k{i % 5}" if i % 4 else None) for i in range(100)], "i int, k string")
    sizes = rows.filter("k <> 'k1'").groupBy("k").count().withColumnRenamed("count", "n").selectExpr("k", "n", "upper(k) u")
    plain = sorted(map(tuple, rows.join(sizes.drop("n"), "k", "left").select("i", "k", "u").collect()))
    assert sorted(map(tuple, skew.hot_join(rows, sizes, ["k"], "n", "left", hot_keys=hot_keys).select("i", "k", "u").collect())) == plain
    assert sorted(map(tuple, skew.hot_join(rows, sizes, ["k"], "n", hot_keys=hot_keys).select("i", "k", "u").collect())) == [r for r in plain if r[2]]


def test_runs_are_contiguous(spark, monkeypatch):
    monkeypatch.setattr(orphans, "BUCKET", 8)
    turns = [(i, "a", f"D1:{m}", day(m), None, 0) for i, m in enumerate(itertools.chain(range(1, 6), range(9, 12), [10]))]
    turns.append((99, "a", "D1:3", day(1), day(2), 0))
    rows = parents(spark.createDataFrame(turns, TURN), spark.createDataFrame([], SESSION))
    got = sorted((r.run_start, r.run_end, r.mixed) for r in key_runs(lives(rows)).collect())
    assert got == [(1, 2, False), (3, 3, True), (4, 5, False), (9, 11, False)]


def test_long_ids_missing_times_and_empty_tables(spark):
    long = "D1:" + "9" * 30
    qa = [(1, "a", [long, "D1:1"], day(5), "s"), (2, "a", ["D1:1"], None, "s"), (3, None, ["D1:1"], day(5), "s"), (4, "a", ["D1:2"], day(5), "s")]
    turns = [(1, "a", long, day(1), None, 0), (2, "a", "D1:1", day(1), None, 0), (3, "a", "D1:2", None, None, 0)]
    got = {g for g in run(spark, qa, turns, []) if g[0] == "qa_items"}
    assert got == {("qa_items", 2, "D1:1", None, "late"), ("qa_items", 3, "D1:1", "2024-01", "missing"), ("qa_items", 4, "D1:2", "2024-01", "late")}
    assert run(spark, [], [], []) == set()
