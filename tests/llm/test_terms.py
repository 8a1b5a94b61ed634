import random
import re
from collections import Counter

from memloom.llm import terms
from memloom.llm.terms import BurstTrie, one_per_record, term_frequencies


def brute(rows):
    out = {}
    for field in {f for f, _ in rows}:
        texts = [t for f, t in rows if f == field and t is not None]
        total, records = Counter(), Counter()
        for t in texts:
            found = re.findall(r"\w+", t.lower())
            total.update(found)
            records.update(set(found))
        for w in total:
            mark = "rare" if records[w] <= 2 else "common" if records[w] > 0.1 * len(texts) else "usual"
            out[field, w] = (total[w], records[w], mark)
    return out


def run(spark, rows):
    got = term_frequencies(spark.createDataFrame(rows, "src_field string, text string, term int").repartition(3)).collect()
    assert len({(r.src_field, r.term) for r in got}) == len(got)
    return {(r.src_field, r.term): (r.n_total, r.n_records, r.mark) for r in got}


def test_trie_bursts_and_keeps_counts():
    trie, want = BurstTrie(burst=4), Counter()
    r = random.Random(1)
    for _ in range(3000):
        w = "".join(r.choice("ab") for _ in range(r.randrange(0, 9)))
        trie.add(w, 2, 1)
        want[w] += 2
    got = {p + s: c[0] for p, node in trie.containers() for s, c in node.items()}
    assert got == dict(want) and trie.size == len(want) and max(len(n) for _, n in trie.containers()) <= 5


def test_against_brute_force_with_many_routes(spark, monkeypatch):
    monkeypatch.setattr(terms, "ROUTE_ENTRIES", 20)
    r = random.Random(2)
    vocabulary = ["".join(r.choice("abcé") for _ in range(r.randrange(1, 6))) for _ in range(300)] + ["the"] * 200 + ["Straße", "½", "日本語", "a_b", "İx"]
    rows = [(r.choice(["m", "q"]), " ".join(r.choices(vocabulary, k=r.randrange(0, 30))) + r.choice(["", "!", "…", "\n"]), 1) for _ in range(400)]
    rows += [("m", None, 1), ("q", "", 1), ("m", "the " * 5000, 1)]
    assert run(spark, rows) == brute([r[:2] for r in rows])


def test_groups_are_bounded_whatever_the_terms_and_tasks(spark, monkeypatch):
    """Small tries of many tasks, terms that begin alike far beyond any prefix that is counted, one term in every task."""
    from pyspark.sql import functions as F

    from memloom.llm.terms import CONTAINERS, _count, matching_subtrees

    monkeypatch.setattr(terms, "ROUTE_ENTRIES", 500)
    monkeypatch.setattr(terms, "MAX_ROUTES", 4)
    begins = "x" * 40
    rows = [("m", " ".join(f"{begins}{i}a{task}" for i in range(200)) + " the") for task in range(16)] + [("m", " ".join(f"{begins}{i}" for i in range(200)))] * 8
    texts = spark.createDataFrame(rows, "src_field string, text string").repartition(16)
    tries = texts.mapInArrow(_count, CONTAINERS).cache()
    sizes = matching_subtrees(tries).groupBy("src_field", "route", "part").agg(F.sum(F.size("suffixes")).alias("n")).collect()
    assert sum(r.n for r in sizes) > 3200 and max(r.n for r in sizes) < 2 * 500
    assert run(spark, [(*r, 1) for r in rows]) == brute(rows)


def test_redelivered_rows_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b", "2024-01-02"), (1, "a b", "2024-01-01"), (None, "a", None), (None, "a", None), (2, None, "x")], "id bigint, text string, at string")
    kept = one_per_record(df, "id", "text", "at", "f")
    assert sorted(r.text for r in kept.collect()) == ["a", "a", "a b"]
    assert run(spark, []) == {} and run(spark, [("m", None, 1)]) == {}
