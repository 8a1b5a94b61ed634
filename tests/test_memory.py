"""Extraction, retrieval, metrics and pipeline on small hand-made inputs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from memloom.functions import text as T
from memloom.operators import dense, extract, sparse
from memloom.operators.answer import CONTEXT_WORDS, context_budget, contexts, reader_prompt, verdict
from memloom.operators.metrics import retrieval_scores, scored_predictions, summary
from memloom.plans import grid
from memloom.plans import pipeline as pl

TURN = "conv_id string, pos int, session_id string, speaker string, dia_id string, text string, timestamp_raw string, ts_date date"
MEMORY = "extractor string, conv_id string, mem_idx int, text string, source_dia_ids array<string>"
QUESTION = "qid bigint, conv_id string, question string, gold_answer string, evidence_dia_ids array<string>, category int"


def turns(spark, *texts, raw="1 January 2024", date=dt.date(2024, 1, 1)):
    rows = [("c", i + 1, "session_1", "Alice", f"D1:{i + 1}", t, raw, date) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, TURN)


def memories(spark, *texts, conv="c"):
    return spark.createDataFrame([("append_all", conv, i, t, [f"D1:{i + 1}"]) for i, t in enumerate(texts)], MEMORY)


def ask(spark, *questions, conv="c"):
    return spark.createDataFrame([(i, conv, q, "g", ["D1:1"], 4) for i, q in enumerate(questions)], QUESTION)


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_rule_versions(spark):
    said = ["We made pizza together!", "I'm so glad to hear that!", "I went home yesterday", "Totally agree", None, "", "I’m here", "I moved", "My dog", "Our cat", "I've worked", "Two weeks ago it rained", "They are gonna go", "I'd like tea"]
    got = {v: {r.text.removeprefix("Alice: "): r.meta.matched_patterns for r in extract.regex(turns(spark, *said), version=v).collect()} for v in ("v1", "v2")}
    assert got["v1"]["I went home yesterday"] == ["past_event", "temporal"]
    assert "We made pizza together!" not in got["v1"] and got["v2"]["We made pizza together!"] == ["past_event"]
    assert got["v1"]["I'm so glad to hear that!"] == ["state"] and "I'm so glad to hear that!" not in got["v2"]
    assert "I’m here" not in got["v1"] and got["v1"]["I moved"] == ["past_event"]
    assert "Our cat" in got["v2"] and "Our cat" not in got["v1"]
    assert got["v2"]["I've worked"] == ["past_event"] and got["v2"]["I'd like tea"] == ["preference"]
    assert got["v1"]["They are gonna go"] == ["plan"]
    with pytest.raises(ValueError):
        extract.regex(turns(spark, "x"), version="v3")


def test_memory_text_with_dates(spark):
    text = lambda t: [r.text for r in extract.append_all(t, with_timestamp=True).collect()]
    assert text(turns(spark, "hi")) == ["[2024-01-01] Alice: hi"]
    assert text(turns(spark, "hi", date=None)) == ["[1 January 2024] Alice: hi"]
    assert text(turns(spark, "hi", raw="", date=None)) == ["Alice: hi"]
    assert extract.no_memory(turns(spark, "hi")).count() == 0
    first = extract.append_all(turns(spark, "hi", None)).orderBy("mem_idx").collect()
    assert [(r.mem_idx, r.text, r.source_dia_ids) for r in first] == [(0, "Alice: hi", ["D1:1"]), (1, "Alice: ", ["D1:2"])]


def test_ner_keeps_tagged_turns(spark):
    tagger = lambda texts: [[("Paris", "GPE"), ("5", "CARDINAL")] if "Paris" in t else [("5", "CARDINAL")] for t in texts]
    got = extract.ner(turns(spark, "to Paris", "five", None), tagger=tagger).collect()
    assert [[tuple(e) for e in r.meta.entities] for r in got] == [[("Paris", "GPE")]]


@pytest.mark.parametrize("top", [sparse.tfidf_topk, sparse.bm25_topk])
def test_sparse_retrieval(spark, top):
    m = memories(spark, "I adopted a tabby cat named Marmalade.", "My favorite sport is tennis.", "", None)
    assert [(r.qid, r.mem_idx) for r in top(m, ask(spark, "What is the cat's name?", "nothing known", None), 2).collect()] == [(0, 0)]
    assert top(m, ask(spark, "cat"), 0).count() == 0
    ties = memories(spark, "red cat", "blue dog", "red cat", "red cat")
    assert [r.mem_idx for r in top(ties, ask(spark, "cat"), 2).orderBy("rank").collect()] == [0, 2]
    assert top(m.limit(0), ask(spark, "cat"), 2).count() == 0


def test_bm25_prefers_short_and_keeps_scopes_apart(spark):
    m = memories(spark, "cat " + "filler " * 30, "cat").unionByName(memories(spark, "cat", conv="other"))
    assert [r.mem_idx for r in sparse.bm25_topk(m, ask(spark, "cat cat"), 5).orderBy("rank").collect()] == [1, 0]


VECTORS = [("cat", [1.0, 0.0, 0.0]), ("kitten", [0.9, 0.1, 0.0]), ("tennis", [0.0, 1.0, 0.0]), ("sport", [0.0, 0.9, 0.1]), ("filler", [0.0, 0.0, 1.0]), ("Boston", [0.0, 1.0, 1.0])]


def test_word_vectors(spark):
    v = spark.createDataFrame(VECTORS, "word string, vec array<double>")
    m = memories(spark, "cat filler filler", "filler filler filler", "unknown words", "filler tennis")
    best = lambda w: dense.word2vec_topk(m, ask(spark, "filler kitten"), v, 1, weighting=w).first().mem_idx
    assert best("uniform") in (0, 1) and best("tfidf") == 0
    assert [r.mem_idx for r in dense.word2vec_topk(memories(spark, "went to Boston", "cat"), ask(spark, "Boston"), v, 5).collect()] == [0]
    pooled = dense.embed_memories(memories(spark, "Cat cat tennis"), v).first().vec
    assert [round(x, 6) for x in pooled] == [0.8, 0.2, 0.0]  # both written forms of cat count twice
    with pytest.raises(ValueError):
        dense.embed_memories(m, v, "other")


def test_sentence_encoder_and_prefixes(spark):
    words = ("cat", "marmalade", "tennis", "sport")
    encoder = lambda texts: [[float(w in t.lower()) for w in words] for t in texts]
    m = memories(spark, "the tabby cat", "we play tennis", "nothing")
    got = dense.sentence_topk(m, ask(spark, "which sport? tennis"), encoder, 2).orderBy("rank").collect()
    assert [(r.mem_idx, r.score) for r in got] == [(1, 1.0), (0, 0.0)]
    assert dense.prefixes_for("all-MiniLM") == ("", "")
    assert dense.prefixes_for("intfloat/E5-base") == ("query: ", "passage: ")
    assert dense.prefixes_for("BAAI/bge-small")[0].startswith("Represent") and dense.prefixes_for("x-e5-y", query="") == ("", "passage: ")


def test_vector_search_in_blocks(spark):
    rows = [(i, [float(i % 7), float(i % 3)], i) for i in range(60)] + [(None, None, 0)]
    v = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, score int")
    got = dense.vector_search(v.filter("vec_id % 10 = 0"), v, 3, block=2).orderBy("query_id", "rank").collect()
    for q in range(0, 60, 10):
        want = sorted(range(60), key=lambda i: (-((q % 7) * (i % 7) + (q % 3) * (i % 3)), i))[:3]
        assert [r.vec_id for r in got if r.query_id == q] == want


def test_text_measures(spark):
    f1 = lambda a, b: one(spark, T.token_f1(F.lit(a), F.lit(b)))[0]
    assert one(spark, T.normalize_answer(F.lit("The  Marmalade! a well-known"))) == ("marmalade wellknown",)
    assert f1("orange tabby cat", "tabby cat") == pytest.approx(0.8) and f1("Boston", "New York") == 0.0
    assert f1("", "the") == 1.0 and f1("x", "") == 0.0 and one(spark, T.exact_match(F.lit(None).cast("string"), F.lit("")))[0] == 1.0
    dates = ["1:56 pm on 8 May, 2023", "8 Sep 2023", "8 Sept 2023", "31 February 2023", "", None]
    got = [str(r[0]) for r in spark.createDataFrame([(x,) for x in dates], "d string").select(T.parse_date(F.col("d"))).collect()]
    assert got == ["2023-05-08", "2023-09-08", "None", "None", "None", "None"]


def test_retrieval_metrics(spark):
    row = [(["D1:1", "D1:2"], [["D1:9"], ["D1:2", "D1:2"], ["D1:9"]])]
    scores = retrieval_scores(F.col("g"), F.col("r"))
    got = spark.createDataFrame(row, "g array<string>, r array<array<string>>").select(*[c.alias(n) for n, c in scores.items()]).first()
    assert tuple(got) == (1.0, 0.5, 0.5, 0.0, 0.5)
    nothing = spark.createDataFrame([(None, None)], "g array<string>, r array<array<string>>").select(*scores.values()).first()
    assert tuple(nothing) == (0.0,) * 5


def test_summary_counts_empty_groups_as_zero(spark):
    schema = "config string, category int, answer_text string, gold_answer string, judge_label int, judge_score double, evidence array<string>, retrieved array<array<string>>"
    rows = [("a", 1, "x", "x", 1, 1.0, [], []), ("a", None, "y", "x", 0, 0.0, None, None)]
    s = summary(scored_predictions(spark.createDataFrame(rows, schema)), ["config"])
    over = s.filter("level = 'overall'").first()
    assert (over.n, over.qa_accuracy, over.mrr, over.n_with_evidence, over.empty_retrieval_rate) == (2, 0.5, 0.0, 0, 1.0)
    assert s.filter("level = 'category'").count() == 2
    assert summary(scored_predictions(spark.createDataFrame([], schema)), ["config"]).count() == 0


def test_context_budget_stops_at_the_first_overflow(spark):
    rows = [(1, 1, "a b"), (1, 2, "c d e"), (1, 3, "f"), (2, 1, "x " * (CONTEXT_WORDS + 1))]
    found = spark.createDataFrame(rows, "qid bigint, rank int, text string")
    assert [r.rank for r in context_budget(found, group=["qid"], max_words=4).collect()] == [1]
    assert {r.qid: r.context for r in contexts(found, group=["qid"]).collect()} == {1: "a b\nc d e\nf"}
    assert one(spark, reader_prompt(F.lit("q?"), F.lit(""))) == ("Context:\nno context\n\nQuestion: q?",)
    assert one(spark, verdict(F.lit(" Yes.")), verdict(F.lit("no"))) == (1.0, 0.0)


def test_grid_and_pipeline(spark):
    assert grid.combo_grid(spark).count() == len(grid.plan()) == 49
    assert [e.combo for e in grid.plan(("base",), "append_all+tfidf,none+such")] == ["append_all+tfidf"]
    t = turns(spark, "I adopted a tabby cat named Marmalade.", "My favorite sport is tennis.")
    q = spark.createDataFrame([(1, "c", "What is the cat's name?", "Marmalade", ["D1:1"], 4), (2, "c", "zzz", "x", [], 1)], QUESTION)
    s = pl.summarize(pl.run_grid(t, q, grid.plan(("base",), "append_all+tfidf,no_memory+no_retrieval"), k=1))
    rows = {(r.config, r.category): r for r in s.collect()}
    assert rows["append_all+tfidf", 4].qa_accuracy == 1.0 and rows["append_all+tfidf", 4].mrr == 1.0
    assert rows["append_all+tfidf", None].empty_retrieval_rate == 0.5 and rows["no_memory+no_retrieval", None].n == 2


def test_run_summary_plans_the_whole_grid(spark, monkeypatch):
    from memloom.queries import memory as Q

    given = {}

    def run_grid(turns, questions, entries, *, resources=None):
        given.update(turns=turns, entries=entries, resources=resources)
        return spark.createDataFrame([], "x int")

    t = spark.createDataFrame([("c", 1, "a", None, "hello", None, None)], "conv_id string, pos int, speaker string, dia_id string, text string, timestamp_raw string, ts_date string")
    monkeypatch.setattr(Q, "turns", lambda *_: t)
    monkeypatch.setattr(Q, "questions", lambda *_: spark.createDataFrame([(1, "who?")], "qid bigint, question string"))
    monkeypatch.setattr(Q.pl, "run_grid", run_grid)
    monkeypatch.setattr(Q.pl, "summarize", lambda x: x)
    monkeypatch.setattr(Q, "_rounded", lambda x: x)
    Q.run_summary(spark, "")
    assert len(given["entries"]) == 49 and given["turns"].count() == 1 and set(given["resources"].encoders) == {"sentence_emb", "sentence_emb_e5"}


def test_the_first_reader_gives_the_whole_first_memory(spark):
    """Also one of several lines, and one beyond the budget of the context."""
    long = "word " * (CONTEXT_WORDS + 100)
    found = spark.createDataFrame([(1, "a", 1, "line one\nline two", ["D1:1"]), (1, "a", 2, "x", ["D1:2"]), (2, "a", 1, long, ["D1:3"]), (3, "a", 1, None, None)], "qid bigint, extractor string, rank int, text string, source_dia_ids array<string>")
    q = spark.createDataFrame([(i, "c", "q?", "g", [], 1) for i in range(1, 5)], QUESTION)
    got = {r.qid: r for r in pl.read_records(found, q, ["a"]).collect()}
    assert (got[1].answer_text, got[2].answer_text, got[3].answer_text, got[4].answer_text) == ("line one\nline two", long, "", "no context")
    assert [m.text for m in got[1].retrieved_memories] == ["line one\nline two", "x"] and got[4].retrieved == []


def test_contexts_by_rows_and_by_lists_agree(spark):
    from memloom.operators.answer import within_budget

    rows = [(q, r, " ".join("w" * (1 + (q * r) % 5) for _ in range((q * r) % 7))) for q in range(1, 6) for r in range(1, 6)]
    found = spark.createDataFrame(rows, "qid bigint, rank int, text string")
    by_rows = {r.qid: r.context for r in contexts(found, group=["qid"], max_words=9).collect()}
    lists = found.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("m"))
    by_lists = {r.qid: r.c for r in lists.select("qid", F.array_join(within_budget(F.col("m"), 9), "\n").alias("c")).collect()}
    assert by_lists == {q: by_rows.get(q, "") for q in by_lists}


def test_added_extractors_and_retrievers_run_in_the_grid(spark):
    from memloom.plans import registry

    registry.register_extractor("halves", registry.per_turn(lambda turns: [[] if t is None else t.split(";") for t in turns["text"]]))
    registry.register_retriever("shared", registry.per_block(lambda q, m: [[len(set(a.split()) & set((b or "").split())) for b in m["text"]] for a in q["question"]], question_block=1, memory_block=2))
    try:
        t = turns(spark, "a tabby cat;my dog", "a red fox", None)
        q = spark.createDataFrame([(1, "c", "which cat", "a tabby cat", ["D1:1"], 4), (2, "c", "zzz", "x", [], 1), (3, "c", "a red dog", "x", [], 1)], QUESTION)
        p = pl.run_grid(t, q, [grid.Entry("base", "halves", "shared")], k=2).collect()
        got = {r.qid: [m.text for m in r.retrieved_memories] for r in p}
        assert got == {1: ["a tabby cat"], 2: [], 3: ["a red fox", "a tabby cat"]} and {r.qid: r.judge_label for r in p}[1] == 1
        entries, skipped = registry.runnable([grid.Entry("base", "halves", "word2vec"), grid.Entry("base", "such", "bm25"), grid.Entry("base", "ner", "bm25")], registry.Resources())
        assert [e.combo for e in entries] == ["ner+bm25"] and [why for _, why in skipped] == ["no word vectors", "no such extractor"]
        with pytest.raises(ValueError):
            registry.retrieve(t, q, "nothing", 1, registry.Resources())
    finally:
        del registry.EXTRACTORS["halves"], registry.RETRIEVERS["shared"]


@pytest.mark.parametrize("blocks", [(4096, 1024), (2, 1)])
def test_dense_retrieval_in_blocks_equals_brute_force(spark, monkeypatch, blocks):
    """With one conversation that holds most rows, ties, and vectors of length zero."""
    monkeypatch.setattr(dense, "MEMORY_BLOCK", blocks[0])
    monkeypatch.setattr(dense, "QUESTION_BLOCK", blocks[1])
    words = [f"w{i}" for i in range(6)]
    v = spark.createDataFrame([(w, [float(i % 3) - 1, float(i % 2)]) for i, w in enumerate(words)], "word string, vec array<double>")
    m = memories(spark, *[f"{words[i % 6]} {words[(i * 2) % 6]}" for i in range(25)], "unknown").unionByName(memories(spark, "w1", conv="other"))
    q = ask(spark, "w1 w2", "w3", "nothing", "w0 w5", None)
    got = [(r.qid, r.conv_id, r.mem_idx, r["rank"]) for r in dense.word2vec_topk(m, q, v, 4).collect()]
    mv = {(r.conv_id, r.mem_idx): r.vec for r in dense.embed_memories(m, v).collect()}
    want = []
    for r in dense.embed_questions(q, m, v).collect():
        scores = []
        for (conv, i), x in mv.items():
            a, b = sum(y * y for y in x) ** 0.5, sum(y * y for y in r.vec) ** 0.5
            if conv == r.conv_id and a and b and (s := sum(y * z for y, z in zip(x, r.vec)) / a / b) > 0:
                scores.append((-round(s, 9), i))
        want += [(r.qid, r.conv_id, i, n + 1) for n, (_, i) in enumerate(sorted(scores)[:4])]
    assert sorted(got) == sorted(want) and len(want) > 8
