import json

import pytest

from memloom.plans import analyze, cli, report
from memloom.sources.locomo import dataset_counts, load_dialogues, load_qa, load_turns, read_samples
from memloom.sources.summaries import latest_run, load_runs

SAMPLES = [
    {
        "sample_id": "s1",
        "conversation": {
            "speaker_a": "Ann",
            "session_10": [{"speaker": "Ann", "dia_id": "D10:1", "text": "I love tea", "x": 1}],
            "session_2": [{"speaker": "Bo", "dia_id": "D2:1", "text": "We met yesterday"}],
            "session_2_date_time": "1:56 pm on 8 May, 2023",
            "session_3": [],
            "session_4_date_time": "9 May 2023",
        },
        "qa": [
            {"question": "What does Ann love?", "answer": "tea", "evidence": ["D10:1"], "category": 4},
            {"question": "n?", "answer": 7, "evidence": ["D:2:01; D2:3"], "category": 1},
            {"question": "b?", "answer": True, "category": 2},
            {"question": "null?", "answer": None, "category": 3},
            {"question": "none?", "category": 3},
            {"question": "gone", "answer": "x", "category": 5},
        ],
    }
]


@pytest.fixture(scope="module")
def file(tmp_path_factory):
    path = tmp_path_factory.mktemp("samples") / "samples.json"
    path.write_text(json.dumps(SAMPLES))
    return str(path)


def test_loader(spark, file):
    s = read_samples(spark, file)
    assert load_dialogues(s).first().speakers == ["Ann", ""]
    turns = load_turns(s).orderBy("session_no").collect()
    assert [(t.session_no, t.dia_id, t.timestamp_raw, str(t.ts_date)) for t in turns] == [(2, "D2:1", "1:56 pm on 8 May, 2023", "2023-05-08"), (10, "D10:1", "", "None")]
    qa = load_qa(s).orderBy("qa_pos").collect()
    assert [q.gold_answer for q in qa] == ["tea", "7", "True", "None", ""]
    assert qa[1].evidence_dia_ids == ["D2:1", "D2:3"] and qa[2].evidence_dia_ids == []
    assert tuple(dataset_counts(s).first()) == (1, 5)


def test_command_line_run_and_stored_summary(spark, file, tmp_path, capsys):
    cli.main(["run", file, "--base-only", "--combos", "append_all+bm25,regex_v2+tfidf,no_memory+no_retrieval", "--results", str(tmp_path), "--name", "r"], spark)
    shown = capsys.readouterr().out
    assert shown.splitlines()[:2] == ["reader: stub (no model)", "judge: stub (no model)"]
    assert shown.splitlines()[2].split() == ["combo", "n", "judge", "EM", "F1", "hit@5", "recall@5", "MRR", "empty"]
    folder = tmp_path / "r" / "base"
    stored = json.loads((folder / "summary.json").read_text())
    assert stored["retrieval_k"] == 5 and {r["combo"] for r in stored["runs"]} == {"append_all+bm25", "regex_v2+tfidf", "no_memory+no_retrieval"}
    assert "# Evaluation Report" in (folder / "report.md").read_text() and (folder / "figures" / "table_main.tex").exists()
    loaded = load_runs(spark, str(folder))
    assert loaded.filter("level = 'overall'").count() == 3 and loaded.filter("level = 'category' and category = 4").count() == 3
    assert sorted(p.name for p in folder.glob("*.jsonl")) == ["append_all+bm25.jsonl", "no_memory+no_retrieval.jsonl", "regex_v2+tfidf.jsonl"]
    records = [json.loads(line) for line in (folder / "append_all+bm25.jsonl").read_text().splitlines()]
    assert {"gold", "answer", "correct", "retrieved_dia_ids"} <= set(records[0]) and len(records) == 5
    cli.main(["run", file, "--base-only", "--combos", "append_all+bm25", "--results", str(tmp_path), "--name", "f", "--records", "folders", "--no-figures"], spark)
    assert spark.read.json(str(tmp_path / "f" / "base" / "questions")).count() == 5
    cli.main(["analyze", str(folder)], spark)
    assert latest_run(str(tmp_path / "r")).name == "base"
    capsys.readouterr()
    cli.main(["count", file], spark)
    assert "1 dialogues, 5 questions" in capsys.readouterr().out
    with pytest.raises(FileNotFoundError):
        load_runs(spark, str(tmp_path))


def row(combo, level="overall", category=None, acc=0.0625):
    names = ["qa_accuracy", "judge_score", "exact_match", "token_f1", "avg_memories_retrieved", "empty_retrieval_rate", "evidence_hit_at_k", "evidence_precision_at_k", "evidence_recall_at_k", "evidence_full_recall_at_k", "mrr"]
    return {"combo": combo, "config": combo, "level": level, "category": category, "n": 96, "n_with_evidence": 2, **dict.fromkeys(names, acc)}


def test_rendering():
    rows = [row("append_all+tfidf"), row("append_all+tfidf", "category", 3), row("append_all+tfidf", "category", 9)]
    text = report.render_markdown(rows, 5)
    assert "| append_all+tfidf | 96 | 6.2% | 0.062 | 6.2% | 6.2% |" in text and "3: Open-domain" in text and "9: Unknown" in text
    assert report.render_console([], 5).splitlines()[1].startswith("-----")
    assert [r["combo"] for r in report.in_order([row("b"), row("a"), row("z")], ["z"])] == ["z", "a", "b"]


def test_pivots_and_ablations(spark):
    rows = [row(f"{e}+{r}", acc=a) for (e, r), a in {("regex", "tfidf"): 0.405, ("regex_v2", "tfidf"): 0.428, ("regex", "bm25"): 0.405, ("ner", "word2vec"): 0.2, ("ner", "word2vec_tfidf"): 0.3}.items()]
    rows += [row("no_memory+no_retrieval", acc=0.008), row("regex+tfidf", "category", 2, 0.5)]
    columns = [c for c in rows[0] if c != "combo"]
    s = spark.createDataFrame([tuple(r[c] for c in columns) for r in rows], "config string, level string, category int, n bigint, n_with_evidence bigint, " + ", ".join(f"{c} double" for c in columns[5:]))
    m = {r.extractor: r for r in analyze.matrix_pivot(s).collect()}
    assert m["regex"].tfidf == 0.405 and m["regex"].word2vec is None and "no_memory" not in m
    assert {r.extractor: r.retriever for r in analyze.best_retriever(s).collect()} == {"regex": "tfidf", "regex_v2": "tfidf", "ner": "word2vec_tfidf"}
    assert {(r.ablation, r.setting): round(r.delta, 3) for r in analyze.ablation_deltas(s).collect()} == {("regex_v1_v2", "tfidf"): 0.023, ("word2vec_pooling", "ner"): 0.1}
    tables = analyze.main_tables(s)
    assert "+2.3" in tables["ablations.md"] and "Baseline (no memory): 0.8" in tables["table_main.md"] and r"regex\_v2" in tables["table_main.tex"]
    assert "| regex+tfidf | -- | 50.0 | -- | -- |" in tables["table_by_category.md"]
    assert tables["table_main.md"].startswith("| Extractor \\ Retriever | tfidf | bm25 |") and tables["table_main.md"].endswith("Cells are QA accuracy (%) judged by the LLM judge.")
    assert tables["table_main.tex"].splitlines()[0] == r"\begin{table}[t]" and r"No-memory baseline: 0.8\%.}" in tables["table_main.tex"] and r"\toprule" in tables["table_main.tex"]
    assert tables["ablations.md"].startswith("## Regex rules: v1 vs v2\n\n| Retriever | v1 | v2 | delta |") and tables["ablations.md"].endswith("(v2 minus v1; tfidf minus uniform).")
    assert tables["table_by_category.md"].startswith("| Combo |") and tables["table_by_category.md"].endswith("Per-category QA accuracy (%).")


def test_pivot_has_every_retriever(spark):
    """Known ones in their order, others after them by name."""
    combos = ["regex+mine", "regex+sentence_emb_e5", "ner+tfidf", "regex+sentence_emb"]
    s = spark.createDataFrame([(c, "overall", 0.1 * i) for i, c in enumerate(combos)], "config string, level string, qa_accuracy double")
    m = analyze.matrix_pivot(s)
    assert m.columns == ["extractor", "tfidf", "sentence_emb", "mine", "sentence_emb_e5"]
    assert {r.extractor: r.mine for r in m.collect()} == {"regex": 0.0, "ner": None}


def test_command_line_says_what_it_skips(spark, file, tmp_path, capsys):
    vectors = tmp_path / "vectors.txt"
    vectors.write_text("3 2\ntea 1.0 0.0\nlove 0.5 0.5\nyesterday 0.0 1.0\n")
    args = ["run", file, "--base-only", "--no-figures", "--results", str(tmp_path)]
    cli.main([*args, "--combos", "append_all+word2vec,append_all+word2vec_tfidf,append_all+sentence_emb", "--name", "w", "--word-vectors", str(vectors)], spark)
    shown = capsys.readouterr().out
    assert "[skip] base:append_all+sentence_emb: no sentence encoder" in shown
    assert {r["combo"] for r in json.loads((tmp_path / "w" / "base" / "summary.json").read_text())["runs"]} == {"append_all+word2vec", "append_all+word2vec_tfidf"}
    cli.main([*args, "--combos", "append_all+sentence_emb", "--name", "none"], spark)
    assert "nothing to score" in capsys.readouterr().out and not (tmp_path / "none").exists()
    with pytest.raises(SystemExit, match="not installed"):
        cli.main([*args, "--reader", "model"], spark)


def test_a_sample_delivered_again_gives_its_last_questions(spark, tmp_path):
    path = tmp_path / "twice.json"
    path.write_text(json.dumps([{**SAMPLES[0], "qa": [{"question": "old", "answer": "x", "category": 1}]}, SAMPLES[0], {"sample_id": "s2", "conversation": {}, "qa": []}]))
    s = read_samples(spark, str(path))
    assert {q.question for q in load_qa(s).collect()} == {"What does Ann love?", "n?", "b?", "null?", "none?"} and load_dialogues(s).count() == 3
