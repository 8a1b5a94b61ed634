"""Reports: rows of a summary (a few for each configuration) formatted on the driver, and the sinks of a run."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.operators.metrics import ANSWER_METRICS, EVIDENCE_METRICS, source_ids

# Names of the question categories, and the columns of the tables.
CATEGORY_NAMES = {1: "Multi-hop", 2: "Temporal", 3: "Open-domain", 4: "Single-hop"}
ANSWER_COLUMNS = ["Method", "N", "Judge Acc.", "Mean Judge Score", "Exact Match", "Token F1"]
RETRIEVAL_COLUMNS = ["Method", "Evidence N", "Evidence Hit@{k}", "Evidence Precision@{k}", "Evidence Recall@{k}", "Full Recall@{k}", "MRR", "Avg. Memories", "Empty Retrieval"]
CATEGORY_COLUMNS = ["Method", "Category", "N", "Judge Acc.", "Token F1", "Evidence Hit@{k}", "Evidence Recall@{k}"]
CONSOLE_COLUMNS = ["combo", "n", "judge", "EM", "F1", "hit@{k}", "recall@{k}", "MRR", "empty"]

_CELLS = {
    "answer": [("n", "d"), ("qa_accuracy", "%"), ("judge_score", ".3f"), ("exact_match", "%"), ("token_f1", "%")],
    "retrieval": [("n_with_evidence", "d"), *[(f"evidence_{m}_at_k", "%") for m in ("hit", "precision", "recall", "full_recall")], ("mrr", ".3f"), ("avg_memories_retrieved", ".2f"), ("empty_retrieval_rate", "%")],
    "category": [("n", "d"), ("qa_accuracy", "%"), ("token_f1", "%"), ("evidence_hit_at_k", "%"), ("evidence_recall_at_k", "%")],
    "console": [("n", "d"), ("qa_accuracy", "%"), ("exact_match", "%"), ("token_f1", "%"), ("evidence_hit_at_k", "%"), ("evidence_recall_at_k", "%"), ("mrr", ".3f"), ("empty_retrieval_rate", "%")],
}


def percent(x: float) -> str:
    """One decimal, rounded as Python formats (not as the JVM does)."""
    return f"{100 * x:.1f}%"


def _cell(value, form: str) -> str:
    return percent(value) if form == "%" else format(value, form)


def _cells(row: dict, table: str) -> list[str]:
    return [_cell(row[name], form) for name, form in _CELLS[table]]


def rows_of(summary: DataFrame, config: str = "config") -> list[dict]:
    """Summary rows on the driver: one for each configuration and category, so a bounded few hundred."""
    rows = [r.asDict() for r in summary.collect()]
    return sorted(({**r, "combo": r[config]} for r in rows), key=lambda r: (r["combo"], r["level"] != "overall", r["category"] is None, r["category"] or 0))


def in_order(rows: list[dict], order: list[str]) -> list[dict]:
    place = {c: i for i, c in enumerate(order)}
    return sorted(rows, key=lambda r: (place.get(r["combo"], len(place)), r["combo"] if r["combo"] not in place else ""))


def markdown_table(headers: list[str], rows: list[list[str]]) -> str:
    return "\n".join("| " + " | ".join(cells) + " |" for cells in [headers, ["---"] * len(headers), *rows])


def category_label(category: int | None) -> str:
    return f"{category}: {CATEGORY_NAMES.get(category, 'Unknown')}"


def render_markdown(rows: list[dict], k: int) -> str:
    overall = [r for r in rows if r["level"] == "overall"]
    by = [r for r in rows if r["level"] == "category"]
    heads = [[h.format(k=k) for h in hs] for hs in (ANSWER_COLUMNS, RETRIEVAL_COLUMNS, CATEGORY_COLUMNS)]
    legend = ", ".join(f"{c} = {n}" for c, n in CATEGORY_NAMES.items())
    parts = [
        "# Evaluation Report",
        f"Retrieval metrics use the top {k} memories. Evidence metrics are macro-averaged over questions that provide gold evidence.",
        "## Overall comparison",
        "### Answer quality",
        markdown_table(heads[0], [[r["combo"], *_cells(r, "answer")] for r in overall]),
        "### Retrieval quality",
        markdown_table(heads[1], [[r["combo"], *_cells(r, "retrieval")] for r in overall]),
        "## LOCOMO category breakdown",
        markdown_table(heads[2], [[r["combo"], category_label(r["category"]), *_cells(r, "category")] for r in by]),
        f"Categories: {legend}.",
    ]
    return "\n\n".join(parts) + "\n"


def render_console(rows: list[dict], k: int) -> str:
    """Aligned text table of the overall rows; without rows only its head."""
    table = [[h.format(k=k) for h in CONSOLE_COLUMNS], *[[r["combo"], *_cells(r, "console")] for r in rows if r["level"] == "overall"]]
    widths = [max(map(len, column)) for column in zip(*table)]
    table.insert(1, ["-" * w for w in widths])
    return "\n".join("  ".join(c.ljust(w) if i == 0 else c.rjust(w) for i, (c, w) in enumerate(zip(line, widths))) for line in table)


def _nested(row: dict) -> dict:
    flat = {m: row[m] for m in ("n", *ANSWER_METRICS, "avg_memories_retrieved", "empty_retrieval_rate")}
    return flat | {"retrieval": {m: row[m] for m in ("n_with_evidence", *EVIDENCE_METRICS)}}


def summary_payload(rows: list[dict], k: int) -> dict:
    runs = []
    for row in rows:
        if row["level"] == "overall":
            by = {str(r["category"]): _nested(r) for r in rows if r["level"] == "category" and r["combo"] == row["combo"]}
            runs.append({"combo": row["combo"], **_nested(row), "by_category": by})
    return {"retrieval_k": k, "runs": runs}


def write_reports(rows: list[dict], output_dir: str | Path, k: int) -> None:
    """``summary.json`` and ``report.md``."""
    out = Path(output_dir)
    out.mkdir(parents=True, exist_ok=True)
    (out / "summary.json").write_text(json.dumps(summary_payload(rows, k), ensure_ascii=False, indent=2) + "\n", encoding="utf-8")
    (out / "report.md").write_text(render_markdown(rows, k), encoding="utf-8")


def question_records(scored: DataFrame, *more: str) -> DataFrame:
    """Per-question records of a run, with the columns of the JSON Lines sink (and further ones, if named)."""
    return scored.select(
        *more,
        "config",
        "conv_id",
        "category",
        "question",
        F.col("gold_answer").alias("gold"),
        F.col("answer_text").alias("answer"),
        F.col("judge_label").alias("correct"),
        "judge_score",
        "exact_match",
        "token_f1",
        F.col("evidence").alias("gold_evidence_dia_ids"),
        source_ids(F.col("retrieved_memories")).alias("retrieved_dia_ids"),
        "retrieved_memories",
    )


def write_question_records(scored: DataFrame, output_dir: str | Path) -> None:
    """JSON Lines, one folder for each configuration; written in parallel by the tasks that hold the rows."""
    question_records(scored).write.mode("overwrite").option("ignoreNullFields", "false").partitionBy("config").json(str(output_dir))


def write_question_files(scored: DataFrame, output_dir: str | Path) -> list[str]:
    """The same records as one file ``<config>.jsonl`` for each configuration.

    A task writes a configuration's rows as they come, so nothing is gathered; the part files are then renamed.
    """
    staging = f"{output_dir}/_questions"
    question_records(scored).repartition("config").write.mode("overwrite").option("ignoreNullFields", "false").partitionBy("config").json(staging)
    jvm, conf = scored.sparkSession.sparkContext._jvm, scored.sparkSession.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(staging)
    fs = where.getFileSystem(conf)
    made = []
    for part in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{staging}/config=*/part-*.json")):
        config = part.getPath().getParent().getName().removeprefix("config=").replace("%2B", "+")
        target = jvm.org.apache.hadoop.fs.Path(f"{output_dir}/{config}.jsonl")
        fs.delete(target, False)
        fs.rename(part.getPath(), target)
        made.append(target.toString())
    fs.delete(where, True)
    return sorted(made)
