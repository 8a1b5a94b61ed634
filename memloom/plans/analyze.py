"""Pivots, ablations and plot data over a run's summary."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.plans.grid import BASELINE
from memloom.plans.report import CATEGORY_NAMES, markdown_table
from memloom.workspace import materialize

# The order in which extractors and retrievers are shown; others follow by name.
EXTRACTOR_ORDER = ["append_all", "regex", "regex_v2", "ner"]
RETRIEVER_ORDER = ["tfidf", "bm25", "word2vec", "word2vec_tfidf", "sentence_emb"]


def split_combo(combo: Column) -> tuple[Column, Column]:
    parts = F.split(combo, r"\+", 2)
    return parts[0], F.coalesce(F.get(parts, F.lit(1)), F.lit(""))


def overall(summary: DataFrame, config: str = "config") -> DataFrame:
    """Overall rows with ``combo, extractor, retriever``."""
    e, r = split_combo(F.col(config))
    others = [c for c in summary.columns if c not in (config, "combo", "extractor", "retriever")]
    return summary.filter("level = 'overall'").select(F.col(config).alias("combo"), e.alias("extractor"), r.alias("retriever"), *others)


def matrix_pivot(summary: DataFrame, retrievers: list[str] | None = None, *, config: str = "config", metric: str = "qa_accuracy") -> DataFrame:
    """Extractor by retriever; a missing configuration is null.

    Without ``retrievers`` every one in the summary gets a column, the known ones first.  The overall rows (one for each
    configuration) are written once, so that finding the names costs no second pass over the predictions.
    """
    cells = overall(summary, config).filter(F.col("combo") != BASELINE).select("extractor", "retriever", metric)
    if retrievers is None:
        cells = materialize(cells, "cells")
        retrievers = present([r.retriever for r in cells.select("retriever").distinct().collect()], RETRIEVER_ORDER)
    return cells.groupBy("extractor").pivot("retriever", retrievers).agg(F.first(metric))


def category_pivot(summary: DataFrame, *, config: str = "config", metric: str = "qa_accuracy") -> DataFrame:
    by = summary.filter("level = 'category'").select(F.col(config).alias("combo"), F.concat(F.lit("c"), F.col("category").cast("string")).alias("c"), metric)
    return by.groupBy("combo").pivot("c", [f"c{c}" for c in CATEGORY_NAMES]).agg(F.first(metric))


def ablation_deltas(summary: DataFrame, *, config: str = "config", metric: str = "qa_accuracy") -> DataFrame:
    """Rule versions for each retriever and pooling modes for each extractor; only where both sides exist."""
    rows = overall(summary, config).select("extractor", "retriever", F.col(metric).alias("x"))

    def pairs(name: str, side: str, other: str, first: str, second: str) -> DataFrame:
        a = rows.filter(F.col(side) == first).select(other, F.col("x").alias("first_value"))
        b = rows.filter(F.col(side) == second).select(other, F.col("x").alias("second_value"))
        delta = (F.col("second_value") - F.col("first_value")).alias("delta")
        return a.join(b, other).select(F.lit(name).alias("ablation"), F.col(other).alias("setting"), "first_value", "second_value", delta)

    rules = pairs("regex_v1_v2", "extractor", "retriever", "regex", "regex_v2")
    return rules.unionByName(pairs("word2vec_pooling", "retriever", "extractor", "word2vec", "word2vec_tfidf"))


def best_retriever(summary: DataFrame, *, config: str = "config", metric: str = "qa_accuracy") -> DataFrame:
    """The best retriever of each extractor; of equal ones the last by name."""
    rows = overall(summary, config).filter(F.col("combo") != BASELINE)
    return rows.groupBy("extractor").agg(F.max(F.struct(F.col(metric).alias("value"), "retriever")).alias("b")).select("extractor", F.col("b.retriever").alias("retriever"), F.col("b.value").alias("best_value"))


def scatter(summary: DataFrame, *, config: str = "config") -> DataFrame:
    """Evidence recall against accuracy of every configuration that retrieves."""
    return overall(summary, config).filter("retriever <> 'no_retrieval'").select("combo", "extractor", "retriever", "evidence_recall_at_k", "qa_accuracy")


def present(names: list[str], order: list[str]) -> list[str]:
    return [n for n in order if n in names] + sorted(n for n in set(names) if n not in order)


def _share(x: float | None) -> str:
    return "--" if x is None else f"{100 * x:.1f}"


# Wording and frame of the tables.
MAIN_HEAD, MAIN_FOOT = "Extractor \\ Retriever", "Cells are QA accuracy (%) judged by the LLM judge."
CATEGORY_FOOT = "Per-category QA accuracy (%)."
ABLATION_FOOT = "Delta is percentage points (v2 minus v1; tfidf minus uniform)."
ABLATIONS = {
    "regex_v1_v2": ("## Regex rules: v1 vs v2", ["Retriever", "v1", "v2", "delta"]),
    "word2vec_pooling": ("## Word2vec pooling: uniform vs tfidf", ["Extractor", "uniform", "tfidf", "delta"]),
}
LATEX_CAPTION = r"\caption{QA accuracy (\%%) for each extractor $\times$ retriever combination. No-memory baseline: %s\%%.}"


def _latex(head: list[str], body: list[list[str]], baseline: str) -> str:
    line = lambda cells: " & ".join(c.replace("_", r"\_") for c in cells) + r" \\"
    frame = [r"\begin{table}[t]", r"\centering", LATEX_CAPTION % baseline, r"\label{tab:main}", rf"\begin{{tabular}}{{l{'r' * (len(head) - 1)}}}", r"\toprule", line(head), r"\midrule"]
    return "\n".join([*frame, *map(line, body), r"\bottomrule", r"\end{tabular}", r"\end{table}"])


def main_tables(summary: DataFrame, config: str = "config") -> dict[str, str]:
    """Text of the figure tables: ``table_main.md``, ``table_main.tex``, ``table_by_category.md``, ``ablations.md``."""
    rows = [r.asDict() for r in overall(summary, config).collect()]
    acc = {r["combo"]: r["qa_accuracy"] for r in rows}
    real = [r for r in rows if r["combo"] != BASELINE]
    extractors = present([r["extractor"] for r in real], EXTRACTOR_ORDER)
    retrievers = present([r["retriever"] for r in real], RETRIEVER_ORDER)
    body = [[e, *[_share(acc.get(f"{e}+{r}")) for r in retrievers]] for e in extractors]
    main = [markdown_table([MAIN_HEAD, *retrievers], body), ""]
    if BASELINE in acc:
        main.append(f"Baseline (no memory): {_share(acc[BASELINE])}")
    by = {(r[config], r["category"]): r["qa_accuracy"] for r in (x.asDict() for x in summary.filter("level = 'category'").collect())}
    order = ([BASELINE] if BASELINE in acc else []) + [f"{e}+{r}" for e in extractors for r in retrievers if f"{e}+{r}" in acc]
    category = [[c, *[_share(by.get((c, k))) for k in CATEGORY_NAMES]] for c in order]
    deltas = [r.asDict() for r in ablation_deltas(summary, config=config).collect()]
    shown = {"regex_v1_v2": (retrievers, {"regex", "regex_v2"} <= set(extractors)), "word2vec_pooling": (extractors, {"word2vec", "word2vec_tfidf"} <= set(retrievers))}
    ablations: list[str] = []
    for key, (title, head) in ABLATIONS.items():
        settings, both = shown[key]
        if both:
            found = {d["setting"]: [_share(d["first_value"]), _share(d["second_value"]), f"{100 * d['delta']:+.1f}"] for d in deltas if d["ablation"] == key}
            ablations += [title, "", markdown_table(head, [[x, *found[x]] for x in settings if x in found]), ""]
    return {
        "table_main.md": "\n".join([*main, "", MAIN_FOOT]),
        "table_main.tex": _latex(["Extractor", *retrievers], body, _share(acc.get(BASELINE))),
        "table_by_category.md": "\n".join([markdown_table(["Combo", *CATEGORY_NAMES.values()], category), "", CATEGORY_FOOT]),
        "ablations.md": "\n".join([*ablations, ABLATION_FOOT]),
    }


def by_category(summary: DataFrame, *, config: str = "config") -> DataFrame:
    """Accuracy by category of each extractor with its best retriever."""
    best = best_retriever(summary, config=config).select(F.concat_ws("+", "extractor", "retriever").alias("combo"), "extractor", "retriever")
    return best.join(category_pivot(summary, config=config), "combo")


def generate(summary: DataFrame, output_dir: str | Path, config: str = "config") -> list[Path]:
    """Writes the tables, and the data of the figures as CSV (plotting itself is left to other tools)."""
    out = Path(output_dir)
    out.mkdir(parents=True, exist_ok=True)
    made = []
    for name, text in main_tables(summary, config).items():
        (out / name).write_text(text, encoding="utf-8")
        made.append(out / name)
    for name, df in (("matrix_accuracy", matrix_pivot(summary, config=config)), ("by_category", by_category(summary, config=config)), ("retrieval_vs_answer", scatter(summary, config=config))):
        df.toPandas().to_csv(out / f"{name}.csv", index=False)
        made.append(out / f"{name}.csv")
    return made
