"""Command line: ``python -m memloom.plans.cli run|analyze|count ...``."""

from __future__ import annotations

import argparse
from datetime import datetime
from pathlib import Path

from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from memloom.operators.answer import ContainsGold, FirstContext, ModelJudge, ModelReader
from memloom.operators.extract import spacy_tagger
from memloom.plans import analyze, grid, pipeline, registry, report
from memloom.sources import models
from memloom.sources.locomo import dataset_counts, load_qa, load_turns, read_samples
from memloom.sources.summaries import latest_run, load_runs


def _parser() -> argparse.ArgumentParser:
    ap = argparse.ArgumentParser(description=__doc__)
    sub = ap.add_subparsers(dest="command", required=True)
    run = sub.add_parser("run", help="run the experiment grid over a file of samples")
    run.add_argument("data")
    run.add_argument("--subset", type=int, default=0, help="only the first N dialogues")
    which = run.add_mutually_exclusive_group()
    which.add_argument("--base-only", action="store_true")
    which.add_argument("--timestamp", action="store_true")
    run.add_argument("--name", default=None, help="folder under results/")
    run.add_argument("--no-figures", action="store_true")
    run.add_argument("--batch-size", type=int, default=16)
    run.add_argument("--combos", default=None)
    run.add_argument("--results", default="results")
    run.add_argument("--records", choices=("files", "folders"), default="files", help="folders: records of a configuration in many part files")
    run.add_argument("--word-vectors", default=None, help="text file of word vectors (default: the model of W2V_MODEL, if gensim is installed)")
    run.add_argument("--reader", choices=("stub", "model"), default="stub", help="model: the local model of READER_MODEL")
    run.add_argument("--judge", choices=("stub", "model"), default="stub", help="model: the local model of JUDGE_MODEL")
    run.add_argument("--tagger", choices=("rules", "spacy"), default="rules", help="spacy: the model of NER_MODEL")
    look = sub.add_parser("analyze", help="tables of a run")
    look.add_argument("run_dir", nargs="?")
    look.add_argument("--results", default="results")
    count = sub.add_parser("count", help="dialogues and questions of a file of samples")
    count.add_argument("data")
    return ap


def _resources(spark: SparkSession, args: argparse.Namespace) -> registry.Resources:
    """What is installed or given for the dense retrievers and the tagger."""
    found = registry.Resources()
    if args.word_vectors:
        found.vectors = models.read_word_vectors(spark, args.word_vectors)
    elif models.installed("gensim") is None:
        try:
            found.vectors = models.gensim_vectors(spark)
        except Exception as e:  # noqa: BLE001  no network, no such model: the retrievers are skipped with this reason
            print(f"word vectors unavailable: {type(e).__name__}: {e}")
    if models.installed("sentence_transformers") is None:
        names = {"sentence_emb": models.model_name("SENT_MODEL"), "sentence_emb_e5": models.E5_MODEL}
        found.encoders = {retriever: (name, models.sentence_encoder(name)) for retriever, name in names.items()}
    if args.tagger == "spacy":
        found.tagger = spacy_tagger(models.model_name("NER_MODEL"))
    return found


def _model(kind: str, choice: str, make, stub):
    """The chosen reader or judge; a run always says which one it is."""
    if choice == "stub":
        print(f"{kind}: stub (no model)")
        return stub()
    lacking = models.installed("torch", "transformers")
    if lacking:
        raise SystemExit(f"{kind} unavailable: {lacking} is not installed")
    name = models.model_name(f"{kind.upper()}_MODEL")
    print(f"{kind}: {name}")
    return make(name)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = _parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("memloom").getOrCreate()
    if args.command == "count":
        row = dataset_counts(read_samples(spark, args.data)).first()
        print(f"{row.n_dialogues} dialogues, {row.n_questions} questions")
        return
    if args.command == "analyze":
        where = Path(args.run_dir) if args.run_dir else latest_run(args.results)
        if where is None:
            raise SystemExit(f"no run under {args.results}")
        analyze.generate(load_runs(spark, str(where)), where / "figures", config="combo")
        return
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(args.batch_size))
    samples = read_samples(spark, args.data)
    if args.subset:
        samples = samples.orderBy("sample_pos").limit(args.subset)
    turns = load_turns(samples).withColumn("pos", F.row_number().over(Window.partitionBy("conv_id").orderBy("session_no", "turn_no")))
    numbered = load_qa(samples).withColumn("qid", F.xxhash64("conv_id", "qa_pos"))
    variants = ("base",) if args.base_only else ("timestamp",) if args.timestamp else grid.VARIANTS
    reader = _model("reader", args.reader, ModelReader, FirstContext)
    judge = _model("judge", args.judge, ModelJudge, ContainsGold)
    resources = _resources(spark, args)
    entries, skipped = registry.runnable(grid.plan(variants, args.combos), resources)
    for entry, why in skipped:
        print(f"[skip] {entry.variant}:{entry.combo}: {why}")
    if not entries:
        print("nothing to score")
        return
    scored = pipeline.scored_predictions(pipeline.run_grid(turns, numbered, entries, resources=resources, reader=reader, judge=judge))
    out = Path(args.results) / (args.name or datetime.now().strftime("%Y%m%d-%H%M%S"))
    for variant in variants:
        own = scored.filter(F.col("variant") == variant)
        summary = pipeline.summary(own, ["config"])
        rows = report.in_order(report.rows_of(summary), [e.combo for e in entries])
        report.write_reports(rows, out / variant, 5)
        if args.records == "files":
            report.write_question_files(own, out / variant)
        else:
            report.write_question_records(own, out / variant / "questions")
        print(report.render_console(rows, 5))
        if not args.no_figures:
            analyze.generate(summary, out / variant / "figures")


if __name__ == "__main__":
    main()
