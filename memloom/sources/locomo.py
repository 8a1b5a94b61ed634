"""Dialogue samples: JSON files and tables of nested samples to dialogues, turns and questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.functions.ids import evidence_ids
from memloom.functions.text import parse_date
from memloom.operators.nested import allow_duplicate_keys, with_whole_json

# Fixed value: question categories that have no answer.
EXCLUDED_CATEGORIES = (5,)


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """``sample_id, conversation, qa, sample_pos`` of a file with one array of samples; nested parts stay JSON texts.

    The schema is given, never inferred: a key for each session would else become a column.
    """
    raw = spark.read.schema("sample_id string, conversation string, qa string").option("multiLine", True).json(path)
    return raw.withColumn("sample_pos", F.monotonically_increasing_id())


def _parsed(samples: DataFrame, column: str) -> DataFrame:
    allow_duplicate_keys(samples)
    return with_whole_json(samples, [column])


def _string(v: Column, path: str, default: str = "") -> Column:
    return F.coalesce(F.try_variant_get(v, path, "string"), F.lit(default))


def load_dialogues(samples: DataFrame, id_col: str = "sample_id") -> DataFrame:
    """``conv_id, speakers``: the two speakers of each sample whose conversation is an object, empty if missing."""
    docs = _parsed(samples.select(F.col(id_col).alias("conv_id"), "conversation"), "conversation")
    docs = docs.filter(F.schema_of_variant("conversation").startswith("OBJECT"))
    return docs.select("conv_id", F.array(_string(F.col("conversation"), "$.speaker_a"), _string(F.col("conversation"), "$.speaker_b")).alias("speakers"))


def load_turns(samples: DataFrame, id_col: str = "sample_id") -> DataFrame:
    """All turns of the sessions in numerical order: ``conv_id, session_no, session_id, turn_no, speaker, dia_id, text, timestamp_raw, ts_date``.

    Only keys ``session_<digits>`` are sessions; a session's date is looked up under its own key.  A session that
    is no array counts as its one turn, null elements are dropped.
    """
    docs = _parsed(samples.select(F.col(id_col).alias("conv_id"), "conversation"), "conversation")
    docs = docs.filter(F.schema_of_variant("conversation").startswith("OBJECT"))
    entries = docs.select("conv_id", F.try_variant_get("conversation", "$", "map<string,variant>").alias("m"))
    sessions = entries.select("conv_id", "m", F.explode(F.filter(F.map_keys("m"), lambda k: k.rlike(r"^session_\d+\z"))).alias("session_id"))
    sessions = sessions.select(
        "conv_id", "session_id", F.element_at("m", F.col("session_id")).alias("v"), F.coalesce(F.try_variant_get(F.element_at("m", F.concat("session_id", F.lit("_date_time"))), "$", "string"), F.lit("")).alias("timestamp_raw")
    ).filter("v is not null and not is_variant_null(v)")
    listed = F.coalesce(F.try_variant_get("v", "$", "array<variant>"), F.array("v"))
    turns = sessions.select("conv_id", "session_id", "timestamp_raw", F.posexplode(listed).alias("turn_no", "t")).filter("t is not null and not is_variant_null(t)")
    return turns.select(
        "conv_id",
        F.regexp_extract("session_id", r"(\d+)\z", 1).try_cast("int").alias("session_no"),
        "session_id",
        "turn_no",
        _string(F.col("t"), "$.speaker").alias("speaker"),
        _string(F.col("t"), "$.dia_id").alias("dia_id"),
        _string(F.col("t"), "$.text").alias("text"),
        "timestamp_raw",
        parse_date(F.col("timestamp_raw")).alias("ts_date"),
    )


def _as_python_text(v: Column) -> Column:
    """Text of a JSON scalar as the published loader prints it: missing is empty, null ``None``, booleans capitalised."""
    kind = F.schema_of_variant(v)
    text = F.try_variant_get(v, "$", "string")
    return F.when(v.isNull(), "").when(F.is_variant_null(v), "None").when(kind == "BOOLEAN", F.initcap(text)).otherwise(text)


def load_qa(samples: DataFrame, id_col: str = "sample_id") -> DataFrame:
    """``conv_id, qa_pos, question, gold_answer, evidence_dia_ids, category`` without the categories that have no answer.

    Of samples with one id the last in the file (``sample_pos``) gives the questions; without that column each row does.
    """
    if "sample_pos" in samples.columns:
        known = samples.filter(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max_by("qa", "sample_pos").alias("qa"))
        samples = known.unionByName(samples.filter(F.col(id_col).isNull()).select(id_col, "qa"))
    docs = _parsed(samples.select(F.col(id_col).alias("conv_id"), "qa"), "qa")
    listed = F.coalesce(F.try_variant_get("qa", "$", "array<variant>"), F.when(F.schema_of_variant("qa").startswith("OBJECT"), F.array("qa")))
    items = docs.select("conv_id", F.posexplode(listed).alias("qa_pos", "q")).filter("q is not null and not is_variant_null(q)")
    evidence = F.try_variant_get("q", "$.evidence", "variant")
    entries = F.coalesce(F.try_variant_get(evidence, "$", "array<variant>"), F.when(evidence.isNotNull() & ~F.is_variant_null(evidence), F.array(evidence)), F.array().cast("array<variant>"))
    category = F.try_variant_get("q", "$.category", "int")
    return items.select(
        "conv_id",
        "qa_pos",
        _string(F.col("q"), "$.question").alias("question"),
        _as_python_text(F.try_variant_get("q", "$.answer", "variant")).alias("gold_answer"),
        evidence_ids(F.transform(entries, lambda e: F.try_variant_get(e, "$", "string"))).alias("evidence_dia_ids"),
        category.alias("category"),
    ).filter(F.col("category").isNull() | ~F.col("category").isin(*EXCLUDED_CATEGORIES))


def dataset_counts(samples: DataFrame, id_col: str = "sample_id") -> DataFrame:
    """One row: number of dialogues and of usable questions."""
    kinds = load_dialogues(samples, id_col).select(F.lit(1).alias("d")).unionByName(load_qa(samples, id_col).select(F.lit(0).alias("d")))
    return kinds.agg(F.count_if(F.col("d") == 1).alias("n_dialogues"), F.count_if(F.col("d") == 0).alias("n_questions"))
