"""Queries of the operators of this package, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from memloom.llm.encode import decode_corpus, encode_corpus
from memloom.llm.pack import pack_corpus, packing_report
from memloom.llm.pairs import broken_pairs, qa_and_prediction_pairs
from memloom.llm.pii import find_spans, redact
from memloom.llm.spam import spam_pages
from memloom.llm.terms import one_per_record, term_frequencies
from memloom.sources.tables import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    memories = one_per_record(table(spark, sf_dir, "memories"), "memory_id", "text", "ingested_at", "memories.text")
    questions = one_per_record(table(spark, sf_dir, "qa_items"), "qid", "question", "ingested_at", "qa_items.question")
    return term_frequencies(memories.unionByName(questions))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_spans(table(spark, sf_dir, "turns"), table(spark, sf_dir, "person_names")).select("turn_id", "pii_type", "start_pos")


def p3_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact(table(spark, sf_dir, "turns"), table(spark, sf_dir, "person_names"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return broken_pairs(qa_and_prediction_pairs(table(spark, sf_dir, "qa_items"), table(spark, sf_dir, "predictions")))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(table(spark, sf_dir, "documents"))


def p6_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode_corpus(p6_ids(spark, sf_dir))


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_corpus(table(spark, sf_dir, "documents"))


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing_report(p7_packed(spark, sf_dir))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spam_pages(table(spark, sf_dir, "documents"))


QUERIES = {
    "p1_found": p1_found,
    "p3_found": p3_found,
    "p3_redacted": p3_redacted,
    "p5_found": p5_found,
    "p6_ids": p6_ids,
    "p6_decoded": p6_decoded,
    "p7_packed": p7_packed,
    "p7_report": p7_report,
    "p8_found": p8_found,
}

ORACLES = {
    "p1_found": r"""
with records as (
  select 'memories.text' src_field, memory_id id, min(text) text from memories where text is not null group by memory_id
  union all select 'qa_items.question', qid, min(question) from qa_items where question is not null group by qid
), terms as (
  select src_field, id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) term from records
), counted as (
  select src_field, term, count(*) n_total, count(distinct id) n_records from terms group by all
), n as (select src_field, count(*) n from records group by all)
select src_field, term, n_total, n_records,
  case when n_records <= 2 then 'rare' when n_records > 0.1 * n then 'common' else 'usual' end mark
from counted join n using (src_field)
""",
    # Decoding gives the texts back.
    "p6_decoded": "select doc_id, coalesce(text, '') as text from documents",
}
