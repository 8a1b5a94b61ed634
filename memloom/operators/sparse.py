"""Sparse retrieval inside scopes: term statistics, TF-IDF cosine, BM25, deterministic top-k.

A scope is one extractor's memories of one conversation; all statistics are keyed by it.  For retrieval, questions and
memories are brought together by conversation, and ``postings`` finds the k best of each question in the task: no row
is made for a pair of them, and only what is found leaves the task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.functions.text import tokens
from memloom.operators.postings import Block
from memloom.workspace import ship_package

SCOPE = ["extractor", "conv_id"]
MEMORY = [*SCOPE, "mem_idx"]
# Parameters of the two scoring formulas.
K1, B = 1.5, 0.75
TOP_K = 5
#: Questions of a conversation from which on it is in several blocks, and in how many at most.
QUESTION_BLOCK, MAX_PARTS = 1000, 4


def _terms(memories: DataFrame) -> Column:
    return F.col("t") if "t" in memories.columns and "text" not in memories.columns else tokens(F.col("text"))


def term_freq(memories: DataFrame) -> DataFrame:
    """``extractor, conv_id, mem_idx, n_terms, term, tf`` of every memory; memories without a term have no row.

    Memories are brought together by their key before their terms are counted: one row of a memory is moved, not one
    for each of its terms.
    """
    found = memories.select(*MEMORY, _terms(memories).alias("t")).repartition(*MEMORY).select(*MEMORY, F.size("t").alias("n_terms"), F.explode("t").alias("term"))
    return found.groupBy(*MEMORY, "n_terms", "term").agg(F.count("*").alias("tf"))


def doc_freq(postings: DataFrame) -> DataFrame:
    """``extractor, conv_id, term, df``: memories of each scope that hold a term, from ``term_freq`` or ``tokenized`` memories."""
    if "t" in postings.columns:
        postings = postings.select(*SCOPE, F.explode(F.array_distinct("t")).alias("term"))
    return postings.groupBy(*SCOPE, "term").agg(F.count("*").alias("df"))


def doc_stats(memories: DataFrame) -> DataFrame:
    """``n_docs, avg_len`` of each scope; memories without terms count in both."""
    return memories.select(*SCOPE, F.size(_terms(memories)).alias("n")).groupBy(*SCOPE).agg(F.count("*").alias("n_docs"), F.avg("n").alias("avg_len"))


def idf_smooth(n_docs: Column, df: Column) -> Column:
    return F.log((1.0 + n_docs) / (1.0 + df)) + 1.0


def idf_bm25(n_docs: Column, df: Column) -> Column:
    return F.log(1.0 + (n_docs - df + 0.5) / (df + 0.5))


def idf_table(memories: DataFrame, formula) -> DataFrame:
    """``extractor, conv_id, term, df, idf`` by one of the two formulas."""
    memories = memories.select(*MEMORY, _terms(memories).alias("t"))
    stats = doc_stats(memories)
    return doc_freq(memories).join(stats, SCOPE).select(*SCOPE, "term", "df", formula(F.col("n_docs"), F.col("df")).alias("idf"))


def top_k(scored: DataFrame, k: int, *, group: list[str], tie: str = "mem_idx") -> DataFrame:
    """The k best of each group by score rounded to 9 digits, ties by the earlier memory; adds ``rank`` from 1."""
    if k <= 0:
        return scored.withColumn("rank", F.lit(0)).filter(F.lit(False))
    order = Window.partitionBy(*group).orderBy(F.round("score", 9).desc(), F.col(tie))
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def block_numbers(questions: DataFrame) -> tuple[DataFrame, Column, Column]:
    """``conv_id, parts`` of conversations that are in several blocks; for rows joined with it, the block of a question, and all blocks of a memory."""
    spark = questions.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism)
    sizes = questions.filter("conv_id is not null").groupBy("conv_id").agg(F.count("*").alias("n")).filter(F.col("n") > QUESTION_BLOCK)
    parts = F.broadcast(sizes.select("conv_id", F.least(F.ceil(F.col("n") / QUESTION_BLOCK), F.lit(MAX_PARTS)).cast("int").alias("parts")))
    # Parts of one conversation have different numbers whatever the hash.
    whole = F.pmod(F.xxhash64("conv_id"), F.lit(n))
    part = lambda i: n + F.pmod(F.xxhash64("conv_id"), F.lit(1 << 40)) * MAX_PARTS + i
    one = F.when(F.col("parts").isNull(), whole).otherwise(part(F.pmod(F.xxhash64("qid"), F.col("parts"))))
    every = F.when(F.col("parts").isNull(), F.array(whole)).otherwise(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), part))
    return parts, one, every


def _blocks(memories: DataFrame, questions: DataFrame, carried: tuple[str, ...], given: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Questions and memories with the ``block`` they meet in; both are moved once, with their terms in one text.

    A conversation is wholly in one block; one with more than ``QUESTION_BLOCK`` questions is in up to ``MAX_PARTS`` of
    them, each with a part of its questions and all its memories.
    """
    parts, one, every = block_numbers(questions)
    text = lambda c: F.array_join(tokens(F.col(c)), " ").alias("t")
    asked = questions.select("qid", "conv_id", *[c for c in carried if c not in ("qid", "conv_id")], text("question")).join(parts, "conv_id", "left")
    held = memories.select(*MEMORY, *given, *([] if "text" in given else [text("text")])).join(parts, "conv_id", "left")
    held = held.withColumn("block", F.explode(every)).drop("parts")
    if "text" in given:
        # A text is moved without its terms, which are found again after that.
        held = held.repartition("block").select("*", text("text"))
    return asked.withColumn("block", one).drop("parts"), held


def _in_blocks(memories: DataFrame, questions: DataFrame, work, schema: str, carried: tuple[str, ...] = (), given: tuple[str, ...] = ()) -> DataFrame:
    ship_package(questions.sparkSession)
    asked, held = _blocks(memories, questions, carried, given)
    return asked.groupBy("block").cogroup(held.groupBy("block")).applyInArrow(work, schema)


def _kinds(df: DataFrame, columns: list[str] | tuple[str, ...]) -> list[str]:
    return [f"{c} {df.schema[c].dataType.simpleString()}" for c in columns]


def _weigh(block: Block, formula: str, k1: float, b: float) -> Block:
    if formula == "bm25":
        block.bm25(k1, b)
    else:
        block.tfidf()
    return block


def _topk(memories: DataFrame, questions: DataFrame, k: int, formula: str, k1: float = K1, b: float = B) -> DataFrame:
    def search(asked, held):
        block = _weigh(Block(asked, held), formula, k1, b)
        return block.rows(block.best(k))

    schema = ", ".join([*_kinds(questions, ["qid"]), *_kinds(memories, MEMORY), "score double", "rank int"])
    return _in_blocks(memories, questions, search, schema)


def bm25_lists(memories: DataFrame, questions: DataFrame, extractors: list[str] | None = None, k: int = TOP_K, *, carried: tuple[str, ...] = ("qid",), given: tuple[str, ...] = ("text", "source_dia_ids")) -> DataFrame:
    """``carried, extractor, memories``: for each question and extractor the k best by BM25 as a list by rank.

    What is ``given`` of the memories comes along from the block, so neither texts nor questions are joined or grouped
    after the search.  Every question has a row for each of the ``extractors``, also where nothing is found (without
    them: for those of its block).  A question without an id has nothing.
    """

    def search(asked, held):
        block = _weigh(Block(asked, held), "bm25", K1, B)
        return block.as_lists(block.best(k), extractors, list(carried), list(given))

    member = ", ".join(["rank: int", *[f"{c}: {memories.schema[c].dataType.simpleString()}" for c in given]])
    schema = ", ".join([*_kinds(questions, carried), "extractor string", f"memories array<struct<{member}>>"])
    found = _in_blocks(memories, questions, search, schema, carried, given)
    return found.withColumn("memories", F.when(F.col("qid").isNotNull(), F.col("memories")).otherwise(F.array().cast(found.schema["memories"].dataType)))


def no_retrieval(questions: DataFrame, extractor: str = "no_memory") -> DataFrame:
    """Nothing is retrieved for any question."""
    return questions.filter(F.lit(False)).select("qid", F.lit(extractor).alias("extractor"), "conv_id", F.lit(0).alias("mem_idx"), F.lit(0.0).alias("score"), F.lit(0).alias("rank"))


def tfidf_topk(memories: DataFrame, questions: DataFrame, k: int = TOP_K) -> DataFrame:
    """The k best by the cosine of TF-IDF vectors, of the memories that share a known term with the question."""
    return _topk(memories, questions, k, "tfidf")


def bm25_topk(memories: DataFrame, questions: DataFrame, k: int = TOP_K, *, k1: float = K1, b: float = B) -> DataFrame:
    """The k best by BM25 with the always-positive IDF; a term that a question repeats counts as often."""
    return _topk(memories, questions, k, "bm25", k1, b)
