"""Extractors and retrievers by name: those of the engine, and any that a user adds.

An extractor is a function ``(turns, with_timestamp) -> memories``, a retriever ``(memories, questions, k, resources) ->
qid, extractor, conv_id, mem_idx, score, rank`` over all extractors' memories at once.  What cannot be written with
DataFrames goes through ``per_turn`` (a Python function of Arrow batches of turns) or ``per_block`` (a Python function of
a block of questions and a block of memories of one scope).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.operators import dense, sparse
from memloom.operators import extract as builtin
from memloom.operators.skew import hot_join
from memloom.workspace import ship_package

Extract = Callable[..., DataFrame]
Retrieve = Callable[..., DataFrame]


class Unavailable(ValueError):
    """A part that is known by name but lacks a model or a table."""


@dataclass
class Resources:
    """What the dense retrievers need: a table of word vectors, and (model name, encoder) by retriever name."""

    vectors: DataFrame | None = None
    encoders: dict[str, tuple[str, dense.Encoder]] = field(default_factory=dict)
    tagger: builtin.Tagger | None = None
    #: Whether the records of a grid keep the texts of what was retrieved.
    keep_texts: bool = True


EXTRACTORS: dict[str, Extract] = {}
RETRIEVERS: dict[str, Retrieve] = {}


def register_extractor(name: str, extractor: Extract) -> None:
    """``extractor(turns, with_timestamp=False, resources=None)`` gives memories as those of ``operators.extract``."""
    EXTRACTORS[name] = extractor


def register_retriever(name: str, retriever: Retrieve) -> None:
    RETRIEVERS[name] = retriever


def extract(turns: DataFrame, name: str, *, with_timestamp: bool = False, resources: Resources | None = None) -> DataFrame:
    """Memories of the extractor of that name, which is also their ``extractor``."""
    if name not in EXTRACTORS:
        raise ValueError(f"no such extractor: {name!r}")
    return EXTRACTORS[name](turns, with_timestamp=with_timestamp, resources=resources or Resources()).withColumn("extractor", F.lit(name))


def retrieve(memories: DataFrame, questions: DataFrame, name: str, k: int, resources: Resources) -> DataFrame:
    """``qid, extractor, conv_id, mem_idx, score, rank`` of one retriever over all extractors' memories."""
    if name not in RETRIEVERS:
        raise ValueError(f"no such retriever: {name!r}")
    return RETRIEVERS[name](memories, questions, k, resources)


def missing(retriever: str, resources: Resources) -> str | None:
    """Why a retriever can't run with these resources, or None."""
    if retriever not in RETRIEVERS:
        return "no such retriever"
    if retriever.startswith("word2vec") and resources.vectors is None:
        return "no word vectors"
    if retriever.startswith("sentence_emb") and retriever not in resources.encoders:
        return "no sentence encoder"
    return None


def runnable(entries: list, resources: Resources) -> tuple[list, list[tuple[object, str]]]:
    """The entries that can run, and the others with the reason."""
    reasons = [(e, "no such extractor" if e.extractor not in EXTRACTORS else missing(e.retriever, resources)) for e in entries]
    return [e for e, why in reasons if why is None], [(e, why) for e, why in reasons if why is not None]


def _word2vec(weighting: str) -> Retrieve:
    def run(memories: DataFrame, questions: DataFrame, k: int, resources: Resources) -> DataFrame:
        if resources.vectors is None:
            raise Unavailable("no word vectors")
        return dense.word2vec_topk(memories, questions, resources.vectors, k, weighting=weighting)

    return run


def _sentences(name: str) -> Retrieve:
    def run(memories: DataFrame, questions: DataFrame, k: int, resources: Resources) -> DataFrame:
        if name not in resources.encoders:
            raise Unavailable("no sentence encoder")
        model, encoder = resources.encoders[name]
        return dense.sentence_topk(memories, questions, encoder, k, model_name=model)

    return run


def _ner(turns: DataFrame, *, with_timestamp: bool, resources: Resources) -> DataFrame:
    return builtin.ner(turns, with_timestamp=with_timestamp, tagger=resources.tagger or builtin.rule_tagger)


for _name in builtin.EXTRACTORS:
    register_extractor(_name, lambda t, with_timestamp, resources, name=_name: builtin.extract(t, name, with_timestamp=with_timestamp))
register_extractor("ner", _ner)
register_retriever("no_retrieval", lambda m, q, k, r: sparse.no_retrieval(q))
register_retriever("tfidf", lambda m, q, k, r: sparse.tfidf_topk(m, q, k))
register_retriever("bm25", lambda m, q, k, r: sparse.bm25_topk(m, q, k))
register_retriever("word2vec", _word2vec("uniform"))
register_retriever("word2vec_tfidf", _word2vec("tfidf"))
register_retriever("sentence_emb", _sentences("sentence_emb"))
register_retriever("sentence_emb_e5", _sentences("sentence_emb_e5"))
#: The engine's own, which a grid runs together (``plans.blocks``) unless another one was registered under the name.
TOGETHER = {name: RETRIEVERS[name] for name in ("tfidf", "bm25", "word2vec", "word2vec_tfidf", "sentence_emb", "sentence_emb_e5")}


def per_turn(function: Callable[[pd.DataFrame], list[list[str]]]) -> Extract:
    """An extractor from a Python function that gives, for a batch of turns, the texts of each turn's memories.

    Turns come in Arrow batches in any order, so no conversation is gathered in a task; memories are numbered by turn.
    """

    def run(turns: DataFrame, *, with_timestamp: bool = False, resources: Resources | None = None) -> DataFrame:
        ship_package(turns.sparkSession)
        kept = [c for c in ("conv_id", "pos", "session_id", "speaker", "dia_id", "timestamp_raw", "ts_date") if c in turns.columns]
        kinds = ", ".join(f"{c} {turns.schema[c].dataType.simpleString()}" for c in kept)

        def said(batches):
            for batch in batches:
                texts = function(batch)
                yield batch[kept].assign(text=texts).explode("text").dropna(subset=["text"])

        found = turns.select(*kept, "text").mapInPandas(said, f"{kinds}, text string")
        return builtin.numbered(found)

    return run


def per_block(function: Callable[[pd.DataFrame, pd.DataFrame], object], question_block: int = 256, memory_block: int = 4096) -> Retrieve:
    """A retriever from a Python function that scores a block of questions against a block of memories of one scope.

    ``function(questions, memories)`` gives a matrix of scores, one row a question.  The score of a memory must not hang
    on other memories, as a scope with many of them is cut into blocks (both are cogrouped by block, so no scope is
    gathered in a task); the k best of each block are merged.  Only positive scores count.
    """

    def run(memories: DataFrame, questions: DataFrame, k: int, resources: Resources) -> DataFrame:
        import numpy as np

        ship_package(memories.sparkSession)
        sizes = dense.scope_sizes(questions, memories, question_block, memory_block)
        q, m = questions.select("qid", "conv_id", "question"), memories.select(*sparse.MEMORY, "text").filter(F.col("conv_id").isNotNull())
        asked = q.join(sizes, "conv_id")
        asked = asked.select("extractor", "conv_id", F.pmod(F.xxhash64("qid"), "q_parts").alias("qb"), F.explode(F.sequence(F.lit(0), F.col("m_parts") - 1)).alias("mb"), "qid", "question")
        held = hot_join(m, sizes, sparse.SCOPE, "n").select(
            F.col("extractor").alias("m_extractor"), F.col("conv_id").alias("m_conv_id"), F.explode(F.sequence(F.lit(0), F.col("q_parts") - 1)).alias("m_qb"), F.pmod(F.xxhash64("mem_idx"), "m_parts").alias("m_mb"), "mem_idx", "text"
        )

        def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            columns = ["qid", "extractor", "conv_id", "mem_idx", "score"]
            if left.empty or right.empty:
                return pd.DataFrame(columns=columns)
            right = right.sort_values("mem_idx", kind="stable")
            scores = np.asarray(function(left, right), float)
            rows, cols = dense.best_k(scores, scores > 0, k)
            return pd.DataFrame(dict(zip(columns, (left["qid"].to_numpy()[rows], right["m_extractor"].to_numpy()[cols], right["m_conv_id"].to_numpy()[cols], right["mem_idx"].to_numpy()[cols], scores[rows, cols]))))

        kinds = {c: memories.schema[c].dataType.simpleString() for c in sparse.MEMORY} | {"qid": questions.schema["qid"].dataType.simpleString()}
        schema = ", ".join(f"{c} {kinds[c]}" for c in ("qid", *sparse.MEMORY)) + ", score double"
        found = asked.groupBy("extractor", "conv_id", "qb", "mb").cogroup(held.groupBy("m_extractor", "m_conv_id", "m_qb", "m_mb")).applyInPandas(score, schema)
        return sparse.top_k(found, k, group=["qid", "extractor"])

    return run
