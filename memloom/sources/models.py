"""Word vectors, sentence encoders and taggers by name; the libraries behind them are loaded only where they are used."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Default models, and the environment variables that replace them.
DEFAULTS = {
    "W2V_MODEL": "word2vec-google-news-300",
    "SENT_MODEL": "sentence-transformers/all-MiniLM-L6-v2",
    "NER_MODEL": "en_core_web_sm",
    "READER_MODEL": "Qwen/Qwen2.5-3B-Instruct",
    "JUDGE_MODEL": "mistralai/Mistral-7B-Instruct-v0.3",
}
E5_MODEL = "intfloat/e5-small-v2"


def model_name(variable: str) -> str:
    return os.environ.get(variable) or DEFAULTS[variable]


def read_word_vectors(spark: SparkSession, path: str) -> DataFrame:
    """``word, vec`` of text files with a word and its numbers in each line; a first line of two counts is left out.

    The lines are split by the tasks; of a word that occurs twice one is kept.
    """
    parts = F.split(F.rtrim("value"), " ")
    lines = spark.read.text(path).select(parts.alias("p")).filter(F.size("p") > 2)
    vec = F.transform(F.slice("p", F.lit(2), F.size("p") - 1), lambda x: x.try_cast("double"))
    return lines.select(F.col("p")[0].alias("word"), vec.alias("vec")).filter(~F.exists("vec", lambda x: x.isNull())).groupBy("word").agg(F.min("vec").alias("vec"))


def gensim_vectors(spark: SparkSession, name: str | None = None, folder: str | None = None) -> DataFrame:
    """``word, vec`` of a model of the gensim downloader: written once as text on the driver, read by the tasks.

    ``folder`` is one that the executors share; the table is that of the model, whatever the data.
    """
    import gensim.downloader

    from memloom.workspace import root

    name = name or model_name("W2V_MODEL")
    path = f"{(folder or root(spark)).removeprefix('file://')}/{name}.txt"
    if not os.path.exists(path):
        gensim.downloader.load(name).save_word2vec_format(path, binary=False)
    return read_word_vectors(spark, path)


def sentence_encoder(name: str) -> Callable[[list[str]], list[list[float]]]:
    """Encoder backed by an installed sentence-transformers model, loaded once in each worker; vectors have length one."""
    loaded: list = []

    def encode(texts: list[str]) -> list[list[float]]:
        if not loaded:
            from sentence_transformers import SentenceTransformer

            loaded.append(SentenceTransformer(name))
        return loaded[0].encode(texts, normalize_embeddings=True).tolist()

    return encode


def installed(*modules: str) -> str | None:
    """The first module that can't be found, or None."""
    import importlib.util

    return next((m for m in modules if importlib.util.find_spec(m) is None), None)
