"""Encoding a whole corpus with a public tokenizer, each distinct word once.

The corpus is read once, in blocks.  A block's words are numbered; what leaves the task is one row for each
distinct word of the block, and one row with the block's positions as packed word numbers.  The distinct words of the
corpus (combined in each task before they are shuffled) are encoded once each; their ids are joined back to the
blocks' rows, and each block is put together again by position.  So positions are moved once, in about a byte each.
A word of which a third of the corpus consists is one row for each block; the ``HOT_WORDS`` words of most blocks are
joined in the tasks that hold the rows, so of the rows that are shuffled by word none has more than one in
``HOT_WORDS`` of them all.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memloom.llm.tokenizers import TOKENIZER_DIR, encoder, rank_bytes, token_bytes, word_text, words
from memloom.workspace import in_arrow, materialize

#: Characters in a block; a longer text is a block by itself.
BLOCK_CHARS = 2_000_000
#: Words of most blocks whose ids are sent to the tasks, and how long they may be: some 1 MB in all.
HOT_WORDS, HOT_CHARS = 10_000, 64
_TASK_BLOCKS = 1 << 32


def _packed(numbers: list[int], n_words: int) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(np.asarray(numbers, np.uint16 if n_words <= 65536 else np.uint32).tobytes())


def _unpacked(data: bytes, n_words: int) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint16 if n_words <= 65536 else np.uint32)


def _cut_blocks(id_type: pa.DataType, block_chars: int):
    names = ["block", "word_no", "word", "doc_ids", "n_words", "positions"]

    def batch_of(block: int, ids: list, counts: list[int], seq: list[int], numbers: dict) -> Iterator[pa.RecordBatch]:
        keys = list(numbers)
        n = len(keys)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([block] * (n + 1), pa.int64()),
                pa.array([*range(n), n], pa.int32()),
                pa.array([*keys, None], pa.string()),
                pa.array([None] * n + [ids], pa.list_(id_type)),
                pa.array([None] * n + [counts], pa.list_(pa.int32())),
                pa.array([None] * n + [_packed(seq, n)], pa.binary()),
            ],
            names,
        )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() * _TASK_BLOCKS
        ids, counts, seq, chars = [], [], [], 0
        numbers: dict = defaultdict()
        numbers.default_factory = numbers.__len__
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                found = words(text)
                ids.append(doc)
                counts.append(len(found))
                seq.extend(map(numbers.__getitem__, found))
                chars += len(text)
                if chars >= block_chars:
                    yield from batch_of(block, ids, counts, seq, numbers)
                    block, ids, counts, seq, chars = block + 1, [], [], [], 0
                    numbers = defaultdict()
                    numbers.default_factory = numbers.__len__
        if ids:
            yield from batch_of(block, ids, counts, seq, numbers)

    return cut


def _encode_words(ranks_of):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(ranks_of.value)
        for batch in batches:
            coded = [np.asarray(ids_of(word_text(word)), np.uint32).astype("<u4").tobytes() for word in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(coded, pa.binary())], ["word", "n_blocks", "ids"])

    return encode


def _ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the slices ``starts[i] : starts[i] + lengths[i]``, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) - np.repeat(ends - lengths, lengths) + np.repeat(starts, lengths)


def _reassemble(id_name: str, id_type: pa.DataType):
    def put_together(left, right):
        docs, counts, data = (left.column(c).to_pylist()[0] for c in ("doc_ids", "n_words", "positions"))
        order = np.argsort(right.column("word_no").to_numpy())
        coded = right.column("ids").combine_chunks() if right.num_rows else pa.array([], pa.binary())
        coded = coded.take(pa.array(order))
        values = np.frombuffer(b"".join(coded.to_pylist()), "<u4").astype(np.int32)
        sizes = np.asarray(pa.compute.binary_length(coded)) // 4
        starts = np.cumsum(sizes) - sizes
        seq = _unpacked(data, right.num_rows).astype(np.int64)
        ids = values[_ragged(starts[seq], sizes[seq])] if len(seq) else np.zeros(0, np.int32)
        upto = np.concatenate([[0], np.cumsum(sizes[seq])])[np.concatenate([[0], np.cumsum(counts)])].astype(np.int32)
        return pa.table({id_name: pa.array(docs, id_type), "ids": pa.ListArray.from_arrays(pa.array(upto), pa.array(ids))})

    import pyarrow.compute  # noqa: F401

    return put_together


def encode_corpus(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k", tokenizer_dir: str = TOKENIZER_DIR, block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """``id_col, ids``: the token ids of every row's text, without special tokens.

    Null and empty texts give an empty list; repeated rows and null ids are kept as they are; strings of special
    tokens inside a text are ordinary text; other columns are not read.
    """
    spark = docs.sparkSession
    id_field = docs.schema[id_col]
    id_type = {T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.StringType: pa.string()}[type(id_field.dataType)]
    id_sql = id_field.dataType.simpleString()
    ranks = spark.sparkContext.broadcast(rank_bytes(tokenizer, tokenizer_dir))
    blocks = in_arrow(docs.select(id_col, text_col), _cut_blocks(id_type, block_chars), f"block bigint, word_no int, word string, doc_ids array<{id_sql}>, n_words array<int>, positions binary")
    blocks = materialize(blocks, "blocks")
    rows = blocks.filter("word is not null").select("block", "word_no", "word")
    coded_words = in_arrow(rows.groupBy("word").agg(F.count("*").alias("n_blocks")), _encode_words(ranks), "word string, n_blocks bigint, ids binary")
    coded_words = materialize(coded_words, "words")
    hot = coded_words.filter(F.length("word") <= HOT_CHARS).orderBy(F.desc("n_blocks"), "word").limit(HOT_WORDS).select("word", F.col("ids").alias("hot_ids"))
    rows = rows.join(F.broadcast(hot), "word", "left")
    seldom = rows.filter("hot_ids is null").select("block", "word_no", "word").join(coded_words.select("word", "ids"), "word").select("block", "word_no", "ids")
    coded = rows.filter("hot_ids is not null").select("block", "word_no", F.col("hot_ids").alias("ids")).unionByName(seldom)
    positions = blocks.filter("word is null").select("block", "doc_ids", "n_words", "positions")
    coded = coded.select(F.col("block").alias("of_block"), "word_no", "ids")
    return positions.groupBy("block").cogroup(coded.groupBy("of_block")).applyInArrow(_reassemble(id_col, id_type), f"{id_col} {id_sql}, ids array<int>")


def _join_bytes(id_name: str, id_type: pa.DataType):
    """Put the bytes of each row's tokens together, which come one after the other and in order."""

    def text_of(parts: list[bytes], given: bool) -> str | None:
        return b"".join(parts).decode("utf-8", "replace") if given else None

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, doc, given, parts, expected = None, None, True, [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            row, pos = batch.column(0).to_numpy(), batch.column(3).fill_null(0).to_numpy()
            tokens = batch.column(4)
            offsets = np.frombuffer(tokens.buffers()[1], np.int32)[tokens.offset : tokens.offset + len(tokens) + 1]
            data = tokens.buffers()[2] or pa.py_buffer(b"")
            starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            ends = np.append(starts[1:], len(row))
            if (pos - np.repeat(pos[starts], ends - starts) != np.arange(len(row)) - np.repeat(starts, ends - starts)).any():
                raise RuntimeError("tokens out of order")
            ids, flags = batch.column(1).take(pa.array(starts)).to_pylist(), batch.column(2).take(pa.array(starts)).to_pylist()
            done: tuple[list, list] = ([], [])
            for start, end, of, flag in zip(starts.tolist(), ends.tolist(), ids, flags):
                if row[start] != last:
                    if last is not None:
                        done[0].append(doc)
                        done[1].append(text_of(parts, given))
                    last, doc, given, parts, expected = row[start], of, flag, [], 0
                if pos[start] != expected:
                    raise RuntimeError("tokens out of order")
                parts.append(data[int(offsets[start]) : int(offsets[end])].to_pybytes())
                expected = pos[end - 1] + 1
            yield pa.RecordBatch.from_arrays([pa.array(done[0], id_type), pa.array(done[1], pa.string())], [id_name, "text"])
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([doc], id_type), pa.array([text_of(parts, given)], pa.string())], [id_name, "text"])

    return together


def decode_corpus(coded: DataFrame, *, id_col: str = "doc_id", tokenizer: str = "byte_bpe_50k", tokenizer_dir: str = TOKENIZER_DIR) -> DataFrame:
    """``id_col, text`` of ``coded(id_col, ids)``: the token-byte table is joined and the bytes put together by position.

    The table has the tokenizer's fixed size, so it is sent to every task; the tokens of a row stay in its task and in
    their order, which is checked, so nothing is shuffled.  Repeated rows and null ids are kept; a null list gives a null
    text and an empty one an empty text.
    """
    spark = coded.sparkSession
    id_field = coded.schema[id_col].dataType
    id_type = {T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.StringType: pa.string()}[type(id_field)]
    table = list(token_bytes(rank_bytes(tokenizer, tokenizer_dir)).items())
    table = spark.createDataFrame(pa.table({"token": pa.array([i for _, i in table], pa.int32()), "bytes": pa.array([b for b, _ in table], pa.binary())}))
    rows = coded.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col("ids").isNotNull().alias("given"), "ids")
    tokens = rows.select("row", "id", "given", F.posexplode_outer("ids").alias("pos", "token")).join(F.broadcast(table), "token", "left")
    return in_arrow(tokens.select("row", "id", "given", "pos", "bytes"), _join_bytes(id_col, id_type), f"{id_col} {id_field.simpleString()}, text string")
