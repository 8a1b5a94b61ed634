import random

import numpy as np
import pytest

from memloom.llm.encode import decode_corpus, encode_corpus
from memloom.llm.pack import containers_of, pack_corpus, packing_report, plan_packing
from memloom.llm.tokenizers import encoder, rank_bytes, word_text, words

pytest.importorskip("tiktoken")
ODD = ["", " ", "  a", "a  b", "a \n b", "a\n\n b ", "it's 's  's", "naïve x y", "日本語 テキスト", "a\tb c", "\x00 \x07x", "<|endoftext|> x", "x" * 3000, " 　 z", "é́ ​ q", "a \x1c b"]


def texts(n=200):
    r = random.Random(3)
    parts = ["a", "b ", " ", "  ", "\n", "the", " don't", "12", "…", "日本", "\t", "'ll", "É", " ", "."]
    return ODD + ["".join(r.choices(parts, k=r.randrange(1, 60))) for _ in range(n)]


def test_words_encode_like_the_whole_text():
    ids = encoder(rank_bytes())
    for t in texts(2000):
        keys = words(t)
        assert "".join(map(word_text, keys)) == t
        assert [i for k in keys for i in ids(word_text(k))] == ids(t)


def test_corpus_ids_and_round_trip(spark):
    rows = [(i, t, 7) for i, t in enumerate(texts())] + [(None, None, 7), (5, texts()[5], 7), (900, "x " * 40000, 7)]
    coded = encode_corpus(spark.createDataFrame(rows, "doc_id bigint, text string, block int").repartition(3), block_chars=500).cache()
    ids = encoder(rank_bytes())
    assert sorted((str(r.doc_id), list(r.ids)) for r in coded.collect()) == sorted((str(i), ids(t or "")) for i, t, _ in rows)
    back = {r.doc_id: r.text for r in decode_corpus(coded).collect()}
    assert decode_corpus(coded).count() == len(rows)
    assert all(back[i] == (t or "") for i, t, _ in rows)
    assert encode_corpus(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    odd = spark.createDataFrame([("a", None), ("a", []), (None, ids("long text " * 9000)), ("b", ids("é日"))], "doc_id string, ids array<int>")
    assert sorted(map(str, [tuple(r) for r in decode_corpus(odd).collect()])) == sorted(map(str, [("a", None), ("a", ""), (None, "long text " * 9000), ("b", "é日")]))
    assert decode_corpus(odd.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plans_place_every_item_once_within_capacity(seed):
    r = np.random.default_rng(seed)
    capacity = [16, 100, 512, 2048][seed]
    lengths = np.clip(r.lognormal(np.log(capacity / 6), 1, 4000).astype(int), 1, capacity)
    plan = plan_packing(np.bincount(lengths, minlength=capacity + 1), capacity)
    ranks = np.zeros(len(lengths), np.int64)
    for v in np.unique(lengths):
        ranks[lengths == v] = np.arange((lengths == v).sum())
    used = np.bincount(containers_of(plan, lengths, ranks), lengths, plan.n_containers)
    assert used.max() <= capacity and (used > 0).all()
    assert plan.n_containers <= 1.02 * np.ceil(lengths.sum() / capacity) + 1


def test_packed_corpus(spark):
    rows = [(i, "word " * (i % 40), 1) for i in range(300)] + [(1000, "long text " * 300, 1), (None, None, 1), (1001, "", 1), (3, "again", 1)]
    packed = pack_corpus(spark.createDataFrame(rows, "doc_id bigint, text string, container int").repartition(3), capacity=64)
    got = packed.collect()
    per = {}
    for r in got:
        per[r.container] = per.get(r.container, 0) + r.n_tokens
    assert max(per.values()) <= 64
    long = sorted((r.piece_no, r.n_tokens) for r in got if r.doc_id == 1000)
    size = len(encoder(rank_bytes())("long text " * 300))
    assert sum(n for _, n in long) == size and [n for _, n in long[:-1]] == [64] * (len(long) - 1)
    assert sum(r.doc_id != 1000 for r in got) == 303 and {r.container for r in got if not r.n_tokens} == {0}
    report = packing_report(packed, capacity=64).first()
    assert report.n_containers <= report.least_containers + 2
    assert pack_corpus(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
