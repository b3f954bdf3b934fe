import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.llm import bpe

PATH = bpe.VOCABULARY
ENC, BY_ID = bpe.vocabulary(PATH)
ENCODE, SIZES, _ = bpe._encoder(PATH)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab'sT  \n\t 　é漢0123,.!<|>")) , max_size=80), st.lists(st.integers(0, 80), max_size=6))
def test_joins_agree_with_whole(text, marks):
    data = text.encode()
    at = sorted({m for m in marks if 0 < m < len(data) and (data[m] & 0xC0) != 0x80})
    edges = [0, *at, len(data)]
    parts = [(a, b, ENCODE(data[a:b])) for a, b in zip(edges, edges[1:]) if b > a]
    assert bpe.join(data, parts, ENCODE, SIZES).tolist() == ENC.encode_ordinary(text)


def test_rolling_hash():
    rng = np.random.default_rng(0)
    data = rng.integers(32, 127, 40_000, dtype=np.uint8)
    at, who = bpe.cuts(data, np.array([0, 15_000, 15_000, 40_000]))
    want = []
    for a, b in ((0, 15_000), (15_000, 40_000)):
        for i in range(a + bpe.WINDOW, b):
            h = 0
            for c in data[i - bpe.WINDOW : i].tolist():
                h = (h * 2 + int(bpe._GEAR[c])) & 0xFFFFFFFF
            if h & (bpe.MASK << 16) == 0:
                want.append(i)
    assert at.tolist() == want and set(who.tolist()) == {0, 2}


def corpus():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefé ghi") for _ in range(rng.randint(1, 9)))
    shared = " ".join(word() for _ in range(2500))
    rows = [(i, " ".join(word() for _ in range(rng.randint(0, 300))) + shared[rng.randint(0, 40) :] + word() * 3, "en", "s") for i in range(12)]
    return [*rows, (50, shared, "en", "s"), (51, shared.replace(" ", ""), "en", "s"), (52, shared.replace(" ", "") + "z", "en", "s")]


@pytest.mark.parametrize("limit", [bpe.BROADCAST_CHUNKS, -1])
def test_corpus(made, limit):
    d = made(corpus())
    got = {r.doc_id: r for r in bpe.encode_documents(d, broadcast_chunks=limit).collect()}
    for i, t, *_ in corpus():
        assert list(got[i].ids) == ENC.encode_ordinary(t) and got[i].exact and got[i].n_tokens == len(got[i].ids)


def test_repeated_rows(made):
    d = made(corpus()[:4] * 3)
    got = bpe.encode_documents(d).collect()
    want = {i: ENC.encode_ordinary(t) for i, t, *_ in corpus()[:4]}
    assert len(got) == 12 and all(list(r.ids) == want[r.doc_id] and r.exact for r in got)


def test_documents(docs):
    text = {r.doc_id: r.text for r in docs.collect()}
    tokens = bpe.encode_documents(docs)
    assert all(list(r.ids) == ENC.encode_ordinary(text[r.doc_id]) for r in tokens.collect())
    assert {r.doc_id: r.text for r in bpe.decode_tokens(tokens).collect()} == text


def test_odd_rows(odd):
    got = bpe.encode_documents(odd)
    assert got.columns == ["doc_id", "ids", "n_tokens", "exact"] and got.count() == odd.count()
    by = {}
    for r in got.collect():
        by.setdefault(r.doc_id, []).append(r)
    assert by[1][0].ids is None and by[1][0].n_tokens is None
    assert list(by[2][0].ids) == [] and by[2][0].exact
    assert sorted(map(str, (list(r.ids) for r in by[4]))) == sorted(map(str, (ENC.encode_ordinary(t) for t in ("one two three", "one two three", "one two four"))))
    assert all(r.exact for r in got.where("ids is not null").collect())
    assert bpe.encode_documents(odd.limit(0)).count() == 0


@pytest.mark.parametrize("ids, want", [([1, 2], True), (None, None), ([-1], None), ([10**6], None), ([], "")])
def test_decode(spark, ids, want):
    got = bpe.decode_tokens(spark.createDataFrame([(1, ids)], "doc_id bigint, ids array<int>")).first().text
    assert got == (BY_ID[1] + BY_ID[2]).decode() if want is True else got == want


def test_clashing_columns(made):
    d = made(corpus()[:3])
    for c in ("key", "known", "ids", "hash", "no"):
        d = d.withColumn(c, F.lit(1))
    assert bpe.encode_documents(d).where("exact").count() == 3
