import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.functions import codec, scoring, text, vectors


def one(spark, column, **values):
    schema = ", ".join(f"{k} {t}" for k, (t, _) in values.items())
    return spark.createDataFrame([tuple(v for _, v in values.values())], schema).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("a, b, want", [([1, 0], [1, 0], 1), ([1, 0], [0, 1], 0), ([1, 0], [-1, 0], -1), ([1, 0], [1, 0, 0], 0), ([0, 0], [1, 0], 0), ([], [], 0), (None, [1], 0)])
def test_cosine(spark, a, b, want):
    assert one(spark, vectors.cosine(F.col("a"), F.col("b")), a=("array<float>", a and [float(x) for x in a]), b=("array<float>", [float(x) for x in b])) == want


def test_cosine_kernel_handles_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [1.0]), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [0.6, 0.8])]
    d = spark.createDataFrame(rows, "id int, embedding array<double>")
    got = {r.id: round(r.similarity, 6) for r in vectors.with_cosine(d, [1.0, 0.0]).collect()}
    assert got == {1: 1.0, 2: 0.0, 3: 0.0, 4: 0.0, 5: 0.0, 6: 0.6}
    assert vectors.with_cosine(d.limit(0), [1.0, 0.0]).count() == 0


@pytest.mark.parametrize("block_rows", [3, 10, 1000])
def test_similarity_pairs_are_all_pairs(spark, block_rows):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 4))
    x[7], x[9] = 0, x[8]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(90, None), (91, []), (92, [1.0, 2.0])]
    got = {(r.a, r.b): r.similarity for r in vectors.similarity_pairs(spark.createDataFrame(rows, "id bigint, embedding array<double>"), 0.5, block_rows=block_rows).collect()}
    n = np.linalg.norm(x, axis=1)
    want = {(i, j) for i in range(40) for j in range(i + 1, 40) if n[i] * n[j] > 0 and x[i] @ x[j] / (n[i] * n[j]) >= 0.5}
    assert set(got) == want and abs(got[8, 9] - 1) < 1e-9


def test_relevance_of_unused_item(spark):
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    assert one(spark, scoring.relevance(F.col("s"), now, F.col("n"), now), s=("double", 1.0), n=("int", 0)) == -math.inf
    assert one(spark, scoring.decay(F.col("s"), F.col("n"), now, now, now), s=("double", 0.0), n=("int", 1)) == 0.1
    fresh = one(spark, scoring.decay(F.col("s"), F.col("n"), now, now, now), s=("double", 1.0), n=("int", 1))
    assert fresh == 1.0
    assert one(spark, scoring.review_hours(F.col("s"), F.col("n")), s=("double", 0.0), n=("int", 1)) == 1.0


@pytest.mark.parametrize("content, want", [("we met at the lake", "Episodic"), ("A heron is a bird", "Semantic"), ("Pattern: two lines and a dot", "Procedural"), ("When it rains then stay", "Procedural"), (None, "Episodic"), ("", "Episodic")])
def test_classify(spark, content, want):
    assert one(spark, text.classify(F.col("t")), t=("string", content)) == want


@pytest.mark.parametrize("pattern, content, want", [("", "abc", True), ("ac", "ABC", True), ("ca", "abc", False), (".*", "a.b*c", True), ("a.", "ab", False), ("aab", "xaxaxb", True)])
def test_fuzzy(spark, pattern, content, want):
    assert one(spark, text.fuzzy(F.col("t"), pattern), t=("string", content)) is want


@pytest.mark.parametrize("word", ["", "a", "hello", "élan", "漢字"])
def test_djb2(spark, word):
    h = 5381
    for b in word.encode():
        h = (h * 33 + b) % 2**32
    assert one(spark, text.djb2(F.col("t")), t=("string", word)) == h


def test_tokens(spark):
    t = "The quick-brown don't é 漢 foo_bar THE"
    assert one(spark, text.index_terms(F.col("t")), t=("string", t)) == ["the", "quick", "brown", "don", "é", "漢", "foo_bar", "the"]
    assert one(spark, text.embed_tokens(F.col("t")), t=("string", t)) == ["quick", "brown", "don't", "漢", "foo", "bar"]
    assert text.query_keywords("What is the 'licence' of x?") == ["licence"]
    assert one(spark, text.tag_similarity(F.col("a"), F.col("b")), a=("array<string>", []), b=("array<string>", [])) == 0
    assert one(spark, text.jaccard(F.col("a"), F.col("b")), a=("string", ""), b=("string", " ")) == 0


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=700))
def test_rle_round_trip(data):
    assert codec._decode(codec._encode(data)) == data


def test_rle_code():
    assert codec._encode(b"aaaaab\xff") == b"\xff\x05ab\xff\x01\xff"


def test_quantise(spark):
    x = [0.1, 0.5, -0.3, 0.8, -0.9]
    d = spark.createDataFrame([(x,), ([1.0, 1.0],), (None,)], "e array<double>")
    a = [r.a for r in d.select(codec.restore(codec.quantise(F.col("e"))).alias("a")).collect()]
    b = [r.b for r in d.select(codec.decompress(codec.compress(F.col("e"))).alias("b")).collect()]
    assert np.abs(np.array(a[0]) - x).max() < 2 * 1.7 / 255 and np.allclose(a[0], b[0])
    assert a[1] == b[1] == [1.0, 1.0] and a[2] is None and b[2] is None


def test_delta(spark):
    rows = [([10, 12, 11, 15, 14, 16],), ([-128, 127, 0, -1],), ([],), (None,)]
    d = spark.createDataFrame(rows, "v array<tinyint>")
    got = d.select("v", codec.undelta(codec.delta(F.col("v"))).alias("same"), codec.delta(F.col("v")).alias("d")).collect()
    assert all(r.v == r.same for r in got) and got[0].d == [10, 2, -1, 4, -1, 2] and got[1].d == [-128, -1, -127, -1]
