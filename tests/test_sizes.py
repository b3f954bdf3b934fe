"""What held on small tables alone: sizes, copies and caps that larger ones bring out."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.functions import vectors
from palimpsest.operators import embedding, graph, mining
from palimpsest.plans import further
from palimpsest.plans.registry import ORACLES, QUERIES


def test_holders_do_not_copy_texts(spark):
    rng = random.Random(1)
    base = "".join(rng.choice("ab") for _ in range(400))
    texts = [base[rng.randrange(100) : rng.randrange(200, 400)] for _ in range(40)] + ["a" * 300, "É" * 60, "short", None]
    news = [t[rng.randrange(10) :][: rng.randrange(20, 90)].upper() for t in texts if t] + ["a" * 200, "a" * 23, ""]
    m = spark.createDataFrame([(k, t, None if k % 3 else "b" * 30) for k, t in enumerate(texts)], "id int, content string, context string")
    found = graph.holders(m, spark.createDataFrame([(t,) for t in news], "content string"), 50, 7)
    low = [(r.id, f"{r.content or ''}\0{r.context or ''}".lower()) for r in m.collect()]
    assert sorted(found.collect()) == sorted((i, c) for i, t in low for c in set(news) if c.lower() in t)
    # a row for each place of a text, with the text, is what filled the disk
    assert "Generate" not in found._jdf.queryExecution().toString()


def _vectors(spark, n, dim=8):
    x = np.random.default_rng(3).normal(size=(n, dim)).astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True), spark.createDataFrame([(f"{k:04}", v.tolist(), float(k * 37 % 10)) for k, v in enumerate(x)], "id string, embedding array<float>, strength double").withColumn("created_at", F.timestamp_seconds(F.col("id").cast("int")))


def test_clusters_list_no_pairs(spark, monkeypatch):
    x, m = _vectors(spark, 300)
    monkeypatch.setattr(graph, "similarity_pairs", lambda *_: 1 / 0)
    got = {(r.primary_id, r.member_id) for r in graph.clusters(m, 0.6, newest=False, chunk_values=160).collect()}
    sim, order, taken, want = x.astype(float) @ x.T.astype(float), sorted(range(300), key=lambda k: (-(k * 37 % 10), k)), set(), set()
    for place, k in enumerate(order):
        if k not in taken:
            own = [q for q in order[place + 1 :] if q not in taken and sim[k, q] >= 0.6]
            taken.update(own)
            first = min([k, *own])
            want |= {(f"{first:04}", f"{q:04}") for q in [k, *own] if q != first}
    assert got == want


def test_pairs_are_spread_over_tasks(spark):
    x, m = _vectors(spark, 300)
    found = vectors.similarity_pairs(m, 0.5, block_rows=50)
    # a task for each pair of the six blocks, which small tables don't merge
    assert found.rdd.getNumPartitions() == 21
    sim = x.astype(float) @ x.T.astype(float)
    assert {(r.a, r.b) for r in found.collect()} == {(f"{a:04}", f"{b:04}") for a in range(300) for b in range(a + 1, 300) if sim[a, b] >= 0.5}


def test_associating_vectors_compares_no_words(spark):
    n = 3000
    m = spark.createDataFrame([(k, f"item {k}", [1.0, float(k)] if k else None) for k in range(n)], "id int, content string, embedding array<float>").withColumn("bare", F.col("embedding").isNull())
    found = graph.similar_words(m, 0.3, "bare")
    assert found.count() == n - 1 and found.agg(F.max("a")).first()[0] == 0
    assert graph.similar_words(m.where("not bare"), 0.3, "bare").count() == 0


def test_timeline_has_all_of_a_day(spark):
    m = spark.range(1500).select(F.format_string("%04d", "id").alias("id"), F.format_string("text %04d", "id").alias("content"), F.timestamp_seconds(F.lit(7)).alias("created_at"))
    row = mining.timeline(m).first()
    assert row.n == 1500 and row.previews == [f"text {k:04}" for k in range(1500)]


def test_near_zero_keeps_its_sign(spark):
    row = spark.sql("select array(-4e-7D, 4e-7D, -0.25D, 0.1234567D) as x").select(F.transform("x", further.signed6).alias("x")).first()
    assert [(math.copysign(1, v), abs(v)) for v in row.x] == [(-1, 0), (1, 0), (-1, 0.25), (1, 0.123457)]


@pytest.fixture(scope="module")
def alike(spark, tmp_path_factory):
    """Tables of 3,000 vectors, some near copies of others, and of 60,000 words more than a filter of 100,000 had room for at a low rate."""
    d = tmp_path_factory.mktemp("alike")
    x = np.random.default_rng(5).normal(size=(3000, 64))
    x[1::3] = x[::3] + np.random.default_rng(6).normal(size=(1000, 64)) * 0.05
    rows = [(k, v.astype(np.float32).tolist(), k % 10) for k, v in enumerate(x)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    text = F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(599)), lambda k: F.concat(F.when(k % 2 == 0, "e").otherwise("w"), (F.col("id") * 600 + k).cast("string"))))
    spark.range(600).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"), F.lit("web").alias("source")).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, 1, "a", 1.0)], "event_id bigint, user_id bigint, event_type string, value double").withColumn("ts", F.timestamp_seconds(F.lit(0))).write.parquet(f"{d}/events.parquet")
    return str(d)


@pytest.mark.parametrize("name", "k01_bloom_both k08_counting_members g10_clusters_of_copies v35_cluster_sizes u04_merge u03_merge_stats r25_index_search r25_index_recall j08_index_links".split())
def test_against_sql_on_alike(spark, duck, equal, alike, name):
    equal(QUERIES[name](spark, alike), duck(ORACLES[name], alike))


def test_tfidf_shuffles_no_words(spark):
    m = spark.createDataFrame([("a", "rust rust code"), ("b", "code memory"), ("b", "rust"), ("c", None), (None, "rust")], "id string, content string")
    assert {r.word: (r.idx, round(math.exp(r.idf - 1), 6)) for r in embedding.vocabulary(m, 2).collect()} == {"rust": (0, 2.5), "code": (1, 2.5)}
    v = spark.createDataFrame([("rust", 0, 1.0), ("code", 1, 2.0)], "word string, idx int, idf double")
    got = [(r.id, [round(x, 6) for x in r.embedding]) for r in embedding.tfidf_embed(m, v, 2).collect()]
    s = round(0.5**0.5, 6)
    assert sorted(got, key=str) == sorted([("a", [s, s]), ("b", [0.447214, 0.894427]), ("b", [0.447214, 0.894427]), ("c", [0.0, 0.0]), (None, [0.0, 0.0])], key=str)
    once = embedding.tfidf_embed(m.where("content like '%code%'"), v, 2)
    assert "Exchange" not in once._jdf.queryExecution().executedPlan().toString()
