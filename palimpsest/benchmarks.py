"""Micro-benchmarks of vector and lookup operators: warm-ups, then timed runs."""

from __future__ import annotations

import statistics
import time
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import vectors
from .operators import ann, embedding, retrieval


class Result(NamedTuple):
    name: str
    runs: int
    total_s: float
    mean_s: float
    median_s: float
    per_second: float


def bench(name: str, f: Callable[[], object], runs: int = 5, warmups: int = 2) -> Result:
    for _ in range(warmups):
        f()
    took = []
    for _ in range(runs):
        began = time.perf_counter()
        f()
        took.append(time.perf_counter() - began)
    total = sum(took)
    return Result(name, runs, total, total / runs, statistics.median(took), runs / total if total else float("inf"))


def _random(spark: SparkSession, n: int, dim: int) -> DataFrame:
    """n texts of random words and vectors of them."""
    m = spark.range(n).select(F.col("id").cast("string").alias("id"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(12)), lambda k: F.concat(F.lit("w"), F.pmod(F.xxhash64("id", k), F.lit(997)).cast("string"))), " ").alias("content"))
    return m.join(embedding.hash_embed(m, dim), "id")


def run(spark: SparkSession, n: int = 10_000, runs: int = 3) -> list[Result]:
    """Cosines by expressions and by matrix products in three sizes, an index's building and search against a scan, and term lookups."""
    noop = lambda d: d.write.format("noop").mode("overwrite").save()
    out = []
    for dim in (128, 256, 512):
        m = _random(spark, n, dim).cache()
        q = [float(x) for x in m.first()["embedding"]]
        a = F.array(*map(F.lit, q))
        out.append(bench(f"cosine by expressions, {dim}", lambda: noop(m.select(vectors.cosine(F.col("embedding"), a))), runs))
        out.append(bench(f"cosine by products, {dim}", lambda: noop(vectors.with_cosine(m, q)), runs))
        if dim == 256:
            out.append(bench("index, building", lambda: noop(ann.build(m).vectors), 1, 0))
            index = ann.build(m)
            index = index._replace(vectors=index.vectors.cache())
            queries = m.limit(100).select(F.col("id").alias("query_id"), "embedding")
            out.append(bench("index, 100 searches", lambda: noop(ann.search_all(index, queries, 10)), runs))
            out.append(bench("scan, one search", lambda: retrieval.top_similar(m, q, 10).collect(), runs))
            out.append(bench("terms, one lookup", lambda: retrieval.search_ranked(m, "w1 w2 w3", 10).collect(), runs))
            index.vectors.unpersist()
        m.unpersist()
    return out
