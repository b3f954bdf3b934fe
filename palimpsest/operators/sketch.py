"""Bloom filters as tables of bit positions.

A filter is (pos), a counting filter (pos, n); sizes come from `sizing`.  Words
count in lower case.  Tables of positions merge, join and shuffle like any
other, so a filter of any size needs no broadcast.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sizing(items: int, rate: float) -> tuple[int, int]:
    """(bits, hashes) for so many items at a rate of false positives."""
    n = max(1, items)
    m = max(64, math.ceil(-n * math.log(rate) / math.log(2) ** 2))
    return m, min(16, max(1, math.ceil(m / n * math.log(2))))


def positions(word: Column, m: int, k: int) -> Column:
    """The k positions of a word, by double hashing."""
    w = F.lower(word)
    a, b = F.pmod(F.xxhash64(w), F.lit(m)), F.pmod(F.xxhash64(w, F.lit(1)), F.lit(m))
    return F.array(*[F.pmod(a + i * b, F.lit(m)) for i in range(k)])


def build(words: DataFrame, m: int, k: int, column: str = "word") -> DataFrame:
    return words.where(F.col(column).isNotNull()).select(F.explode(F.array_distinct(positions(F.col(column), m, k))).alias("pos")).distinct()


def contains(bloom: DataFrame, words: DataFrame, m: int, k: int, column: str = "word") -> DataFrame:
    """(word, maybe): false means certainly absent."""
    w = words.select(F.col(column).alias("word")).where("word is not null").distinct()
    at = w.select("word", F.explode(F.array_distinct(positions(F.col("word"), m, k))).alias("pos"))
    return at.join(bloom.select("pos", F.lit(1).alias("set")), "pos", "left").groupBy("word").agg((F.count("*") == F.count("set")).alias("maybe"))


def false_positive_rate(k: int, n: Column, m: int) -> Column:
    return F.pow(1 - F.exp(-F.lit(float(k)) * n / m), F.lit(float(k)))


def stats(bloom: DataFrame, m: int, k: int, added: int) -> DataFrame:
    row = bloom.agg(F.count("*").alias("bits_set"))
    return row.select(F.lit(m).cast("bigint").alias("bits"), F.lit(k).alias("hashes"), F.lit(added).cast("bigint").alias("items"), "bits_set", (F.col("bits_set") / m).alias("fill"), false_positive_rate(k, F.lit(float(added)), m).alias("rate"))


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def counting(words: DataFrame, m: int, k: int, column: str = "word") -> DataFrame:
    """(pos, n); counters stop at 255."""
    return words.where(F.col(column).isNotNull()).select(F.explode(positions(F.col(column), m, k)).alias("pos")).groupBy("pos").agg(F.least(F.lit(255), F.count("*")).alias("n"))


def counting_remove(c: DataFrame, words: DataFrame, m: int, k: int, column: str = "word") -> DataFrame:
    gone = counting(words, m, k, column).select("pos", F.col("n").alias("g"))
    return c.join(gone, "pos", "left").select("pos", F.greatest(F.lit(0), F.col("n") - F.coalesce("g", F.lit(0))).alias("n")).where("n > 0")


def counting_contains(c: DataFrame, words: DataFrame, m: int, k: int, column: str = "word") -> DataFrame:
    return contains(c.where("n > 0").select("pos"), words, m, k, column)
