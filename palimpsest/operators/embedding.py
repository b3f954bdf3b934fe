"""Embeddings of texts: signed hashing, TF-IDF, tables of word vectors, and a cache."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import embed_tokens
from ..functions.vectors import normalised
from .graph import checkpointed


def _djb2(word: str) -> int:
    h = 5381
    for b in word.encode():
        h = (h * 33 + b) & 0xFFFFFFFF
    return h


def hash_embed(m: DataFrame, dim: int = 256, stop: bool = True) -> DataFrame:
    """(id, embedding): tokens hashed to places, with a sign by the 16th bit, summed and brought to length 1.

    Tokens come from the JVM; each distinct one of a batch is hashed once, and nothing is shuffled.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                tokens = b.column(1)
                off = tokens.offsets.to_numpy().astype(np.int64)
                coded = tokens.values.slice(off[0], off[-1] - off[0]).dictionary_encode()
                h = np.array([_djb2(w) for w in coded.dictionary.to_pylist()], np.int64)
                x = np.zeros((b.num_rows, dim))
                if len(h):
                    k = coded.indices.to_numpy()
                    who = np.repeat(np.arange(b.num_rows), np.diff(off))
                    x = np.bincount(who * dim + (h % dim)[k], np.where((h >> 16) & 1, -1.0, 1.0)[k], b.num_rows * dim).reshape(b.num_rows, dim)
                n = np.linalg.norm(x, axis=1, keepdims=True)
                x = np.divide(x, n, out=x, where=n > 0)
                rows = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * dim), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0), rows], names=["id", "embedding"])

    t = m.select("id", embed_tokens(F.col("content"), stop, apostrophe=stop).alias("t"))
    return t.mapInArrow(kernel, f"id {dict(m.dtypes)['id']}, embedding array<double>")


def _unique(m: DataFrame) -> bool:
    return m.where("id is not null").groupBy("id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def vocabulary(m: DataFrame, dim: int) -> DataFrame:
    """(word, idx, idf) of the most frequent tokens: idf = ln(n / df) + 1.

    Tokens are counted first, the memories that hold them for the chosen ones alone; no
    pairs of words and ids are shuffled unless ids repeat.
    """
    t = embed_tokens(F.col("content"))
    n = m.select(F.explode(t).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    top = checkpointed(n.orderBy(F.desc("n"), "word").limit(dim))
    held = m.select("id", F.explode(F.array_distinct(t)).alias("word")).join(F.broadcast(top.select("word")), "word")
    df = held.groupBy("word").agg((F.count("id") if _unique(m) else F.count_distinct("id")).alias("df"))
    total = m.agg(F.count("*").alias("total"))
    return top.join(df, "word").crossJoin(F.broadcast(total)).select("word", (F.row_number().over(Window.orderBy(F.desc("n"), "word")) - 1).alias("idx"), (F.ln(F.col("total") / F.col("df")) + 1).alias("idf"))


def add_words(v: DataFrame, words: DataFrame, dim: int) -> DataFrame:
    """The vocabulary with further words at idf 1, as far as it has room."""
    new = words.select("word").distinct().join(v, "word", "left_anti").orderBy("word").limit(dim)  # no more can have room
    have = v.agg(F.coalesce(F.max("idx") + 1, F.lit(0)).alias("have"))
    placed = new.crossJoin(F.broadcast(have)).select("word", (F.row_number().over(Window.orderBy("word")) - 1 + F.col("have")).alias("idx"), F.lit(1.0).alias("idf"))
    return v.unionByName(placed.where(F.col("idx") < dim))


def tfidf_embed(m: DataFrame, v: DataFrame, dim: int) -> DataFrame:
    """(id, embedding) by a vocabulary; tokens outside it count for the total.  Nothing is shuffled unless ids repeat; then their memories count as one."""
    told = m.sparkSession.sparkContext.broadcast({r["word"]: (r["idx"], r["idf"]) for r in v.collect() if r["idx"] < dim})
    t = m.select("id", F.when(F.col("id").isNotNull(), embed_tokens(F.col("content"))).otherwise(F.array().cast("array<string>")).alias("t"))
    if not _unique(m):
        t = m.select("id").join(t.groupBy("id").agg(F.flatten(F.collect_list("t")).alias("t")), "id", "left").withColumn("t", F.coalesce("t", F.array().cast("array<string>")))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = told.value
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                tokens = b.column(1)
                off = tokens.offsets.to_numpy().astype(np.int64)
                coded = tokens.values.slice(off[0], off[-1] - off[0]).dictionary_encode()
                own = [known.get(w, (-1, 0.0)) for w in coded.dictionary.to_pylist()]
                x = np.zeros((b.num_rows, dim))
                if own:
                    k = coded.indices.to_numpy()
                    to = np.array([i for i, _ in own], np.int64)[k]
                    who = np.repeat(np.arange(b.num_rows), np.diff(off))
                    x = np.bincount((who * dim + to)[to >= 0], minlength=b.num_rows * dim).reshape(b.num_rows, dim) / np.maximum(1, np.diff(off))[:, None]
                    idf = np.zeros(dim)
                    for i, w in own:
                        if i >= 0:
                            idf[i] = w
                    x = x * idf
                n = np.linalg.norm(x, axis=1, keepdims=True)
                x = np.divide(x, n, out=x, where=n > 0)
                rows = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * dim), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0), rows], names=["id", "embedding"])

    return t.mapInArrow(kernel, f"id {dict(m.dtypes)['id']}, embedding array<double>")


def word_vectors(spark, path: str, most: int | None = None) -> DataFrame:
    """(word, vec) of a text file of a word and its numbers a line; lines of another size than the first are left out."""
    lines = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("p"), F.monotonically_increasing_id().alias("n")).where("size(p) > 1")
    size = lines.orderBy("n").select(F.size("p")).first()
    if size is None:
        return spark.createDataFrame([], "word string, vec array<double>")
    vec = F.transform(F.slice("p", 2, size[0] - 1), lambda x: x.try_cast("double"))
    good = lines.where(F.size("p") == size[0]).select(F.lower(F.element_at("p", 1)).alias("word"), vec.alias("vec"), "n").where(~F.exists("vec", lambda x: x.isNull()))
    return (good if most is None else good.orderBy("n").limit(most)).select("word", "vec")


def category_vector(dim: int, category: int, strength: float) -> list[float]:
    """A synthetic word vector: ten high places for the category and a slow sine elsewhere."""
    i = np.arange(dim)
    v = np.sin(i * 0.01) * 0.1
    for k in range(10):
        v[(category * 10 + k) % dim] += strength * (1.0 - k * 0.05)
    return (v / np.linalg.norm(v)).tolist()


def mean_vector(v: DataFrame) -> list[float]:
    """The mean of a table of word vectors, which stands for unknown words."""
    rows = v.select(F.posexplode("vec").alias("k", "x")).groupBy("k").agg(F.avg("x").alias("x")).orderBy("k").collect()
    return [r["x"] for r in rows]


def table_embed(m: DataFrame, v: DataFrame) -> DataFrame:
    """(id, embedding): the mean of the tokens' vectors at length 1; without a token, the unknown word's as it is."""
    unknown = mean_vector(v)
    dim = len(unknown)
    oov = F.array(*map(F.lit, unknown))
    t = m.select("id", F.explode_outer(F.when(F.size(embed_tokens(F.col("content"))) > 0, embed_tokens(F.col("content")))).alias("word"))
    x = t.join(v, "word", "left").select("id", "word", F.coalesce("vec", oov).alias("vec"))
    means = x.groupBy("id").agg(F.array(*[F.avg(F.col("vec")[k]) for k in range(dim)]).alias("e"), F.count("word").alias("n"))
    return means.select("id", F.when(F.col("n") > 0, normalised(F.col("e"))).otherwise(F.col("e")).alias("embedding"))


#: Words of the synthetic table with their strengths, by category.
CATEGORIES = (
    {"rust": 0.8, "python": 0.75, "programming": 0.9, "code": 0.7, "language": 0.5},
    {"memory": 0.85, "safety": 0.8, "ownership": 0.75, "management": 0.6},
    {"machine": 0.8, "learning": 0.85, "data": 0.7, "science": 0.65, "mlx": 0.9},
    {"apple": 0.85, "silicon": 0.8, "gpu": 0.75, "hardware": 0.7},
    {"uses": 0.3, "great": 0.4, "runs": 0.35},
)


def synthetic_table(spark, dim: int = 50) -> DataFrame:
    """(word, vec): 21 words of five categories, with vectors that are alike within one."""
    return spark.createDataFrame([(w, category_vector(dim, k, x)) for k, ws in enumerate(CATEGORIES) for w, x in ws.items()], "word string, vec array<double>")


def word_vector(v: DataFrame, words: DataFrame) -> DataFrame:
    """(word, vec) of words in any case; the mean of the table for those that it lacks."""
    oov = F.array(*map(F.lit, mean_vector(v)))
    return words.select("word", F.lower("word").alias("__w")).join(v.select(F.col("word").alias("__w"), "vec"), "__w", "left").select("word", F.coalesce("vec", oov).alias("vec"))


def known_words(v: DataFrame, words: DataFrame) -> DataFrame:
    """(word, known)."""
    return words.select("word", F.lower("word").alias("__w")).join(v.select(F.col("word").alias("__w"), F.lit(True).alias("known")), "__w", "left").select("word", F.coalesce("known", F.lit(False)).alias("known"))


def mock_embed(text: Column, dim: int = 512) -> Column:
    """A pseudo-random unit vector that depends on the text alone, by a 64-bit linear congruential generator."""
    @F.pandas_udf("array<double>")
    def embed(s):
        import pandas as pd

        mask = (1 << 64) - 1

        def one(t):
            if t is None:
                return None
            seed = 0
            for b in t.encode():
                seed = (seed * 31 + b) & mask
            out = np.empty(dim)
            for k in range(dim):
                seed = (seed * 6364136223846793005 + 1) & mask
                out[k] = seed / mask * 2 - 1
            return out / np.linalg.norm(out)

        return pd.Series([one(t) for t in s])

    return embed(text)


def cached_embed(m: DataFrame, cache: DataFrame, embed: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(memories with embedding, grown cache): texts of the cache (content, embedding) aren't embedded again, and equal texts once."""
    texts = m.select("content").distinct()
    missing = texts.join(cache, "content", "left_anti").withColumn("id", F.col("content"))
    new = embed(missing).select(F.col("id").alias("content"), "embedding")
    grown = cache.unionByName(new)
    return m.drop("embedding").join(grown, "content", "left"), grown


def cache_stats(m: DataFrame, cache: DataFrame) -> DataFrame:
    hit = m.select("content").join(cache.select("content", F.lit(1).alias("hit")), "content", "left")
    row = hit.agg(F.count("hit").alias("hits"), (F.count("*") - F.count("hit")).alias("misses"))
    return row.crossJoin(cache.agg(F.count("*").alias("size"))).withColumn("hit_rate", F.coalesce(F.try_divide("hits", F.col("hits") + F.col("misses")), F.lit(0.0)))


def preload(cache: DataFrame, texts: DataFrame, embed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The cache with the vectors of texts (content) that it lacks."""
    return cached_embed(texts.select("content"), cache, embed)[1]


def save_cache(cache: DataFrame, path: str) -> None:
    cache.select("content", F.col("embedding").cast("array<float>").alias("embedding")).write.mode("overwrite").parquet(path)


def load_cache(spark, path: str) -> DataFrame:
    return spark.read.schema("content string, embedding array<float>").parquet(path)


def fitted_capacity(capacity: Column, hits: Column, misses: Column) -> Column:
    """What a cache of bounded size should hold: half as much again if more than 0.8 of 100 lookups or more hit, a quarter less if fewer than 0.2 do, between 1,000 and 100,000 as the limits where it grows and shrinks no further."""
    n = hits + misses
    rate = F.coalesce(F.try_divide(hits, n), F.lit(0.0))
    return F.when(n < 100, capacity).when((rate > 0.8) & (capacity < 100_000), F.floor(capacity * 1.5)).when((rate < 0.2) & (capacity > 1000), F.floor(capacity * 0.75)).otherwise(capacity).cast("bigint")


def process_batches(m: DataFrame, embed: Callable[[DataFrame], DataFrame], f: Callable[[list[str], np.ndarray], list], schema: str, rows: int = 32) -> DataFrame:
    """(id, value of `schema`): a function of texts and their vectors, called for so many rows at once."""
    kind = dict(m.dtypes)["id"]
    x = m.select("id", "content").join(embed(m), "id").select("id", "content", F.col("embedding").cast("array<double>").alias("embedding"))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                b = whole.slice(at, rows)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(f(b.column(1).to_pylist(), np.array(b.column(2).to_pylist(), float)))], names=["id", "value"])

    return x.mapInArrow(kernel, f"id {kind}, value {schema}")
