"""Taking in new memories: vectors, types, links to what is alike, importance."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring
from ..functions.text import classify
from ..functions.vectors import matrix
from ..schema import NOW, new_memories
from .embedding import hash_embed
from .storage import associate

#: How many of the strongest memories of each store new ones are held against.
POOLS = (("Semantic", 100), ("Episodic", 50))


def embedded(m: DataFrame, dim: int = 256) -> DataFrame:
    """Memories with vectors of their contents."""
    return m.drop("embedding").join(hash_embed(m, dim), "id", "left").withColumn("embedding", F.col("embedding").cast("array<float>")).select(*m.columns)


def related(m: DataFrame, new: DataFrame, threshold: float = 0.4, top: int = 5, pools: Sequence[tuple[str, int]] = POOLS) -> DataFrame:
    """(id, other, similarity): for each new memory, the most similar of the strongest of each store, above the threshold.

    The pools are a few hundred vectors, which each task holds; new memories go past them in batches.
    """
    rows = []
    for kind, n in pools:
        own = m.where((F.col("memory_type") == kind) & F.col("embedding").isNotNull())
        rows += own.orderBy(F.desc("strength"), "id").limit(n).select("id", "embedding").collect()
    dim = len(rows[0]["embedding"]) if rows else 0
    rows = [r for r in rows if len(r["embedding"]) == dim]
    ids = [r["id"] for r in rows]
    pool = np.array([r["embedding"] for r in rows], float).reshape(len(rows), dim)
    size = np.linalg.norm(pool, axis=1)
    told = m.sparkSession.sparkContext.broadcast((ids, np.divide(pool, size[:, None], out=np.zeros_like(pool), where=size[:, None] > 0)))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, pool = told.value
        for b in batches:
            x, _ = matrix(b.column(1), dim) if dim else (np.zeros((b.num_rows, 0)), None)
            n = np.linalg.norm(x, axis=1)
            sim = np.divide(x @ pool.T, n[:, None], out=np.zeros((len(x), len(ids))), where=n[:, None] > 0)
            out = []
            for i, own in enumerate(b.column(0).to_pylist()):
                near = sorted((-sim[i, j], ids[j]) for j in np.flatnonzero(sim[i] > threshold) if ids[j] != own)
                out += [(own, other, -s) for s, other in near[:top]]
            a, o, s = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(o, pa.string()), pa.array(s, pa.float64())], names=["id", "other", "similarity"])

    return new.select("id", "embedding").mapInArrow(kernel, "id string, other string, similarity double")


def processed(m: DataFrame, new: DataFrame, at: str = NOW, dim: int = 256, threshold: float = 0.4, top: int = 5) -> DataFrame:
    """New memories of (content, and perhaps context, tags, id), with vectors, types and associations to what `m` has like them; they are of one batch and don't see each other."""
    x = new_memories(new, at=at).withColumn("memory_type", classify(F.col("content")))
    x = embedded(x, dim)
    return associate(x, related(m, x, threshold, top).select(F.col("id").alias("from_id"), F.col("other").alias("to_id")))


def process(m: DataFrame, new: DataFrame, at: str = NOW, **how) -> DataFrame:
    """Memories with the new ones."""
    return m.unionByName(processed(m, new, at, **how), allowMissingColumns=True)


def importance(m: DataFrame, new: DataFrame, known: float = 0.5) -> DataFrame:
    """(content, novelty, rarity, importance) of new (content, tags, valence).

    Novelty is 1 where no memory holds the content, less by the share of the five
    strongest that do and have a vector; rarity is the mean over the tags of how rare they are.
    """
    from .graph import holders

    x = new.select("content", "tags", "valence").dropDuplicates(["content"])
    vector = F.col("embedding").isNotNull() if "embedding" in m.columns else F.lit(False)
    hold = m.select("id", "strength", vector.alias("__e")).join(holders(m, x), "id")
    best = hold.withColumn("__r", F.row_number().over(Window.partitionBy("c").orderBy(F.desc("strength"), "id"))).where("__r <= 5")
    seen = best.groupBy(F.col("c").alias("content")).agg((F.lit(1.0) - F.lit(known) * F.count_if("__e") / F.count("*")).alias("novelty"))
    tags = m.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))
    total = m.agg(F.count("*").alias("total"))
    own = x.select("content", F.explode("tags").alias("tag")).join(tags, "tag", "left").crossJoin(F.broadcast(total))
    rare = own.groupBy("content").agg(F.avg(1 - F.least(F.lit(1.0), F.coalesce(F.try_divide(F.col("n"), F.col("total")), F.lit(0.0)))).alias("rarity"))
    out = x.join(seen, "content", "left").join(rare, "content", "left").withColumn("novelty", F.coalesce("novelty", F.lit(1.0))).withColumn("rarity", F.coalesce("rarity", F.lit(0.5)))
    return out.select("content", "novelty", "rarity", scoring.importance(F.col("novelty"), F.col("valence"), F.col("rarity")).alias("importance"))


def store_with_importance(m: DataFrame, new: DataFrame, at: str = NOW, **how) -> DataFrame:
    """Memories with the new ones of (content, tags, valence); the strongest semantic memory that holds a content then has its importance as strength."""
    from .graph import holders

    score = importance(m, new)
    all_ = process(m, new.select("content", F.array_join("tags", ",").alias("context")), at, **how)
    semantic = all_.where("memory_type = 'Semantic'")
    hold = semantic.select("id", "strength").join(holders(semantic, new), "id")
    best = hold.withColumn("__r", F.row_number().over(Window.partitionBy("c").orderBy(F.desc("strength"), "id"))).where("__r = 1")
    # of several contents whose best holder is one memory, the last in order says its strength
    given = best.select("id", F.col("c").alias("content")).join(score.select("content", "importance"), "content").groupBy("id").agg(F.max_by("importance", "content").alias("__s"))
    return all_.join(given, "id", "left").withColumn("strength", F.coalesce("__s", "strength")).drop("__s")

