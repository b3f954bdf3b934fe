"""Approximate nearest vectors: an index of lists around centroids, whose hits are re-checked exactly.

An index is a table (id, embedding, list) beside its centroids.  Written with
`write.partitionBy("list")`, a search reads no more than the lists that it
probes.  A vector is in the list of its nearest centroid; a query looks into the
`probes` nearest lists and ranks what is there by exact cosine, so what it returns
is right, and only its completeness is a matter of `probes` (`recall` measures it).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine, matrix, nearest_pairs

#: Vectors for each list that the centroids are fitted to.
SAMPLE = 64
MOST_DISTANCE = (1 << 32) - 1


class Index(NamedTuple):
    vectors: DataFrame
    centroids: np.ndarray
    #: Removed ids (id); they are dropped from results, after the limit if `search` is told so.
    removed: DataFrame | None = None

    @property
    def dim(self) -> int:
        return self.centroids.shape[1]


def distance(a: Column, b: Column) -> Column:
    """(1 - cosine) / 2 as a whole number of 32 bits; vectors of different sizes are farthest."""
    d = F.floor((1 - cosine(a, b)) / 2 * F.lit(float(MOST_DISTANCE))).cast("bigint")
    return F.when(F.size(a) == F.size(b), d).otherwise(F.lit(MOST_DISTANCE))


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def centroids_of(x: np.ndarray, lists: int, rounds: int = 8, seed: int = 1) -> np.ndarray:
    """Unit centroids of unit vectors by spherical k-means; empty lists get far vectors."""
    lists = max(1, min(lists, len(x)))
    c = x[np.random.default_rng(seed).permutation(len(x))[:lists]].copy()
    for _ in range(rounds):
        sim = x @ c.T
        near = sim.argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        empty = np.flatnonzero(np.bincount(near, minlength=lists) == 0)
        if len(empty):
            sums[empty] = x[np.argsort(sim[np.arange(len(x)), near])[: len(empty)]]
        c = _unit(sums)
    return c


def _assigned(v: DataFrame, key: str, c: np.ndarray, probes: int) -> DataFrame:
    """(key, embedding, list), a row for each of the nearest lists; vectors of another size are left out."""
    told = v.sparkSession.sparkContext.broadcast(c)
    dim, kind = c.shape[1], dict(v.dtypes)[key]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = told.value
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                b = whole.slice(at, 2000)
                x, ok = matrix(b.column(1), dim)
                own = np.flatnonzero(ok)
                if not len(own):
                    continue
                sim = x[own] @ c.T
                n = min(probes, len(c))
                near = np.argpartition(-sim, n - 1, axis=1)[:, :n]
                rows = pa.array(np.repeat(own, n))
                yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), pa.array(near.ravel().astype(np.int32))], names=[key, "embedding", "list"])

    return v.select(key, F.col("embedding").cast("array<float>").alias("embedding")).mapInArrow(kernel, f"{key} {kind}, embedding array<float>, list int")


def build(v: DataFrame, lists: int | None = None, sample: int = SAMPLE, seed: int = 1) -> Index:
    """An index of (id, embedding); of repeated ids one stays, vectors of another size than the first id's are left out.  The centroids are fitted to `sample` vectors a list, those of the least hashes."""
    fit = v.where("size(embedding) > 0").select("id", "embedding")
    row = fit.agg(F.count("*").alias("n"), F.min_by(F.size("embedding"), "id").alias("dim")).first()
    if not row.n:
        return Index(_assigned(fit, "id", np.zeros((1, 0)), 1), np.zeros((1, 0)))
    lists = lists or max(1, round(2 * row.n**0.5))
    some = fit.where(F.size("embedding") == row.dim).orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(lists * sample).select("embedding").collect()
    c = centroids_of(_unit(np.array([r.embedding for r in some], float)), lists, seed=seed)
    return Index(_assigned(fit.dropDuplicates(["id"]), "id", c, 1), c)


def add(index: Index, new: DataFrame) -> Index:
    """The index with further vectors; ids that it has are ignored, so are vectors of another size."""
    fresh = new.select("id", "embedding").dropDuplicates(["id"]).join(index.vectors.select("id"), "id", "left_anti")
    return index._replace(vectors=index.vectors.unionByName(_assigned(fresh, "id", index.centroids, 1)))


def rejected(index: Index, new: DataFrame) -> DataFrame:
    """(id, size, reason) of the vectors that the index doesn't take."""
    return new.where(F.coalesce(F.size("embedding"), F.lit(-1)) != index.dim).select("id", F.size("embedding").alias("size"), F.lit(f"expected {index.dim} values").alias("reason"))


def remove(index: Index, ids: DataFrame, at_once: bool = True) -> Index:
    """The index without some ids; not `at_once`, they are only noted."""
    gone = ids.select(F.col(ids.columns[0]).alias("id"))
    if at_once:
        return index._replace(vectors=index.vectors.join(gone, "id", "left_anti"))
    return index._replace(removed=gone if index.removed is None else index.removed.unionByName(gone))


def stats(index: Index) -> DataFrame:
    return index.vectors.agg(F.count("*").alias("vectors"), F.lit(index.dim).cast("bigint").alias("dim"), F.count_distinct("list").alias("lists"))


def search_all(index: Index, queries: DataFrame, k: int, probes: int | None = 8, after: bool = False, least: float | None = None) -> DataFrame:
    """(query_id, id, similarity, rank): the k nearest of each query (query_id, embedding), exactly without `probes`; a query of another size has none.

    Removed ids are left out before the k are taken, or `after`; then fewer may return.
    """
    q = _assigned(queries, "query_id", index.centroids, len(index.centroids) if probes is None else probes)
    v = index.vectors
    if index.removed is not None and not after:
        v = v.join(index.removed, "id", "left_anti")
    kinds, dim = (dict(v.dtypes)["id"], dict(q.dtypes)["query_id"]), index.dim

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        """The k nearest of a list's vectors for each query that probes it."""
        names = ["query_id", "id", "similarity"]
        if not left.num_rows or not right.num_rows:
            return pa.table({n: pa.array([], t) for n, t in zip(names, (left.schema.field("query_id").type, right.schema.field("id").type, pa.float64()))})
        x, y = (_unit(matrix(t.column("embedding"), dim)[0]) for t in (left, right))
        n = min(k, len(y))
        rows, cols, sims = [], [], []
        for a in range(0, len(x), 1000):
            s = x[a : a + 1000] @ y.T
            # those as near as the last one too, as ids decide between them
            r, c = np.nonzero(s >= -np.partition(-s, n - 1, axis=1)[:, n - 1 : n] - 1e-12)
            rows.append(a + r)
            cols.append(c)
            sims.append(s[r, c])
        r, c, s = np.concatenate(rows), np.concatenate(cols), np.concatenate(sims)
        if least is not None:
            r, c, s = r[s > least], c[s > least], s[s > least]
        return pa.table([left.column("query_id").combine_chunks().take(pa.array(r)), right.column("id").combine_chunks().take(pa.array(c)), pa.array(s)], names=names)

    hits = q.groupBy("list").cogroup(v.groupBy("list")).applyInArrow(best, f"query_id {kinds[1]}, id {kinds[0]}, similarity double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
    top = hits.withColumn("rank", rank).where(F.col("rank") <= k)
    return top.join(index.removed, "id", "left_anti").select("query_id", "id", "similarity", "rank") if after and index.removed is not None else top


def search(index: Index, query: Sequence[float], k: int, probes: int = 8, after: bool = False) -> DataFrame:
    """(id, similarity) of the k nearest, best first."""
    one = index.vectors.sparkSession.createDataFrame([(0, [float(x) for x in query])], "query_id int, embedding array<float>")
    return search_all(index, one, k, probes, after).orderBy("rank").select("id", "similarity")


def links(index: Index, v: DataFrame, k: int, least: float, probes: int | None = 8) -> DataFrame:
    """(id, other, similarity, rank): of each memory's k nearest, itself among them, the others above a similarity; in place of all pairs where there are too many.

    Without `probes` they are exact, of `v` that the index holds; all pairs of its vectors are compared then, by blocks.
    """
    if probes is None:
        own = index.vectors if index.removed is None else index.vectors.join(index.removed, "id", "left_anti")
        rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("similarity"), "b"))
        top = nearest_pairs(own, k, least).withColumn("rank", rank).where(F.col("rank") <= k)
        found = top.join(v.select(F.col("id").alias("a")), "a", "left_semi").withColumnsRenamed({"a": "query_id", "b": "id"})
    else:
        found = search_all(index, v.select(F.col("id").alias("query_id"), "embedding"), k, probes, least=least)
    return found.where("query_id <> id").select(F.col("query_id").alias("id"), F.col("id").alias("other"), "similarity", "rank")


def fitted_probes(index: Index, k: int, least: float = 0.97, queries: int = 200, seed: int = 2) -> int:
    """How many lists a search must probe for a recall of `least` of its k nearest, by exact searches for so many of the index's vectors."""
    q = index.vectors.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(queries).select(F.col("id").alias("query_id"), "embedding")
    exact = search_all(index, q, k, probes=None).select("query_id", "id")
    hits = exact.join(index.vectors.select("id", "list"), "id").select("query_id", "list").collect()
    near = {r.query_id: np.argsort(np.argsort(-(index.centroids @ np.array(r.embedding, float)))) for r in q.collect()}
    ranks = sorted(int(near[r.query_id][r.list]) for r in hits)
    return ranks[-int(-least * len(ranks) // 1) - 1] + 1 if ranks else 1


def pairs(index: Index, v: DataFrame, k: int, least: float, probes: int = 8) -> DataFrame:
    """(a, b, similarity), a < b, of memories that are among each other's k nearest, above a similarity."""
    found = links(index, v, k, least, probes)
    return found.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"), "similarity").dropDuplicates(["a", "b"])


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: the share of the exact hits (query_id, id) that were found."""
    hit = exact.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return hit.agg((F.count("hit") / F.count("*")).alias("recall"))
