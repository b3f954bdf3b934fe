"""Vector functions: Column expressions, and Arrow kernels for whole scans."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _double(a: Column) -> Column:
    return a.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """0 if the sizes differ."""
    s = F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: x * y), F.lit(0.0), lambda n, x: n + x)
    return F.when(F.size(a) == F.size(b), s).otherwise(F.lit(0.0))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(_double(a), F.lit(0.0), lambda n, x: n + x * x))


def cosine(a: Column, b: Column) -> Column:
    """0 if sizes differ, for empty and zero vectors and nulls."""
    n = norm(a) * norm(b)
    return F.coalesce(F.when((F.size(a) == F.size(b)) & (n > 0), F.try_divide(dot(a, b), n)), F.lit(0.0))


def normalised(a: Column) -> Column:
    return once(norm(a), lambda n: F.transform(_double(a), lambda x: F.when(n > 0, F.try_divide(x, n)).otherwise(x)))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is evaluated once a row, however often inner lambdas name it."""
    return F.transform(F.array(value), use)[0]


def matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, dim) doubles, and which rows have that size and no null; the others are zero."""
    out = np.zeros((len(column), dim))
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    ok = sizes == dim
    if ok.any():
        flat = column.filter(pa.array(ok)).flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
        out[ok] = flat.reshape(-1, dim)
        bad = np.isnan(out).any(axis=1)
        out[bad] = 0.0
        ok &= ~bad
    return out, ok


def with_cosine(df: DataFrame, query: Sequence[float], to: str = "similarity", embedding: str = "embedding") -> DataFrame:
    """`df` with the cosine of each embedding and one query vector, by matrix products on Arrow batches."""
    q = np.asarray(query, float)
    n = np.linalg.norm(q)
    names = [f"c{i}" for i in range(len(df.columns))]
    at = df.columns.index(embedding)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, _ = matrix(b.column(at), len(q))
            d = np.linalg.norm(x, axis=1) * n
            sim = np.divide(x @ q, d, out=np.zeros(len(x)), where=d > 0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sim)], names=[*names, "sim"])

    plain = df.toDF(*names)
    out = plain.mapInArrow(kernel, T.StructType([*plain.schema.fields, T.StructField("sim", T.DoubleType())]))
    return out.toDF(*df.columns, to)


#: Rows of a block of vectors at most, and values.
BLOCK_ROWS, BLOCK_VALUES = 16_384, 4_000_000


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1; zeros stay."""
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def over_blocks(df: DataFrame, work: Callable, names: tuple[str, str], block_rows: int = BLOCK_ROWS, rows: int | None = None) -> DataFrame:
    """(*names, similarity): `work` of each pair of blocks of `df` (id, embedding), which every pair of vectors of one size is in once.

    `work` takes two arrays of ids, the unit vectors of each, and whether both are the
    same block, and yields arrays of ids, ids and cosines.  A pair of blocks is one task
    however few they are, so a task's work and memory are bounded by the blocks' size.
    """
    row = df.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dim")).first()
    n = row.n if rows is None else rows
    most = max(1, min(block_rows, BLOCK_VALUES // max(1, row.dim or 1)))
    k = max(1, -(-n // most), min(6, n // 2000))
    kinds = dict(df.dtypes)
    kind, real = kinds["id"], "<f4" if kinds["embedding"] == "array<float>" else "<f8"

    def pack(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        dim = t.column("dim")[0].as_py()
        x, ok = matrix(t.column("embedding"), dim)
        ids = t.column("id").filter(pa.array(ok)).combine_chunks()
        return pa.table({"block": pa.array([t.column("block")[0].as_py()], pa.int32()), "dim": pa.array([dim], pa.int32()), "ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), "x": pa.array([x[ok].astype(real).tobytes()], pa.large_binary() if x.nbytes > 1 << 30 else pa.binary())})

    block = df.where("size(embedding) > 0").select("id", "embedding", F.pmod(F.xxhash64("id"), F.lit(k)).cast("int").alias("block"), F.size("embedding").alias("dim"))
    packed = block.groupBy("block", "dim").applyInArrow(pack, f"block int, dim int, ids array<{kind}>, x binary")
    # blocks i <= j as number i + j (j + 1) / 2
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda o: (F.least("block", o) + F.floor(F.greatest("block", o) * (F.greatest("block", o) + 1) / 2)).cast("int"))).alias("pair")
    placed = packed.select("*", pair).repartitionById(k * (k + 1) // 2, F.col("pair"))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides: dict[int, list] = {}
        for b in batches:
            for r in range(b.num_rows):
                dim = b.column("dim")[r].as_py()
                x = np.frombuffer(b.column("x")[r].as_buffer(), real).reshape(-1, dim).astype(float)
                sides.setdefault(dim, []).append((b.column("block")[r].as_py(), b.column("pair")[r].as_py(), b.column("ids")[r].values, unit(x)))
        for own in sides.values():
            own.sort(key=lambda s: s[0])
            i, pair, ids, x = own[0]
            if len(own) == 2:
                found = work(ids, x, own[1][2], own[1][3], False)
            elif pair == i + i * (i + 1) // 2:
                found = work(ids, x, ids, x, True)
            else:  # the other block has no vector of this size
                continue
            for a, b, s in found:
                for at in range(0, len(a), 50_000):
                    yield pa.RecordBatch.from_arrays([a[at : at + 50_000], b[at : at + 50_000], pa.array(s[at : at + 50_000])], names=[*names, "similarity"])

    return placed.mapInArrow(kernel, f"{names[0]} {kind}, {names[1]} {kind}, similarity double")


def similarity_pairs(df: DataFrame, threshold: float, strict: bool = False, block_rows: int = BLOCK_ROWS, rows: int | None = None) -> DataFrame:
    """(a, b, similarity), a < b: all pairs of `df` (id, embedding) whose cosine reaches the threshold (passes it, if strict).  Exact."""

    def work(p: pa.Array, x: np.ndarray, q: pa.Array, y: np.ndarray, same: bool):
        for at in range(0, len(x), 256):
            sim = x[at : at + 256] @ y.T
            r, c = np.nonzero(sim > threshold if strict else sim >= threshold)
            if same:
                later = c > r + at
                r, c = r[later], c[later]
            a, b, s = p.take(pa.array(r + at)), q.take(pa.array(c)), sim[r, c]
            less = pc.less(a, b)
            a, b = pc.if_else(less, a, b), pc.if_else(less, b, a)
            if same:  # equal ids are in one block
                own = pc.not_equal(a, b)
                a, b, s = a.filter(own), b.filter(own), s[own.to_numpy(zero_copy_only=False)]
            yield a, b, s

    return over_blocks(df, work, ("a", "b"), block_rows, rows)


def nearest_pairs(df: DataFrame, k: int, least: float | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(a, b, similarity): all that may be of the k nearest of `a`, itself among them: the k nearest in each block, and those as near as the last; with `least`, above it.  Exact."""

    def side(p: pa.Array, x: np.ndarray, q: pa.Array, y: np.ndarray):
        n = min(k, len(y))
        for at in range(0, len(x), 256) if n else ():
            sim = x[at : at + 256] @ y.T
            last = -np.partition(-sim, n - 1, axis=1)[:, n - 1 : n]
            near = sim >= last - 1e-12
            r, c = np.nonzero(near if least is None else near & (sim > least))
            yield p.take(pa.array(r + at)), q.take(pa.array(c)), sim[r, c]

    def work(p: pa.Array, x: np.ndarray, q: pa.Array, y: np.ndarray, same: bool):
        yield from side(p, x, q, y)
        if not same:
            yield from side(q, y, p, x)

    return over_blocks(df, work, ("a", "b"), block_rows)
