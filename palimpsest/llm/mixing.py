"""Mixing sources to target weights by a low-discrepancy schedule.

The documents of a source, in the order of a hash, form one stream of tokens
(runs of characters other than white space), cut into blocks of equal size; the
last block of a source may be shorter.  Slot t of the schedule takes the van der
Corput point of t (its 48 bits reversed), which the cumulative weights map to a
source.  The k-th slot of a source takes block k of its first epoch, then those
of further epochs, each in another order.  The schedule is the shortest that
holds every block, so no document is lost; a source above its natural share
repeats.  Without given weights, a source's is its tokens to the power `alpha`.

Nothing is ordered in one place: streams are summed up in 4096 hash ranges for
each source, slots in chunks of 65,536.  Only the sources' totals and weights are
held by the driver, some 100 bytes for each source.

Defined cases: null and empty texts hold no token and are not scheduled; so are
rows with a null doc_id, unless `without_id` gives each a key of its own, and
sources with no or zero weight where weights are given; a null source counts as the empty one; rows that repeat a doc_id are one
document, that with most tokens (then the least source and text); an empty table
gives an empty schedule.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mapped, one_per_id, packed, token_count, written

BLOCK, ALPHA, SEED = 2048, 0.7, 1
BITS = 48
CHUNK = 1 << 16
#: The count of van der Corput points in an interval is off by at most 2 (log2(N) / 3 + 1), which is under 34 for 48 bits.
SLACK = 34
#: Multipliers of the orders after the first epoch; a count of blocks below 2^48 is no multiple of two of them.
PRIMES = (16777213, 16777199)
SCHEDULE = "slot bigint, source string, epoch bigint, block bigint, doc_id bigint, tok_start bigint, tok_end bigint"


def van_der_corput(t: np.ndarray) -> np.ndarray:
    """The low 48 bits of t, reversed."""
    x = t.astype(np.uint64)
    out = np.zeros_like(x)
    for _ in range(BITS // 8):
        byte = (x & np.uint64(255)).astype(np.uint8)
        out = (out << np.uint64(8)) | _REVERSED[byte]
        x >>= np.uint64(8)
    return out.astype(np.int64)


_REVERSED = np.array([int(f"{b:08b}"[::-1], 2) for b in range(256)], np.uint64)


def _slots(thresholds: np.ndarray):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in batch.column(0).to_pylist():
                slot = np.arange(chunk * CHUNK, (chunk + 1) * CHUNK)
                sid = np.searchsorted(thresholds, van_der_corput(slot), side="right")
                order = np.argsort(sid, kind="stable")
                s = sid[order]
                first = np.searchsorted(s, s)
                rank = np.empty(len(s), np.int64)
                rank[order] = np.arange(len(s)) - first
                yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(sid.astype(np.int64)), pa.array(np.full(len(s), chunk)), pa.array(rank)], names=["slot", "sid", "chunk", "rank"])

    return kernel


def streams(docs: DataFrame, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """(source, doc_id, n, start): the tokens of each document and where it begins in the stream of its source."""
    counted = docs.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("source", F.lit("")).alias("source"), token_count(F.col("text")).alias("n"), F.xxhash64("text").alias("x"))
    # of rows that repeat an id, one; ids alone are shuffled, not texts
    rows = counted.where("n > 0").groupBy("doc_id").agg(F.min(F.struct((-F.col("n")).alias("m"), "source", "x")).alias("r")).select("doc_id", F.col("r.source").alias("source"), (-F.col("r.m")).cast("bigint").alias("n"))
    rows = written(rows.withColumn("h", F.md5(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")))).withColumn("range", F.substring("h", 1, 3)), "mix-documents")
    sums = rows.groupBy("source", "range").agg(F.sum("n").alias("s"))
    before = sums.select("source", "range", (F.sum("s").over(Window.partitionBy("source").orderBy("range")) - F.col("s")).alias("before"))
    inside = F.sum("n").over(Window.partitionBy("source", "range").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    return rows.withColumn("inside", inside).join(before, ["source", "range"]).select("source", "doc_id", "n", (F.col("before") + F.col("inside")).alias("start"))


def schedule(docs: DataFrame, weights: Mapping[str, float] | None = None, block: int = BLOCK, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """A row for each part of a document in each slot: (slot, source, epoch, block, doc_id, tok_start, tok_end)."""
    spark = docs.sparkSession
    placed = written(streams(docs, block, seed), "mix-streams")
    totals = sorted((r["source"], r["t"]) for r in placed.groupBy("source").agg(F.sum("n").alias("t")).collect())
    share = [(s, t, float(t) ** alpha if weights is None else float(weights.get(s, 0.0))) for s, t in totals]
    share = [(s, -(-t // block), w) for s, t, w in share if w > 0]
    if not share:
        return spark.createDataFrame([], SCHEDULE)
    cumulative = np.cumsum([w for *_, w in share])
    thresholds = np.floor(cumulative / cumulative[-1] * float(1 << BITS)).astype(np.int64)
    most = max(int(np.ceil((n + SLACK) / (w / cumulative[-1]))) for _, n, w in share)
    sources = spark.createDataFrame([(k, s, int(n)) for k, (s, n, _) in enumerate(share)], "sid bigint, source string, blocks bigint")
    raw = mapped(spark.range(-(-most // CHUNK)), _slots(thresholds[:-1]), "slot bigint, sid bigint, chunk bigint, rank bigint")
    counts = raw.groupBy("sid", "chunk").count()
    before = counts.select("sid", "chunk", (F.sum("count").over(Window.partitionBy("sid").orderBy("chunk")) - F.col("count")).alias("before"))
    ranked = written(raw.join(before, ["sid", "chunk"]).select("slot", "sid", (F.col("before") + F.col("rank")).alias("k")).join(sources, "sid"), "mix-slots")
    last = ranked.where("k = blocks - 1").agg(F.max("slot")).first()[0]
    k, n, e = F.expr("k % blocks"), F.col("blocks"), F.expr("k div blocks")
    step = F.when(e == 0, F.lit(1)).when((e % 2 == 1) & (n % PRIMES[0] != 0) | (n % PRIMES[1] == 0), F.lit(PRIMES[0])).otherwise(F.lit(PRIMES[1])).cast("bigint")
    slots = ranked.where(F.col("slot") <= last).select("slot", "source", e.alias("epoch"), ((k * step + e * 7919) % n).alias("block"))
    b = F.lit(block).cast("bigint")
    cut = placed.select("source", "doc_id", "n", "start", F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + n - 1) div {block}"))).alias("block"))
    parts = cut.select("source", "block", "doc_id", (F.greatest("start", F.col("block") * b) - F.col("start")).alias("tok_start"), (F.least(F.col("start") + F.col("n"), (F.col("block") + 1) * b) - F.col("start")).alias("tok_end"))
    return slots.join(parts, ["source", "block"]).select("slot", "source", "epoch", "block", "doc_id", "tok_start", "tok_end")


def _keyed(docs: DataFrame) -> DataFrame:
    """packed(docs), rows with a null doc_id under a key of their own: a hash of text and source, and a number among equal ones."""
    rows = packed(docs)
    text, source = F.col("__row.text"), F.coalesce("__row.source", F.lit(""))
    none = rows.where("__doc is null").withColumn("__x", F.xxhash64(text, source))
    number = F.row_number().over(Window.partitionBy("__x").orderBy(text, source))
    key = F.xxhash64(F.lit("without id"), "__x", number)
    return rows.where("__doc is not null").select(F.col("__doc").cast("bigint").alias("__doc"), "__row").union(none.select(key.alias("__doc"), "__row"))


def mix_documents(docs: DataFrame, weights: Mapping[str, float] | None = None, without_id: bool = False, **how) -> DataFrame:
    """The rows of `docs` in the order of the schedule, each as often as its first token is scheduled; columns stay as they are.  With `without_id` also rows with a null doc_id."""
    packs = _keyed(docs) if without_id else packed(docs)
    table = packs.select(F.col("__doc").alias("doc_id"), F.col("__row.source").alias("source"), F.col("__row.text").alias("text")) if without_id else docs
    starts = schedule(table, weights, **how).where("tok_start = 0").select(F.col("doc_id").alias("__id"), F.col("slot").alias("__slot"))
    rows = one_per_id(docs, packs, lambda c: [-token_count(c("text")), F.coalesce(c("source"), F.lit("")), F.xxhash64(c("text"))])
    placed = rows.join(starts, F.col("__doc") == F.col("__id"))
    return placed.repartitionByRange("__slot").sortWithinPartitions("__slot", "__id").select("__row.*")


ORACLE = f"""
WITH t AS (
  SELECT doc_id, source, n, md5('{SEED}:' || doc_id) AS h FROM (
    SELECT doc_id, coalesce(source, '') AS source, len(regexp_extract_all(text, '[^\\t\\n\\v\\f\\r ]+')) AS n FROM documents WHERE doc_id IS NOT NULL) WHERE n > 0
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, source) = 1),
p AS (SELECT source, doc_id, n, CAST(sum(n) OVER (PARTITION BY source ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) - n AS BIGINT) AS start FROM t),
s AS (SELECT source, (CAST(sum(n) AS BIGINT) + {BLOCK - 1}) // {BLOCK} AS blocks, pow(CAST(sum(n) AS DOUBLE), {ALPHA}) AS w FROM t GROUP BY source),
c AS (SELECT source, blocks, w / sum(w) OVER () AS share,
      CAST(floor(coalesce(sum(w) OVER (ORDER BY source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(w) OVER () * {1 << BITS}) AS BIGINT) AS low,
      CAST(floor(sum(w) OVER (ORDER BY source) / sum(w) OVER () * {1 << BITS}) AS BIGINT) AS high, row_number() OVER (ORDER BY source DESC) = 1 AS top FROM s),
x AS (SELECT slot, CAST(list_sum(list_transform(range({BITS}), lambda i: ((slot >> i) & 1) << ({BITS - 1} - i))) AS BIGINT) AS v FROM (SELECT unnest(range((SELECT CAST(max(ceil((blocks + {SLACK}) / share)) AS BIGINT) FROM c))) AS slot)),
r AS (SELECT slot, source, blocks, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS k FROM x JOIN c ON v >= low AND (v < high OR top)),
f AS (SELECT *, k // blocks AS epoch FROM r WHERE slot <= (SELECT max(slot) FROM r WHERE k = blocks - 1)),
g AS (SELECT slot, source, epoch, ((k % blocks) * CASE WHEN epoch = 0 THEN 1 WHEN (epoch % 2 = 1 AND blocks % {PRIMES[0]} <> 0) OR blocks % {PRIMES[1]} = 0 THEN {PRIMES[0]} ELSE {PRIMES[1]} END + epoch * 7919) % blocks AS block FROM f),
d AS (SELECT source, doc_id, n, start, unnest(range(start // {BLOCK}, (start + n - 1) // {BLOCK} + 1)) AS block FROM p)
SELECT slot, source, epoch, block, doc_id, greatest(start, block * {BLOCK}) - start AS tok_start, least(start + n, (block + 1) * {BLOCK}) - start AS tok_end
FROM g JOIN d USING (source, block)
"""
