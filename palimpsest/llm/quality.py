"""Quality rules by cross-document line frequency.

Lines are normalised (lower case, runs of blanks as one, trimmed) and hashed.
Per host (`source`; null counts as the empty host) the distinct documents that
hold a line are counted, distinct by text, so that copies of one document count
once.  A line above the limit, max(floor, share of the host's distinct
documents), is removed from all documents of the host but the first (least
doc_id) that holds it.  A document that keeps less than `min_kept` of the
characters of its non-blank normalised lines is depleted and rejected.

Defined cases: a null or empty text, or one of blank lines only, has nothing
left and is rejected; texts without a removed line come back unchanged to the
byte; a null doc_id counts for frequencies and is never the first document;
repeated rows count once for frequencies and are each returned; an empty table
gives an empty one; the columns of the input come back in their order, with
`n_chars` (if there is one) as the length of the text that is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

FLOOR, SHARE, MIN_KEPT = 10, 0.001, 0.3
#: Beyond these, the removed lines come by a join on doc_id instead of a broadcast; the results are the same.
BROADCAST_ROWS, BROADCAST_PER_HOST = 200_000, 5_000


def normalised(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), "[ \t\r\f]+", " "))


def _hashes(text: Column) -> Column:
    """The distinct hashes of the non-blank lines."""
    lines = F.filter(F.transform(F.split(text, "\n"), normalised), lambda x: x != "")
    return F.array_distinct(F.transform(lines, lambda x: F.xxhash64(x)))


def frequent_lines(docs: DataFrame, floor: int = FLOOR, share: float = SHARE) -> DataFrame:
    """(host, line, first): lines above the limit of their host, and the first document that holds each."""
    base = docs.select(F.col("doc_id").alias("doc_id"), F.coalesce("source", F.lit("")).alias("host"), F.col("text").alias("text")).where("text is not null")
    held = base.select("doc_id", "host", F.xxhash64("text").alias("content"), F.explode(_hashes(F.col("text"))).alias("line"))
    counted = held.groupBy("host", "line").agg(F.count_distinct("content").alias("n"), F.min("doc_id").alias("first")).where(F.col("n") > floor)
    hosts = base.groupBy("host").agg(F.count_distinct(F.xxhash64("text")).alias("n_host"))
    return counted.join(hosts, "host").where(F.col("n") > F.greatest(F.lit(float(floor)), F.lit(share) * F.col("n_host"))).select("host", "line", "first")


def apply_quality(docs: DataFrame, floor: int = FLOOR, share: float = SHARE, min_kept: float = MIN_KEPT, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The documents that are not rejected, without their removed lines."""
    columns = docs.columns
    frequent = written(frequent_lines(docs, floor, share), "frequent-lines")
    n, most = frequent.groupBy("host").count().agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.max("count"), F.lit(0))).first()
    host = F.coalesce(F.col("d.source"), F.lit(""))
    if n <= broadcast_rows and most <= BROADCAST_PER_HOST:
        by_host = frequent.groupBy("host").agg(F.collect_list("line").alias("lines"))
        spared = frequent.where("first is not null").groupBy("host", "first").agg(F.collect_list("line").alias("spared"))
        joined = docs.alias("d").join(F.broadcast(by_host.alias("h")), host == F.col("h.host"), "left").join(F.broadcast(spared.alias("s")), (F.col("d.doc_id") == F.col("s.first")) & (host == F.col("s.host")), "left")
        gone = F.array_except(F.array_intersect(_hashes(F.col("d.text")), F.col("h.lines")), F.coalesce(F.col("s.spared"), F.array().cast("array<bigint>")))
    else:
        held = docs.where("text is not null").select(F.col("doc_id").alias("id"), F.coalesce("source", F.lit("")).alias("host"), F.explode(_hashes(F.col("text"))).alias("line"))
        # one entry per document and host: the same id may stand under several hosts
        cut = held.join(frequent, ["host", "line"]).where("not (id <=> first)").groupBy("id", "host").agg(F.collect_set("line").alias("lines"))
        joined = docs.alias("d").join(cut.alias("h"), F.col("d.doc_id").eqNullSafe(F.col("h.id")) & (host == F.col("h.host")), "left")
        gone = F.array_intersect(_hashes(F.col("d.text")), F.col("h.lines"))
    row = F.struct(*[F.col(f"d.`{c}`").alias(c) for c in columns])
    # each explode of one element keeps what it holds from being evaluated again inside later expressions
    cut = joined.select(row.alias("row"), F.explode(F.array(gone)).alias("gone"))
    touched = F.size("gone") > 0
    pairs = F.transform(F.split(F.col("row.text"), "\n"), lambda x: F.struct(x.alias("raw"), normalised(x).alias("norm")))
    cut = cut.select("row", "gone", F.explode(F.array(F.when(touched, pairs))).alias("pairs"))
    left = F.filter("pairs", lambda x: ~F.array_contains(F.col("gone"), F.xxhash64(x["norm"])))
    cut = cut.select("row", "pairs", F.explode(F.array(left)).alias("left"))
    chars = lambda c: F.aggregate(c, F.lit(0), lambda n, x: n + F.length(x["norm"]))
    kept = F.when(F.col("pairs").isNull(), F.col("row.text").rlike(r"[^ \t\r\f\n]")).otherwise((chars("left") > 0) & (chars("left") >= min_kept * chars("pairs")))
    text = F.when(F.col("pairs").isNull(), F.col("row.text")).otherwise(F.array_join(F.transform("left", lambda x: x["raw"]), "\n"))
    out = {"text": text, "n_chars": F.length(text).cast(docs.schema["n_chars"].dataType) if "n_chars" in columns else None}
    return cut.where(kept).select(*[(out[c] if c in out else F.col(f"row.`{c}`")).alias(c) for c in columns])


ORACLE = f"""
WITH l AS (
  SELECT doc_id, coalesce(source, '') AS host, text, list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(lower(x), '[ \\t\\r\\f]+', ' ', 'g'))) AS norm,
         string_split(text, chr(10)) AS raw
  FROM documents WHERE text IS NOT NULL),
h AS (SELECT doc_id, host, text, unnest(list_distinct(norm)) AS line FROM l),
n AS (SELECT host, count(DISTINCT text) AS n_host FROM l GROUP BY host),
f AS (SELECT host, line, min(doc_id) AS first, count(DISTINCT text) AS n FROM h WHERE line <> '' GROUP BY host, line HAVING count(DISTINCT text) > {FLOOR}),
g AS (SELECT host, line, first FROM f JOIN n USING (host) WHERE n > greatest({FLOOR}, {SHARE} * n_host)),
c AS (SELECT h.doc_id, h.host, h.text, list(DISTINCT h.line) AS gone FROM h JOIN g ON h.host = g.host AND h.line = g.line WHERE h.doc_id IS DISTINCT FROM g.first GROUP BY ALL),
j AS (SELECT d.*, l.norm, l.raw, coalesce(c.gone, []) AS gone FROM documents d
      JOIN (SELECT DISTINCT ON (text, host, doc_id) * FROM l) l ON d.text = l.text AND coalesce(d.source, '') = l.host AND d.doc_id IS NOT DISTINCT FROM l.doc_id
      LEFT JOIN c ON c.text = d.text AND c.host = l.host AND c.doc_id IS NOT DISTINCT FROM d.doc_id),
k AS (SELECT *, CASE WHEN len(gone) = 0 THEN text ELSE array_to_string(list_filter(raw, lambda x: NOT list_contains(gone, trim(regexp_replace(lower(x), '[ \\t\\r\\f]+', ' ', 'g')))), chr(10)) END AS kept,
             coalesce(list_sum(list_transform(norm, lambda x: length(x))), 0) AS before,
             coalesce(list_sum(list_transform(list_filter(norm, lambda x: NOT list_contains(gone, x)), lambda x: length(x))), 0) AS after FROM j)
SELECT doc_id, kept AS text, lang, source, CAST(length(kept) AS BIGINT) AS n_chars FROM k WHERE after > 0 AND after >= {MIN_KEPT} * before
"""
