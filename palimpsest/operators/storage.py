"""Storing, deleting and looking up memories and links; every operator maps DataFrames to DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str] = ("id",), order: Sequence[str | Column] = ()) -> DataFrame:
    """`old` with the rows of `new` in place of those of equal keys; of equal keys, the last row of `new` stays.

    The last is the greatest by `order`; without one it is the row that stands last
    in `new`, which says something only where `new` has an order of its own (rows of
    a list or a file, not of a shuffle).  Both sides go through one shuffle on the
    keys, after each task has left out what it can.
    """
    last = F.struct(*[F.col(c) if isinstance(c, str) else c for c in order]) if order else F.monotonically_increasing_id()
    both = old.withColumn("__last", F.lit(None).cast(new.select(last.alias("x")).schema["x"].dataType)).withColumn("__new", F.lit(0)).unionByName(new.withColumn("__last", last).withColumn("__new", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(F.desc("__new"), F.desc("__last"))
    return both.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank", "__new", "__last")


def insert_links(links: DataFrame, new: DataFrame, order: Sequence[str | Column] = ()) -> DataFrame:
    """Links with new ones, one for each pair of ends, the last; weights are brought to 0 to 1, relations to their normal form."""
    from ..functions.scoring import clamp
    from ..functions.text import relation

    x = new.withColumn("weight", clamp(F.coalesce("weight", F.lit(1.0)), 0.0, 1.0)) if "weight" in new.columns else new.withColumn("weight", F.lit(1.0))
    return upsert(links, x.withColumn("relation", relation(F.col("relation"))) if "relation" in x.columns else x, ("from_id", "to_id"), order)


def delete_links(links: DataFrame, ids: DataFrame) -> DataFrame:
    """Links without those that begin at one of the ids."""
    return delete(links, ids, "from_id")


def associate(m: DataFrame, pairs: DataFrame, column: str = "associations", both: bool = False) -> DataFrame:
    """Memories whose `column` holds the ids that pairs (from_id, to_id) give them besides, once each and after those that are there; with `both`, also the other way."""
    p = pairs.select(F.col("from_id").alias("id"), F.col("to_id").alias("__to"))
    if both:
        p = p.unionByName(pairs.select(F.col("to_id").alias("id"), F.col("from_id").alias("__to")))
    more = p.groupBy("id").agg(F.sort_array(F.collect_set("__to")).alias("__to"))
    have = F.coalesce(F.col(column), F.array().cast("array<string>"))
    return m.join(more, "id", "left").withColumn(column, F.when(F.col("__to").isNull(), have).otherwise(F.array_union(have, "__to"))).drop("__to")


def count(m: DataFrame) -> DataFrame:
    return m.agg(F.count("*").alias("n"))


def ensure(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The table at a path; made, with no rows, if it isn't there.  A table of another schema is an error."""
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        spark.createDataFrame([], kind).write.parquet(path)
    have = dict(spark.read.parquet(path).dtypes)
    wrong = [f.name for f in kind if have.get(f.name) != f.dataType.simpleString()]
    if wrong:
        raise ValueError(f"the table at {path} has other columns: {', '.join(wrong)}")
    return spark.read.schema(kind).parquet(path)


def store_vectors(v: DataFrame, new: DataFrame, dim: int | None = None) -> DataFrame:
    """Appends (embedding, metadata) under new numbers; equal rows are stored again.  Vectors of another size than `dim` are left out."""
    fit = new if dim is None else new.where(F.size("embedding") == dim)
    first = v.agg(F.coalesce(F.max("vec_id") + 1, F.lit(0)).alias("__first"))
    # numbers leave gaps between tasks, as no order is asked for
    numbered = fit.select((F.monotonically_increasing_id()).alias("__n"), "embedding", "metadata").crossJoin(F.broadcast(first))
    return v.select("vec_id", "embedding", "metadata").unionByName(numbered.select((F.col("__n") + F.col("__first")).alias("vec_id"), "embedding", "metadata"))


def healthy(spark: SparkSession, path: str) -> bool:
    """Whether the table at a path can be read."""
    try:
        spark.read.parquet(path).limit(1).collect()
        return True
    except Exception:  # whatever keeps it from being read
        return False


def delete(m: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return m.join(ids.select(F.col(ids.columns[0]).alias(key)), key, "left_anti")


def delete_prefix(m: DataFrame, prefix: str) -> DataFrame:
    return m.where(~F.col("id").startswith(prefix))


def contains_text(query: str) -> Column:
    """Whether content or context holds the query, whatever the case; the empty query matches all."""
    q = query.lower()
    if not q:
        return F.lit(True)
    return F.coalesce(F.lower("content").contains(q), F.lit(False)) | F.coalesce(F.lower("context").contains(q), F.lit(False))


def search(m: DataFrame, query: str, limit: int) -> DataFrame:
    """The strongest memories that hold the query."""
    return m.where(contains_text(query)).orderBy(F.desc("strength"), "id").limit(limit)


def recent(m: DataFrame, limit: int) -> DataFrame:
    return m.orderBy(F.desc("created_at"), "id").limit(limit)


def in_range(m: DataFrame, start: str, end: str) -> DataFrame:
    """Both ends count; newest first."""
    return m.where(F.col("created_at").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"))).orderBy(F.desc("created_at"), "id")


def has_tag(tag: str) -> Column:
    """Whether a part of any tag equals the given one, whatever the case."""
    return F.exists("tags", lambda t: F.lower(t).contains(tag.lower()))


def by_tag(m: DataFrame, tag: str) -> DataFrame:
    return m.where(has_tag(tag)).orderBy(F.desc("strength"), "id")


def get(m: DataFrame, key: str) -> DataFrame:
    return m.where(F.col("id") == key)


def get_many(m: DataFrame, ids: Sequence[str]) -> DataFrame:
    """In the order of the ids, with their place as `pos`; those that are missing are left out."""
    wanted = m.sparkSession.createDataFrame([(k, i) for k, i in enumerate(ids)], "pos int, id string")
    return m.join(F.broadcast(wanted), "id").orderBy("pos") if len(ids) < 100_000 else m.join(wanted, "id").orderBy("pos")


def decode_rows(rows: DataFrame) -> DataFrame:
    """Memories of text rows: times in milliseconds, JSON arrays, and the defaults of a store."""
    c = F.col
    kind = F.when(c("memory_type").isin("Working", "Episodic", "Semantic", "Procedural"), c("memory_type")).otherwise("Semantic")
    emotion = F.when(c("emotion").isin("Positive", "Negative", "Surprise"), c("emotion")).otherwise("Neutral")
    return rows.where("id is not null and content is not null").select(
        "id",
        "content",
        F.nullif(c("context"), F.lit("")).alias("context"),
        kind.alias("memory_type"),
        emotion.alias("emotion"),
        F.timestamp_millis(c("created_at").try_cast("bigint")).alias("created_at"),
        F.timestamp_millis(c("last_accessed").try_cast("bigint")).alias("last_accessed"),
        F.coalesce(c("access_count").try_cast("int"), F.lit(0)).alias("access_count"),
        F.coalesce(c("strength").try_cast("double"), F.lit(1.0)).alias("strength"),
        F.coalesce(F.from_json("tags", "array<string>"), F.array().cast("array<string>")).alias("tags"),
    )


def from_metadata(rows: DataFrame) -> DataFrame:
    """Memories of (vec_id, metadata MAP): missing keys have defaults, tags are divided by commas."""
    md = lambda k, d: F.coalesce(F.try_element_at("metadata", F.lit(k)), F.lit(d))
    tags = F.filter(F.transform(F.split(md("tags", ""), ","), lambda t: F.trim(t)), lambda t: t != "")
    kind = F.when(md("type", "").isin("Semantic", "Procedural"), md("type", "")).otherwise("Episodic")
    return rows.select("vec_id", md("content", "").alias("content"), kind.alias("memory_type"), md("strength", "1.0").try_cast("double").alias("strength"), md("access_count", "1").try_cast("int").alias("access_count"), tags.alias("tags"))


def stats(vectors: DataFrame) -> DataFrame:
    return vectors.agg(F.count("*").alias("vectors"), F.coalesce(F.max(F.size("embedding")), F.lit(0)).cast("bigint").alias("dim"))


def links_of(links: DataFrame, source: str) -> DataFrame:
    return links.where(F.col("from_id") == source)


def associated(links: DataFrame, m: DataFrame, source: str) -> DataFrame:
    to = links_of(links, source).select(F.col("to_id").alias("id")).distinct()
    return m.join(to, "id", "left_semi")


def both_ways(links: DataFrame) -> DataFrame:
    """Links and their reverses, once each."""
    back = links.select(*[F.col({"from_id": "to_id", "to_id": "from_id"}.get(c, c)).alias(c) for c in links.columns])
    return links.unionByName(back).dropDuplicates(["from_id", "to_id"])


def set_strength(m: DataFrame, prefix: str, strength: float) -> DataFrame:
    """The first memory whose id has the prefix, in the order of stores and ids, gets the strength, from 0 to 1."""
    order = F.element_at(F.create_map(*[F.lit(x) for k, t in enumerate(("Episodic", "Semantic", "Procedural", "Working")) for x in (t, k)]), F.col("memory_type"))
    first = m.where(F.col("id").startswith(prefix)).orderBy(order, "id").limit(1).select("id", F.lit(min(1.0, max(0.0, strength))).alias("__s"))
    return m.join(F.broadcast(first), "id", "left").withColumn("strength", F.coalesce("__s", "strength")).drop("__s")


def run_sql(m: DataFrame, sql: str, view: str = "memories", width: int | None = None) -> DataFrame:
    """A query over the memories; with `width`, text values are cut to so many characters, as a page of results shows them."""
    m.createOrReplaceTempView(view)
    out = m.sparkSession.sql(sql)
    return out if width is None else out.select(*[F.substring(F.col(f"`{c}`"), 1, width).alias(c) if t == "string" else F.col(f"`{c}`") for c, t in out.dtypes])
