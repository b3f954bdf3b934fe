"""The memory table, and its derivation from the driver's tables.

A memory has id, content, context, memory_type, emotion, created_at,
last_accessed, access_count, strength, embedding and tags.  "Now" is always a
parameter; NOW is that of the registered queries.  DERIVED_SQL has the same
derivations as DuckDB views, so that queries and their SQL don't drift.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.text import classify

NOW = "2024-02-01 00:00:00"
MEMORY_TYPES = ("Working", "Episodic", "Semantic", "Procedural")
EMOTIONS = ("Neutral", "Positive", "Negative", "Surprise")

MEMORY = (
    T.StructType()
    .add("id", "string")
    .add("content", "string")
    .add("context", "string")
    .add("memory_type", "string")
    .add("emotion", "string")
    .add("created_at", "timestamp")
    .add("last_accessed", "timestamp")
    .add("access_count", "integer")
    .add("strength", "double")
    .add("embedding", T.ArrayType(T.FloatType()))
    .add("associations", T.ArrayType(T.StringType()))
    .add("tags", T.ArrayType(T.StringType()))
)


def now(at: str = NOW) -> Column:
    return F.lit(at).cast("timestamp")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_memories(df: DataFrame, content: str = "content", at: str = NOW) -> DataFrame:
    """Memories of texts, with the defaults of a new one: working, neutral, accessed once, full strength."""
    have = set(df.columns)
    values = {
        "id": F.sha2(F.concat_ws("\x1f", F.col(content), F.lit(at)), 256),
        "content": F.col(content),
        "context": F.lit(None),
        "memory_type": F.lit("Working"),
        "emotion": F.lit("Neutral"),
        "created_at": now(at),
        "last_accessed": now(at),
        "access_count": F.lit(1),
        "strength": F.lit(1.0),
        "embedding": F.lit(None),
        "associations": F.array(),
        "tags": F.array(),
    }
    return df.select(*[(F.col(f.name) if f.name in have and f.name != "content" else values[f.name]).cast(f.dataType).alias(f.name) for f in MEMORY])


def document_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    i = F.col("doc_id")
    return d.select(
        i.cast("string").alias("id"),
        F.col("text").alias("content"),
        F.col("source").alias("context"),
        classify(F.col("text")).alias("memory_type"),
        F.element_at(F.array(*map(F.lit, EMOTIONS)), (i % 4 + 1).cast("int")).alias("emotion"),
        (now() - F.make_dt_interval(hours=(i * 13 % 1440).cast("int"))).alias("created_at"),
        (now() - F.make_dt_interval(hours=(i * 7 % 720).cast("int"), mins=(i % 60).cast("int"))).alias("last_accessed"),
        (1 + i % 9).cast("int").alias("access_count"),
        (F.lit(0.2) + F.lit(0.8) * (i * 37 % 100) / F.lit(100.0)).alias("strength"),
        F.array("lang", "source").alias("tags"),
    )


def vector_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, embedding, tags, strength, access_count and times of the embeddings table."""
    d = read(spark, sf_dir, "embeddings")
    i = F.col("vec_id")
    return d.select(
        i.cast("string").alias("id"),
        F.concat(F.lit("item "), i.cast("string")).alias("content"),
        "embedding",
        F.array(F.concat(F.lit("label"), F.col("label").cast("string"))).alias("tags"),
        (F.lit(0.2) + F.lit(0.8) * (i * 37 % 100) / F.lit(100.0)).alias("strength"),
        (1 + i % 9).cast("int").alias("access_count"),
        (now() - F.make_dt_interval(hours=(i * 13 % 1440).cast("int"))).alias("created_at"),
        (now() - F.make_dt_interval(hours=(i * 7 % 720).cast("int"))).alias("last_accessed"),
    )


def event_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as one sequence of memories for each user: type and parity of the value's tens as tags."""
    e = read(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").cast("string").alias("id"),
        F.col("user_id").alias("user_id"),
        F.col("ts").cast("timestamp").alias("created_at"),
        F.array("event_type", F.concat(F.lit("v"), (F.floor(F.col("value") / 10) % 2).cast("string"))).alias("tags"),
        F.col("event_type").alias("content"),
    )


def _classify_sql(c: str) -> str:
    has = lambda *w: " OR ".join(f"contains(lower({c}), '{x}')" for x in w)
    return f"""CASE WHEN (contains(lower({c}), 'when ') AND contains(lower({c}), ' then ')) OR {has("pattern:", "how to ", "always ", "never ")} THEN 'Procedural'
    WHEN {has(" is ", " are ", " means ", "definition:", "fact:")} THEN 'Semantic' ELSE 'Episodic' END"""


DERIVED_SQL = f"""
m AS (SELECT CAST(doc_id AS VARCHAR) AS id, text AS content, source AS context, {_classify_sql("text")} AS memory_type,
  ['Neutral', 'Positive', 'Negative', 'Surprise'][CAST(doc_id % 4 + 1 AS INTEGER)] AS emotion,
  TIMESTAMP '{NOW}' - to_hours(CAST(doc_id * 13 % 1440 AS INTEGER)) AS created_at,
  TIMESTAMP '{NOW}' - to_hours(CAST(doc_id * 7 % 720 AS INTEGER)) - to_minutes(CAST(doc_id % 60 AS INTEGER)) AS last_accessed,
  CAST(1 + doc_id % 9 AS INTEGER) AS access_count, CAST(0.2 AS DOUBLE) + CAST(0.8 AS DOUBLE) * (doc_id * 37 % 100) / CAST(100.0 AS DOUBLE) AS strength, [lang, source] AS tags FROM documents),
v AS (SELECT CAST(vec_id AS VARCHAR) AS id, 'item ' || vec_id AS content, CAST(embedding AS DOUBLE[]) AS embedding, ['label' || label] AS tags,
  CAST(0.2 AS DOUBLE) + CAST(0.8 AS DOUBLE) * (vec_id * 37 % 100) / CAST(100.0 AS DOUBLE) AS strength, CAST(1 + vec_id % 9 AS INTEGER) AS access_count,
  TIMESTAMP '{NOW}' - to_hours(CAST(vec_id * 13 % 1440 AS INTEGER)) AS created_at, TIMESTAMP '{NOW}' - to_hours(CAST(vec_id * 7 % 720 AS INTEGER)) AS last_accessed FROM embeddings),
e AS (SELECT CAST(event_id AS VARCHAR) AS id, user_id, CAST(ts AS TIMESTAMP) AS created_at, [event_type, 'v' || CAST(CAST(floor(value / 10) AS BIGINT) % 2 AS VARCHAR)] AS tags, event_type AS content FROM events)
"""
