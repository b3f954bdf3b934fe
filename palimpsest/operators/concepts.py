"""Concepts: named knowledge with a description, sources, a level of consolidation and relations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .embedding import hash_embed
from .retrieval import top_similar

CONCEPT = "id string, name string, description string, embedding array<float>, source_memories array<string>, created_at timestamp, updated_at timestamp, level double"
FIRST_LEVEL = 0.1


def store_knowledge(c: DataFrame, new: DataFrame, now: Column, dim: int = 256) -> DataFrame:
    """Concepts with new ones of (name, description, source_memories), each with a vector of its description and a low level; a name may come again."""
    x = new.select(F.sha2(F.concat_ws("\x1f", "name", "description", now.cast("string")), 256).alias("id"), "name", "description", "source_memories", now.alias("created_at"), now.alias("updated_at"), F.lit(FIRST_LEVEL).alias("level"))
    e = hash_embed(x.select("id", F.col("description").alias("content")), dim)
    return c.unionByName(x.join(e, "id").withColumn("embedding", F.col("embedding").cast("array<float>")).select(*c.columns))


def by_name(c: DataFrame) -> DataFrame:
    """One concept a name, the last that was stored."""
    w = Window.partitionBy("name").orderBy(F.desc("created_at"), F.desc("id"))
    return c.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def query(c: DataFrame, name: str) -> DataFrame:
    """The concept of exactly that name, the last that was stored."""
    return c.where(F.col("name") == name).orderBy(F.desc("created_at"), F.desc("id")).limit(1)


def knowledge(c: DataFrame, name: str) -> DataFrame:
    return query(c, name).select("description")


def search(c: DataFrame, k: int, text: str | None = None, vector: Sequence[float] | None = None) -> DataFrame:
    """(name, score): by a vector, the most similar; else concepts whose name or description holds the text, case counted, at 0.5."""
    if vector is not None:
        return top_similar(c, vector, k).select("name", F.col("similarity").alias("score"))
    hit = F.col("name").contains(text) | F.col("description").contains(text)
    return c.where(hit).orderBy("name", "id").limit(k).select("name", F.lit(0.5).alias("score"))


def strengthen(c: DataFrame, ids: DataFrame, by: float, now: Column) -> DataFrame:
    """Concepts of which some have their level raised, to 1 at most."""
    hit = ids.select(F.col(ids.columns[0]).alias("id"), F.lit(True).alias("__hit")).distinct()
    h = F.col("__hit").isNotNull()
    return c.join(hit, "id", "left").withColumn("level", F.when(h, F.least(F.lit(1.0), F.col("level") + by)).otherwise(F.col("level"))).withColumn("updated_at", F.when(h, now).otherwise(F.col("updated_at"))).drop("__hit")


def names(c: DataFrame) -> DataFrame:
    return c.select("id", "name", "level")
