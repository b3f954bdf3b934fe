"""Forgetting, reinforcement, sleep and consolidation as functions of DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring
from .graph import associate
from .mining import concept

FORGOTTEN = 0.1


def access(m: DataFrame, hit: Column, now: Column) -> DataFrame:
    """Memories with those that are hit accessed now: once more, and a tenth stronger."""
    return m.withColumns(
        {
            "strength": F.when(hit, F.least(F.lit(1.0), F.col("strength") + 0.1)).otherwise(F.col("strength")),
            "access_count": F.when(hit, F.col("access_count") + 1).otherwise(F.col("access_count")),
            "last_accessed": F.when(hit, now).otherwise(F.col("last_accessed")),
        }
    )


def _decay(now: Column) -> Column:
    return scoring.decay(F.col("strength"), F.col("access_count"), F.col("last_accessed"), F.col("created_at"), now)


def forget(m: DataFrame, now: Column, soft: bool = False) -> DataFrame:
    """Decays all strengths and drops what is forgotten; soft decay, of semantic memories, is half as strong."""
    d = _decay(now)
    return m.withColumn("strength", F.col("strength") * (d * 0.5 + 0.5 if soft else d)).where(F.col("strength") >= FORGOTTEN)


def decay_all(m: DataFrame, factor: float) -> DataFrame:
    return m.withColumn("strength", F.col("strength") * factor).where(F.col("strength") >= FORGOTTEN)


def fade(m: DataFrame, now: Column, rate: float, least: float = 0.01) -> DataFrame:
    """Exponential decay by hours since the last access, whatever the strength."""
    minutes = F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros("last_accessed") - (F.unix_micros(now) - F.unix_micros("last_accessed")) % 60_000_000) / 60_000_000)
    return m.withColumn("strength", F.col("strength") * F.exp(-minutes / 60 * rate)).where(F.col("strength") >= least)


def reinforce(m: DataFrame, ids: DataFrame, by: float, now: Column) -> DataFrame:
    hit = ids.select(F.col(ids.columns[0]).alias("id"), F.lit(True).alias("__hit")).distinct()
    x = m.join(hit, "id", "left")
    h = F.col("__hit").isNotNull()
    return x.withColumns({"strength": F.when(h, scoring.clamp(F.col("strength") + by, 0.0, 1.0)).otherwise(F.col("strength")), "access_count": F.when(h, F.col("access_count") + 1).otherwise(F.col("access_count")), "last_accessed": F.when(h, now).otherwise(F.col("last_accessed"))}).drop("__hit")


def visual_forget(v: DataFrame, rate: float) -> DataFrame:
    """(…, changed): strengths after linear decay, and whether that changed them."""
    s = scoring.visual_decay(F.col("strength"), F.col("valence"), F.col("recall_count"), rate)
    return v.withColumn("__new", s).withColumn("changed", F.abs(F.col("__new") - F.col("strength")) > 0.001).withColumn("strength", F.col("__new")).drop("__new")


def promoted(working: DataFrame, least: float = 0.7) -> DataFrame:
    """Important working memories, as the type that their content says."""
    from ..functions.text import classify

    return working.where(F.col("strength") >= least).withColumn("memory_type", classify(F.col("content")))


def sleep(m: DataFrame, working: DataFrame, now: Column) -> DataFrame:
    """Memories after a sleep: working memory's important items come in; episodic and semantic ones are forgotten by their curves; procedural ones keep."""
    episodic = forget(m.where("memory_type = 'Episodic'"), now)
    semantic = forget(m.where("memory_type = 'Semantic'"), now, soft=True)
    rest = m.where("memory_type = 'Procedural'")
    come = promoted(working).select(*m.columns)
    return episodic.unionByName(semantic).unionByName(rest).unionByName(come)


def consolidate(m: DataFrame, now: Column, threshold: float = 0.3, rate: float = 0.02) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(memories, links, concept): links of associated memories; those of strength 0.5 or more form a concept, if three at least, and get stronger; all fade."""
    links = associate(m, threshold)
    strong = m.where("strength >= 0.5")
    enough = strong.agg((F.count("*") >= 3).alias("enough"))
    name = concept(strong).crossJoin(enough).select(F.when(F.col("enough"), F.col("name")).alias("name"))
    ids = strong.select("id").crossJoin(F.broadcast(enough)).where("enough").select("id")
    return fade(reinforce(m, ids, 0.1, now), now, rate), links, name
