"""Procedural patterns, "when this, do that", with counts of success and failure.

A pattern is a memory whose content is its JSON; what isn't JSON of a pattern is
left as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring
from ..schema import NOW, new_memories
from .lifecycle import access
from .storage import contains_text

PATTERN = "trigger string, action string, success_count bigint, failure_count bigint, tags array<string>"
FIELDS = ("trigger", "action", "success_count", "failure_count", "tags")


def new_patterns(df: DataFrame) -> DataFrame:
    """Patterns of (trigger, action, and perhaps tags): one success, no failure."""
    tags = F.coalesce("tags", F.array().cast("array<string>")) if "tags" in df.columns else F.array().cast("array<string>")
    return df.select("trigger", "action", F.lit(1).cast("bigint").alias("success_count"), F.lit(0).cast("bigint").alias("failure_count"), tags.alias("tags"))


def parsed(content: Column) -> Column:
    """The pattern in a content; null if it is none."""
    p = F.from_json(content, PATTERN)
    return F.when(p["trigger"].isNotNull() & p["action"].isNotNull(), p)


def success(p: Column) -> Column:
    return p.withField("success_count", p["success_count"] + 1)


def failure(p: Column) -> Column:
    return p.withField("failure_count", p["failure_count"] + 1)


def confidence(p: Column) -> Column:
    return scoring.confidence(p["success_count"], p["failure_count"])


def learn(m: DataFrame, patterns: DataFrame, at: str = NOW) -> DataFrame:
    """Memories with new ones for patterns (trigger, action, success_count, failure_count, tags); tags are copied, nothing is looked up."""
    new = patterns.select(F.to_json(F.struct(*FIELDS)).alias("content"), "tags", F.lit("Procedural").alias("memory_type"))
    return m.unionByName(new_memories(new, at=at), allowMissingColumns=True)


def feedback(m: DataFrame, outcomes: DataFrame, now: Column) -> DataFrame:
    """Memories after outcomes (trigger, success): each counts for the strongest procedural memory that holds its trigger, if that is a pattern, and accesses it.

    Outcomes of one trigger are counted together; the triggers are few and known to each task.
    """
    told = outcomes.groupBy("trigger").agg(F.count_if(F.col("success")).alias("__s"), F.count_if(~F.col("success")).alias("__f"))
    triggers = [r["trigger"] for r in told.select("trigger").collect()]
    if not triggers:
        return m
    own = m.where("memory_type = 'Procedural'")
    holds = F.filter(F.array(*[F.when(contains_text(t), F.lit(t)) for t in triggers]), lambda t: t.isNotNull())
    hits = own.select("id", "strength", F.explode(holds).alias("trigger"))
    best = hits.withColumn("__r", F.row_number().over(Window.partitionBy("trigger").orderBy(F.desc("strength"), "id"))).where("__r = 1")
    add = best.join(told, "trigger").groupBy("id").agg(F.sum("__s").alias("__s"), F.sum("__f").alias("__f"))
    x = m.join(F.broadcast(add), "id", "left").withColumn("__p", parsed(F.col("content")))  # one row a trigger at most
    hit = F.col("__s").isNotNull() & F.col("__p").isNotNull()
    p = F.col("__p")
    p = p.withField("success_count", p["success_count"] + F.col("__s")).withField("failure_count", p["failure_count"] + F.col("__f"))
    n = F.when(hit, F.col("__s") + F.col("__f")).otherwise(0)
    changed = x.withColumn("content", F.when(hit, F.to_json(F.struct(*[p[f].alias(f) for f in FIELDS]))).otherwise(F.col("content"))).withColumn("__n", n)
    # an access for each outcome: the first by the rule, the others on top
    once = access(changed, F.col("__n") > 0, now)
    more = F.greatest(F.lit(0), F.col("__n") - 1)
    return once.withColumn("strength", F.when(more > 0, F.least(F.lit(1.0), F.col("strength") + 0.1 * more)).otherwise(F.col("strength"))).withColumn("access_count", (F.col("access_count") + more).cast(m.schema["access_count"].dataType)).drop("__s", "__f", "__p", "__n")
