"""Operators over sequences of memories in time; `by` names the columns of independent sequences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tag_similarity
from ..functions.vectors import cosine


#: Seconds of a stretch of time that one task sorts, for one sequence without `by`.  Stretches hold the rows of an hour; only their ends meet in one place.
STRETCH = 3600


def _window(by: Sequence[str]):
    return Window.partitionBy(*by).orderBy("created_at", "id")


def _stretches(m: DataFrame) -> DataFrame:
    return m.withColumn("__t", F.floor(F.unix_micros("created_at") / (STRETCH * 1_000_000)))


def _ends(cut: DataFrame, value: Column, back: bool) -> DataFrame:
    """(__t, __far): for each stretch the value of the last row of the stretch before, or of the first row of the one after."""
    key = F.struct("created_at", "id")
    end = cut.groupBy("__t").agg((F.max_by if back else F.min_by)(value, key).alias("__end"))
    # one row a stretch
    w = Window.partitionBy(F.lit(0)).orderBy("__t")
    return end.select("__t", (F.lag if back else F.lead)("__end").over(w).alias("__far"))


def neighbour(m: DataFrame, value: Column, to: str, by: Sequence[str] = (), back: bool = True) -> DataFrame:
    """Memories with the value of the one before (after, if not `back`) in their sequence; in one without `by`, time is cut into stretches that are sorted apart."""
    step = F.lag if back else F.lead
    if by:
        return m.withColumn(to, step(value).over(_window(by)))
    cut = _stretches(m)
    near = cut.withColumn("__near", step(value).over(Window.partitionBy("__t").orderBy("created_at", "id")))
    return near.join(_ends(cut, value, back), "__t", "left").withColumn(to, F.coalesce("__near", "__far")).drop("__t", "__near", "__far")


def links(m: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Neighbours in time: (*by, from_id, to_id, at, gap_seconds, cos, tags_alike); cos is null without both embeddings."""
    vector = "embedding" in m.columns
    s = F.struct("id", "created_at", "tags", *(["embedding"] if vector else []))
    p = neighbour(m, s, "__prev", by).where("__prev is not null")
    sim = F.when(F.col("embedding").isNotNull() & F.col("__prev.embedding").isNotNull(), cosine(F.col("__prev.embedding"), F.col("embedding"))) if vector else F.lit(None).cast("double")
    gap = F.expr("(unix_micros(created_at) - unix_micros(__prev.created_at)) div 1000000")
    return p.select(*by, F.col("__prev.id").alias("from_id"), F.col("id").alias("to_id"), F.col("created_at").alias("at"), gap.alias("gap_seconds"), sim.alias("cos"), tag_similarity(F.col("__prev.tags"), F.col("tags")).alias("tags_alike"))


def replay(m: DataFrame, now: Column, hours: int, by: Sequence[str] = ()) -> DataFrame:
    """Replay of the memories of the last hours: the strength of each link, what it adds to the earlier memory, and whether it is a new connection."""
    x = links(m.where(F.col("created_at") > now - F.make_dt_interval(hours=F.lit(hours))), by)
    cos = F.coalesce("cos", F.lit(0.0))
    s = F.lit(0.4) / (1 + F.abs("gap_seconds") / 3600.0) + 0.4 * cos + 0.2 * F.col("tags_alike")
    return x.withColumn("replay_strength", s).where("replay_strength > 0.2").select(*by, "from_id", "to_id", "replay_strength", (F.col("replay_strength") * 0.05).alias("boost"), ((cos > 0.5) & (F.col("tags_alike") < 0.3)).alias("new_connection"))


def replayed(m: DataFrame, boosts: DataFrame) -> DataFrame:
    """Memories with what the replay added to them."""
    add = boosts.groupBy(F.col("from_id").alias("id")).agg(F.sum("boost").alias("__boost"))
    return m.join(add, "id", "left").withColumn("strength", F.least(F.lit(1.0), F.col("strength") + F.coalesce("__boost", F.lit(0.0)))).drop("__boost")


def chains(m: DataFrame, max_gap_minutes: int, by: Sequence[str] = ()) -> DataFrame:
    """Links with the number of their chain; a link over too long a gap is the first of a new chain."""
    broken = links(m, by).withColumn("__break", F.when(F.expr("gap_seconds div 60") > max_gap_minutes, 1).otherwise(0))
    if by:
        w = Window.partitionBy(*by).orderBy("at", "to_id").rowsBetween(Window.unboundedPreceding, 0)
        x = broken.withColumn("__chain", F.sum("__break").over(w))
    else:
        cut = broken.withColumn("__t", F.floor(F.unix_micros("at") / (STRETCH * 1_000_000)))
        w = Window.partitionBy(F.lit(0)).orderBy("__t").rowsBetween(Window.unboundedPreceding, -1)
        before = cut.groupBy("__t").agg(F.sum("__break").alias("n")).select("__t", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("__before"))
        w = Window.partitionBy("__t").orderBy("at", "to_id").rowsBetween(Window.unboundedPreceding, 0)
        x = cut.withColumn("__in", F.sum("__break").over(w)).join(before, "__t").withColumn("__chain", F.col("__in") + F.col("__before"))
    return x.select(*by, F.col("__chain").cast("bigint").alias("chain"), "from_id", "to_id", "gap_seconds", F.coalesce("cos", "tags_alike").alias("similarity"))


def context(m: DataFrame, key: str, width: int, by: Sequence[str] = ()) -> DataFrame:
    """The memories up to `width` places before and after one in its sequence; the best few on either side are taken, nothing is sorted whole."""
    at = m.where(F.col("id") == key).select(*by, F.struct("created_at", "id").alias("__at"))
    own = m.select(*by, "id", F.struct("created_at", "id").alias("__k"))
    near = own.join(F.broadcast(at), list(by)) if by else own.crossJoin(F.broadcast(at))
    before = near.where(F.col("__k") < F.col("__at"))
    pos = at.crossJoin(before.agg(F.count("*").alias("__n")))
    first = before.orderBy(F.desc("__k")).limit(width)
    rest = near.where(F.col("__k") >= F.col("__at")).orderBy("__k").limit(width + 1)
    few = first.unionByName(rest)
    first_pos = F.greatest(F.lit(0), F.col("__n") - width)
    w = Window.partitionBy(F.lit(0)).orderBy("__k")
    return few.crossJoin(F.broadcast(pos.select("__n"))).select(*by, "id", (F.row_number().over(w) + first_pos).cast("int").alias("pos"))


def working(m: DataFrame, by: Sequence[str] = (), capacity: int = 7) -> DataFrame:
    """The newest memories of each sequence, as working memory holds them; pos 1 is the newest."""
    order = F.desc("created_at"), F.desc("id")
    if not by:
        few = m.orderBy(*order).limit(capacity).withColumn("pos", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))
    else:
        few = m.withColumn("pos", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("pos") <= capacity)
    return few.withColumn("memory_type", F.lit("Working"))


def last(m: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return working(m, by, 1)


def restore(w: DataFrame, rows: DataFrame, capacity: int = 100) -> DataFrame:
    """Working memory (pos 1 is the newest) after restored rows are put in behind its oldest, in the order of their times; what is too many goes from the newest end."""
    n = w.agg(F.coalesce(F.max("pos"), F.lit(0)).alias("__n"))
    numbered = rows.withColumn("__k", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("created_at", "id")))
    back = numbered.crossJoin(F.broadcast(n)).withColumn("pos", F.col("__k") + F.col("__n")).drop("__k", "__n")
    both = w.unionByName(back, allowMissingColumns=True)
    over = both.agg(F.greatest(F.lit(0), F.max("pos") - capacity).alias("__over"))
    return both.crossJoin(F.broadcast(over)).where(F.col("pos") > F.col("__over")).withColumn("pos", (F.col("pos") - F.col("__over")).cast("int")).drop("__over")


def rehearse(w: DataFrame, content: str, now: Column) -> DataFrame:
    """Accesses the memories that hold the content."""
    hit = F.col("content").contains(content)
    return w.withColumns(
        {
            "strength": F.when(hit, F.least(F.lit(1.0), F.col("strength") + 0.1)).otherwise(F.col("strength")),
            "access_count": F.when(hit, F.col("access_count") + 1).otherwise(F.col("access_count")),
            "last_accessed": F.when(hit, now).otherwise(F.col("last_accessed")),
        }
    )


def snapshot(m: DataFrame, at: Column) -> DataFrame:
    kinds = {"episodic": "Episodic", "semantic": "Semantic", "procedural": "Procedural"}
    return m.agg(*[F.count_if(F.col("memory_type") == t).alias(k) for k, t in kinds.items()]).withColumn("at", at)


def snapshot_changes(s: DataFrame) -> DataFrame:
    """What each snapshot has more than the one before."""
    w = Window.partitionBy(F.lit(0)).orderBy("at")
    return s.select("at", *[(F.col(c) - F.lag(c, 1, 0).over(w)).alias(c) for c in s.columns if c != "at"])
