"""Notes of an assistant: typed, with a source, a channel and an importance from 1 to 5, kept as semantic memories.

Their tags say type and importance; PREFIX names the assistant in them and is a parameter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import clamp
from ..schema import NOW, new_memories
from .embedding import hash_embed
from .retrieval import top_similar
from .storage import by_tag

PREFIX = "note"
KINDS = ("conversation", "learning", "project", "decision", "lesson", "preference", "task")
#: The sign of each kind, which becomes the memory's context.
SIGNS = dict(zip(KINDS, ("💬", "📚", "🔧", "⚖️", "💡", "❤️", "📋")))


def note(df: DataFrame, kind: str | Column, importance: int = 3, source: str = "manual", channel: str | Column | None = None, tags: Sequence[str] = ()) -> DataFrame:
    """(id, content, kind, source, channel, importance, tags) of (content, and perhaps id and tags)."""
    own = F.array(*map(F.lit, tags)).cast("array<string>")
    have = F.coalesce("tags", own) if "tags" in df.columns else own
    key = F.col("id") if "id" in df.columns else F.sha2(F.concat_ws("\x1f", "content", kind if isinstance(kind, Column) else F.lit(kind)), 256)
    return df.select(
        key.alias("id"),
        "content",
        (kind if isinstance(kind, Column) else F.lit(kind)).alias("kind"),
        F.lit(source).alias("source"),
        (channel if isinstance(channel, Column) else F.lit(channel).cast("string")).alias("channel"),
        F.lit(importance).alias("importance"),
        have.alias("tags"),
    )


def conversation(df: DataFrame, channel: str | Column) -> DataFrame:
    return note(df, "conversation", source="chat", channel=channel)


def learning(df: DataFrame) -> DataFrame:
    return note(df, "learning", 4)


def preference(df: DataFrame, owner: str) -> DataFrame:
    """Tagged with whose preference it is."""
    return note(df, "preference", 5, tags=(owner,))


def lesson(df: DataFrame) -> DataFrame:
    return note(df, "lesson", 5)


def project(df: DataFrame) -> DataFrame:
    """Of (name, details): the content names the project, and so does the tag, in lower case."""
    x = df.withColumn("content", F.concat(F.col("name"), F.lit(": "), F.col("details"))).withColumn("tags", F.array(F.lower("name")))
    return note(x, "project")


def with_importance(notes: DataFrame, importance: Column) -> DataFrame:
    return notes.withColumn("importance", clamp(importance, 1, 5).cast("int"))


def remember(m: DataFrame, notes: DataFrame, at: str = NOW, dim: int = 256, prefix: str = PREFIX) -> DataFrame:
    """Memories with the notes as semantic ones: their tags, type and importance as tags, and a vector."""
    sign = F.element_at(F.create_map(*[F.lit(x) for pair in SIGNS.items() for x in pair]), F.col("kind"))
    tags = F.concat("tags", F.array(F.lower(F.concat(F.lit(f"{prefix}:"), F.col("kind"))), F.concat(F.lit("importance:"), F.col("importance").cast("string"))))
    new = new_memories(notes.select("id", "content", sign.alias("context"), tags.alias("tags"), F.lit("Semantic").alias("memory_type")), at=at)
    made = new.drop("embedding").join(hash_embed(new, dim), "id", "left").withColumn("embedding", F.col("embedding").cast("array<float>"))
    return m.unionByName(made.select(*new.columns), allowMissingColumns=True)


def by_kind(m: DataFrame, kind: str, prefix: str = PREFIX) -> DataFrame:
    """All notes of a kind, the strongest first."""
    return by_tag(m, f"{prefix}:{kind}")


def preferences(m: DataFrame, prefix: str = PREFIX) -> DataFrame:
    return by_kind(m, "preference", prefix)


def lessons(m: DataFrame, prefix: str = PREFIX) -> DataFrame:
    return by_kind(m, "lesson", prefix)


def fast_recall(m: DataFrame, query: Sequence[float], limit: int) -> DataFrame:
    """Ids and similarities alone."""
    return top_similar(m, query, limit).select("id", "similarity")
