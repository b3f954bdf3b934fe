"""Memories of images: a path, a vector from a model that the caller gives, feelings, recalls and links."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scoring import clamp
from ..schema import NOW, now
from . import ann
from .retrieval import top_similar
from .storage import associate

CONTEXT = T.StructType().add("people", T.ArrayType(T.StringType())).add("location", "string").add("activity", "string").add("source", "string")
SOURCES = ("Camera", "Screenshot", "Downloaded", "Received", "Generated", "Unknown")
VISUAL = (
    T.StructType()
    .add("id", "string")
    .add("image_path", "string")
    .add("embedding", T.ArrayType(T.FloatType()))
    .add("description", "string")
    .add("context", CONTEXT)
    .add("tags", T.ArrayType(T.StringType()))
    .add("valence", "double")
    .add("strength", "double")
    .add("recall_count", "integer")
    .add("created_at", "timestamp")
    .add("last_accessed", "timestamp")
    .add("linked_memories", T.ArrayType(T.StringType()))
    .add("linked_visuals", T.ArrayType(T.StringType()))
)


def valence(x: Column) -> Column:
    """A feeling from -1 to 1."""
    return clamp(x, -1.0, 1.0)


def new_visuals(df: DataFrame, at: str = NOW) -> DataFrame:
    """Visual memories of (image_path, embedding, description), with defaults for what isn't there."""
    have = set(df.columns)
    none = F.array().cast("array<string>")
    values = {
        "id": F.sha2(F.concat_ws("\x1f", F.col("image_path"), F.lit(at)), 256),
        "context": F.struct(none.alias("people"), F.lit(None).cast("string").alias("location"), F.lit(None).cast("string").alias("activity"), F.lit("Unknown").alias("source")),
        "tags": none,
        "valence": F.lit(0.0),
        "strength": F.lit(1.0),
        "recall_count": F.lit(0),
        "created_at": now(at),
        "last_accessed": now(at),
        "linked_memories": none,
        "linked_visuals": none,
    }
    out = df.select(*[(F.col(f.name) if f.name in have else values[f.name]).cast(f.dataType).alias(f.name) for f in VISUAL])
    return out.withColumn("valence", valence(F.coalesce("valence", F.lit(0.0))))


def recalled(v: DataFrame, hit: Column, at: Column) -> DataFrame:
    """Visual memories with those that are hit recalled now: once more, and a tenth stronger."""
    return v.withColumns(
        {
            "recall_count": F.when(hit, F.col("recall_count") + 1).otherwise(F.col("recall_count")),
            "last_accessed": F.when(hit, at).otherwise(F.col("last_accessed")),
            "strength": F.when(hit, F.least(F.lit(1.0), F.col("strength") + 0.1)).otherwise(F.col("strength")),
        }
    )


def link_memories(v: DataFrame, pairs: DataFrame) -> DataFrame:
    """Links (from_id, to_id) to text memories, each once."""
    return associate(v, pairs, "linked_memories")


def link_visuals(v: DataFrame, pairs: DataFrame) -> DataFrame:
    return associate(v, pairs, "linked_visuals")


def store_images(v: DataFrame, images: DataFrame, embed: Callable[[Column], Column], at: str = NOW, near: int = 5, least: float = 0.7, probes: int = 8, lists: int | None = None) -> DataFrame:
    """Visual memories with new ones of (image_path, description, ...): each gets a vector of its path and is linked to those of its `near` most similar (itself among them) that are above `least`."""
    new = new_visuals(images.withColumn("embedding", embed(F.col("image_path"))), at)
    both = v.unionByName(new)
    index = ann.build(both.select("id", "embedding"), lists)
    found = ann.search_all(index, new.select(F.col("id").alias("query_id"), "embedding"), near, probes)
    pairs = found.where((F.col("query_id") != F.col("id")) & (F.col("similarity") > least)).select(F.col("query_id").alias("from_id"), F.col("id").alias("to_id"))
    return v.unionByName(link_visuals(new, pairs).select(*v.columns))


def store_captioned(v: DataFrame, images: DataFrame, caption: Callable[[Column], Column], embed: Callable[[Column], Column], **how) -> DataFrame:
    """The same, with descriptions by a model that the caller gives."""
    return store_images(v, images.withColumn("description", caption(F.col("image_path"))), embed, **how)


def search(v: DataFrame, query: Sequence[float], limit: int) -> DataFrame:
    """The most similar images to a vector of a text or an image; there is no threshold."""
    return top_similar(v, query, limit)


def search_by(v: DataFrame, what: str, embed: Callable[[Column], Column], limit: int) -> DataFrame:
    """By a text, or the path of an image, and the model that makes vectors of such."""
    one = v.sparkSession.range(1).select(embed(F.lit(what)).alias("e")).first()["e"]
    return search(v, one, limit)


def encode_rows(v: DataFrame) -> DataFrame:
    """Rows of text, as a store without types keeps them."""
    js = [c for c in ("embedding", "context", "tags", "linked_memories", "linked_visuals")]
    return v.select(*[(F.to_json(c) if c in js else F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'") if c in ("created_at", "last_accessed") else F.col(c).cast("string")).alias(c) for c in VISUAL.names])


def decode_rows(rows: DataFrame) -> DataFrame:
    """Visual memories of such rows; those that can't be read are left out."""
    c = F.col
    lists = lambda x: F.coalesce(F.from_json(x, "array<string>"), F.array().cast("array<string>"))
    out = rows.select(
        "id",
        "image_path",
        F.from_json("embedding", "array<float>").alias("embedding"),
        F.coalesce("description", F.lit("")).alias("description"),
        F.from_json("context", CONTEXT).alias("context"),
        lists("tags").alias("tags"),
        F.coalesce(c("valence").try_cast("double"), F.lit(0.0)).alias("valence"),
        F.coalesce(c("strength").try_cast("double"), F.lit(1.0)).alias("strength"),
        F.coalesce(c("recall_count").try_cast("int"), F.lit(0)).alias("recall_count"),
        F.try_to_timestamp("created_at").alias("created_at"),
        F.try_to_timestamp("last_accessed").alias("last_accessed"),
        lists("linked_memories").alias("linked_memories"),
        lists("linked_visuals").alias("linked_visuals"),
    )
    return out.where("id is not null and image_path is not null and embedding is not null")
