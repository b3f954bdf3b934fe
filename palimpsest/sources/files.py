"""Importing and exporting memories: JSON, CSV, Markdown, plain text, Parquet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import MEMORY, NOW, new_memories

LEAST_BYTES = 3


def _kept(df: DataFrame) -> DataFrame:
    return df.withColumn("content", F.trim("content")).where(F.octet_length("content") >= LEAST_BYTES)


def _tagged(df: DataFrame, tags: Sequence[str], kind: str, at: str) -> DataFrame:
    extra = F.array(*map(F.lit, tags)).cast("array<string>")
    own = F.coalesce("tags", F.array().cast("array<string>")) if "tags" in df.columns else F.array().cast("array<string>")
    return new_memories(df.withColumn("tags", F.concat(own, extra)).withColumn("memory_type", F.coalesce("memory_type", F.lit(kind)) if "memory_type" in df.columns else F.lit(kind)), at=at)


def read_lines(spark: SparkSession, path: str, tags: Sequence[str] = (), kind: str = "Semantic", at: str = NOW, separator: str | None = None, least: int = LEAST_BYTES) -> DataFrame:
    """A memory a line, blank and very short ones left out; `separator` divides Markdown by empty lines."""
    lines = spark.read.option("lineSep", separator).text(path) if separator else spark.read.text(path)
    return memories_of_lines(lines, tags, kind, at, least)


def memories_of_lines(lines: DataFrame, tags: Sequence[str] = (), kind: str = "Semantic", at: str = NOW, least: int = LEAST_BYTES) -> DataFrame:
    """Memories of a table of lines (value)."""
    x = lines.select(F.trim(F.regexp_replace("value", r"^\s+|\s+$", "")).alias("content")).where(F.octet_length("content") >= least)
    return _tagged(x, tags, kind, at)


def read_batch(spark: SparkSession, path: str, tags: Sequence[str] = (), at: str = NOW) -> DataFrame:
    """A semantic memory a line; blank lines are left out."""
    return read_lines(spark, path, tags, "Semantic", at, least=1)


def read_markdown(spark: SparkSession, path: str, tags: Sequence[str] = (), kind: str = "Semantic", at: str = NOW) -> DataFrame:
    return read_lines(spark, path, tags, kind, at, "\n\n")


def read_json(spark: SparkSession, path: str, tags: Sequence[str] = (), kind: str = "Semantic", at: str = NOW) -> DataFrame:
    """Arrays of memories, whole or of content, tags and context alone; lines of single objects are read too."""
    raw = spark.read.schema(MEMORY).option("multiLine", True).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][XXX]").json(path)
    full = raw.where("content is not null")
    return _tagged(_kept(full.select("content", "tags", "context", *[F.coalesce(c, v).alias(c) for c, v in (("id", F.sha2("content", 256)), ("memory_type", F.lit(kind)), ("emotion", F.lit("Neutral")), ("created_at", F.lit(at).cast("timestamp")), ("last_accessed", F.lit(at).cast("timestamp")), ("access_count", F.lit(1)), ("strength", F.lit(1.0)))], "embedding", F.coalesce("associations", F.array().cast("array<string>")).alias("associations"))), tags, kind, at)


def read_csv(spark: SparkSession, path: str, tags: Sequence[str] = (), kind: str = "Semantic", at: str = NOW) -> DataFrame:
    """content[,tags]: the content may stand in quotes; tags are divided by commas or semicolons; a first line that names content or text is a header."""
    lines = spark.read.text(path, wholetext=True).select(F.split("value", r"\r?\n").alias("l"))
    body = F.when(F.lower(F.element_at("l", 1)).rlike("content|text"), F.slice("l", 2, F.size("l"))).otherwise(F.col("l"))
    return _tagged(csv_rows(lines.select(F.explode(body).alias("value"))), tags, kind, at)


def csv_rows(lines: DataFrame, value: str = "value") -> DataFrame:
    """(content, tags) of lines."""
    v = F.trim(F.col(value))
    quoted = v.startswith('"')
    content = F.when(quoted, F.regexp_extract(v, r'^"([^"]*)"', 1)).otherwise(F.regexp_extract(v, r"^([^,]*)", 1))
    rest = F.when(quoted, F.regexp_extract(v, r'^"[^"]*",?(.*)$', 1)).otherwise(F.regexp_extract(v, r"^[^,]*,?(.*)$", 1))
    tags = F.filter(F.transform(F.split(F.regexp_replace(rest, '"', ""), "[,;]"), lambda t: F.trim(t)), lambda t: t != "")
    return _kept(lines.select(content.alias("content"), tags.alias("tags")))


def read_any(spark: SparkSession, path: str, **how) -> DataFrame:
    """By the file's extension."""
    kind = path.rsplit(".", 1)[-1].lower()
    return {"json": read_json, "csv": read_csv, "md": read_markdown}.get(kind, read_lines)(spark, path, **how)


def export(m: DataFrame, limit: int | None = None, procedural: bool = True) -> DataFrame:
    """What is exported: semantic, episodic and (unless not wanted) procedural memories; with a limit, the strongest semantic, newest episodic and strongest procedural ones."""
    from ..operators.retrieval import list_memories

    if limit is None:
        return m.where(F.col("memory_type").isin("Semantic", "Episodic", *(["Procedural"] if procedural else [])))
    return list_memories(m, limit, procedural)


def write_json(m: DataFrame, path: str) -> None:
    m.write.mode("overwrite").json(path)


def merge_records(old: DataFrame, new: DataFrame) -> DataFrame:
    """Photo records by uuid; new ones replace old ones."""
    from ..operators.storage import upsert

    return upsert(old, new, ("uuid",))


def photo_stats(p: DataFrame) -> DataFrame:
    row = p.agg(F.count("*").alias("photos"), F.count("location").alias("located"), F.count_if(F.size("persons") > 0).alias("with_people"), F.count_if("favorite").alias("favorites"))
    for c in ("persons", "keywords", "albums"):
        row = row.crossJoin(p.select(F.explode(c).alias("x")).agg(F.count_distinct("x").alias(c)))
    return row


def albums(p: DataFrame) -> DataFrame:
    return p.select(F.explode("albums").alias("album")).groupBy("album").agg(F.count("*").alias("photos")).orderBy("album")


def push(m: DataFrame, known: DataFrame, send) -> DataFrame:
    """(id, sent): memories whose id a remote store (id) lacks go to `send`, a function of a list of dictionaries that returns how each fared; batches leave from the tasks."""
    import pyarrow as pa

    new = m.join(known.select("id"), "id", "left_anti").select("id", "content", "tags", "memory_type", "strength", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"))

    def kernel(batches):
        for b in batches:
            done = send(b.to_pylist()) if b.num_rows else []
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([bool(x) for x in done], pa.bool_())], names=["id", "sent"])

    return new.mapInArrow(kernel, "id string, sent boolean")


def pull(rows: DataFrame, m: DataFrame, tag: str = "synced", at: str = NOW) -> DataFrame:
    """Memories of a remote store's rows (content, tags, ...) that `m` has no equal content of, tagged with where they come from."""
    new = rows.join(m.select("content"), "content", "left_anti")
    return _tagged(_kept(new), (tag,), "Semantic", at)
