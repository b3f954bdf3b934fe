"""A library of memories on shared storage, with the operators as its methods.

Each change writes a new version of the table beside the old one; readers take
the newest version that was written to its end, so a lost job leaves the library
as it was.  Links are a table of their own, the log is appended to.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import benchmarks
from .functions.text import classify
from .operators import concepts, embedding, graph, ingest, lifecycle, mining, notes, patterns, retrieval, sequence, storage
from .schema import MEMORY, NOW, new_memories, now
from .sources import files

LINKS = "from_id string, to_id string, relation string, weight double"


class Library:
    def __init__(self, spark: SparkSession, path: str, dim: int = 256, keep: int = 2):
        self.spark, self.path, self.dim, self.keep = spark, path.rstrip("/"), dim, keep

    # Versions

    def _folder(self, name: str):
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _versions(self, name: str) -> list[int]:
        fs, at = self._folder(name)
        if not fs.exists(at):
            return []
        done = [s.getPath().getName() for s in fs.listStatus(at) if fs.exists(s.getPath().suffix("/_SUCCESS"))]
        return sorted(int(v) for v in done if v.isdigit())

    def _read(self, name: str, schema) -> DataFrame:
        v = self._versions(name)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}/{v[-1]}") if v else self.spark.createDataFrame([], schema)

    def _write(self, name: str, df: DataFrame) -> None:
        old = self._versions(name)
        df.write.parquet(f"{self.path}/{name}/{(old[-1] if old else 0) + 1}")
        fs, at = self._folder(name)
        for v in old[: max(0, len(old) + 1 - self.keep)]:
            fs.delete(at.suffix(f"/{v}"), True)

    @property
    def memories(self) -> DataFrame:
        return self._read("memories", MEMORY)

    @property
    def links(self) -> DataFrame:
        return self._read("links", LINKS)

    @property
    def concepts(self) -> DataFrame:
        return self._read("concepts", concepts.CONCEPT)

    def replace(self, m: DataFrame) -> None:
        self._write("memories", m.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in MEMORY]))

    # Storing

    def _embedded(self, m: DataFrame) -> DataFrame:
        return m.drop("embedding").join(embedding.hash_embed(m, self.dim), "id", "left").withColumn("embedding", F.col("embedding").cast("array<float>")).select(*MEMORY.names)

    def vector(self, text: str) -> list[float]:
        q = self.spark.createDataFrame([("q", text)], "id string, content string")
        return embedding.hash_embed(q, self.dim).first()["embedding"]

    def add(self, new: DataFrame) -> None:
        """Memories of any columns of the model; types are classified, vectors are made."""
        m = new_memories(new) if set(MEMORY.names) - set(new.columns) else new
        m = m.withColumn("memory_type", F.when(F.col("memory_type") == "Working", classify(F.col("content"))).otherwise(F.col("memory_type")))
        self.replace(storage.upsert(self.memories, self._embedded(m)))

    def store(self, content: str, tags: Sequence[str] = (), context: str | None = None, at: str = NOW) -> None:
        self.add(new_memories(self.spark.createDataFrame([(content, list(tags), context)], "content string, tags array<string>, context string"), at=at))

    def load(self, path: str, **how) -> None:
        self.add(files.read_any(self.spark, path, **how))

    def export(self, path: str) -> None:
        files.write_json(files.export(self.memories), path)

    def delete(self, prefix: str) -> None:
        self.replace(storage.delete_prefix(self.memories, prefix))

    def link(self, pairs: DataFrame) -> None:
        self._write("links", storage.insert_links(self.links, pairs.select("from_id", "to_id", "relation", F.col("weight").cast("double").alias("weight"))))

    def process(self, new: DataFrame, at: str = NOW) -> None:
        """New memories of (content, ...), with associations to what is like them."""
        self.replace(ingest.process(self.memories, new, at, dim=self.dim))

    def store_with_importance(self, new: DataFrame, at: str = NOW) -> DataFrame:
        """The same of (content, tags, valence), with their importance as strength; returns the scores."""
        score = ingest.importance(self.memories, new)
        done = score.collect()
        self.replace(ingest.store_with_importance(self.memories, new, at, dim=self.dim))
        return self.spark.createDataFrame(done, score.schema)

    def remember(self, new: DataFrame, at: str = NOW, prefix: str = notes.PREFIX) -> None:
        self.replace(notes.remember(self.memories, new, at, self.dim, prefix))

    def learn(self, trigger: str, action: str, at: str = NOW) -> None:
        p = patterns.new_patterns(self.spark.createDataFrame([(trigger, action)], "trigger string, action string"))
        self.replace(patterns.learn(self.memories, p, at))

    def feedback(self, trigger: str, success: bool, at: str = NOW) -> None:
        self.replace(patterns.feedback(self.memories, self.spark.createDataFrame([(trigger, success)], "trigger string, success boolean"), now(at)))

    def know(self, name: str, description: str, sources: Sequence[str] = (), at: str = NOW) -> None:
        new = self.spark.createDataFrame([(name, description, list(sources))], "name string, description string, source_memories array<string>")
        self._write("concepts", concepts.store_knowledge(self.concepts, new, now(at), self.dim))

    def knowledge(self, name: str) -> DataFrame:
        return concepts.knowledge(self.concepts, name)

    # Audit

    def log(self, op: str, content: str, tags: Sequence[str] = (), result: str = "ok", at: str = NOW) -> None:
        """A line of the log; lines are only appended."""
        row = self.spark.createDataFrame([(op, content, list(tags), result)], "op string, content string, tags array<string>, result string")
        row.select(mining.audit_line(now(at), F.col("op"), F.col("content"), F.col("tags"), F.col("result")).alias("value")).coalesce(1).write.mode("append").text(f"{self.path}/log")

    @property
    def audit(self) -> DataFrame:
        fs, at = self._folder("log")
        lines = self.spark.read.text(f"{self.path}/log") if fs.exists(at) else self.spark.createDataFrame([], "value string")
        return mining.parse_audit(lines)

    def watch(self, folder: str, tags: Sequence[str] = (), every: str | None = None):
        from .streaming import jobs

        return jobs.watch(self.spark, folder, self.add, f"{self.path}/watched", tuple(tags), every)

    # Asking

    def recall(self, query: str, limit: int = 10, at: str = NOW, **filters) -> DataFrame:
        found = retrieval.recall(self.memories, query, now(at), limit * 10 if filters else limit, self.vector(query))
        return retrieval.filtered(found, limit, **filters, by=[F.desc("score"), F.col("id")]) if filters else found

    def search(self, query: str, limit: int = 10, threshold: float = 0.05) -> DataFrame:
        return retrieval.semantic_search(self.memories, self.vector(query), limit, threshold)

    def list(self, n: int = 10) -> DataFrame:
        return retrieval.list_memories(self.memories, n)

    def show(self, prefix: str) -> DataFrame:
        return retrieval.show(self.memories, self.links, prefix)

    def predict(self, hour: int, limit: int = 5) -> DataFrame:
        return mining.predictions(self.memories, hour, limit)

    def alerts(self, limit: int = 10, at: str = NOW) -> DataFrame:
        return mining.alerts(self.memories, now(at), limit)

    def patterns(self) -> DataFrame:
        return mining.discover(self.memories)

    def stats(self) -> DataFrame:
        return mining.store_stats(self.memories)

    def counts(self) -> DataFrame:
        return mining.totals(self.memories, self.memories.where("memory_type = 'Working'"))

    def rebuild(self, limit: int | None = None) -> DataFrame:
        return retrieval.rebuild(self.memories, limit)

    def timeline(self) -> DataFrame:
        return mining.timeline(self.memories)

    def map(self, limit: int = 100, threshold: float = 0.3, query: str | None = None, form: str = "json") -> DataFrame:
        n = graph.nodes(self.memories, limit, query)
        e = graph.edges(n, threshold)
        return graph.to_html(graph.graph_json(n, e)) if form == "html" else {"json": graph.graph_json, "dot": graph.to_dot, "mermaid": graph.to_mermaid}[form](n, e)

    def constellation(self, limit: int = 500) -> DataFrame:
        return graph.constellation(self.memories, limit)

    def chains(self, max_gap_minutes: int = 60) -> DataFrame:
        return sequence.chains(self.memories, max_gap_minutes)

    # Lifecycle

    def sleep(self, at: str = NOW) -> None:
        working = self.memories.where("memory_type = 'Working'")
        self.replace(lifecycle.sleep(self.memories, working, now(at)))

    def dream(self, at: str = NOW, threshold: float = 0.3) -> DataFrame:
        """Consolidates: links associated memories, strengthens, fades; returns the concept that they have in common."""
        m, found, name = lifecycle.consolidate(self.memories, now(at), threshold)
        self.link(found.select(F.col("a").alias("from_id"), F.col("b").alias("to_id"), F.lit("similar").alias("relation"), F.col("similarity").alias("weight")))
        self.replace(m)
        return name

    def merge(self, threshold: float = 0.85, dry_run: bool = False) -> DataFrame:
        m = self.memories
        found = graph.clusters(m, threshold)
        stats = graph.merge_stats(found, m)
        if not dry_run:
            done = stats.collect()
            self.replace(graph.merge(m, found))
            return self.spark.createDataFrame(done, stats.schema)
        return stats


def serve(library: Library, port: int) -> None:
    from . import http
    from .service import Api

    http.server(Api(library), port=port).serve_forever()


COMMANDS: dict[str, Callable] = {
    "store": lambda lib, a: lib.store(a.text[0], a.tags),
    "import": lambda lib, a: lib.load(a.text[0], tags=a.tags),
    "batch": lambda lib, a: lib.add(files.read_batch(lib.spark, a.text[0], a.tags)),
    "export": lambda lib, a: lib.export(a.text[0]),
    "delete": lambda lib, a: lib.delete(a.text[0]),
    "recall": lambda lib, a: lib.recall(" ".join(a.text), a.limit, **{k: v for k, v in (("regex", a.regex), ("like", a.fuzzy), ("tag", reduce(lambda x, y: y, a.tags, None)), ("kind", a.type)) if v}).select("id", "content", "score"),
    "search": lambda lib, a: lib.search(" ".join(a.text), a.limit, a.threshold if a.threshold is not None else 0.05).select("id", "content", "similarity"),
    "list": lambda lib, a: lib.list(a.limit).select("id", "memory_type", "content", "strength"),
    "show": lambda lib, a: lib.show(a.text[0]),
    "sleep": lambda lib, a: lib.sleep(),
    "dream": lambda lib, a: lib.dream(),
    "merge": lambda lib, a: lib.merge(a.threshold if a.threshold is not None else 0.85, a.dry_run),
    "map": lambda lib, a: lib.map(a.limit, a.threshold if a.threshold is not None else 0.3, " ".join(a.text) or None, a.form),
    "constellation": lambda lib, a: lib.constellation(a.limit),
    "predict": lambda lib, a: lib.predict(a.hour, a.limit),
    "forget": lambda lib, a: lib.alerts(a.limit),
    "patterns": lambda lib, a: lib.patterns(),
    "stats": lambda lib, a: lib.stats(),
    "timeline": lambda lib, a: lib.timeline(),
    "chains": lambda lib, a: lib.chains(),
    "counts": lambda lib, a: lib.counts(),
    "rebuild": lambda lib, a: lib.rebuild(),
    "learn": lambda lib, a: lib.learn(a.text[0], a.text[1]),
    "good": lambda lib, a: lib.feedback(" ".join(a.text), True),
    "bad": lambda lib, a: lib.feedback(" ".join(a.text), False),
    "know": lambda lib, a: lib.know(a.text[0], " ".join(a.text[1:])),
    "ask": lambda lib, a: lib.knowledge(" ".join(a.text)),
    "note": lambda lib, a: lib.remember(notes.note(lib.spark.createDataFrame([(" ".join(a.text[1:]),)], "content string"), a.text[0])),
    "notes": lambda lib, a: notes.by_kind(lib.memories, a.text[0]).select("id", "content", "tags"),
    "audit": lambda lib, a: lib.audit,
    "operations": lambda lib, a: mining.daily_ops(lib.audit),
    "watch": lambda lib, a: lib.watch(a.text[0], a.tags).awaitTermination(),
    "bench": lambda lib, a: lib.spark.createDataFrame(benchmarks.run(lib.spark, a.limit * 100, 1)),
    "serve": lambda lib, a: serve(lib, int(a.text[0]) if a.text else 8080),
    "sql": lambda lib, a: storage.run_sql(lib.memories, " ".join(a.text)),
}
