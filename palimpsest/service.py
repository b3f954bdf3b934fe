"""Requests to a library as dictionaries and DataFrames: what an API, pages or a mailbox would send.

Transport is left to the caller; a page or an API prints what comes back.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .library import Library
from .operators import ann, mining, retrieval, sequence, storage
from .schema import NOW, new_memories, now


class Api:
    """Store, recall, delete and statistics over a library and an index of its vectors."""

    def __init__(self, library: Library, index: ann.Index | None = None):
        self.library, self.index = library, index

    def build_index(self, lists: int | None = None) -> int:
        self.index = ann.build(self.library.memories.where("embedding is not null"), lists)
        return ann.stats(self.index).first().vectors

    def store(self, content: str, tags: Iterable[str] = (), context: str | None = None, memory_type: str | None = None, at: str = NOW) -> dict:
        """A memory in the semantic store, whatever its type says; it goes into the index too."""
        spark = self.library.spark
        kind = {"episodic": "Episodic", "procedural": "Procedural"}.get((memory_type or "").lower(), "Semantic")
        row = spark.createDataFrame([(content, list(tags), context, kind)], "content string, tags array<string>, context string, memory_type string")
        made = self.library._embedded(new_memories(row, at=at))
        key = made.first().id
        if self.index is not None:
            self.index = ann.add(self.index, made)
        self.library.replace(storage.upsert(self.library.memories, made))
        return {"id": key, "success": True}

    def recall(self, query: str, limit: int = 5, use_index: bool = False, at: str = NOW) -> DataFrame:
        """By the library's recall; by the index, ids and similarities alone."""
        if use_index:
            if self.index is None:
                self.build_index()
            return ann.search(self.index, self.library.vector(query), limit)
        return self.library.recall(query, limit, at)

    def delete(self, key: str) -> bool:
        """Takes an id out of the index; the memory itself stays."""
        if not key:
            return False
        if self.index is not None:
            self.index = ann.remove(self.index, self.library.spark.createDataFrame([(key,)], "id string"))
        return True

    def stats(self) -> DataFrame:
        n = mining.totals(self.library.memories, self.library.memories.where("memory_type = 'Working'"))
        if self.index is None:
            return n
        i = ann.stats(self.index)
        return n.drop("indexed", "dim").crossJoin(i.select(F.col("vectors").alias("indexed"), "dim"))

    # Pages

    def memories_page(self, n: int = 50) -> DataFrame:
        return strongest(self.library.memories, n)

    def results_page(self, query: str, tags: str = "", limit: int = 20, at: str = NOW) -> DataFrame:
        found = self.library.recall(query, limit, at) if query.strip() else retrieval.list_memories(self.library.memories, limit)
        return with_any_tag(found, tags)

    def submit(self, content: str, tags: str = "", context: str | None = None, at: str = NOW) -> dict:
        """A form: tags are divided by commas; blank contents are refused."""
        if not content.strip():
            return {"success": False}
        return self.store(content, [t.strip() for t in tags.split(",") if t.strip()], context or None, at=at)

    def listing(self, n: int = 100) -> DataFrame:
        """(type, content, date) for a terminal."""
        return strongest(self.library.memories, n).select("memory_type", "content", F.date_format("created_at", "yyyy-MM-dd HH:mm").alias("date"))


def strongest(m: DataFrame, n: int) -> DataFrame:
    return m.orderBy(F.desc("strength"), "id").limit(n)


def with_any_tag(found: DataFrame, tags: str) -> DataFrame:
    """Those of which a tag has one of the comma-divided words as a part, whatever the case; all, without words."""
    words = [t.strip().lower() for t in tags.split(",") if t.strip()]
    if not words:
        return found
    hit = F.exists("tags", lambda t: F.exists(F.array(*map(F.lit, words)), lambda w: F.lower(t).contains(w)))
    return found.where(hit)


class Guardian:
    """A mailbox over a library: messages are dictionaries with an `op`; each has an answer, a wrong one an error.  Messages are answered one by one, in order."""

    def __init__(self, library: Library, capacity: int = 100):
        self.library, self.api, self.capacity = library, Api(library), capacity
        self.active, self.dreaming, self.last_dream = True, False, None

    def handle(self, message: dict[str, Any]) -> dict[str, Any]:
        if not self.active:
            return {"error": "the library is not active"}
        op = getattr(self, f"_{message.get('op')}", None)
        if op is None:
            return {"error": f"unknown operation: {message.get('op')}"}
        return op(**{k: v for k, v in message.items() if k != "op"})

    def run(self, messages: Iterable[dict[str, Any]]) -> Iterator[dict[str, Any]]:
        """Answers until the messages end or one shuts the library down."""
        for m in messages:
            yield self.handle(m)
            if not self.active:
                return

    def _store(self, content: str, tags: Iterable[str] = (), context: str | None = None) -> dict:
        return {"stored": self.api.store(content, tags, context)["id"]}

    def _recall(self, query: str, k: int = 5) -> dict:
        """The similar ones get stronger."""
        best, touched = retrieval.recall_reinforcing(self.library.memories, self.library.vector(query), k)
        found = [(r.id, r.score) for r in best.select("id", "score").collect()]
        if found:
            self.library.replace(storage.upsert(self.library.memories, touched.drop("similarity").withColumn("last_accessed", now())))
        return {"recalled": found}

    def _get(self, id: str) -> dict:
        r = storage.get(self.library.memories, id).first()
        return {"found": r.asDict() if r else None}

    def _reinforce(self, id: str, delta: float) -> dict:
        from .operators.lifecycle import reinforce

        m = self.library.memories
        if storage.get(m, id).isEmpty():
            return {"error": f"no such memory: {id}"}
        self.library.replace(reinforce(m, self.library.spark.createDataFrame([(id,)], "id string"), delta, now()))
        return {"strength": storage.get(self.library.memories, id).first().strength}

    def _forget(self, rate: float) -> dict:
        from .operators.lifecycle import fade

        before = self.library.memories.count()
        self.library.replace(fade(self.library.memories, now(), rate))
        return {"affected": before - self.library.memories.count()}

    def _recent(self, limit: int = 10) -> dict:
        return {"memories": [r.id for r in storage.recent(self.library.memories, limit).select("id").collect()]}

    def _link(self, source: str, target: str) -> dict:
        m = self.library.memories
        row = storage.get(m, source).first()
        if row is None or target in (row.associations or []):
            return {"error": "not linked"}
        self.library.replace(storage.associate(m, self.library.spark.createDataFrame([(source, target)], "from_id string, to_id string")))
        return {"linked": True}

    def _start_dream(self) -> dict:
        self.dreaming = True
        return {"dream": "started"}

    def _tick(self, at: str = NOW) -> dict:
        """A consolidation, while dreaming."""
        if not self.dreaming:
            return {"error": "no dream is running"}
        name = self.library.dream(at).first()
        self.last_dream = at
        return {"concept": name[0] if name else None}

    def _stop_dream(self) -> dict:
        self.dreaming = False
        return {"dream": "stopped"}

    def _restore(self, rows: DataFrame) -> dict:
        """Memories as they are, with no new vectors."""
        self.library.replace(storage.upsert(self.library.memories, rows))
        return {"restored": rows.count()}

    def _working(self) -> dict:
        return {"memories": [r.id for r in sequence.working(self.library.memories, capacity=self.capacity).orderBy("pos").select("id").collect()]}

    def _stats(self) -> dict:
        return {"memories": self.library.memories.count(), "concepts": self.library.concepts.count(), "active": self.active, "dreaming": self.dreaming, "last_dream": self.last_dream}

    def _status(self) -> dict:
        """What the library's parts are connected to."""
        return {"readable": all(storage.healthy(self.library.spark, f"{self.library.path}/{t}/{v[-1]}") for t in ("memories", "links") if (v := self.library._versions(t))), "dim": self.library.dim}

    def _learn(self, name: str, description: str, sources: Iterable[str] = ()) -> dict:
        self.library.know(name, description, sources)
        return {"stored": name}

    def _query(self, name: str) -> dict:
        r = self.library.knowledge(name).first()
        return {"knowledge": r[0] if r else None}

    def _generalise(self, ids: list[str] | None = None) -> dict:
        """Over the memories that are named, or all."""
        m = self.library.memories if ids is None else self.library.memories.where(F.col("id").isin(*ids))
        name = mining.concept(m).first()[0]
        return {"concept": name} if name else {"error": "no concept in common"}

    def _associate(self, threshold: float = 0.3) -> dict:
        from .operators.graph import associate

        return {"links": [tuple(r) for r in associate(self.library.memories, threshold).collect()]}

    def _shutdown(self) -> dict:
        self.dreaming = self.active = False
        return {"shutdown": True}
