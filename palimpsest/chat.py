"""Prompts and facts of a conversation over memories; the model that answers is given by the caller."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.text import bullets
from .operators.retrieval import recall
from .schema import new_memories


def prompt(m: DataFrame, question: str, now: Column, limit: int = 5) -> str:
    """What the model is asked: the recalled memories, one a line, then the question."""
    rows = recall(m, question, now, limit).select("content").collect()
    return "\n".join([*(f"- {r['content']}" for r in rows), "", question])


def chat(m: DataFrame, question: str, now: Column, answer: Callable[[str], str], limit: int = 5) -> tuple[str, DataFrame]:
    """(the answer, the new episodic memory of the exchange)."""
    said = answer(prompt(m, question, now, limit))
    row = m.sparkSession.createDataFrame([(f"Q: {question}\nA: {said}", "Episodic")], "content string, memory_type string")
    return said, new_memories(row)


def summarise(m: DataFrame, topic: str, now: Column, answer: Callable[[str], str]) -> str:
    return answer(prompt(m, topic, now, 10))


def facts(replies: DataFrame, text: str = "text") -> DataFrame:
    """(fact) of the lists in replies, as they are learnt."""
    return replies.select(F.explode(bullets(F.col(text))).alias("fact"))
