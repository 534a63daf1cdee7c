"""Texts that are put to a language model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import or_empty

NO_VOCABULARY = "(none yet)"


def batch_line(number: Column, peer: Column, content: Column) -> Column:
    """``[id] peer: text``."""
    return F.concat(F.lit("["), number.cast("string"), F.lit("] "), F.coalesce(peer, F.lit("user")), F.lit(": "), or_empty(content))


def batch_texts(rows: DataFrame, key: list[str], order: str = "id") -> DataFrame:
    """(key, first_id, messages, text): the lines of each batch in order. A batch is bounded by its message limit."""
    line = F.struct(order, batch_line(F.col("id"), F.col("peer_name"), F.col("content")).alias("line"))
    g = rows.groupBy(*key).agg(F.min("id").alias("first_id"), F.count("*").alias("messages"), F.array_sort(F.collect_list(line)).alias("_l"))
    return g.select(*key, "first_id", "messages", F.array_join(F.transform("_l", lambda x: x["line"]), "\n").alias("text"))


def vocabulary_text(words: list[str]) -> str:
    return ", ".join(words) if words else NO_VOCABULARY


def arm_prompt(transcript: Column, trigger: Column, digest: Column | None = None) -> Column:
    """The prompt of an arm: the same text in both, with the memory digest in front in arm a."""
    body = F.concat(or_empty(transcript), F.lit("\nUser: "), or_empty(trigger))
    return body if digest is None else F.concat(F.lit("Memory:\n"), or_empty(digest), F.lit("\n\n"), body)
