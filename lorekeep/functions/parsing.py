"""Facts out of the text that a language model answered."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import blank_to_null

_ARRAY = (
    "array<struct<kind:string,subject:string,predicate:string,object:string,statement:string,domain:string,scope:string,"
    "conditions:map<string,string>,evidence_ids:array<string>,evidence:array<string>>>"
)


def json_body(c: Column) -> Column:
    """The JSON inside fences or prose: the first fenced block if it holds a bracket, an unclosed fence up to
    the end, else from the first opening bracket to its last closing one; null where there is none."""
    fenced = F.regexp_extract(c, r"(?s)```[A-Za-z]*\s*(.*?)(?:```|\z)", 1)
    body = F.when(F.contains(c, F.lit("```")) & fenced.rlike(r"[\[{]"), fenced).otherwise(c)
    return blank_to_null(F.regexp_extract(body, r"(?s)^[^\[{]*(\[.*\]|\{.*\})", 1))


def parse_facts(answers: DataFrame, key: str, text: str) -> DataFrame:
    """One row per fact of each answer: ``key``, its place, and the fields with defaults.

    Unknown domains become WORLD, unknown scopes PROJECT; kind PSYCHE means domain PSYCHE; an unknown
    kind is STATE if predicate and object are there, else NARRATIVE. Evidence ids may be numbers or
    numeric texts, others are skipped. Subject, predicate, object and statement are trimmed. A fact with neither subject nor statement is dropped. Null, empty
    and unreadable answers have no facts; ``readable`` tells the last from those that truly hold none.
    """
    body = answers.select(key, json_body(F.col(text)).alias("_b"))
    array, wrapped = F.ltrim("_b").startswith("["), F.from_json("_b", f"facts {_ARRAY}")["facts"]
    lists = body.select(key, F.when(array, F.from_json("_b", _ARRAY)).otherwise(wrapped).alias("_f"))
    f = lists.select(key, F.posexplode_outer("_f").alias("place", "f")).where("f is not null")  # outer: no filter on the list that would read it twice
    up = lambda c: F.upper(F.trim(c))
    kind, domain, scope = up(F.col("f.kind")), up(F.col("f.domain")), up(F.col("f.scope"))
    full = blank_to_null(F.col("f.predicate")).isNotNull() & blank_to_null(F.col("f.object")).isNotNull()
    known = F.when(F.col("f.kind").isNull(), "STATE").when(kind.isin("STATE", "NARRATIVE", "EVENT"), kind)
    ids = F.coalesce("f.evidence_ids", "f.evidence", F.array().cast("array<string>"))
    out = f.select(
        key, "place",
        F.coalesce(known, F.when(full, F.lit("STATE")).otherwise("NARRATIVE")).alias("kind"),
        F.when((kind == "PSYCHE") | (domain == "PSYCHE"), "PSYCHE").otherwise("WORLD").alias("domain"),
        F.when(scope.isin("SESSION", "PROJECT", "USER"), scope).otherwise("PROJECT").alias("scope"),
        *[F.regexp_replace(f"f.{c}", r"^[\x00-\x20]+|[\x00-\x20]+$", "").alias(c) for c in ("subject", "predicate", "object", "statement")],
        F.coalesce("f.conditions", F.create_map().cast("map<string,string>")).alias("conditions"),
        F.filter(F.transform(ids, lambda x: F.trim(x).try_cast("bigint")), lambda x: x.isNotNull()).alias("evidence"),
    )
    return out.where(blank_to_null(F.col("subject")).isNotNull() | blank_to_null(F.col("statement")).isNotNull())


def readable(answer: str | None) -> bool:
    """Whether an answer holds whole JSON, a list or an object, inside fences or prose."""
    text = answer or ""
    if m := re.search(r"```[A-Za-z]*\s*(.*?)(?:```|\Z)", text, re.S):
        text = m[1] if re.search(r"[\[{]", m[1]) else text
    at = re.search(r"[\[{]", text)
    if not at:
        return False
    end = text.rfind("]" if at[0] == "[" else "}")
    try:
        json.loads(text[at.start() : end + 1])
    except ValueError:
        return False
    return True


def judge_verdict(c: Column) -> Column:
    """struct(a_pass, b_pass, reason) out of a judge's answer; null if there is no readable JSON in it."""
    return F.from_json(json_body(c), "a_pass boolean, b_pass boolean, reason string")
