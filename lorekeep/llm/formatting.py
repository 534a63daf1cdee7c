"""Records that are the same but for white space, letter case, punctuation or field order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import cut, discard
from ..sources.tables import table
from .words import WORD, word_sequence

_BITS = 62
_MASK = (1 << _BITS) - 1


def statement_fields(text: Column) -> Column:
    """The word sequences of the fields that ``;``, ``|``, a middle dot or a line feed divides, without empty ones."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[;|·\n]")
    return F.filter(F.transform(parts, lambda x: F.array_join(F.regexp_extract_all(x, F.lit(f"({WORD})"), F.lit(1)), " ")), lambda x: x != "")


def _multiset_hash(fields: Column, seed: str) -> Column:
    """Sum of the fields' hashes modulo 2^62: the same for every order, another for other multiplicities."""
    one = lambda x: F.xxhash64(F.lit(seed), x).bitwiseAND(F.lit(_MASK))
    return F.aggregate(fields, F.lit(0).cast("long"), lambda acc, x: (acc + one(x)).bitwiseAND(F.lit(_MASK)))


def _same_multiset(a: Column, b: Column) -> Column:
    """Whether two arrays hold the same elements as often, by hashed set operations, without sorting."""
    count = lambda xs, v: F.size(F.filter(xs, lambda x: x == v))
    sets = (F.size(a) == F.size(b)) & (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)
    once = (F.size(F.array_distinct(a)) == F.size(a)) & (F.size(F.array_distinct(b)) == F.size(b))
    counts = F.forall(F.array_distinct(a), lambda v: count(a, v) == count(b, v))
    return F.when(a == b, True).when(~sets, False).when(once, True).otherwise(counts)


def copies(records: DataFrame, *, number: str, same: dict[str, Column], fields: Column) -> DataFrame:
    """(first, number) for every record; ``first`` is the smallest number of the records it equals, itself included.

    Records are equal if each named value of ``same`` is equal (null equals null) and ``fields``, an
    array of strings, holds the same strings as often in any order. Each (field name, value) pair is
    hashed, the hashes are combined by a commutative sum in two independent 62-bit halves, records are
    grouped by that fingerprint, and each is compared with the first of its group, field by field and
    without sorting; what differs from it in spite of the fingerprint is fingerprinted again with other hashes, until nothing is left.

    The records' fields are computed once and cut. A hot group of copies is reduced to (fingerprint, first, count)
    map-side; its members then meet that one row in a join, which adaptive execution splits. Nothing is collected into an array.
    Null ``fields`` count as empty. An empty table gives an empty result. ``number`` must be unique; rows whose number repeats are rows of their own.
    """
    tagged = [F.array(F.concat(F.lit(name + "\x01"), F.coalesce(c.cast("string"), F.lit("\x00")))) for name, c in same.items()]
    body = F.coalesce(fields, F.array().cast("array<string>"))
    rows = records.select(F.col(number).alias("_no"), body.alias("_f"), F.concat(*tagged).alias("_k"))
    out, seed = None, 0
    while True:
        every = F.concat("_k", F.transform("_f", lambda x: F.concat(F.lit("\x02"), x)))
        rows = cut(rows.select("_no", "_f", "_k", _multiset_hash(every, f"a{seed}").alias("_h1"), _multiset_hash(every, f"b{seed}").alias("_h2")))
        groups = rows.groupBy("_h1", "_h2").agg(F.min("_no").alias("_first"), F.count("*").alias("_n"))
        leaders = rows.join(groups.where("_n > 1"), ["_h1", "_h2"]).where("_no = _first").groupBy("_h1", "_h2", "_first").agg(F.first(F.struct("_f", "_k")).alias("_l"))
        judged = rows.join(leaders.select("_h1", "_h2", "_first", F.col("_l._f").alias("_lf"), F.col("_l._k").alias("_lk")), ["_h1", "_h2"], "left")
        ok = F.col("_lk").isNull() | ((F.col("_k") == F.col("_lk")) & _same_multiset(F.col("_f"), F.col("_lf")))
        judged = judged.select("_no", F.coalesce("_first", "_no").alias("_first"), ok.alias("_ok"), F.when(~ok, F.col("_f")).alias("_f"), F.when(~ok, F.col("_k")).alias("_k"))
        done, seed = cut(judged), seed + 1
        discard(rows)
        same_ = done.where("_ok").select(F.col("_first").alias("first"), F.col("_no").alias("number"))
        out = same_ if out is None else out.union(same_)
        rows = done.where("not _ok").select("_no", "_f", "_k")
        if not rows.take(1):
            return out


def _fact_copies(spark: SparkSession, folder: str) -> DataFrame:
    facts = table(spark, folder, "facts").select("fact_no", "owner_id", "project_id", "subject_norm", "predicate_norm", "statement")
    with_words = facts.withColumn("fields", statement_fields(F.col("statement"))).where(F.size("fields") > 0)
    return copies(
        with_words,
        number="fact_no",
        same={"owner": F.col("owner_id"), "project": F.col("project_id"), "subject": word_sequence(F.col("subject_norm")), "predicate": word_sequence(F.col("predicate_norm"))},
        fields=F.col("fields"),
    )


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """(first_no, fact_no) for each copy of an earlier fact that differs in formatting only."""
    return _fact_copies(spark, folder).where("first < number").select(F.col("first").alias("first_no"), F.col("number").alias("fact_no"))


def p6_records(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record: its first fact, and how many copies it has in all, itself included."""
    return _fact_copies(spark, folder).groupBy(F.col("first").alias("fact_no")).agg(F.count("*").alias("copies"))


_RECORDS = r"""
WITH field AS (
  SELECT fact_no, list_filter(list_transform(regexp_split_to_array(lower(coalesce(statement, '')), '[;|·\n]'),
    lambda x: array_to_string(regexp_extract_all(x, '[\p{L}\p{N}]+'), ' ')), lambda x: x <> '') AS fs, owner_id, project_id,
    array_to_string(regexp_extract_all(lower(coalesce(subject_norm, '')), '[\p{L}\p{N}]+'), ' ') AS s,
    array_to_string(regexp_extract_all(lower(coalesce(predicate_norm, '')), '[\p{L}\p{N}]+'), ' ') AS p
  FROM facts),
grouped AS (
  SELECT fact_no, min(fact_no) OVER w AS first_no, count(*) OVER w AS n FROM field WHERE len(fs) > 0
  WINDOW w AS (PARTITION BY owner_id, project_id, s, p, list_sort(fs)))
"""
QUERIES = {"p6_found": p6_found, "p6_records": p6_records}
SQL = {
    "p6_found": _RECORDS + "SELECT first_no, fact_no FROM grouped WHERE first_no < fact_no",
    "p6_records": _RECORDS + "SELECT fact_no, n AS copies FROM grouped WHERE first_no = fact_no",
}
