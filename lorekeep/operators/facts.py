"""Operators on stored facts: deduplication, vocabulary, experience, visibility."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, condition_text, normalize
from .sequences import totals_before
from .similar import similar_pairs

ANCHOR = ["_owner", "_scope", "_project", "_subject", "_predicate", "_conditions"]


def anchored(facts: DataFrame) -> DataFrame:
    """``facts`` with its anchor (owner, scope, project, subject, predicate, conditions) and normalised object."""
    parts = [normalize(F.col("owner_id")), F.col("scope"), blank_to_null(F.col("project_id")), normalize(F.col("subject_norm")), normalize(F.col("predicate_norm")), condition_text(F.col("conditions"))]
    return facts.select("*", *[p.alias(n) for p, n in zip(parts, ANCHOR)], normalize(F.col("object_value")).alias("_object"))


def _evidence_size(c: str = "evidence") -> Column:
    return F.greatest(F.size(F.coalesce(c, F.array().cast("array<bigint>"))), F.lit(0)).cast("long")


def as_stored(facts: DataFrame) -> DataFrame:
    """The rows that an insert stores: owner, subject and predicate normalised, a blank project null, object and statement as they are;
    asserted by the user, seen once, at full weight."""
    return facts.select(
        "fact_no", normalize(F.col("owner_id")).alias("owner_id"), blank_to_null(F.col("project_id")).alias("project_id"), "kind", "fact_domain", "scope", normalize(F.col("subject_norm")).alias("subject_norm"),
        normalize(F.col("predicate_norm")).alias("predicate_norm"), "object_value", "statement", F.lit(1).alias("reinforcement_count"), F.lit("USER_ASSERTED").alias("permanence"), F.lit(1.0).alias("w"),
    )


def folding(facts: DataFrame, mode: str = "first") -> DataFrame:
    """(fact_no, into, evidence_count, conflict): the fact that each fact folds into, itself if it stays; see ``dedup``."""
    f = anchored(facts).select("fact_no", "kind", "_object", _evidence_size().alias("_n"), F.xxhash64(*ANCHOR).alias("_h"), F.struct(*ANCHOR).alias("_a"))
    state = f.where("kind = 'STATE'")
    key = ["_h", "_a"] if mode == "first" else ["_h", "_a", "_object"]
    first = state.groupBy(*key).agg(F.min(F.struct("fact_no", "_object")).alias("_first"))
    same = [F.col(f"s.{k}") == F.col(f"g.{k}") for k in ("_h", "_object") if k in key] + [F.col("s._a").eqNullSafe(F.col("g._a"))]
    on = same[0]
    for c in same[1:]:
        on = on & c
    met = state.alias("s").join(first.alias("g"), on)
    target = F.when(F.col("s._object") == F.col("_first._object"), F.col("_first.fact_no")).otherwise(F.col("s.fact_no"))
    folded = met.select(F.col("s.fact_no").alias("fact_no"), target.alias("into"), F.col("_n").alias("evidence_count"), (F.col("s._object") != F.col("_first._object")).alias("conflict"))
    return folded.union(f.where("kind is null or kind <> 'STATE'").select("fact_no", F.col("fact_no").alias("into"), F.col("_n"), F.lit(False)))


def dedup(facts: DataFrame, mode: str = "first") -> DataFrame:
    """(fact_no, reinforced, evidence_count, conflict) of the facts that stay after folding repeats in order of fact_no.

    Only STATE facts fold. mode ``first``: the earliest fact of an anchor takes in every later one with
    its normalised object; each fact with another object stays by itself as a conflict. mode
    ``converged``: every (anchor, object) is one fact. ``reinforced`` counts the facts folded into one, itself
    included; ``evidence_count`` adds up the lengths of their evidence (repeats count). Anchor columns: null equals null.

    The fold's outcome depends on the earliest object alone, so it is a map-side minimum per anchor, a
    join back, and a map-side count per kept fact; a hot anchor is never gathered.
    """
    return folding(facts, mode).groupBy(F.col("into").alias("fact_no")).agg(F.count("*").alias("reinforced"), F.sum("evidence_count").alias("evidence_count"), F.max("conflict").alias("conflict"))


def dedup_rows(facts: DataFrame, mode: str = "first") -> DataFrame:
    """The rows that are stored after the fold: those of ``as_stored`` for the facts that stay, with the count of facts folded into each."""
    kept = dedup(facts, mode).select("fact_no", F.col("reinforced").cast("int").alias("_n"), "evidence_count")
    return as_stored(facts).join(kept, "fact_no").withColumn("reinforcement_count", F.col("_n")).drop("_n")


def dedup_evidence(facts: DataFrame, mode: str = "first") -> DataFrame:
    """(fact_no, place, message_id): the evidence of each fact that stays, then that of the facts folded into it in their order, repeats kept.

    One row for each message, with its place from 1: the bag of a fact that takes in a third of all facts is spread like any other.
    """
    own = facts.select("fact_no", "evidence")
    runs = totals_before(folding(facts, mode).select("fact_no", "into", "evidence_count"), "into", "fact_no", "evidence_count")
    each = runs.join(own, "fact_no").select(F.col("into").alias("fact_no"), "before", F.posexplode("evidence").alias("_p", "message_id"))
    return each.select("fact_no", (F.col("before") + F.col("_p") + 1).alias("place"), "message_id")


def near_inserts(facts: DataFrame, least: float = 0.6) -> DataFrame:
    """(fact_no) of the STATE facts that open an anchor although an earlier fact has a subject written almost like theirs.

    The subject must differ once normalised, and reach ``least`` in 3-gram similarity; facts of any kind count as earlier. They are logged as near
    duplicates and stored all the same.
    """
    subject = normalize(F.col("subject_norm"))
    first = facts.where("subject_norm is not null").groupBy(subject.alias("_s")).agg(F.min("fact_no").alias("_first"))
    pairs = similar_pairs(first.select("_s"), least)
    both = pairs.select(F.col("a").alias("_s"), F.col("b").alias("_other")).union(pairs.select("b", "a"))
    earliest = both.join(first.select(F.col("_s").alias("_other"), "_first"), "_other").groupBy("_s").agg(F.min("_first").alias("_near"))
    opening = anchored(facts).where("kind = 'STATE'").groupBy(*ANCHOR).agg(F.min("fact_no").alias("fact_no")).select("fact_no", F.col("_subject").alias("_s"))
    return opening.join(earliest, "_s").where("_near < fact_no").select("fact_no")


def dedup_stats(facts: DataFrame) -> DataFrame:
    """One row: total, inserted, reinforced, conflicts, ratio (reinforced / total, 0 without facts)."""
    d = dedup(facts).agg(
        F.coalesce(F.sum("reinforced"), F.lit(0)).alias("total"), F.count("*").alias("inserted"), F.count_if("conflict").alias("conflicts")
    )
    return d.select("total", "inserted", (F.col("total") - F.col("inserted")).alias("reinforced"), "conflicts", F.when(F.col("total") > 0, (F.col("total") - F.col("inserted")) / F.col("total")).otherwise(0.0).alias("ratio"))


def predicate_counts(facts: DataFrame) -> DataFrame:
    return facts.where(F.col("predicate_norm").isNotNull()).groupBy("predicate_norm").agg(F.count("*").alias("uses"), F.max("created_at").alias("last_used"))


def vocabulary(facts: DataFrame, limit: int = 40) -> DataFrame:
    """(predicate_norm): three quarters of the limit by frequency, the rest by recency, without repeats; ties by name."""
    often = max(1, int(0.75 * limit))
    c = predicate_counts(facts)
    a = c.orderBy(F.desc("uses"), "predicate_norm").limit(often).select("predicate_norm")
    b = c.orderBy(F.desc("last_used"), "predicate_norm").limit(max(1, limit - often)).select("predicate_norm")
    return a.union(b).distinct()


def experience(facts: DataFrame) -> DataFrame:
    """(fact_no, experience, pool): distinct sessions of the fact's pool (owner, scope) up to its time, and in all.

    A session counts from its first fact on. First occurrences are a map-side minimum; their
    running count is kept per (pool, day) and the days of a pool are added up on one row each, so that neither a
    quadratic self-join nor one task per pool is needed. Facts without a time or session count no session;
    without a time their experience is null.
    """
    f = facts.select("fact_no", "owner_id", "scope", "session_id", "created_at")
    firsts = f.where("session_id is not null and created_at is not null").groupBy("owner_id", "scope", "session_id").agg(F.min("created_at").alias("created_at"))
    pool = ["owner_id", "scope"]
    both = f.select("fact_no", *pool, "created_at", F.lit(0).alias("_one")).union(firsts.select(F.lit(None).cast("long"), *pool, "created_at", F.lit(1)))
    both = both.withColumn("_day", F.col("created_at").cast("date"))
    w = Window.partitionBy(*pool, "_day").orderBy("created_at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    inner = both.select("*", F.sum("_one").over(w).alias("_in")).where("_one = 0")
    days = firsts.groupBy(*pool, F.col("created_at").cast("date").alias("_day")).agg(F.count("*").alias("_n"))
    every = both.select(*pool, "_day").distinct().join(days.select(F.col("owner_id").alias("_o"), F.col("scope").alias("_s"), F.col("_day").alias("_d"), "_n"), F.col("owner_id").eqNullSafe(F.col("_o")) & F.col("scope").eqNullSafe(F.col("_s")) & F.col("_day").eqNullSafe(F.col("_d")), "left")
    all_ = Window.partitionBy(*pool)
    sums = every.select(
        F.col("owner_id").alias("_o"), F.col("scope").alias("_s"), F.col("_day").alias("_d"),
        F.coalesce(F.sum("_n").over(all_.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.coalesce(F.sum("_n").over(all_), F.lit(0)).alias("pool"),
    )
    j = inner.join(sums, inner["owner_id"].eqNullSafe(sums["_o"]) & inner["scope"].eqNullSafe(sums["_s"]) & inner["_day"].eqNullSafe(sums["_d"]))
    return j.select("fact_no", F.when(F.col("created_at").isNotNull(), F.col("_in") + F.col("_before")).cast("long").alias("experience"), F.col("pool").cast("long").alias("pool"))


def visible(facts: DataFrame, owner: str, project: str | None) -> DataFrame:
    """The facts of one owner that a project sees: its own, those of scope USER and those without a project."""
    own = F.lit(None).cast("boolean") if project is None else F.col("project_id") == project
    return facts.where((F.col("owner_id") == owner) & ((F.col("scope") == "USER") | own | F.col("project_id").isNull()))


def visible_counts(facts: DataFrame) -> DataFrame:
    """(owner_id, project_id, visible): how many facts each project of an owner sees, without joining facts to projects."""
    f = facts.where("owner_id is not null").withColumn("_wide", (F.coalesce(F.col("scope"), F.lit("")) == "USER") | F.col("project_id").isNull())
    c = f.groupBy("owner_id", "project_id").agg(F.count_if("_wide").alias("_w"), F.count_if(~F.col("_wide")).alias("_n"))
    wide = c.groupBy("owner_id").agg(F.sum("_w").alias("_all"))
    return c.where("project_id is not null").join(wide, "owner_id").select("owner_id", "project_id", (F.col("_n") + F.col("_all")).alias("visible"))


def with_evidence_in(facts: DataFrame, ids: DataFrame, column: str = "id") -> DataFrame:
    """(fact_no) of facts with a message of ``ids`` among their evidence."""
    e = facts.select("fact_no", F.explode("evidence").alias("_id"))
    return e.join(ids.select(F.col(column).alias("_id")), "_id", "left_semi").select("fact_no").distinct()


def shared_projects(facts: DataFrame) -> DataFrame:
    """(project_id, owners) of the projects that have facts of more than one owner."""
    pairs = facts.where("project_id is not null and owner_id is not null").select("project_id", "owner_id").distinct()
    return pairs.groupBy("project_id").agg(F.count("*").alias("owners")).where("owners > 1")


def axis_states(facts: DataFrame) -> DataFrame:
    """(owner_id, predicate_norm, sessions, state): emerging with one distinct session, active from the second on."""
    s = facts.where("owner_id is not null and predicate_norm is not null and session_id is not null").select("owner_id", "predicate_norm", "session_id").distinct()
    c = s.groupBy("owner_id", "predicate_norm").agg(F.count("*").alias("sessions"))
    return c.withColumn("state", F.when(F.col("sessions") >= 2, "active").otherwise("emerging"))


def acceptance(facts: DataFrame) -> DataFrame:
    """Per owner: whether any statement holds an e-mail address, whether every fact has evidence, whether any statement is blank,
    whether a branch, an account and a build are known, and whether no subject is noise."""
    p, o, s = (F.lower(F.coalesce(c, F.lit(""))) for c in ("predicate_norm", "object_value", "subject_norm"))
    has = lambda c, *parts: reduce(lambda x, y: x | y, [F.contains(c, F.lit(part)) for part in parts])
    return facts.groupBy("owner_id").agg(
        F.coalesce(F.bool_or(F.contains("statement", F.lit("@"))), F.lit(False)).alias("has_email"),
        F.bool_and(_evidence_size() > 0).alias("all_evidenced"),
        F.bool_or(blank_to_null(F.col("statement")).isNull()).alias("has_blank"),
        F.bool_or(has(p, "branch") & has(o, "main", "master")).alias("has_branch"),
        F.bool_or(has(p, "build", "stack") & has(o, "gradle")).alias("has_build"),
        F.bool_and(~has(s, "compressed")).alias("no_noise"),
    )
