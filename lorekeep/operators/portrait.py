"""Portraits of owners: sections, order, state as of a position, differences, digests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import cosine
from ..functions.text import blank_to_null, fact_line
from .sequences import looking_back, positions

# What makes a fact critical.
CRITICAL_KEYS = ("organization", "project_type")
CRITICAL_PREDICATES = ("email", "identity", "auth", "secret")
CRITICAL_STEMS = ("критич", "critical", "правило", "запомни")
SECTIONS = ("critical", "constructs", "preferences")


def is_critical() -> Column:
    keys = F.map_keys(F.coalesce("conditions", F.create_map().cast("map<string,string>")))
    p, s = F.lower(F.coalesce("predicate_norm", F.lit(""))), F.lower(F.coalesce("statement", F.lit("")))
    found = F.arrays_overlap(keys, F.array(*map(F.lit, CRITICAL_KEYS)))
    for part in CRITICAL_PREDICATES:
        found = found | F.contains(p, F.lit(part))
    for part in CRITICAL_STEMS:
        found = found | F.contains(s, F.lit(part))
    return found


def section() -> Column:
    return F.when(is_critical(), "critical").when(F.col("fact_domain") == "PSYCHE", "preferences").otherwise("constructs")


def ranked(facts: DataFrame, most: int | None = None, width: int | None = None, also: tuple[str, ...] = ()) -> DataFrame:
    """(owner_id, project_id, section, place, fact_no, line, ``also``): every fact in its place of its portrait section, with its whole line.

    Order: reinforcement descending, created_at ascending, fact_no. Sections are ranked within hours of one reinforcement
    and offset by counts, so a hot owner isn't one task. ``most`` keeps only the first facts of each section; it reaches
    the ranking before the shuffle, so a hot owner sends ``most`` rows per task. ``width`` cuts the lines.
    """
    line = fact_line(F.col("statement"), F.col("subject_norm"), F.col("predicate_norm"), F.col("object_value"))
    f = facts.select("owner_id", "project_id", section().alias("section"), "fact_no", "reinforcement_count", "created_at", (line if width is None else F.left(line, F.lit(width))).alias("line"), *[F.col(c).alias(f"_also_{c}") for c in also])
    out = ["owner_id", "project_id", "section", "place", "fact_no", "line", *[F.col(f"_also_{c}").alias(c) for c in also]]
    key = ["owner_id", "project_id", "section"]
    if most is not None:
        w = Window.partitionBy(*key).orderBy(F.desc_nulls_last("reinforcement_count"), F.asc_nulls_last("created_at"), "fact_no")
        return f.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select(*out)
    piece = [*key, "reinforcement_count", "_hour"]
    c = f.withColumn("_hour", F.date_trunc("hour", "created_at"))
    inner = c.withColumn("_r", F.row_number().over(Window.partitionBy(*piece).orderBy("created_at", "fact_no")))
    before = Window.partitionBy(*key).orderBy(F.desc_nulls_last("reinforcement_count"), F.asc_nulls_last("_hour")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = c.groupBy(*piece).agg(F.count("*").alias("_n")).select(*piece, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    a, b = inner.alias("a"), offsets.alias("b")
    on = reduce(lambda x, y: x & y, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in piece])
    return a.join(b, on).select("a.*", (F.col("_r") + F.col("_o")).cast("int").alias("place")).select(*out)


def _rendered(rows: DataFrame, key: list[str], rank: str) -> DataFrame:
    """(``key``, digest) of rows with section, ``rank`` and line: sections in their order, their lines by rank; empty ones are left out."""
    order = F.array_position(F.array(*map(F.lit, SECTIONS)), F.col("section"))
    s = rows.groupBy(*key, "section").agg(F.array_sort(F.collect_list(F.struct(F.col(rank).alias("place"), "line"))).alias("_l"))
    text = F.concat(F.lit("["), F.col("section"), F.lit("]\n"), F.array_join(F.transform("_l", lambda x: F.concat(F.lit("- "), x["line"])), "\n"))
    p = s.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), text.alias("t")))).alias("_s"))
    return p.select(*key, F.array_join(F.transform("_s", lambda x: x["t"]), "\n").alias("digest"))


def digests(facts: DataFrame, most: int | None = None, width: int | None = None) -> DataFrame:
    """(owner_id, project_id, digest): the whole portrait as text, in its order; the mode without a trigger.

    ``most`` keeps only the first lines of each section, ``width`` cuts them.
    """
    return _rendered(ranked(facts, most, width).where(blank_to_null(F.col("line")).isNotNull()), ["owner_id", "project_id"], "place")


def selected_digests(items: DataFrame, triggers: DataFrame, vectors: DataFrame, key: list[str], most: int = 50) -> DataFrame:
    """(``key``, digest) for each trigger: the ``most`` items of its portrait that are nearest to it, over all sections.

    ``items`` has the key, section, place, id, line, reinforcement_count and created_at of whole portraits, ``triggers``
    the key and trigger (one row each), ``vectors`` id and vector (one row each). Order: cosine to the trigger descending,
    reinforcement descending (null is 0), created_at ascending (null first), then the place in the portrait. A null trigger
    (where ``Settings.selects`` is false) gives the whole portrait in its order; without items a digest is empty.

    An item with a blank line takes no part. One without an id raises an error, as does one that is to be compared but
    has no vector, one of another length, or a zero vector: nothing drops out of a selection silently. Null keys are one key.
    """
    if most < 1:
        raise ValueError(f"a digest needs at least one item, got {most}")
    has_id = F.when(blank_to_null(F.col("id")).isNull(), F.raise_error(F.lit("portrait item without an id")).cast("boolean")).otherwise(True)
    i = items.where(blank_to_null(F.col("line")).isNotNull()).where(has_id)
    t, n = triggers.select(*key, "trigger"), [f"_k{k}" for k in range(len(key))]
    on = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(x)) for k, x in zip(key, n)])
    o = t.select(*[F.col(k).alias(x) for k, x in zip(key, n)], "trigger")
    met = i.join(o, on).drop(*n)
    compared = met.where("trigger is not null").join(vectors.select(F.col("id").alias("_id"), F.col("vector").alias("_v")), F.col("id") == F.col("_id"), "left")
    score = F.when(F.col("_v").isNull(), F.raise_error(F.concat(F.lit("portrait item without a vector: "), F.col("id"))).cast("double")).otherwise(cosine(F.col("_v"), F.col("trigger")))
    order = F.array_position(F.array(*map(F.lit, SECTIONS)), F.col("section"))
    by = [F.desc("_score"), F.desc("_n"), F.asc_nulls_first("created_at"), "_o", "place"]
    c = compared.select(*key, "section", "place", "line", "created_at", score.alias("_score"), F.coalesce("reinforcement_count", F.lit(0)).alias("_n"), order.alias("_o"))
    top = c.withColumn("_rank", F.row_number().over(Window.partitionBy(*key).orderBy(*by))).where(F.col("_rank") <= most)
    every = met.where("trigger is null").select(*key, "section", F.col("place").alias("_rank"), "line")
    d = _rendered(top.select(*key, "section", "_rank", "line").union(every), key, "_rank")
    d = d.select(*[F.col(k).alias(x) for k, x in zip(key, n)], F.regexp_replace("digest", r"\s+$", "").alias("digest"))
    return t.join(d, on, "left").select(*key, F.coalesce("digest", F.lit("")).alias("digest"))


def cutoffs(facts: DataFrame) -> DataFrame:
    """(owner_id, project_id, cutoff): the time of the latest fact of each portrait."""
    return facts.groupBy("owner_id", "project_id").agg(F.max("created_at").alias("cutoff"))


def at_bound(facts: DataFrame, bound: int) -> DataFrame:
    """The facts as they were when messages up to ``bound`` had been read.

    Evidence beyond the bound is dropped, facts without evidence left are dropped, and reinforcement is
    at most the number of evidence ids kept (repeats count). Null or empty evidence: dropped. All else is unchanged.
    """
    kept = F.filter("evidence", lambda e: e <= bound)
    f = facts.withColumn("evidence", kept).where(F.size("evidence") > 0)
    return f.withColumn("reinforcement_count", F.least(F.size("evidence"), F.col("reinforcement_count")))


def new_facts(before: DataFrame, after: DataFrame, key: str = "fact_no") -> DataFrame:
    return after.join(before.select(key), key, "left_anti")


def stale(facts: DataFrame, portraits: DataFrame) -> DataFrame:
    """(snapshot_id) of the portraits for whose owner and project a fact is newer than their cutoff; null project is ''."""
    newest = cutoffs(facts.withColumn("project_id", F.coalesce("project_id", F.lit(""))))
    p = portraits.select("snapshot_id", "owner_id", F.coalesce("project_id", F.lit("")).alias("project_id"), F.col("cutoff").alias("_c"))
    return p.join(newest, ["owner_id", "project_id"]).where("cutoff > _c").select("snapshot_id")


_ITEM = "array<struct<id:string,subject:string,predicate:string,object:string,statement:string,reinforcement_count:int,conditions:map<string,string>>>"
SNAPSHOT = f"owner_id string, project_id string, critical {_ITEM}, constructs {_ITEM}, preferences {_ITEM}"


def items(portraits: DataFrame) -> DataFrame:
    """(snapshot_id, section, place, id, subject, predicate, object, statement) of the items stored in portraits.

    A JSON null and a missing field are both null; an unreadable document has no items; places count from 1.
    """
    doc = portraits.select("snapshot_id", F.from_json("snapshot", SNAPSHOT).alias("d"))
    each = doc.select("snapshot_id", F.explode(F.array(*[F.struct(F.lit(s).alias("section"), F.col(f"d.{s}").alias("items")) for s in SECTIONS])).alias("s"))
    out = each.select("snapshot_id", "s.section", F.posexplode("s.items").alias("place", "i"))
    return out.select("snapshot_id", "section", (F.col("place") + 1).alias("place"), "i.id", "i.subject", "i.predicate", "i.object", "i.statement")


def bounds_of(evidence: str = "evidence") -> tuple[Column, Column]:
    """Smallest and largest evidence id, -1 where there is none."""
    return F.coalesce(F.array_min(evidence), F.lit(-1)), F.coalesce(F.array_max(evidence), F.lit(-1))


def provenance(facts: DataFrame, w0: int) -> DataFrame:
    """(fact_no, provenance): unknown without evidence, valid if all of it lies at or before ``w0``, in-window if all
    lies after it, else lag."""
    low, high = bounds_of()
    verdict = F.when(high < 0, "unknown").when(high <= w0, "valid").when(low > w0, "in-window").otherwise("lag")
    return facts.select("fact_no", verdict.alias("provenance"))


def answer_coverage(facts: DataFrame, must: list[str], w0: int) -> DataFrame:
    """(owner_id, project_id, covered): whether each marker occurs in the joined text of the portrait's facts valid at ``w0``; no markers: false.

    The texts are joined by spaces in the order of the portrait (sections, places), so that a marker may begin in one fact and end in
    another. They aren't gathered: a marker of n letters that ends in a fact begins at most n // 2 facts before it, so each fact
    is searched together with that many before it, in pieces of the portrait.
    """
    key = ["owner_id", "project_id"]
    every = facts.select(*key).distinct()
    if not must:
        return every.withColumn("covered", F.lit(False))
    text = F.lower(F.regexp_replace(F.concat_ws(" ", *[blank_to_null(F.col(c)) for c in ("subject_norm", "predicate_norm", "object_value", "statement")]), r"\s+", " "))
    valid = facts.join(provenance(facts, w0).where("provenance = 'valid'").select("fact_no"), "fact_no", "left_semi").withColumn("_text", text).where("_text <> ''")
    order = F.array_position(F.array(*map(F.lit, SECTIONS)), F.col("section")) * F.lit(1 << 40) + F.col("place")
    placed = ranked(valid, also=("_text",)).select(F.struct(*key).alias("_portrait"), order.alias("_order"), "_text")
    back = max(len(m) for m in must) // 2
    seen = looking_back(positions(placed, "_portrait", "_order"), "_portrait", back, {"_joined": lambda w: F.collect_list("_text").over(w.rowsBetween(-back, 0))})
    joined = F.regexp_replace(F.concat_ws(" ", "_joined"), r"\s+", " ")
    hits = seen.select("_portrait", joined.alias("_t")).groupBy("_portrait").agg(*[F.bool_or(F.contains("_t", F.lit(m.lower()))).alias(f"_m{k}") for k, m in enumerate(must)])
    found = hits.select(F.col("_portrait").alias("_p"), reduce(lambda x, y: x & y, [F.col(f"_m{k}") for k in range(len(must))]).alias("_all"))
    return every.join(found, F.struct(*key).eqNullSafe(F.col("_p")), "left").select(*key, F.coalesce("_all", F.lit(False)).alias("covered"))


def reconcile(facts: DataFrame, portraits: DataFrame, *, bound: int | None = None, only_stale: bool = False) -> DataFrame:
    """``portraits`` (owner_id, project_id, cutoff, lines) with those of ``facts`` built anew over them; lines counts their facts.

    With ``bound`` they are built as of that message. All are rebuilt, or with ``only_stale`` those that a fact is newer than.
    """
    f = facts if bound is None else at_bound(facts, bound)
    built = cutoffs(f).join(f.groupBy("owner_id", "project_id").agg(F.count("*").alias("lines")).select(F.col("owner_id").alias("_o"), F.col("project_id").alias("_p"), "lines"), F.col("owner_id").eqNullSafe(F.col("_o")) & F.col("project_id").eqNullSafe(F.col("_p")))
    built = built.select("owner_id", "project_id", "cutoff", "lines")
    old = portraits.select(F.col("owner_id").alias("_o"), F.col("project_id").alias("_p"), F.col("cutoff").alias("_c"), F.col("lines").alias("_l"))
    both = built.join(old, F.col("owner_id").eqNullSafe(F.col("_o")) & F.col("project_id").eqNullSafe(F.col("_p")), "full")
    new = F.col("lines").isNotNull()
    if only_stale:
        new = new & (F.col("_l").isNull() | (F.col("cutoff") > F.col("_c")))
    pick = lambda a, b: F.when(new, F.col(a)).otherwise(F.col(b)).alias(a)
    return both.select(F.when(F.col("lines").isNotNull(), F.col("owner_id")).otherwise(F.col("_o")).alias("owner_id"), F.when(F.col("lines").isNotNull(), F.col("project_id")).otherwise(F.col("_p")).alias("project_id"), pick("cutoff", "_c"), pick("lines", "_l"))
