"""Attributes as they were known at an event's time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK_DAYS = 32


def _day(ts: Column) -> Column:
    return F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date"))


def known_at(
    facts: DataFrame,
    moments: DataFrame,
    *,
    entity: dict[str, tuple[Column, Column]],
    item: dict[str, Column],
    start: Column,
    known: Column,
    end: Column,
    fact_id: str,
    at: Column,
    moment_id: str,
    bucket_days: int = 8,
) -> DataFrame:
    """For each moment, the fact of its entity that holds for each item, of those known by then.

    A fact counts at time T when ``start <= T``, ``known <= T`` and ``end`` is null or ``> T``; of
    the facts of one item the latest ``start`` wins, then the latest ``known``, then the largest
    ``fact_id``. ``entity`` maps a name to its column in ``facts`` and in ``moments``; ``item`` maps
    a name to a column of ``facts``. Result: ``moment_id``, ``fact_id``; no row for a moment
    at which nothing holds.

    How: a fact is valid over the half-open ``[greatest(start, known), end)``. Successive change
    times shorten it: once a fact of a later chunk of start times is known and has no end, it hides
    the earlier ones for good. The interval is exploded into dyadic time buckets (an interval of n
    buckets needs O(log n) rows), a moment looks in the one bucket of each level that holds it, the
    two meet in an equi-join by entity and bucket, and ``start <= T < end`` decides. A hot entity is
    split by its buckets, and what is left of one item is reduced by a map-side maximum.

    Nulls: entity columns never match if null (coalesce them first where null is a value); item
    columns group null with null; a null ``start`` or ``known``, or a null ``at``, counts nowhere.
    Empty tables give an empty result; other columns of either table, also clashing ones, are ignored.
    """
    keys, items = [f"_e_{n}" for n in entity], [f"_i_{n}" for n in item]
    m = moments.select(
        F.col(moment_id).alias("_mid"), at.alias("_at"), *[c[1].alias(f"_e_{n}") for n, c in entity.items()]
    ).where(F.col("_at").isNotNull())
    bucket = lambda ts: F.floor(_day(ts) / bucket_days).cast("long")
    span = m.agg(F.min("_at").alias("a"), F.max("_at").alias("b")).select(F.col("a").cast("string"), F.col("b").cast("string"), bucket(F.col("a")).alias("x"), bucket(F.col("b")).alias("y")).first()
    if span.a is None:
        return _empty(facts, moments, fact_id, moment_id)
    kind = dict(m.dtypes)["_at"]
    low, high, first, last = F.lit(span.a).cast(kind), F.lit(span.b).cast(kind), span.x, span.y
    f = (
        facts.select(
            F.col(fact_id).alias("_fid"), start.alias("_start"), known.alias("_known"), end.alias("_end"),
            *[c[0].alias(f"_e_{n}") for n, c in entity.items()], *[c.alias(f"_i_{n}") for n, c in item.items()],
        )
        .where(F.col("_start").isNotNull() & F.col("_known").isNotNull())
        .withColumn("_begin", F.greatest("_start", "_known"))
        .where((F.col("_begin") <= high) & (F.col("_end").isNull() | ((F.col("_end") > F.col("_begin")) & (F.col("_end") > low))))
        .withColumn("_chunk", F.floor(_day(F.col("_start")) / CHUNK_DAYS))
    )
    # per item and chunk: when the first fact without an end became known; a few rows for each item, reduced map-side
    lasting = f.where(F.col("_end").isNull()).groupBy(*keys, *items, "_chunk").agg(F.min("_begin").alias("_from"))
    per_item = lasting.groupBy(*keys, *items).agg(F.collect_list(F.struct("_chunk", "_from")).alias("_changes"))
    a, b = f.alias("a"), per_item.alias("b")
    on = reduce(lambda x, y: x & y, [F.col(f"a.{n}").eqNullSafe(F.col(f"b.{n}")) for n in keys + items])
    hide = F.array_min(F.transform(F.filter("_changes", lambda x: x["_chunk"] > F.col("_chunk")), lambda x: x["_from"]))
    cut_end = F.when(F.col("_hide").isNull(), F.col("_end")).otherwise(F.least("_end", "_hide"))
    f = a.join(b, on, "left").select("a.*", hide.alias("_hide")).withColumn("_end", cut_end).drop("_hide", "_chunk")
    f = f.where(F.col("_end").isNull() | ((F.col("_end") > F.col("_begin")) & (F.col("_end") > low)))

    levels = max(1, (last - first + 1).bit_length())
    node = lambda k, n: n * 64 + k
    lo = F.greatest(bucket(F.col("_begin")), F.lit(first)) - first
    hi = F.least(F.coalesce(bucket(F.col("_end")), F.lit(last)), F.lit(last)) - first + 1
    pieces = []
    for k in range(levels + 1):
        left, right = F.floor((F.col("_lo") + (1 << k) - 1) / (1 << k)), F.floor(F.col("_hi") / (1 << k))
        pieces += [F.when((left < right) & (left % 2 == 1), node(k, left)), F.when((left < right) & (right % 2 == 1), node(k, right - 1))]
    f = f.withColumn("_lo", lo).withColumn("_hi", hi).select(
        "_fid", "_start", "_known", "_begin", "_end", *keys, *items, F.explode(F.array_compact(F.array(*pieces)).cast("array<bigint>")).alias("_node")
    )
    here = bucket(F.col("_at")) - first
    m = m.select("_mid", "_at", *keys, F.explode(F.array(*[node(k, F.shiftright(here, k)) for k in range(levels + 1)]).cast("array<bigint>")).alias("_node"))
    met = m.join(f, [*keys, "_node"]).where((F.col("_begin") <= F.col("_at")) & (F.col("_end").isNull() | (F.col("_end") > F.col("_at"))))
    won = met.groupBy("_mid", *items).agg(F.max(F.struct("_start", "_known", "_fid")).alias("_w"))
    return won.select(F.col("_mid").alias(moment_id), F.col("_w._fid").alias(fact_id))


def _empty(facts: DataFrame, moments: DataFrame, fact_id: str, moment_id: str) -> DataFrame:
    return moments.sparkSession.createDataFrame([], f"{moment_id} {dict(moments.dtypes)[moment_id]}, {fact_id} {dict(facts.dtypes)[fact_id]}")
