"""Paired evaluation: verdicts, outcome tables, exact tests, validation of exam points."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains_span, hit, marker_in, missed, prepared
from .sequences import positions


def verdict(answer: Column, must: Column, must_not: Column) -> Column:
    """struct(passed, missed, hit): passed if no marker of must is missed and none of must_not is hit. Null lists are empty."""
    m, h = missed(answer, must), hit(answer, must_not)
    return F.struct(((F.size(m) == 0) & (F.size(h) == 0)).alias("passed"), m.alias("missed"), h.alias("hit"))


def arm_verdicts(points: DataFrame, answers: DataFrame) -> DataFrame:
    """(point_id, a_pass, b_pass, leak) of the points answered in both arms.

    ``points``: point_id, level, must, must_not; ``answers``: point_id, arm (a or b), answer. A leak is a control point
    (level C) whose arm a, the one with memory, hits a forbidden marker.
    """
    p = answers.groupBy("point_id").pivot("arm", ["a", "b"]).agg(F.first("answer"))
    j = points.join(p.where("a is not null and b is not null"), "point_id")
    a, b = verdict(F.col("a"), F.col("must"), F.col("must_not")), verdict(F.col("b"), F.col("must"), F.col("must_not"))
    v = j.select("point_id", "level", a.alias("va"), b.alias("vb"))
    return v.select("point_id", F.col("va.passed").alias("a_pass"), F.col("vb.passed").alias("b_pass"), ((F.col("level") == "C") & (F.size("va.hit") > 0)).alias("leak"))


def paired_stats(verdicts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """n, a_pass, b_pass, a_only, b_only, both, neither, leaks; a leak is counted and taken out of the rest."""
    ok = ~F.coalesce("leak", F.lit(False)) & F.col("a_pass").isNotNull() & F.col("b_pass").isNotNull()
    a, b = F.coalesce("a_pass", F.lit(False)), F.coalesce("b_pass", F.lit(False))
    n = lambda c: F.count_if(ok & c)
    return verdicts.groupBy(*(by or [])).agg(
        F.count_if(ok).alias("n"), n(a).alias("a_pass"), n(b).alias("b_pass"), n(a & ~b).alias("a_only"), n(b & ~a).alias("b_only"),
        n(a & b).alias("both"), n(~a & ~b).alias("neither"), F.count_if(F.coalesce("leak", F.lit(False))).alias("leaks"),
    )


def _log_gamma(x: Column) -> Column:
    """The logarithm of the gamma function from 1 on, by its asymptotic series eight places further up."""
    y = x + 8.0
    series = (y - 0.5) * F.log(y) - y + F.lit(0.5 * math.log(2 * math.pi)) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    below = reduce(lambda p, q: p * q, [x + float(k) for k in range(8)])
    return series - F.log(below)


def mcnemar(b: Column, c: Column) -> Column:
    """Two-sided exact McNemar p: 2 * sum of C(n, k) / 2^n for k up to min(b, c), at most 1; 1 without discordant pairs.

    The sum runs down from its largest term, whose logarithm is known, and each term is a fraction of the one before; after about
    eight square roots of n they no longer count, so the work doesn't grow with n itself and no number of pairs overflows.
    """
    n, m = (b + c).cast("double"), F.least(b, c).cast("double")
    top = _log_gamma(n + 1.0) - _log_gamma(m + 1.0) - _log_gamma(n - m + 1.0) - n * F.lit(math.log(2.0))
    terms = F.least(m, F.floor(F.sqrt(n) * 8.0) + 64.0).cast("long")

    def step(s, j):
        term = s["term"] * (m - j + 1.0) / (n - m + j)
        return F.struct(term.alias("term"), (s["total"] + term).alias("total"))

    down = F.when(terms >= 1, F.sequence(F.lit(1).cast("long"), terms)).otherwise(F.array().cast("array<bigint>"))
    total = F.aggregate(down, F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total")), step)["total"]
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.exp(top + F.log(total) + F.lit(math.log(2.0)))))


def report(verdicts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The outcome table with lift, p and whether the lift is significant (lift > 0 and p < 0.05); lift is null without pairs."""
    s = paired_stats(verdicts, by)
    p = mcnemar(F.col("a_only"), F.col("b_only"))
    lift = F.when(F.col("n") > 0, (F.col("a_pass") - F.col("b_pass")) / F.col("n"))
    return s.withColumns({"lift": lift, "p_value": p}).withColumn("significant", F.coalesce((F.col("lift") > 0) & (F.col("p_value") < 0.05), F.lit(False)))


def known_verdicts(verdicts: DataFrame, points: DataFrame) -> DataFrame:
    """The verdicts whose point is still in the dataset."""
    return verdicts.join(points.select("point_id"), "point_id", "left_semi")


def to_judge(verdicts: DataFrame) -> DataFrame:
    """(point_id, reason) of the points worth a judge: failed by both arms, or passed only without memory. Null verdicts aren't."""
    reason = F.when(~F.col("a_pass") & ~F.col("b_pass"), "both-fail").when(F.col("b_pass") & ~F.col("a_pass"), "b-only")
    return verdicts.select("point_id", reason.alias("reason")).where("reason is not null")


def judged_summary(verdicts: DataFrame) -> DataFrame:
    """(slice, n, a_pass, b_pass, both_fail, a_only, b_only, lift_pp, p_value) of overlaid verdicts with a level: over all, and over those of level L1.

    ``lift_pp`` is the difference of the arms' shares in whole percentage points, rounded half to even; null without points.
    """
    a, b = F.coalesce("a_pass", F.lit(False)), F.coalesce("b_pass", F.lit(False))
    each = verdicts.select(F.explode(F.when(F.col("level") == "L1", F.array(F.lit("all"), F.lit("L1"))).otherwise(F.array(F.lit("all")))).alias("slice"), a.alias("a"), b.alias("b"))
    s = each.groupBy("slice").agg(
        F.count("*").alias("n"), F.count_if("a").alias("a_pass"), F.count_if("b").alias("b_pass"), F.count_if(~F.col("a") & ~F.col("b")).alias("both_fail"),
        F.count_if(F.col("a") & ~F.col("b")).alias("a_only"), F.count_if(F.col("b") & ~F.col("a")).alias("b_only"),
    )
    return s.withColumns({"lift_pp": F.bround((F.col("a_pass") - F.col("b_pass")) * 100 / F.col("n")).cast("long"), "p_value": mcnemar(F.col("a_only"), F.col("b_only"))})


def overlay(verdicts: DataFrame, judged: DataFrame) -> DataFrame:
    """Machine verdicts with a judge's in their place where there is one (point_id, a_pass, b_pass)."""
    j = judged.select("point_id", F.col("a_pass").alias("_a"), F.col("b_pass").alias("_b"))
    return verdicts.join(j, "point_id", "left").select("point_id", F.coalesce("_a", "a_pass").alias("a_pass"), F.coalesce("_b", "b_pass").alias("b_pass"), "leak")


def _some(texts: Column, markers: Column) -> Column:
    """Whether any marker occurs in any of the texts, each of which is prepared once."""
    return F.exists(F.transform(texts, prepared), lambda t: F.exists(markers, lambda m: marker_in(t, m)))


def span_status(trigger: Column, message: Column, truth: Column, anchor: Column, anchor_id: Column, message_id: Column, level: Column, must: Column, must_not: Column, window: Column, skip: Column) -> Column:
    """Status of an exam point, the first that applies: skip, span-miss, in-window, marker-collision, causality, unanchored, ok.

    span-miss: the trigger isn't in its message, or the truth isn't in its anchor; in-window: a marker of the branch (must,
    or must_not for level C) occurs in ``window``, the texts visible anyway; marker-collision: a forbidden marker occurs in a
    required one; causality: the anchor lies before or at the message; unanchored: an L1 point without an anchor.
    """
    empty = F.array().cast("array<string>")
    branch = F.coalesce(F.when(level == "C", must_not).otherwise(must), empty)
    inside = _some(window, branch)
    clash = _some(F.coalesce(must, empty), F.coalesce(must_not, empty))
    miss = ~F.coalesce(contains_span(message, trigger), F.lit(False)) | (anchor_id.isNotNull() & truth.isNotNull() & ~F.coalesce(contains_span(anchor, truth), F.lit(False)))
    return (
        F.when(F.coalesce(skip, F.lit(False)), "skip").when(miss, "span-miss").when(inside, "in-window").when(clash, "marker-collision")
        .when(anchor_id.isNotNull() & (anchor_id <= message_id), "causality").when((level == "L1") & anchor_id.isNull(), "unanchored").otherwise("ok")
    )


def spread_of(values: DataFrame, column: str) -> DataFrame:
    """One row: n, least, most and mean of a column; nulls are left out."""
    return values.agg(F.count(column).alias("n"), F.min(column).alias("least"), F.max(column).alias("most"), F.avg(column).alias("mean"))


def points_by_session(points: DataFrame) -> DataFrame:
    """(session_name, place, point_id, points): the points of each session in order of their messages, place from 1, and how many it has.

    Rows, not lists, so that a session with a third of all points is spread. ``message_id`` must be unique.
    """
    n = points.groupBy("session_name").agg(F.count("*").alias("points")).select(F.col("session_name").alias("_s"), "points")
    p = positions(points.select("session_name", "message_id", "point_id"), "session_name", "message_id")
    return p.join(n, p["session_name"].eqNullSafe(n["_s"])).select("session_name", F.col("pos").alias("place"), "point_id", "points")


def order_statistics(values: DataFrame, column: str, quantiles: list[float]) -> DataFrame:
    """(quantile, value): the element at place floor(n * q) of the sorted values, from 0; nulls are left out.

    An exact distributed percentile over (value, count) pairs, aimed between places so that no rounding decides.
    """
    v = values.where(F.col(column).isNotNull()).select(F.col(column).alias("v"))
    n, kind = v.count(), dict(v.dtypes)["v"]
    if not n:
        return v.select(F.lit(0.0).alias("quantile"), F.col("v").alias("value")).where("false")
    exact = [F.expr(f"percentile_disc({(min(math.floor(n * q), n - 1) + 0.5) / n!r}) WITHIN GROUP (ORDER BY v)").alias(f"q{k}") for k, q in enumerate(quantiles)]
    row = v.agg(*exact)
    return row.select(F.explode(F.array(*[F.struct(F.lit(q).alias("quantile"), F.col(f"q{k}").cast(kind).alias("value")) for k, q in enumerate(quantiles)])).alias("x")).select("x.*")
