"""Operators on ordered message logs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import speaker
from .sequences import ROW_CHUNK, looking_back, positions

WINDOW = 5


def message_log(messages: DataFrame) -> DataFrame:
    """The log: a missing token count is a quarter of the length, at least 1."""
    tokens = F.coalesce("token_count", F.greatest(F.lit(1), F.floor(F.length("content") / 4)).cast("int"), F.lit(1))
    return messages.select("id", "session_name", "peer_name", "content", tokens.alias("tokens"), "created_at")


def day_slice(messages: DataFrame, first: str, last: str, session: str | None = None) -> DataFrame:
    """Rows of the days ``first`` to ``last``, both included, as a half-open range that reaches the scan."""
    kind = dict(messages.dtypes)["created_at"]
    end = F.date_add(F.lit(last).cast("date"), 1).cast(kind)
    out = messages.where((F.col("created_at") >= F.lit(first).cast(kind)) & (F.col("created_at") < end))
    return out.where(F.col("session_name") == session) if session is not None else out


def window_start(log: DataFrame, n: int = WINDOW) -> DataFrame:
    """(id, w0, previous): the last message outside the window of n rows before each, -1 if none; the row before, 0 if none."""
    p = positions(log.select("session_name", "id"), "session_name", "id")
    out = looking_back(
        p, "session_name", n + 1,
        {"w0": lambda w: F.coalesce(F.lag("id", n + 1).over(w), F.lit(-1)), "previous": lambda w: F.coalesce(F.lag("id", 1).over(w), F.lit(0))},
    )
    return out.select("id", "session_name", "pos", "w0", "previous")


def transcripts(log: DataFrame, n: int = WINDOW) -> DataFrame:
    """(id, transcript): the n messages before each as lines ``Role: content``, oldest first; '' if none."""
    p = positions(log.select("session_name", "id", "peer_name", "content"), "session_name", "id")
    line = F.concat(speaker(F.col("peer_name")), F.lit(": "), F.coalesce("content", F.lit("")))
    out = looking_back(p.withColumn("_line", line), "session_name", n, {"_lines": lambda w: F.collect_list("_line").over(w.rowsBetween(-n, -1))})
    return out.select("id", F.array_join("_lines", "\n").alias("transcript"))


def next_by_other(log: DataFrame, mine: str = "User") -> DataFrame:
    """(id, reply_id): for each message the first later one of its session whose speaker isn't ``mine``; null if none.

    Forward as-of join: within pieces of a session by a window, across pieces by the first such row
    of the pieces that follow, found on one row for each piece.
    """
    p = positions(log.select("session_name", "id", "peer_name"), "session_name", "id")
    p = p.withColumn("_p", F.floor((F.col("pos") - 1) / ROW_CHUNK)).withColumn("_hit", F.when(speaker(F.col("peer_name")) != mine, F.col("id")))
    w = Window.partitionBy("session_name", "_p").orderBy("pos").rowsBetween(1, Window.unboundedFollowing)
    inner = p.select("session_name", "_p", "id", F.first("_hit", ignorenulls=True).over(w).alias("_in"))
    heads = p.groupBy("session_name", "_p").agg(F.min_by("_hit", F.when(F.col("_hit").isNotNull(), F.col("pos"))).alias("_h"))
    after = Window.partitionBy("session_name").orderBy("_p").rowsBetween(1, Window.unboundedFollowing)
    carry = heads.select(F.col("session_name").alias("_s"), F.col("_p").alias("_q"), F.first("_h", ignorenulls=True).over(after).alias("_later"))
    joined = inner.join(carry, inner["session_name"].eqNullSafe(carry["_s"]) & (inner["_p"] == carry["_q"]))
    return joined.select("id", F.coalesce("_in", "_later").alias("reply_id"))


def segments(log: DataFrame, bounds: DataFrame) -> DataFrame:
    """``log`` with ``segment``: the number of bounds (session_name, bound_id) of its session below its id.

    Bounds are ids; a row with the id of a bound belongs to the segment that the bound closes.
    """
    rows = log.select("session_name", "id", F.lit(0).alias("_b"))
    marks = bounds.select("session_name", F.col("bound_id").alias("id"), F.lit(1).alias("_b"))
    both = rows.union(marks).withColumn("_c", F.floor(F.col("id") / 65_536))
    w = Window.partitionBy("session_name", "_c").orderBy("id").rangeBetween(Window.unboundedPreceding, -1)
    inner = both.select("session_name", "_c", "id", "_b", F.coalesce(F.sum("_b").over(w), F.lit(0)).alias("_n")).where("_b = 0")
    sums = both.groupBy("session_name", "_c").agg(F.sum("_b").alias("_s"))
    before = Window.partitionBy("session_name").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col("session_name").alias("_k"), F.col("_c").alias("_d"), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_o"))
    joined = inner.join(offsets, inner["session_name"].eqNullSafe(offsets["_k"]) & (inner["_c"] == offsets["_d"]))
    return log.join(joined.select("id", (F.col("_n") + F.col("_o")).cast("long").alias("segment")), "id")


def _walk(tokens: list[int], entry: int, most: int, limit: int) -> list[int]:
    """Places where batches begin, the first at ``entry``."""
    starts, at, n = [], entry, len(tokens)
    while at < n:
        starts.append(at)
        size = total = 0
        while at < n and not (size and total + tokens[at] > limit):
            total, size, at = total + tokens[at], size + 1, at + 1
            if size >= most or total >= limit:
                break
    return starts


def greedy_batches(log: DataFrame, key: list[str], most: int = 20, limit: int = 2000, chunk: int = ROW_CHUNK) -> DataFrame:
    """(id, batch) per key in order of id: a batch closes before a row that would exceed ``limit`` tokens, and after
    ``most`` rows or ``limit`` tokens; a row above the limit ends a batch by itself. Batches count from 1.

    Where a batch begins depends on all rows before it, but a batch spans at most ``most`` rows. So a long key is
    cut into pieces of ``chunk`` rows; each piece, with the ``most`` rows that follow it, is walked once for every
    place at which a batch may enter it, giving a table entry -> (exit, batches); the tables of a key are composed in
    order, a few numbers per piece; and each piece is then walked once from its true entry, in a stream.
    No key is handled in one task. Null token counts count as 0.
    """
    rows = log.select(F.to_json(F.struct(*key)).alias("_key"), "id", F.greatest(F.coalesce("tokens", F.lit(0)), F.lit(0)).cast("long").alias("_t"))
    p = positions(rows, "_key", "id").withColumn("_p", F.floor((F.col("pos") - 1) / chunk))
    long_keys = p.where("_p > 0").select("_key").distinct()
    borders = p.join(long_keys, "_key", "left_semi")
    lends = ((F.col("pos") - 1) % chunk < most) & (F.col("_p") > 0)
    borders = borders.withColumn("_q", F.explode(F.when(lends, F.array("_p", F.col("_p") - 1)).otherwise(F.array("_p")))).withColumn("_own", F.col("_q") == F.col("_p"))

    def table(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("pos")
        own, tokens = int(g["_own"].sum()), g["_t"].tolist()
        exits, counts = [], []
        for entry in range(most):
            starts = _walk(tokens, entry, most, limit)
            after = [x for x in starts if x >= own]
            exits.append(after[0] - own if after else 0)  # none: the key ends here
            counts.append(len(starts) - len(after))
        return pd.DataFrame({"_key": [g["_key"].iloc[0]], "_p": [int(g["_q"].iloc[0])], "_exit": [exits], "_count": [counts]})

    tables = borders.groupBy("_key", "_q").applyInPandas(table, "_key string, _p long, _exit array<int>, _count array<int>")

    def compose(g: pd.DataFrame) -> pd.DataFrame:
        g, at, n, ats, ns = g.sort_values("_p"), 0, 0, [], []
        for exits, counts in zip(g["_exit"], g["_count"]):
            ats.append(at)
            ns.append(n)
            at, n = int(exits[at]), n + int(counts[at])
        return pd.DataFrame({"_key": g["_key"], "_p": g["_p"], "_at": ats, "_n": ns})

    entries = tables.groupBy("_key").applyInPandas(compose, "_key string, _p long, _at int, _n long")  # one row for each piece
    entered = p.join(entries, ["_key", "_p"], "left").select("_key", "_p", "pos", "id", "_t", F.coalesce("_at", F.lit(0)).alias("_at"), F.coalesce("_n", F.lit(0)).alias("_n"))

    def number(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, skip, batch, size, total = None, 0, 0, 0, 0
        for f in frames:
            if not len(f):
                continue
            out = []
            for k, q, t, at, n in zip(f["_key"], f["_p"], f["_t"].tolist(), f["_at"].tolist(), f["_n"].tolist()):
                if (k, q) != here:
                    here, skip, batch, size, total = (k, q), at, n, 0, 0
                if skip:
                    skip -= 1
                    out.append(batch)
                    continue
                if not size or total + t > limit or size >= most or total >= limit:
                    batch, size, total = batch + 1, 0, 0
                size, total = size + 1, total + t
                out.append(batch)
            yield pd.DataFrame({"id": f["id"], "batch": out})

    return entered.repartition("_key", "_p").sortWithinPartitions("_key", "_p", "pos").mapInPandas(number, "id long, batch long")


def session_stats(log: DataFrame) -> DataFrame:
    """Per session: messages, tokens, first and last id, first and last time."""
    return log.groupBy("session_name").agg(
        F.count("*").alias("messages"), F.sum("tokens").cast("long").alias("tokens"), F.min("id").alias("first_id"), F.max("id").alias("last_id"),
        F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"),
    )

