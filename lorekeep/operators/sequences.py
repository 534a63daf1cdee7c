"""Order within long sequences, found without putting one sequence into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ID_CHUNK = 65_536
ROW_CHUNK = 8_192


def positions(df: DataFrame, key: str, order: str, chunk: int = ID_CHUNK) -> DataFrame:
    """``df`` with ``pos``: the rank (from 1) of each row within its ``key`` by ``order``, a unique whole number.

    Rows are ranked within ranges of ``order`` of ``chunk`` numbers, which bounds a range's rows; the ranges
    before it add their counts, which are summed over one row for each (key, range). Null keys are one key.
    """
    c = df.withColumn("_c", F.floor(F.col(order) / chunk))
    inner = c.withColumn("_r", F.row_number().over(Window.partitionBy(key, "_c").orderBy(order)))
    counts = c.groupBy(key, "_c").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(key).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col(key).alias("_k"), F.col("_c").alias("_d"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    joined = inner.join(offsets, inner[key].eqNullSafe(offsets["_k"]) & (inner["_c"] == offsets["_d"]))
    return joined.select(*df.columns, (F.col("_r") + F.col("_o")).cast("long").alias("pos"))


def totals_before(df: DataFrame, key: str, order: str, value: str, chunk: int = ID_CHUNK) -> DataFrame:
    """``df`` with ``before``: the sum of ``value`` over the rows of its ``key`` that come earlier by ``order``, a unique whole number.

    Added up within ranges of ``order`` and over one row for each (key, range), as ``positions`` does. Null values count as 0.
    """
    c = df.withColumn("_c", F.floor(F.col(order) / chunk)).withColumn("_v", F.coalesce(F.col(value), F.lit(0)).cast("long"))
    earlier = Window.unboundedPreceding, -1
    inner = c.withColumn("_s", F.coalesce(F.sum("_v").over(Window.partitionBy(key, "_c").orderBy(order).rowsBetween(*earlier)), F.lit(0)))
    sums = c.groupBy(key, "_c").agg(F.sum("_v").alias("_n"))
    offsets = sums.select(F.col(key).alias("_k"), F.col("_c").alias("_d"), F.coalesce(F.sum("_n").over(Window.partitionBy(key).orderBy("_c").rowsBetween(*earlier)), F.lit(0)).alias("_o"))
    joined = inner.join(offsets, inner[key].eqNullSafe(offsets["_k"]) & (inner["_c"] == offsets["_d"]))
    return joined.select(*df.columns, (F.col("_s") + F.col("_o")).alias("before"))


def looking_back(df: DataFrame, key: str, back: int, compute: dict[str, Column | object], chunk: int = ROW_CHUNK) -> DataFrame:
    """``df`` (which has ``pos``) with columns over the ``back`` rows before each row.

    ``compute`` maps names to functions of a window specification (key and piece, by ``pos``). Sequences are
    cut into pieces of ``chunk`` rows; each piece also gets the last ``back`` rows of the piece before it, so a
    frame of at most ``back`` preceding rows sees all it needs.
    """
    p = F.floor((F.col("pos") - 1) / chunk)
    lends = (F.col("pos") - 1) % chunk >= chunk - back
    pieces = df.withColumn("_p", F.explode(F.when(lends, F.array(p, p + 1)).otherwise(F.array(p)))).withColumn("_own", F.col("_p") == p)
    w = Window.partitionBy(key, "_p").orderBy("pos")
    return pieces.select("*", *[f(w).alias(n) for n, f in compute.items()]).where("_own").drop("_p", "_own")
