"""Weights that decay with experience."""

from __future__ import annotations

import math

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def fact_weight(rate: Column | float, floor: Column | float, distance: Column) -> Column:
    """floor + (1 - floor) * exp(-rate * distance)."""
    r, f = (x if isinstance(x, Column) else F.lit(float(x)) for x in (rate, floor))
    return f + (1.0 - f) * F.exp(-r * distance)


def rate_of_half_life(half_life: float) -> float:
    return math.log(2.0) / half_life


def register(spark: SparkSession) -> None:
    """The same as an SQL function, inlined by the optimizer."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION fact_weight(rate DOUBLE, w_floor DOUBLE, distance DOUBLE) RETURNS DOUBLE RETURN w_floor + (1 - w_floor) * exp(-rate * distance)")
