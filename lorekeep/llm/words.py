"""Words: maximal runs of letters and digits of the lower-cased text; all else separates them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]+"


def words(text: Column) -> Column:
    """The words of ``text`` in order; null counts as empty."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({WORD})"), F.lit(1))


def word_sequence(text: Column) -> Column:
    """The words of ``text`` joined by single spaces."""
    return F.array_join(words(text), " ")
