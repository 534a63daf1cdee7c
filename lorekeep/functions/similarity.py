"""Similarity of texts and vectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import normalize


def grams(c: Column) -> Column:
    """Distinct 3-grams of the normalised text with two spaces before and one after it."""
    p = F.concat(F.lit("  "), normalize(c), F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substring(p, i, F.lit(3))))


def coded_grams(norms: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The same for texts that are normalised: (place of the text, its 3-gram as one number), with repeats. The empty text has a 3-gram of its own, -1."""
    padded = [f"  {t} " for t in norms]
    points = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    length = np.array([len(p) for p in padded], np.int64)
    at = np.repeat(np.arange(len(padded)), length)
    codes = points[:-2] << 42 | points[1:-1] << 21 | points[2:]  # 21 bits hold every code point
    whole = at[:-2] == at[2:]
    at, codes = at[:-2][whole], codes[whole]
    codes[length[at] == 3] = -1
    return at, codes


def word_grams(c: Column) -> Column:
    """The same for each alphanumeric word by itself."""
    ws = F.filter(F.split(normalize(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    padded = F.transform(ws, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substring(p, i, F.lit(3))))))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def trigram_similarity(a: Column, b: Column) -> Column:
    """1 if the normalised texts are equal, 0 if one of them is empty, else the Jaccard similarity of their 3-grams."""
    x, y = normalize(a), normalize(b)
    return F.when(x == y, F.lit(1.0)).when((x == "") | (y == ""), F.lit(0.0)).otherwise(jaccard(grams(a), grams(b)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; raises on different lengths and on a zero vector; null if either is null."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, v: s + v)
    na, nb = dot(a, a), dot(b, b)
    bad = F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors of different length"))).when((na == 0) | (nb == 0), F.raise_error(F.lit("zero vector")))
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).otherwise(F.coalesce(bad.cast("double"), dot(a, b) / F.sqrt(na * nb)))
