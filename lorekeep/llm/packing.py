"""Filling fixed-capacity containers with items of varying length."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import cut
from .encoding import Tokenizer, corpus, encode

CAPACITY = 2048
OPEN_BINS = 64
GROUP_CONTAINERS = 2048  # containers a packing group fills, about


class BestFit:
    """Bounded-space online best-fit: at most ``open_bins`` bins are open; the fullest closes first.

    A bitset has bit f set if an open bin has f units of free space, so the bin with the least
    sufficient space and the fullest bin are each one lowest-bit operation.
    """

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.most = capacity, open_bins
        self.free: dict[int, list[int]] = {}
        self.bits = self.open = self.made = 0

    def _take(self, space: int) -> int:
        bins = self.free[space]
        number = bins.pop()
        if not bins:
            self.bits &= ~(1 << space)
        self.open -= 1
        return number

    def put(self, size: int) -> tuple[int, int]:
        """(container, units used in it before) for an item of at most ``capacity`` units."""
        fits = self.bits >> size
        if fits:
            space = size + (fits & -fits).bit_length() - 1
            number = self._take(space)
        else:
            if self.open == self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
            number, space = self.made, self.capacity
            self.made += 1
        left = space - size
        if left:
            self.free.setdefault(left, []).append(number)
            self.bits |= 1 << left
            self.open += 1
        return number, self.capacity - space


def pack(items: DataFrame, key: str, size: str, capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> DataFrame:
    """(container, ``key``, piece_no, first_unit, n_units, offset) for every item.

    ``items``: an id and a size in units. An item is divided only if it alone exceeds the capacity: into pieces
    of just the capacity and a last one. A null or negative size counts as 0; an item of size 0 takes a place
    but no space. Equal sizes and repeated ids are items like any others. An empty table gives an
    empty result; other columns are ignored.

    Items are dealt by hash of their id into packing groups of about ``GROUP_CONTAINERS`` containers
    each, so that the number of groups follows the data, and each group is streamed through its own
    best-fit in order of that hash. A group ends with at most ``open_bins`` partly filled containers.
    """
    n = F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("long")
    total = items.select(n.alias("n")).agg(F.sum("n")).first()[0] or 0
    groups = max(1, int(total // (capacity * GROUP_CONTAINERS)))
    last = F.greatest(F.ceil(n / capacity), F.lit(1)).cast("long")
    h = F.xxhash64(F.col(key).cast("string"))
    rows = items.select(F.col(key).alias("_id"), n.alias("_n"), h.alias("_h"), F.explode(F.sequence(F.lit(1).cast("long"), last)).alias("_piece"))
    rows = rows.select(
        F.pmod("_h", F.lit(groups)).alias("_g"), "_h", "_id", "_piece", ((F.col("_piece") - 1) * capacity).alias("_first"),
        F.least(F.col("_n") - (F.col("_piece") - 1) * capacity, F.lit(capacity)).alias("_size"),
    )
    dealt = rows.repartition(groups, "_g").sortWithinPartitions("_g", "_h", "_id", "_piece")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, fit = None, None
        for batch in batches:
            if not len(batch):
                continue
            out = []
            for g, s in zip(batch["_g"].tolist(), batch["_size"].tolist()):
                if g != group:
                    group, fit = g, BestFit(capacity, open_bins)
                number, used = fit.put(int(s))
                out.append((g * (1 << 32) + number, used))
            yield pd.DataFrame(
                {"container": [c for c, _ in out], "_id": batch["_id"], "piece_no": batch["_piece"], "first_unit": batch["_first"], "n_units": batch["_size"], "offset": [o for _, o in out]}
            )

    kind = dict(items.dtypes)[key]
    packed = dealt.mapInPandas(run, f"container long, _id {kind}, piece_no long, first_unit long, n_units long, offset long")
    return packed.withColumnRenamed("_id", key)


def p8_packed(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's place in containers of 2048 tokens."""
    docs = corpus(spark, folder)
    sizes = encode(docs, Tokenizer(spark, docs.select("text")), "doc_id", "text").select("doc_id", F.size("ids").alias("n_tokens"))
    return pack(cut(sizes), "doc_id", "n_tokens")


QUERIES = {"p8_packed": p8_packed}
SQL: dict[str, str] = {}
