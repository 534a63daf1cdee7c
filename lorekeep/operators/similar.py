"""Similarity joins on dictionaries and vectors."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import coded_grams, grams
from ..functions.text import normalize
from ..shared import cut

BLOCK = 1024  # queries in one matrix product
SIGNATURE = 4  # words of 64 bits
CHUNK = 32_768  # vectors, or queries, of one task
TEXT = 64  # characters of a value for which a chunk of values has room
PAIRS = 65_536  # pairs that a task holds before it hands them on


def dictionary(values: DataFrame) -> DataFrame:
    """(value, norm, grams, n) of the distinct non-null values of one column."""
    v = values.select(F.col(values.columns[0]).alias("value")).where("value is not null").distinct()
    return v.withColumn("norm", normalize(F.col("value"))).withColumn("grams", grams(F.col("value"))).withColumn("n", F.size("grams"))


def _signature(grams_: Column) -> list[Column]:
    """A set as ``SIGNATURE`` words of 64 bits, in which each element sets one bit."""
    bits = F.transform(grams_, lambda g: F.pmod(F.xxhash64(g), F.lit(64 * SIGNATURE)))
    one = lambda b: F.call_function("shiftleft", F.lit(1).cast("long"), (b % 64).cast("int"))

    def word(k: int) -> Column:
        return F.aggregate(F.filter(bits, lambda b: F.floor(b / 64) == k), F.lit(0).cast("long"), lambda acc, b: acc.bitwiseOR(one(b)))

    return [word(k) for k in range(SIGNATURE)]


def similar_pairs(values: DataFrame, least: float) -> DataFrame:
    """(a, b, similarity) of distinct values a < b whose 3-gram similarity is at least ``least`` (above 0).

    An inverted index on 3-grams restricted to prefixes: grams are ordered by rarity, and of a set of n grams only the
    first n - ceil(least * n) + 1 are indexed, since two sets as similar as that share one of them. Equal norms have
    similarity 1; a value without letters pairs with nothing but its equals. Common grams
    are last in the order and stay out of the index, so no frequent gram gathers its values.

    The index holds numbers only: of each pair that meets in it the sizes and two bit signatures are compared, whose differing
    bits bound the symmetric difference from below. What can still be similar is made distinct, and only then do the sets themselves come to it.
    """
    d = cut(dictionary(values).withColumn("id", F.monotonically_increasing_id()))
    each = d.select("id", "n", F.explode("grams").alias("gram"))
    often = each.groupBy("gram").agg(F.count("*").alias("f"))
    w = Window.partitionBy("id").orderBy("f", "gram")
    rare = each.join(often, "gram").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= F.col("n") - F.ceil(F.lit(least) * F.col("n")) + 1)
    signed = d.select("id", *[s.alias(f"s{k}") for k, s in enumerate(_signature(F.col("grams")))])
    index = cut(rare.select("id", F.xxhash64("gram").alias("g"), "n").join(signed, "id"))
    left, right = (index.select("g", *[F.col(c).alias(f"{c}{side}") for c in ("id", "n", *[f"s{k}" for k in range(SIGNATURE)])]) for side in "ab")
    differ = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"s{k}a").bitwiseXOR(F.col(f"s{k}b"))) for k in range(SIGNATURE)])
    near = (F.col("ida") < F.col("idb")) & (F.col("na") >= F.lit(least) * F.col("nb")) & (F.col("nb") >= F.lit(least) * F.col("na"))
    # |A and B| / |A or B| >= least with at least ``differ`` in one of them only
    near = near & ((F.col("na") + F.col("nb")) * (1.0 - least) + 1e-9 >= differ * (1.0 + least))
    met = left.join(right, "g").where(near).select("ida", "idb").distinct()
    x, y = (d.select(F.col("id").alias(f"id{s}"), F.col("value").alias(f"v{s}"), F.col("norm").alias(f"x{s}"), F.col("grams").alias(f"g{s}"), F.col("n").alias(f"m{s}")) for s in "ab")
    pairs = met.join(x, "ida").join(y, "idb")
    shared = F.size(F.array_intersect("ga", "gb"))
    score = F.when(F.col("xa") == F.col("xb"), F.lit(1.0)).when((F.col("xa") == "") | (F.col("xb") == ""), F.lit(0.0)).otherwise(shared / (F.col("ma") + F.col("mb") - shared))
    return pairs.select(F.least("va", "vb").alias("a"), F.greatest("va", "vb").alias("b"), score.alias("similarity")).where(F.col("similarity") >= least)


def many_similar_pairs(values: DataFrame, least: float, chunk: int = CHUNK) -> DataFrame:
    """The result of ``similar_pairs``, its similarity rounded half up to nine decimals, for a ``least`` so low that the pairs which meet in an index are too many to shuffle.

    No pair is ever shuffled or kept: values are dealt into ranges of about ``chunk`` of them, every two ranges are one task, and a task hands on
    the pairs that it finds in batches of about ``PAIRS``. What is shuffled is each value once per range. A task holds the 3-grams of one range as lists of
    places, frequent ones as vectors, and counts for each value of the other range how many it shares with all of them at once; values with
    neighbouring texts share most 3-grams, whose counts are added up once for all of them. The work still grows with the square of the values.
    """
    d = cut(values.select(F.col(values.columns[0]).alias("value")).where("value is not null").distinct().withColumn("norm", normalize(F.col("value"))))
    n, characters = d.agg(F.count("*"), F.coalesce(F.sum(F.length("norm")), F.lit(0))).first()
    cores = d.sparkSession.sparkContext.defaultParallelism
    ranges = max(1, -(-n // chunk), -(-characters // (TEXT * chunk)), min(math.isqrt(8 * cores), n // 1024))
    dealt = d.repartitionByRange(ranges, "value").sortWithinPartitions("value").withColumn("_x", F.spark_partition_id())
    to = dealt.withColumn("_y", F.explode(F.sequence(F.lit(0), F.lit(ranges - 1)))).select(
        (F.least("_x", "_y").cast("long") * ranges + F.greatest("_x", "_y")).alias("_task"), (F.col("_x") > F.col("_y")).alias("_later"), (F.col("_x") == F.col("_y")).alias("_own"),
        "value", F.when(F.col("norm") != F.col("value"), F.col("norm")).alias("norm"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        t = t.set_column(t.column_names.index("norm"), "norm", pc.coalesce(t["norm"], t["value"])).take(pc.sort_indices(t, [("_later", "ascending"), ("value", "ascending")]))
        own, split = t["_own"][0].as_py(), t.num_rows - pc.sum(t["_later"]).as_py()
        a, b = (t, t) if own else (t.slice(0, split), t.slice(split))
        if len(a) and len(b):
            left, right = (x["value"].combine_chunks() for x in (a, b))
            for i, j, similarity in _met(a["norm"].to_pylist(), None if own else b["norm"].to_pylist(), least):
                yield pa.RecordBatch.from_arrays([left.take(pa.array(i)), right.take(pa.array(j)), pa.array(similarity)], ["a", "b", "similarity"])

    tasks = min(ranges * (ranges + 1), 128 * cores)  # two for each pair of ranges, so that few hold several
    return to.repartition(tasks, "_task").groupBy("_task").applyInArrow(run, "a string, b string, similarity double")


def _met(a: list[str], b: list[str] | None, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places in ``a``, places in ``b``, similarities) of the similar normalised texts, in batches; without ``b`` of those within ``a``, the first before the second."""
    at, codes = coded_grams(a if b is None else a + b)
    vocabulary = _distinct(codes)
    at, gram = np.divmod(_distinct(at * len(vocabulary) + np.searchsorted(vocabulary, codes)), len(vocabulary))
    sizes = np.bincount(at, minlength=len(a) + len(b or ()))
    cuts = np.searchsorted(at, np.arange(len(a) + 1))
    sets = [set(gram[x:y].tolist()) for x, y in zip(cuts[:-1], cuts[1:])]
    if b is not None:
        at, gram = at[cuts[-1] :] - len(a), gram[cuts[-1] :]
    na, nb = sizes[: len(a)], sizes if b is None else sizes[len(a) :]
    most = int(sizes.max())
    kind = np.uint8 if most < 255 else np.uint16 if most < 65_535 else np.int64
    one, width = kind(1), -(-len(nb) // 8) * 8  # so that eight places can be looked at as one word

    # the least count c with c / (total - c) >= least, by the sum of both sizes
    total = np.arange(2 * most + 1)
    needed = np.maximum(np.ceil(total * least / (1 + least)) - 1, 1)
    for _ in range(2):
        needed += needed / np.maximum(total - needed, 1) < least
    needed = np.minimum(needed, most + 1).astype(kind)
    need = {k: np.append(needed[k + nb], np.ones(width - len(nb), kind)) for k in _distinct(na).tolist()}

    order = np.argsort(gram, kind="stable")
    ends = np.searchsorted(gram[order], np.arange(len(vocabulary) + 1))
    places = [at[order[x:y]] for x, y in zip(ends[:-1], ends[1:])]
    dense = {}
    for g in np.flatnonzero(np.diff(ends) * 32 >= len(nb)).tolist():
        dense[g] = np.zeros(width, kind)
        dense[g][places[g]] = 1

    def add(counts: np.ndarray, grams_: set[int], change: np.ufunc = np.add) -> None:
        for g in grams_:
            if (v := dense.get(g)) is not None:
                change(counts, v, out=counts)
            elif len(p := places[g]):
                counts[p] = change(counts[p], one)

    found: list[tuple[int, np.ndarray, np.ndarray]] = []
    held = 0

    def batch() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        i, j, c = np.repeat([x for x, _, _ in found], [len(x) for _, x, _ in found]), np.concatenate([x for _, x, _ in found]), np.concatenate([x for _, _, x in found]).astype(np.int64)
        found.clear()
        either = na[i] + nb[j] - c
        return i, j, (c * 2 * 10**9 + either) // (2 * either) / 1e9

    run = sorted(range(len(a)), key=a.__getitem__)
    base, counts, known = np.zeros(width, kind), np.zeros(width, kind), set()
    start = 0
    while start < len(run):
        shared, stop, first = sets[run[start]], start + 1, 0
        while stop < len(run) and stop - start < 64:  # as long as no more than a few are lost
            less = shared & sets[run[stop]]
            first = first or len(less)
            if len(less) < first - 3:
                break
            shared, stop = less, stop + 1
        add(base, known - shared, np.subtract)
        add(base, shared - known)
        known = shared
        for i in run[start:stop]:
            np.copyto(counts, base)
            add(counts, sets[i] - shared)
            hit = counts >= need[int(na[i])]
            words = np.flatnonzero(hit.view(np.uint64))
            x, y = np.nonzero(hit.reshape(-1, 8)[words])
            j = words[x] * 8 + y
            if b is None:
                j = j[j > i]
            if len(j):
                found.append((i, j, counts[j]))
                held += len(j)
                if held >= PAIRS:
                    yield batch()
                    held = 0
        start = stop
    if found:
        yield batch()


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def near_duplicates(values: DataFrame, least: float = 0.6, most: int = 5) -> DataFrame:
    """(value, other, similarity, place): for each distinct value its ``most`` most similar other values; ties by value."""
    p = similar_pairs(values, least)
    both = p.select(F.col("a").alias("value"), F.col("b").alias("other"), "similarity").union(p.select("b", "a", "similarity"))
    w = Window.partitionBy("value").orderBy(F.desc("similarity"), "other")
    return both.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def nearest(vectors: DataFrame, queries: DataFrame, key: str, vector: str, most: int = 10, chunk: int = CHUNK) -> DataFrame:
    """(query_id, ``key``, cosine, place): for each query its ``most`` most similar vectors, itself left out; ties by id.

    Exact, as a product of blocked matrices: vectors and queries are dealt by hash into chunks of about ``chunk`` rows, and each pair of
    chunks is one task that keeps its own ``most`` per query from matrix products of ``BLOCK`` queries; only those are ranked. Nothing passes
    through the driver but two counts. Null vectors take no part; a zero vector or another length than the first one's raises an error.
    """
    kind = dict(vectors.dtypes)[key]
    as_double = lambda df: df.where(F.col(vector).isNotNull()).select(F.col(key).alias("_id"), F.col(vector).cast("array<double>").alias("_v"))
    v, q = as_double(vectors), as_double(queries)
    across, down = (max(1, -(-df.count() // chunk)) for df in (v, q))
    dealt = lambda df, name, n: df.withColumn(name, F.pmod(F.xxhash64("_id"), F.lit(n)))
    to = lambda df, name, n: df.withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    left, right = to(dealt(v, "_x", across), "_y", down), to(dealt(q, "_y", down), "_x", across)

    def unit(f: pd.DataFrame) -> np.ndarray:
        if len({len(x) for x in f["_v"]}) > 1:
            raise ValueError("vectors of different lengths")
        m = np.array(f["_v"].tolist())
        n = np.linalg.norm(m, axis=1)
        if (n == 0).any():
            raise ValueError("zero vector")
        return m / n[:, None]

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": b["_id"].iloc[:0], key: a["_id"].iloc[:0], "cosine": np.zeros(0)})]
        if len(a) and len(b):
            m, w = unit(a), unit(b)
            if m.shape[1] != w.shape[1]:
                raise ValueError("vectors of different lengths")
            k = min(most + 1, len(a))
            for at in range(0, len(b), BLOCK):
                s = w[at : at + BLOCK] @ m.T
                top = np.argpartition(-s, k - 1, axis=1)[:, :k]
                floor = np.take_along_axis(s, top, 1).min(axis=1)
                qi, vi = np.nonzero(s >= floor[:, None] - 1e-12)
                out.append(pd.DataFrame({"query_id": b["_id"].to_numpy()[at + qi], key: a["_id"].to_numpy()[vi], "cosine": s[qi, vi]}))
        return pd.concat(out)

    found = left.groupBy("_x", "_y").cogroup(right.groupBy("_x", "_y")).applyInPandas(run, f"query_id {kind}, {key} {kind}, cosine double")
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("cosine", 9)), key)
    return found.where(F.col("query_id") != F.col(key)).withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)
