"""Deduplicating new batches against everything already accepted."""

from __future__ import annotations

import json
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import cut, discard, ensure_checkpoint_dir, remove, scratch
from ..sources.tables import table
from .words import words

SLIPS = 2
ROWS_PER_SHARD = 20_000
HOT_BLOCK = 20_000
_BASE_LEVEL = 1_000
DEPTH = 32  # symbols by which suffixes are ordered
MANY = 16  # occurrences of a query's rarest words beyond which longer substrings are tried
_CLOSE, _END = "\x00", "\x01"
_OUT_COLUMNS = ["kind", "shard", "number", "first", "blocks", "body", "suffixes", "owners", "ranks", "rank_starts", "starts", "bounds", "numbers"]
_OUT = "kind string, shard long, number long, first long, " + ", ".join(f"{c} binary" for c in _OUT_COLUMNS[4:])


# ------------------------------------------------------------------ slips


@lru_cache(maxsize=200_000)
def slips(a: str, b: str, most: int = SLIPS) -> int:
    """Fewest letters left out, added, replaced or swapped with their neighbour that turn a into b; most + 1 if more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    a, b = a[start:], b[start:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if len(a) > 400:
        return _banded(a, b, most)
    far = len(a) + len(b)
    rows = [[far] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        rows[i + 1][1] = i
    for j in range(len(b) + 1):
        rows[1][j + 1] = j
    seen: dict[str, int] = {}
    for i in range(1, len(a) + 1):
        match = 0
        for j in range(1, len(b) + 1):
            i1, j1 = seen.get(b[j - 1], 0), match
            cost = a[i - 1] != b[j - 1]
            if not cost:
                match = j
            rows[i + 1][j + 1] = min(rows[i][j] + cost, rows[i + 1][j] + 1, rows[i][j + 1] + 1, rows[i1][j1] + (i - i1 - 1) + 1 + (j - j1 - 1))
        seen[a[i - 1]] = i
    return min(rows[-1][-1], most + 1)


def _banded(a: str, b: str, most: int) -> int:
    """The same for very long words: only cells within ``most`` of the diagonal, swaps of neighbours included."""
    far, before, last = most + 1, {}, {j: j for j in range(min(len(b), most) + 1)}
    for i in range(1, len(a) + 1):
        now: dict[int, int] = {}
        for j in range(max(0, i - most), min(len(b), i + most) + 1):
            best = i if j == 0 else min(last.get(j - 1, far) + (a[i - 1] != b[j - 1]), now.get(j - 1, far) + 1)
            best = min(best, last.get(j, far) + 1)
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                best = min(best, before.get(j - 2, far) + 1)
            now[j] = min(best, far)
        if min(now.values(), default=far) >= far:
            return far
        before, last = last, now
    return last.get(len(b), far)


def alike(a: list[str], b: list[str], most: int = SLIPS) -> bool:
    """Whether two sorted lists of words, each led by the letter of its field, match word for word with at most ``most`` slips."""
    if a == b:
        return True
    if len(a) != len(b):
        return False
    x, y, i, j = [], [], 0, 0
    while i < len(a) or j < len(b):
        if j == len(b) or (i < len(a) and a[i] < b[j]):
            x.append(a[i])
            i += 1
        elif i == len(a) or b[j] < a[i]:
            y.append(b[j])
            j += 1
        else:
            i, j = i + 1, j + 1
        if len(x) > most or len(y) > most:
            return False
    return _pair_up(x, y, most)


def _pair_up(x: list[str], y: list[str], most: int) -> bool:
    if not x:
        return True
    for k, other in enumerate(y):
        if other[0] == x[0][0] and (d := slips(x[0][1:], other[1:], most)) <= most and _pair_up(x[1:], y[:k] + y[k + 1 :], most - d):
            return True
    return False


# ------------------------------------------------------------------ suffix arrays


def _text(words_: list[str]) -> str:
    """A record's text: its words, each closed, and the record's end. An empty record is its end alone."""
    return "".join(w + _CLOSE for w in words_) + _END


def _by_word(n: int) -> bool:
    """Whether the substrings of a record of ``n`` words are whole words: two slips break at most two of them, so it takes three."""
    return n > SLIPS


def pieces(words_: list[str]) -> tuple[list[str], int]:
    """The substrings that a record's text is cut into, and how many of them two slips can break at most.

    Whole words where there are three or more; else every word in equal parts, five or more in all: a slip breaks one
    part, or two if it swaps the letters on both sides of a cut. Parts of very short words may be empty.
    """
    if _by_word(len(words_)):
        return [w + _CLOSE for w in words_], SLIPS
    parts = -(-(2 * SLIPS + 1) // max(1, len(words_)))
    out = []
    for w in words_ or [""]:
        t = w + _CLOSE if words_ else ""
        out += [t[len(t) * k // parts : len(t) * (k + 1) // parts] for k in range(parts)]
    return out, 2 * SLIPS


def runs(words_: list[str]) -> list[str]:
    """Five longer substrings, of neighbouring words: two slips can change two words, and each changed word may sort into one more."""
    cut_ = [len(words_) * k // (2 * SLIPS + 1) for k in range(2 * SLIPS + 2)]
    return ["".join(w + _CLOSE for w in words_[a:b]) for a, b in zip(cut_, cut_[1:])]


class Segment:
    """An immutable suffix array over the concatenated texts of a set of records.

    Records stand block by block, and so do their suffixes: ``bounds`` holds where each block's begin, and within a block they are
    in order of their first ``DEPTH`` symbols. Indexed are the places where a substring of ``pieces`` can begin: every word of a record
    whose substrings are words, every symbol of the others. ``owners`` has the record of each suffix, ``ranks`` the
    places of each record's suffixes in the array. All are stored, so that opening a segment rebuilds nothing.
    """

    ARRAYS = {"suffixes": "i", "owners": "i", "ranks": "i", "rank_starts": "q", "starts": "q", "bounds": "q", "numbers": "q"}

    def __init__(self, blocks: list[str], text: str, arrays: dict[str, bytes]):
        self.blocks, self.text, self.arrays = blocks, text, arrays
        for name, kind in self.ARRAYS.items():
            setattr(self, name, memoryview(arrays[name]).cast(kind))
        self.place = {b: k for k, b in enumerate(blocks)}
        self._ranks, self._rank_starts = np.frombuffer(arrays["ranks"], np.int32), np.frombuffer(arrays["rank_starts"], np.int64)
        self._owners, self._numbers = np.frombuffer(arrays["owners"], np.int32), np.frombuffer(arrays["numbers"], np.int64)

    def __len__(self) -> int:
        return len(self.numbers)

    def words(self, record: int) -> list[str]:
        stop = self.starts[record + 1] if record + 1 < len(self.starts) else len(self.text)
        return self.text[self.starts[record] : stop].split(_CLOSE)[:-1]

    def records(self) -> Iterator[tuple[str, list[str], int]]:
        """(block, words, number) of each record."""
        block = np.zeros(len(self), np.int64)
        block[self._owners] = np.repeat(np.arange(len(self.blocks)), np.diff(np.append(np.asarray(self.bounds), len(self.suffixes))))
        for k, b in enumerate(block.tolist()):
            yield self.blocks[b], self.words(k), self.numbers[k]

    def block(self, name: str) -> tuple[int, int]:
        """The interval of a block's suffixes; empty if the segment lacks the block."""
        if (k := self.place.get(name)) is None:
            return 0, 0
        return self.bounds[k], self.bounds[k + 1] if k + 1 < len(self.bounds) else len(self.suffixes)

    def find(self, part: str, low: int, high: int) -> tuple[int, int]:
        """Of the interval [low, high) of one block the part whose suffixes begin with ``part``, by binary search.

        Only the first ``DEPTH`` symbols of a longer substring are compared, so that it may find more than it should.
        """
        part = part[:DEPTH]
        head = lambda p, text=self.text, n=len(part): text[p : p + n]
        low = bisect_left(self.suffixes, part, low, high, key=head)
        return low, bisect_right(self.suffixes, part, low, high, key=head)

    def covered(self, q: np.ndarray, r: np.ndarray, first: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """For each pair of a query and a record, how many of the query's substrings, ``first[q]`` to ``first[q + 1]``, the record holds."""
        n = first[q + 1] - first[q]
        pair = np.repeat(np.arange(len(q)), n)
        piece = first[q][pair] + np.arange(len(pair)) - np.append(0, np.cumsum(n))[pair]
        a, b = self._rank_starts[r][pair], self._rank_starts[r + 1][pair]
        stop, least = b.copy(), low[piece]
        while (open_ := a < b).any():
            mid = (a + b) // 2
            right = open_ & (self._ranks[np.minimum(mid, len(self._ranks) - 1)] < least)
            a, b = np.where(right, mid + 1, a), np.where(open_ & ~right, mid, b)
        held = (a < stop) & (self._ranks[np.minimum(a, len(self._ranks) - 1)] < high[piece])
        return np.bincount(pair, held, len(q)).astype(np.int64)

    def row(self, shard: int) -> dict:
        pack = lambda x: zlib.compress(x.encode("utf-8", "surrogatepass"), 1)
        return {"kind": "segment", "shard": shard, "blocks": pack(json.dumps(self.blocks, ensure_ascii=False)), "body": pack(self.text), **self.arrays}

    @staticmethod
    def of(row: dict) -> Segment:
        read = lambda x: zlib.decompress(x).decode("utf-8", "surrogatepass")
        return Segment(json.loads(read(row["blocks"])), read(row["body"]), {n: bytes(row[n]) for n in Segment.ARRAYS})

    @staticmethod
    def build(records: Iterable[tuple[str, list[str], int]]) -> Segment:
        """From (block, sorted words, number); blocks and words may repeat."""
        rows = sorted(records)
        texts = [_text(ws) for _, ws, _ in rows]
        text = "".join(texts)
        starts = np.append(0, np.cumsum([len(t) for t in texts], dtype=np.int64))[:-1]
        blocks, bounds, suffixes, owners, mine = [], [], [], [], []
        head = lambda x: text[x[0] : x[0] + DEPTH]

        def close() -> None:
            mine.sort(key=head)
            suffixes.extend(p for p, _ in mine)
            owners.extend(k for _, k in mine)
            mine.clear()

        for k, ((block, ws, _), at) in enumerate(zip(rows, starts.tolist())):
            if not blocks or block != blocks[-1]:
                close()
                blocks.append(block)
                bounds.append(len(suffixes))
            if _by_word(len(ws)):
                for w in ws:
                    mine.append((at, k))
                    at += len(w) + 1
            else:
                mine.extend((p, k) for p in range(at, at + len(texts[k])))
        close()
        owner = np.array(owners, np.int32)
        arrays = {
            "suffixes": np.array(suffixes, np.int32), "owners": owner, "ranks": np.argsort(owner, kind="stable").astype(np.int32),
            "rank_starts": np.append(0, np.cumsum(np.bincount(owner, minlength=len(rows)))).astype(np.int64),
            "starts": starts, "bounds": np.array(bounds, np.int64), "numbers": np.array([n for *_, n in rows], np.int64),
        }
        return Segment(blocks, text, {n: a.tobytes() for n, a in arrays.items()})

    @staticmethod
    def merge(parts: list[Segment]) -> Segment:
        """One segment for several; of records with equal blocks and words the smallest number stays."""
        first: dict[tuple, int] = {}
        for s in parts:
            for block, ws, no in s.records():
                key = (block, tuple(ws))
                first[key] = min(no, first.get(key, no))
        return Segment.build((block, list(ws), no) for (block, ws), no in first.items())


def candidates(segment: Segment, queries: list[tuple[str, list[str]]], before: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, record) of one block whose record holds as much of the query's text as any within two slips must.

    Each query's text is cut into substrings (``pieces``), and each is looked up in the suffix array by binary search. If two
    slips can break k of them, any k + 1 hold one that stands unbroken in every record looked for: the k + 1 with the fewest
    occurrences are followed. Where those are many, five longer ``runs`` are looked up as well and followed if they occur less often.
    Then the coverage is added up per record: it must hold all of the query's substrings but k.
    ``before``: only records with a smaller number than this are of use to each query.
    """
    first, low, high, need, q, r = [0], [], [], [], [], []
    for k, (block, ws) in enumerate(queries):
        a, b = segment.block(block)
        found: list[tuple[int, int]] = []
        breakable = 0
        if a < b:
            parts, breakable = pieces(ws)
            found = [segment.find(p, a, b) for p in parts]
            follow = sorted(found, key=lambda x: x[1] - x[0])[: breakable + 1]
            if len(ws) > 2 * SLIPS and sum(y - x for x, y in follow) > MANY:
                longer = [segment.find(p, a, b) for p in runs(ws)]
                if sum(y - x for x, y in longer) < sum(y - x for x, y in follow):
                    follow = longer
            held = [segment._owners[x:y] for x, y in follow if x < y]
            if held:
                records = np.unique(np.concatenate(held)).astype(np.int64) if len(held) > 1 or len(held[0]) > 1 else held[0].astype(np.int64)
                if before is not None:
                    records = records[segment._numbers[records] < before[k]]
                q.append(np.full(len(records), k, np.int64))
                r.append(records)
        first.append(first[-1] + len(found))
        low.extend(x for x, _ in found)
        high.extend(y for _, y in found)
        need.append(len(found) - breakable)
    if not q:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    q, r = np.concatenate(q), np.concatenate(r)
    enough = segment.covered(q, r, np.array(first, np.int64), np.array(low, np.int64), np.array(high, np.int64)) >= np.array(need, np.int64)[q]
    return q[enough], r[enough]


def _visit(due: frozenset[int], search: bool):
    """What one shard does with one batch: ask every live segment, build the batch's own, merge what is due."""

    def visit(live: pd.DataFrame, batch: pd.DataFrame) -> pd.DataFrame:
        shard = int((live if len(live) else batch)["shard"].iloc[0])
        batch = batch.sort_values(["number", "home"], ascending=[True, False]).drop_duplicates("number")  # salts may share a shard
        queries = [(b, list(w)) for b, w in zip(batch["block"], batch["letters"])]
        numbers = batch["number"].to_numpy(dtype=np.int64)
        home = batch["home"].to_numpy(dtype=bool) if len(batch) else np.zeros(0, bool)
        own = Segment.build((*queries[k], int(numbers[k])) for k in np.flatnonzero(home))
        stored = [(int(row["step"]), Segment.of(row)) for row in live.to_dict("records")]
        best = numbers.copy()
        for segment in [*(s for _, s in stored), own] if search and len(batch) else []:
            q, r = candidates(segment, queries, best)
            for k in np.lexsort((segment._numbers[r], q)):
                no = segment.numbers[r[k]]
                if no < best[q[k]] and alike(queries[q[k]][1], segment.words(r[k])):
                    best[q[k]] = no
        merged = Segment.merge([own, *(s for step, s in stored if step in due)]) if due else own
        found = best < numbers
        rows = [{"kind": "match", "shard": shard, "number": int(a), "first": int(b)} for a, b in zip(numbers[found], best[found])]
        if len(merged):
            rows.append(merged.row(shard))
        return pd.DataFrame({c: pd.Series([row.get(c) for row in rows], dtype=object) for c in _OUT_COLUMNS})

    return visit


class History:
    """All assertions accepted so far, as immutable suffix-array segments in the shared folder.

    ``add`` checks one batch against every live segment and itself, and writes the batch's own
    segment; segments of equal size class are merged as a binary counter carries, so after b
    batches at most log2(b) + 2 are live and a record is rewritten at most log2(b) times. The first
    batch (the history) is kept as it is. Segments are sharded by hash of the block; a block of more than
    ``HOT_BLOCK`` records is salted over several shards, and its queries go to all of them.

    The segments are a table bucketed by shard: they are read where they lie and written where they are made, and only
    the rows of the batch are shuffled. The table is entered in the session's catalog under a name of its own until ``drop``.
    """

    def __init__(self, spark: SparkSession, shards: int, hot: DataFrame):
        self.spark, self.shards = spark, shards
        self.buckets = min(shards, max(1, spark.sparkContext.defaultParallelism * 4))
        self.hot = hot if hot.take(1) else None
        self.name = f"history_{uuid.uuid4().hex}"
        self.root = f"{ensure_checkpoint_dir(spark)}/{self.name}"
        self.live: list[tuple[int, int]] = []  # (step, level)
        self.count = 0

    def _route(self, batch: DataFrame, search: bool) -> DataFrame:
        """Each row at the shard of its block; a row of a hot block at the shards of all its salts if they are to be searched, at home in one."""
        columns = ["number", "block", "letters"]
        if self.hot is None:
            return batch.select(F.pmod(F.xxhash64("block", F.lit(0).cast("long")), F.lit(self.shards)).alias("shard"), *columns, F.lit(True).alias("home"))
        salts = F.coalesce(F.col("salts"), F.lit(1))
        b = batch.join(self.hot, "block", "left").withColumn("_home", F.pmod(F.xxhash64("letters", "block"), salts))
        to = F.sequence(F.lit(0).cast("long"), (salts - 1).cast("long")) if search else F.array("_home")
        b = b.withColumn("_salt", F.explode(to))
        shard = F.pmod(F.xxhash64("block", "_salt"), F.lit(self.shards))
        return b.select(shard.alias("shard"), *columns, (F.col("_salt") == F.col("_home")).alias("home"))

    def _stored(self, kind: str) -> DataFrame:
        return self.spark.table(self.name).where(F.col("kind") == kind)

    def add(self, batch: DataFrame, search: bool = True) -> None:
        """``batch``: number (smallest of its equals), block, letters; one row for each distinct (block, letters).

        ``search``: False for rows that are accepted without being checked, as the history itself.
        """
        carry = (self.count & -self.count).bit_length() - 1 if self.count else _BASE_LEVEL
        due = frozenset(step for step, level in self.live if level < carry) if carry != _BASE_LEVEL else frozenset()
        read = "step int, " + _OUT
        live = self._stored("segment").where(F.col("step").isin([step for step, _ in self.live])).select("shard", "step", "blocks", "body", *Segment.ARRAYS) if self.live else self.spark.createDataFrame([], read).select("shard", "step")
        right = self._route(batch, search).repartition(self.buckets, "shard")
        done = live.groupBy("shard").cogroup(right.groupBy("shard")).applyInPandas(_visit(due, search), _OUT)
        done.withColumn("step", F.lit(self.count)).write.format("parquet").mode("append").option("path", self.root).partitionBy("kind", "step").bucketBy(self.buckets, "shard").saveAsTable(self.name)
        self.live = [(step, level) for step, level in self.live if step not in due] + [(self.count, carry)]
        self.count += 1

    def found(self) -> DataFrame:
        """(number, first): the smallest earlier number that each batch row repeats, as far as it repeats one."""
        return self._stored("match").groupBy("number").agg(F.min("first").alias("first"))

    def drop(self) -> None:
        """Delete the segments and matches."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


# ------------------------------------------------------------------ the facts


def _trimmed(x: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(x, F.lit("")), r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))


def _led(ws: Column, by: str) -> Column:
    return F.transform(ws, lambda w: F.concat(F.lit(by), w))


def assertions(facts: DataFrame) -> DataFrame:
    """(fact_no, batch_no, block, letters): what two assertions must share exactly, and the words that may differ by slips.

    ``block``: owner, project, conditions, the words with a digit of each field and the number of the
    others; ``letters``: those others, sorted, each led by the letter of its field. Null fields hold no words;
    a null batch number counts as history (0).
    """
    entry = lambda e: F.concat(_trimmed(e["key"]), F.lit("\x02"), _trimmed(e["value"]))
    conditions = F.array_join(F.array_sort(F.array_distinct(F.transform(F.map_entries(F.coalesce("conditions", F.create_map().cast("map<string,string>"))), entry))), "\x03")
    digit = lambda w: w.rlike(r"\p{N}")
    fields = {"s": words(F.col("subject_norm")), "p": words(F.col("predicate_norm")), "o": words(F.col("object_value"))}
    out = facts.select("fact_no", F.coalesce("batch_no", F.lit(0)).alias("batch_no"), "owner_id", "project_id", conditions.alias("_c"), *[w.alias(f"_{n}") for n, w in fields.items()])
    exact = [F.array_join(F.array_sort(F.filter(f"_{n}", digit)), " ") for n in fields]
    rest = {n: F.array_sort(F.filter(f"_{n}", lambda w: ~digit(w))) for n in fields}
    owner, project = (F.coalesce(F.concat(F.lit("="), c), F.lit("-")) for c in ("owner_id", "project_id"))
    block = F.concat_ws("\x01", owner, project, F.col("_c"), *exact, *[F.size(r).cast("string") for r in rest.values()])
    letters = F.concat(*[_led(r, n) for n, r in rest.items()])
    # the fields' order of sorting must be that of the whole list
    return out.select("fact_no", "batch_no", block.alias("block"), F.array_sort(letters).alias("letters"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """(first_no, fact_no): each STATE fact of a later batch that repeats an earlier one, exactly or with up to two slips."""
    facts = table(spark, folder, "facts").where("kind = 'STATE'")
    if not facts.take(1):
        return facts.select(F.col("fact_no").alias("first_no"), "fact_no")
    rows = scratch(spark, "assertions")
    assertions(facts).write.partitionBy("batch_no").parquet(rows)
    answer = cut(repeated(spark.read.parquet(rows)))
    remove(spark, rows)
    return answer


def repeated(kept: DataFrame) -> DataFrame:
    """(first_no, fact_no) of the assertions (fact_no, batch_no, block, letters) of batches above 0 that repeat an earlier one."""
    spark = kept.sparkSession
    total = kept.count()
    hot = cut(kept.groupBy("block").count().where(F.col("count") > HOT_BLOCK).select("block", F.ceil(F.col("count") / HOT_BLOCK).cast("long").alias("salts")))
    history = History(spark, max(2 * spark.sparkContext.defaultParallelism, -(-total // ROWS_PER_SHARD)), hot)
    try:
        for number in sorted(r.batch_no for r in kept.select("batch_no").distinct().collect()):  # one value a batch
            batch = kept.where(F.col("batch_no") == number).groupBy("block", "letters").agg(F.min("fact_no").alias("number"))
            history.add(batch, search=number > 0)
        found = cut(history.found())
    finally:
        history.drop()
        discard(hot)
    later = kept.where("batch_no > 0")
    classes = later.groupBy("batch_no", "block", "letters").agg(F.min("fact_no").alias("number"))
    answer = classes.join(found, "number", "left").select("batch_no", "block", "letters", F.coalesce("first", "number").alias("first_no"))
    return later.join(answer, ["batch_no", "block", "letters"]).where("first_no < fact_no").select("first_no", "fact_no")


# DuckDB counts slips in bytes, so Cyrillic letters are first mapped to single bytes.
P2_SQL = r"""
WITH f AS (
  SELECT fact_no, coalesce(batch_no, 0) AS batch_no, owner_id, project_id,
    list_sort(list_distinct(list_transform(map_entries(coalesce(conditions, MAP {})), lambda e: lower(trim(e.key)) || chr(2) || lower(trim(coalesce(e.value, '')))))) AS cond,
    list_concat(
      list_transform(regexp_extract_all(lower(coalesce(subject_norm, '')), '[\p{L}\p{N}]+'), lambda w: 's' || w),
      list_transform(regexp_extract_all(lower(coalesce(predicate_norm, '')), '[\p{L}\p{N}]+'), lambda w: 'p' || w),
      list_transform(regexp_extract_all(lower(coalesce(object_value, '')), '[\p{L}\p{N}]+'), lambda w: 'o' || w)) AS ws
  FROM facts WHERE kind = 'STATE'),
g AS (SELECT fact_no, batch_no, owner_id, project_id, cond,
    list_sort(list_filter(ws, lambda w: regexp_matches(w, '\p{N}'))) AS exact,
    list_sort(list_transform(list_filter(ws, lambda w: NOT regexp_matches(w, '\p{N}')),
      lambda w: translate(w, 'абвгдежзийклмнопрстуфхцчшщъыьэюяё', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ!#$%&*+'))) AS free
  FROM f),
n AS (SELECT *, list_transform(free, lambda w, i: w || '|' || len(list_filter(free[1:i], lambda x: x = w))) AS numbered,
    list_sort(list_transform(free, lambda w: w[1])) AS shape FROM g),
pair AS (
  SELECT b.fact_no, a.fact_no AS first_no,
    list_transform(list_filter(a.numbered, lambda w: NOT list_contains(b.numbered, w)), lambda w: split_part(w, '|', 1)) AS x,
    list_transform(list_filter(b.numbered, lambda w: NOT list_contains(a.numbered, w)), lambda w: split_part(w, '|', 1)) AS y
  FROM n AS b JOIN n AS a ON a.owner_id IS NOT DISTINCT FROM b.owner_id AND a.project_id IS NOT DISTINCT FROM b.project_id
    AND a.cond = b.cond AND a.exact = b.exact AND a.shape = b.shape AND a.fact_no < b.fact_no
  WHERE b.batch_no > 0)
SELECT min(first_no) AS first_no, fact_no FROM pair
WHERE len(x) = 0
  OR len(x) = 1 AND x[1][1] = y[1][1] AND damerau_levenshtein(x[1], y[1]) <= 2
  OR len(x) = 2 AND (x[1][1] = y[1][1] AND x[2][1] = y[2][1] AND damerau_levenshtein(x[1], y[1]) + damerau_levenshtein(x[2], y[2]) <= 2
    OR x[1][1] = y[2][1] AND x[2][1] = y[1][1] AND damerau_levenshtein(x[1], y[2]) + damerau_levenshtein(x[2], y[1]) <= 2)
GROUP BY fact_no
"""
QUERIES = {"p2_found": p2_found}
SQL = {"p2_found": P2_SQL}
