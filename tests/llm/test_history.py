"""Repeated assertions: slips, suffix arrays, segments, and the whole against brute force."""

import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lorekeep.llm import history
from lorekeep.llm.history import Segment, alike, slips

DDL = "fact_no long, batch_no int, kind string, owner_id string, project_id string, subject_norm string, predicate_norm string, object_value string, conditions map<string,string>"


def neighbours(word, letters="abc"):
    out = {word}
    for i in range(len(word) + 1):
        out |= {word[:i] + c + word[i:] for c in letters}
        if i < len(word):
            out |= {word[:i] + word[i + 1 :]} | {word[:i] + c + word[i + 1 :] for c in letters}
        if i + 1 < len(word):
            out.add(word[:i] + word[i + 1] + word[i] + word[i + 2 :])
    return out


@settings(max_examples=60, deadline=None)
@given(st.text("abc", max_size=5), st.text("abc", max_size=5))
def test_slips_equal_a_search(a, b):
    one = neighbours(a)
    two = set().union(*(neighbours(x) for x in one))
    assert slips(a, b) == (0 if a == b else 1 if b in one else 2 if b in two else 3)


def test_slips_of_very_long_words():
    a = "x" * 3000 + "abc" + "y" * 3000
    assert slips(a, a[:3001] + a[3002:]) == 1 and slips("q" * 2000, "z" * 2000) == 3
    assert slips("p" + "ab" * 500 + "q", "ab" * 500 + "q") == 1
    assert slips("p" + "ab" * 500 + "q", "r" + "ab" * 500 + "s") == 2


@pytest.mark.parametrize(
    ("a", "b", "wanted"),
    [(["owl", "sred"], ["owl", "sred"], True), (["owl", "sred"], ["owk", "srod"], True), (["owl", "sred"], ["oxk", "srod"], False), (["owl"], ["swl"], False), ([], [], True), (["oa"], [], False), (["oa", "ob"], ["ob", "oa"], True)],
)
def test_alike(a, b, wanted):
    assert alike(sorted(a), sorted(b)) is wanted


def test_suffix_array_finds_every_substring():
    rng = random.Random(7)
    texts = [(rng.choice("xy"), sorted("".join(rng.choice("ab") for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(0, 5)))) for _ in range(80)]
    s = Segment.build((b, ws, k) for k, (b, ws) in enumerate(texts))
    assert sorted((b, ws, n) for b, ws, n in s.records()) == sorted((b, ws, k) for k, (b, ws) in enumerate(texts))
    whole = history._text
    for _ in range(300):
        block, n = rng.choice("xyz"), rng.randrange(0, 6)
        words = sorted("".join(rng.choice("ab") for _ in range(rng.randrange(1, 4))) for _ in range(n))
        for part in history.pieces(words)[0] + (history.runs(words) if n > 4 else []):
            low, high = s.find(part, *s.block(block))
            got = {s.numbers[s.owners[k]] for k in range(low, high)}
            starts = lambda ws, part=part: [whole(ws)[p:] for p in range(len(whole(ws))) if len(ws) < 3 or p == 0 or whole(ws)[p - 1] == "\x00"]
            assert got == {k for k, (b, ws) in enumerate(texts) if b == block and any(x.startswith(part) for x in starts(ws))}
    again = Segment.of(s.row(0))
    assert again.arrays == s.arrays and list(again.records()) == list(s.records())


def test_merged_segments_keep_the_first_of_equals():
    a, b = Segment.build([("x", ["oa"], 5), ("y", [], 2)]), Segment.build([("x", ["oa"], 3), ("x", ["ob"], 4)])
    assert sorted(Segment.merge([a, b]).records()) == [("x", ["oa"], 3), ("x", ["ob"], 4), ("y", [], 2)]
    assert len(Segment.build([])) == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=6), min_size=0, max_size=12), st.data())
def test_no_record_within_two_slips_is_missed(words, data):
    """Whatever the number of words, and whether whole words, parts or longer runs are followed."""
    other = list(words)
    for _ in range(2 if words else 0):
        k = data.draw(st.integers(0, len(other) - 1))
        other[k] = data.draw(st.sampled_from(sorted(w for w in neighbours(other[k]) if w)))
    a, b = sorted("s" + w for w in words), sorted("s" + w for w in other)
    s = Segment.build([("b", b, 1)] + [("b", a, k + 2) for k in range(data.draw(st.sampled_from([0, 40])))])
    q, r = history.candidates(s, [("b", a), ("c", a)])
    assert alike(a, b) and set(q.tolist()) <= {0} and 1 in {s.numbers[k] for k in r}


def test_longer_runs_are_followed_where_words_are_common():
    rng = random.Random(8)
    vocabulary = [f"s{a}{b}" for a in "abcdefgh" for b in "abcdefgh"]
    records = [("b", sorted(rng.sample(vocabulary, 40)), k) for k in range(400)]
    s = Segment.build(records)
    for _, ws, k in records[:30]:
        changed = sorted([*rng.sample(ws, 38), "sxx", "syy"])
        assert k in [s.numbers[x] for x in history.candidates(s, [("b", changed)])[1]]


def test_a_batch_moves_its_own_rows_only(spark):
    """The bytes that a small batch shuffles don't depend on the size of the history."""
    from pyspark.sql import functions as F

    def written(size):
        rows = spark.range(size).select(F.col("id").alias("number"), F.concat(F.lit("block"), F.col("id") % 50).alias("block"), F.array(F.concat(F.lit("o"), F.sha2(F.col("id").cast("string"), 256))).alias("letters"))
        h = history.History(spark, 8, spark.createDataFrame([], "block string, salts long"))
        h.add(rows, search=False)
        before = shuffled(spark)
        h.add(rows.where("id < 100").withColumn("number", F.col("number") + 10**9))
        moved = shuffled(spark) - before
        assert {(r.number, r.first) for r in h.found().collect()} == {(10**9 + k, k) for k in range(100)}
        h.drop()
        return moved

    small, large = written(2_000), written(20_000)
    assert 0 < small and abs(large - small) < 0.02 * small


def shuffled(spark):
    """Bytes written to shuffles by this session so far."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    found = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(found.apply(k).totalShuffleWrite() for k in range(found.size()))


def brute(rows):
    def ws(t):
        import re

        return re.findall(r"[^\W_]+", (t or "").lower())

    def same_field(a, b):
        if len(a) != len(b):
            return 3
        best = 3
        for p in itertools.permutations(b):
            cost = 0
            for x, y in zip(a, p):
                cost += 0 if x == y else 3 if any(c.isdigit() for c in x + y) else slips(x, y)
            best = min(best, cost)
        return best

    def cond(m):
        return tuple(sorted({(k.strip().lower(), (v or "").strip().lower()) for k, v in (m or {}).items()}))

    out, seen = set(), []
    for r in sorted(rows):
        if r[2] != "STATE":
            continue
        if (r[1] or 0) > 0:
            for o in seen:
                if o[3:5] == r[3:5] and cond(o[8]) == cond(r[8]) and sum(same_field(ws(o[k]), ws(r[k])) for k in (5, 6, 7)) <= 2:
                    out.add((o[0], r[0]))
                    break
        seen.append(r)
    return out


def found(spark, tmp_path, rows):
    spark.createDataFrame(rows, DDL).write.mode("overwrite").parquet(f"{tmp_path}/facts.parquet")
    return {(r.first_no, r.fact_no) for r in history.p2_found(spark, str(tmp_path)).collect()}


def slipped(rng, text):
    words = text.split(" ")
    for _ in range(rng.randrange(0, 4)):
        k = rng.randrange(len(words))
        if words[k].isalpha():
            words[k] = rng.choice(sorted(neighbours(words[k], "xy")))
    rng.shuffle(words)
    return " ".join(words)


def test_equals_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(history, "HOT_BLOCK", 6)  # so that blocks are salted
    rng = random.Random(9)
    subjects, predicates = ["repo amber falcon 17", "user nell", "queue red fox 3", "a"], ["retry limit", "owner squad"]
    objects = ["payments crew", "research bench", "5", None, "one two three four"]
    rows = []
    for n in range(1, 241):
        o = rng.choice(objects)
        c = rng.choice([None, {}, {}, {"env": "ci"}, {" ENV": "CI "}])
        rows.append((n, [None, 0, 0, 1, 2, 3, 4, 5, 6][min(8, n // 30)], rng.choice(["STATE"] * 5 + ["EVENT", None]), rng.choice(["u", "u", "u", None]), "p", slipped(rng, rng.choice(subjects)), rng.choice(predicates), slipped(rng, o) if o else o, c))
    wanted = brute(rows)
    assert found(spark, tmp_path, rows) == wanted and len(wanted) > 20


def test_nulls_and_empty_tables(spark, tmp_path):
    assert found(spark, tmp_path, []) == set()
    none = (None,) * 6
    rows = [(1, 0, "STATE", *none), (2, 1, "STATE", *none), (3, 1, "STATE", None, None, "", " ", "-", {}), (4, None, "STATE", *none), (5, 2, None, *none)]
    assert found(spark, tmp_path, rows) == {(1, 2), (1, 3)}
