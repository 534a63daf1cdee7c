"""Pointer jumping and whole conversations."""

import datetime as dt

from pyspark.sql import functions as F

from lorekeep.llm import threads

T = dt.datetime(2025, 1, 1)
DDL = "id long, session_name string, peer_name string, content string, created_at timestamp_ntz"


def test_chain_tree_orphans_and_cycles(spark):
    rows = [(i, i - 1 if i > 1 else None) for i in range(1, 41)] + [(100, 3), (200, 999), (201, 200), (300, 301), (301, 302), (302, 300), (303, 300), (400, 400)]
    got = {r.node: (r.root, r.depth, r.state) for r in threads.resolve(spark.createDataFrame(rows, "node long, parent long")).collect()}
    assert all(got[i] == (1, i, "ok") for i in range(1, 41))
    assert got[100] == (1, 4, "ok")
    assert got[200] == (200, 1, "orphan") and got[201] == (200, 2, "orphan")
    assert all(got[i] == (None, None, "cycle") for i in (300, 301, 302, 303, 400))
    assert len(got) == len(rows)


def test_no_rows(spark):
    assert threads.resolve(spark.createDataFrame([], "node long, parent long")).count() == 0
    assert threads.conversations(spark.createDataFrame([], DDL)).count() == 0


def turns(spark, rows):
    df = spark.createDataFrame([(i, s, p, c, None if t is None else T + dt.timedelta(minutes=t)) for i, s, p, c, t in rows], DDL).withColumn("turn_no", F.lit("clash"))
    return sorted((r.session_name, r.turn_no, r.message_id, r.speaker) for r in threads.conversations(df).collect())


def test_kept_and_dropped(spark):
    rows = [
        (1, "s", "user-x", "hi", 0), (2, "s", " Agent-y ", "yo", 5), (3, "s", "system", "note", 6),
        (4, "broken", None, "hi", 0), (5, "broken", "ai", "yo", None),
        (6, "noreply", "human", "hi", 0), (7, "empty", "user", " ", 0), (8, "empty", "ai", "﻿​", 1),
        (9, None, "user", "hi", 0), (10, None, "ai", "yo", 1), (11, "  ", "user", "hi", 0), (12, "  ", "ai", "yo", 1),
        (13, "cut", "ai", "yo", 0), (14, "cut", "user", "hi", 1), (15, "cut", "ai", "yo", 2), (16, "others", "bot", "x", 0),
    ]
    assert turns(spark, rows) == [("s", 1, 1, "User"), ("s", 2, 2, "Assistant"), ("s", 3, 3, "Other")]


def test_copies_ties_and_order_of_arrival(spark):
    rows = [(9, "s", "user", "late", 0), (5, "s", "ai", "b", 1), (4, "s", "ai", "a", 1), (7, "s", "ai", "a", 1), (6, "s", None, "q", 0), (8, "s", None, "q", 0)]
    assert turns(spark, rows) == [("s", 1, 6, "User"), ("s", 2, 9, "User"), ("s", 3, 4, "Assistant"), ("s", 4, 5, "Assistant")]


def test_a_session_within_one_hour_is_spread_over_many_tasks(spark):
    rows = [(i, "hot", T + dt.timedelta(seconds=(i * 7919) % 3000)) for i in range(1, 2001)] + [(i, f"s{i % 50}", T) for i in range(2001, 3001)]
    df = spark.createDataFrame(rows, "id long, session_name string, created_at timestamp_ntz")
    got = {r.node: r.parent for r in threads.reply_to_previous(df, thread="session_name", node="id", at="created_at").collect()}
    wanted, last = {}, {}
    for i, s, t in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        wanted[i] = last.get(s)
        last[s] = i
    assert got == wanted


def test_long_session_over_many_hours(spark):
    rows = [(i, "long", "user" if i % 2 else "assistant", "x" * (i % 3 + 1) + str(i), 7 * i) for i in range(1, 301)]
    got = turns(spark, rows)
    assert [(t, m) for _, t, m, _ in got] == [(i, i) for i in range(1, 301)]


def test_roles(spark):
    df = spark.createDataFrame([(p,) for p in (None, "USER", " human", "human-1", "Agent-z", "AI", "assistant-2", "userx", "", "tool")], "p string")
    assert [r[0] for r in df.select(threads.role(F.col("p"))).collect()] == ["User"] * 4 + ["Assistant"] * 3 + ["Other"] * 3
