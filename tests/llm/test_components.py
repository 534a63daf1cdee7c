"""Groups of matched records against union-find."""

import random

from pyspark.sql import functions as F

from lorekeep.llm import components


def groups(spark, nodes, edges):
    n = spark.createDataFrame([(x,) for x in nodes], "s string")
    e = spark.createDataFrame(edges, "a string, b string")
    return {r.node: r.component for r in components.components(n, e).collect()}


def union_find(nodes, edges):
    up = {x: x for x in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            x, y = sorted((find(a), find(b)))
            up[y] = x
    return {x: find(x) for x in up}


def test_random_graphs(spark):
    rng = random.Random(1)
    nodes = [f"n{i}" for i in range(60)]
    edges = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(45)] + [(None, "n1"), ("n2", None), ("n3", "n3"), ("n4", "n5"), ("n5", "n4"), ("n4", "n5")]
    assert groups(spark, nodes, edges) == union_find(nodes, edges)


def test_chain_ring_and_hub(spark):
    chain = [(f"c{i:03}", f"c{i + 1:03}") for i in range(70)]
    ring = [(f"r{i}", f"r{(i + 1) % 9}") for i in range(9)]
    hub = [("hub", f"h{i}") for i in range(40)]
    edges = chain + ring + hub
    nodes = sorted({x for e in edges for x in e} | {"alone", "Ä", ""})
    assert groups(spark, nodes, edges) == union_find(nodes, edges)


def test_empty(spark):
    assert groups(spark, [], []) == {}
    assert groups(spark, ["x"], []) == {"x": "x"}
    assert groups(spark, ["x"], [(None, None)]) == {"x": "x"}


def test_query_keeps_every_subject(spark, tmp_path):
    rows = [("b", "a", 0.6), ("a", "b", 0.1), ("c", "d", 0.59), ("e", None, 0.9), (None, "f", 0.9), ("g", "h", None), ("i", "i", 1.0), ("b", "z", 0.7)]
    spark.createDataFrame(rows, "subject_a string, subject_b string, similarity double").withColumn("subject", F.lit("clash")).write.parquet(f"{tmp_path}/split_candidates.parquet")
    got = {r.subject: r.group_subject for r in components.p5_found(spark, str(tmp_path)).collect()}
    assert got == {"a": "a", "b": "a", "z": "a", **{x: x for x in "cdefghi"}}
