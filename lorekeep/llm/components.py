"""Groups of records that pairwise matches link directly or through others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import cut, discard
from ..sources.tables import table


def _collapse(parents: DataFrame) -> DataFrame:
    """(node, parent) of a forest, roots pointing at themselves -> the same with each node's root as its parent, by pointer doubling."""
    while True:
        before = parents
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        parents = cut(
            parents.join(up, "parent").select("node", F.col("above").alias("parent"), (F.col("above") != F.col("parent")).alias("moved"))
        )
        discard(before)
        if not parents.where("moved").take(1):
            return parents


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): the component of each node, named by its smallest node.

    ``nodes``: one column of distinct non-null ids; ``edges``: two columns of ids, any direction,
    repeated or not. Nulls and loops link nothing; an id that occurs only in ``edges`` is added to
    the nodes. Empty tables give an empty result; extra columns must be selected away by the caller.

    Deterministic Boruvka hooking. Edges are ordered by their (smaller, larger) end, so every
    component has exactly one smallest outgoing edge and hooks along it; the only cycles are two
    components that chose the same edge, where the smaller becomes the root. Trees collapse by
    pointer doubling, edges are relabelled by root and deduplicated, until none remain. Components at
    least halve in each round. Each round's tables are cut through the shared folder.
    Choosing is a map-side minimum, so a hub that holds a third of all pairs is reduced before it
    is shuffled; relabelling joins it to one row, which adaptive execution splits.
    """
    node, (a, b) = nodes.columns[0], edges.columns[:2]
    e = cut(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u < v").distinct())
    labels = None  # (node, root) of every node that has an edge; its root changes round by round
    while e.take(1):
        ends = e.select(F.col("u").alias("node"), "u", "v").union(e.select(F.col("v").alias("node"), "u", "v"))
        chosen = ends.groupBy("node").agg(F.min(F.struct("u", "v")).alias("edge"))
        target = F.when(F.col("edge.u") == F.col("node"), F.col("edge.v")).otherwise(F.col("edge.u"))
        hooks = chosen.select("node", target.alias("target"))
        back = hooks.select(F.col("node").alias("target"), F.col("target").alias("again"))
        mutual = (F.col("again") == F.col("node")) & (F.col("node") < F.col("target"))
        parents = hooks.join(back, "target").select("node", F.when(mutual, F.col("node")).otherwise(F.col("target")).alias("parent"))
        flat = _collapse(cut(parents))
        step = flat.select("node", F.col("parent").alias("root"))
        if labels is None:
            labels = cut(step)
        else:
            moved = step.select(F.col("node").alias("root"), F.col("root").alias("new"))
            old, labels = labels, cut(labels.join(moved, "root", "left").select("node", F.coalesce("new", "root").alias("root")))
            discard(old)
        left, right = step.select(F.col("node").alias("u"), F.col("root").alias("ru")), step.select(F.col("node").alias("v"), F.col("root").alias("rv"))
        old, e = e, cut(
            e.join(left, "u").join(right, "v").where("ru != rv").select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct()
        )
        discard(old, flat)
    alone = nodes.select(F.col(node).alias("node")).where("node is not null")
    if labels is None:
        return alone.distinct().select(F.col("node"), F.col("node").alias("component"))
    smallest = labels.groupBy("root").agg(F.min("node").alias("component"))
    grouped = labels.join(smallest, "root").select("node", "component")
    return grouped.union(alone.distinct().join(grouped, "node", "left_anti").select("node", F.col("node").alias("component")))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every subject of the candidate pairs with the smallest subject of its group (similarity >= 0.6)."""
    pairs = table(spark, folder, "split_candidates")
    sides = pairs.select(F.col("subject_a").alias("subject")).union(pairs.select("subject_b"))
    found = components(sides.where("subject is not null").distinct(), pairs.where("similarity >= 0.6").select("subject_a", "subject_b"))
    return found.select(F.col("node").alias("subject"), F.col("component").alias("group_subject"))


QUERIES = {"p5_found": p5_found}
P5_SQL = """
WITH RECURSIVE pair AS (
  SELECT DISTINCT subject_a AS a, subject_b AS b FROM split_candidates
  WHERE subject_a IS NOT NULL AND subject_b IS NOT NULL AND subject_a <> subject_b AND similarity >= 0.6),
link AS (SELECT a, b FROM pair UNION SELECT b, a FROM pair),
node AS (SELECT subject_a AS s FROM split_candidates WHERE subject_a IS NOT NULL
  UNION SELECT subject_b FROM split_candidates WHERE subject_b IS NOT NULL),
reach AS (SELECT s, s AS t FROM node UNION SELECT r.s, l.b FROM reach r JOIN link l ON l.a = r.t)
SELECT s AS subject, min(t) AS group_subject FROM reach GROUP BY s
"""
SQL = {"p5_found": P5_SQL}
