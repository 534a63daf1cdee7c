"""Queries on validity and knowledge in time, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.asof import known_at
from ..sources.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Per portrait, the state facts that held at its cutoff and were known by then."""
    facts = table(spark, folder, "facts").where(
        (F.col("kind") == "STATE") & (F.col("conditions").isNull() | (F.size("conditions") == 0))
    )
    return known_at(
        facts,
        table(spark, folder, "portrait_snapshots"),
        entity={
            "owner": (F.col("owner_id"), F.col("owner_id")),
            "project": (F.coalesce("project_id", F.lit("")), F.coalesce("project_id", F.lit(""))),
        },
        item={"subject": F.col("subject_norm"), "predicate": F.col("predicate_norm")},
        start=F.coalesce("valid_from", "created_at"),
        known=F.col("created_at"),
        end=F.col("valid_to"),
        fact_id="fact_no",
        at=F.col("cutoff"),
        moment_id="snapshot_id",
    )


P1_SQL = """
SELECT snapshot_id, fact_no FROM (
  SELECT s.snapshot_id, f.fact_no, row_number() OVER (
    PARTITION BY s.snapshot_id, f.subject_norm, f.predicate_norm
    ORDER BY coalesce(f.valid_from, f.created_at) DESC, f.created_at DESC, f.fact_no DESC) AS rn
  FROM portrait_snapshots s JOIN facts f
    ON f.owner_id = s.owner_id AND coalesce(f.project_id, '') = coalesce(s.project_id, '')
  WHERE f.kind = 'STATE' AND (f.conditions IS NULL OR cardinality(f.conditions) = 0)
    AND f.created_at <= s.cutoff AND coalesce(f.valid_from, f.created_at) <= s.cutoff
    AND (f.valid_to IS NULL OR f.valid_to > s.cutoff))
WHERE rn = 1
"""

QUERIES = {"p1_found": p1_found}
SQL = {"p1_found": P1_SQL}
