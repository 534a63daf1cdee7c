"""State on immutable tables: latest-wins, cursors, cascades, insert-if-absent, run status, experiments."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, key: list[str], version: list[str]) -> DataFrame:
    """One row for each key, the one with the greatest version; null versions are smallest. A map-side maximum, not a window."""
    rest = [c for c in rows.columns if c not in key]
    best = rows.groupBy(*key).agg(F.max(F.struct(*version, *[c for c in rest if c not in version])).alias("_r"))
    return best.select(*key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def upsert(table: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """``table`` with the rows of ``changes`` (one for each key) in the place of those with the same key."""
    return table.join(changes.select(*key), key, "left_anti").unionByName(changes)


def insert_absent(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """``table`` and those of ``rows`` (one for each key) whose key it lacks; what is there is kept as it is."""
    return table.unionByName(rows.join(table.select(*key), key, "left_anti"))


def reads(table: DataFrame, keys: DataFrame, key: list[str], column: str, default=None) -> DataFrame:
    """(``key``, ``column``) for every row of ``keys``: what the table holds for it, ``default`` where it holds nothing. Null keys match nothing."""
    found = keys.join(table.select(*key, column), key, "left")
    return found if default is None else found.withColumn(column, F.coalesce(column, F.lit(default)))


def listing(table: DataFrame, *order: str, **equal) -> DataFrame:
    """The rows that have the given values, in order; a column name with a leading minus runs downwards. Nulls come last."""
    rows = table
    for c, v in equal.items():
        rows = rows.where(F.col(c) == v)
    return rows.orderBy(*[F.desc_nulls_last(c[1:]) if c[0] == "-" else F.asc_nulls_last(c) for c in order])


def cursor(done: DataFrame, key: str, position: str) -> DataFrame:
    """(``key``, position): the furthest position of each key; it never moves back."""
    return done.groupBy(key).agg(F.max(position).alias("position"))


def processed(log: DataFrame, cursors: DataFrame, key: str, position: str) -> DataFrame:
    """(``key``, total, done): the rows of each key and how many lie at or before its cursor; a key without a cursor is at 0."""
    c = cursors.select(F.col(key).alias("_k"), F.col("position").alias("_p"))
    n = log.join(c, log[key].eqNullSafe(c["_k"]), "left")
    return n.groupBy(key).agg(F.count("*").alias("total"), F.count_if(F.col(position) <= F.coalesce("_p", F.lit(0))).alias("done"))


def pending(log: DataFrame, cursors: DataFrame, key: str, position: str) -> DataFrame:
    """Rows beyond their key's cursor; a key without a cursor is at 0."""
    c = cursors.select(F.col(key).alias("_k"), F.col("position").alias("_p"))
    return log.join(c, log[key].eqNullSafe(c["_k"]), "left").where(F.col(position) > F.coalesce("_p", F.lit(0))).select(*log.columns)


def delete_run(children: dict[str, DataFrame], run: int) -> tuple[dict[str, DataFrame], dict[str, Column]]:
    """Each child table without the rows that the run still owns, and the count expression of those removed.

    Rows that a later run has overwritten carry that run's id and stay.
    """
    gone = F.coalesce(F.col("run_id") == run, F.lit(False))
    return {n: t.where(~gone) for n, t in children.items()}, {n: F.count_if(gone) for n in children}


def cascade(children: DataFrame, parents: DataFrame, key: list[str]) -> DataFrame:
    """The child rows whose parent isn't among the deleted ``parents``."""
    return children.join(parents.select(*key).distinct(), key, "left_anti")


RUN_EVENT = "run_id BIGINT, seq BIGINT, at TIMESTAMP_NTZ, experiment STRING, stage STRING, status STRING, calls BIGINT, prompt_tokens BIGINT, completion_tokens BIGINT"


def run_states(events: DataFrame) -> DataFrame:
    """One row for each run from its event rows (``RUN_EVENT``), added to and never changed: a start, any progress, an end.

    Experiment, stage and start are those of the first event; the status is that of the latest event that names one, so progress keeps it; each counter is the latest one given
    (counters run from the start). An end is the time of the latest event whose status isn't ``running``. ``seq`` orders the events of a run.
    """
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
    over = F.col("status").isNotNull() & (F.col("status") != "running")
    return events.groupBy("run_id").agg(
        F.min_by("experiment", "seq").alias("experiment"), F.min_by("stage", "seq").alias("stage"), F.min_by("at", "seq").alias("started_at"),
        last("status"), *[last(c) for c in ("calls", "prompt_tokens", "completion_tokens")], F.max(F.when(over, F.col("at"))).alias("finished_at"),
    )


def interrupted(runs: DataFrame, experiment: str, stage: str) -> Column:
    """How many runs ``interrupt`` changes, as an aggregate."""
    return F.count_if((F.col("experiment") == experiment) & (F.col("stage") == stage) & (F.col("status") == "running"))


def works(points: DataFrame) -> DataFrame:
    """(n, point_id, bound, kind) in the order in which portraits are to be built, n from 1: by bound, at equal bounds ``w0`` before ``m``, then by point.

    ``points``: point_id, w0 (where the window starts, -1 if nothing lies before it), previous (the message before the point). Without a
    null bound; -1 has nothing to be built from. The order is global, so ranges are ranked and offset by their counts.
    """
    both = points.select("point_id", F.explode(F.array(F.struct(F.col("w0").cast("long").alias("bound"), F.lit("w0").alias("kind"), F.lit(0).alias("tie")), F.struct(F.col("previous").cast("long").alias("bound"), F.lit("m").alias("kind"), F.lit(1).alias("tie")))).alias("x")).select("point_id", "x.*")
    kept = both.where("bound >= 0").withColumn("_range", F.floor(F.col("bound") / 4096))
    inner = kept.withColumn("_r", F.row_number().over(Window.partitionBy("_range").orderBy("bound", "tie", "point_id")))
    ranges = kept.groupBy("_range").agg(F.count("*").alias("_n"))
    before = ranges.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))  # one row for 4096 messages
    return inner.join(before, "_range").select((F.col("_r") + F.col("_o")).alias("n"), "point_id", "bound", "kind")


def replay_branch(bound: Column, cursor_: Column) -> Column:
    """What a bound asks for: ``ingest`` beyond the cursor, ``project`` (evidence cut at the bound) before it, ``build`` at it; a null cursor is 0."""
    c = F.coalesce(cursor_, F.lit(0))
    return F.when(bound > c, "ingest").when(bound < c, "project").otherwise("build")


def interrupt(runs: DataFrame, experiment: str, stage: str) -> DataFrame:
    """``runs`` with the running ones of this experiment and stage set to interrupted."""
    hit = (F.col("experiment") == experiment) & (F.col("stage") == stage) & (F.col("status") == "running")
    return runs.withColumn("status", F.when(hit, "interrupted").otherwise(F.col("status")))


def purge(rows: DataFrame, **equal: str) -> DataFrame:
    """Rows that don't equal all the given values, compared without case and outer space."""
    same = F.lit(True)
    for c, v in equal.items():
        same = same & F.coalesce(F.lower(F.trim(c)) == v.strip().lower(), F.lit(False))
    return rows.where(~same)


def check_points(points: DataFrame) -> DataFrame:
    """``points`` with ``error``: why a point can't be appended, null if it can."""
    known = points.groupBy("id").count().where("count > 1").select(F.col("id").alias("_twice"))
    p = points.join(known, points["id"] == known["_twice"], "left")
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    error = (
        F.when(~F.coalesce(F.col("id").rlike(r"^[A-Za-z0-9._-]+$"), F.lit(False)), "bad id").when(F.col("_twice").isNotNull(), "repeated id")
        .when(~F.coalesce(F.col("level").isin("L1", "C"), F.lit(False)), "bad level").when((F.col("level") == "L1") & blank("truth"), "L1 needs a truth")
        .when((F.col("level") == "C") & (F.coalesce(F.size("must_not"), F.lit(0)) <= 0), "C needs must_not")
    )
    return p.select(*points.columns, error.alias("error"))


def resolve_experiment(experiments: DataFrame, ingest_fp: str, slug: str | None = None) -> str:
    """The slug to work on: the named one, or the only active one; archived ones and another fingerprint are refused."""
    rows = experiments.where(F.col("slug") == slug if slug else F.col("status") == "active").limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"one experiment expected, {len(rows)} found")
    if rows[0].status == "archived":
        raise ValueError(f"{rows[0].slug} is archived")
    if rows[0].ingest_fp not in (None, ingest_fp):
        raise ValueError(f"{rows[0].slug} was ingested otherwise")
    return rows[0].slug


def create_experiment(experiments: DataFrame, facts: DataFrame, cursors: DataFrame, sources: DataFrame, *, slug: str, material: str, ingest_fp: str, answer_fp: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(experiments, facts, cursors) for a new experiment: it is the active one, the others that were are archived, and what is to be ingested anew is gone.

    ``experiments``: slug, material, status, ingest_fp, answer_fp; ``sources``: owner_id, project_id, session_name of the exam points. Facts of their
    owners and projects and the cursors of their sessions are left out. An experiment of the same slug is written over.
    """
    columns = ["slug", "material", "status", "ingest_fp", "answer_fp"]
    old = experiments.where(F.col("slug") != slug).select(*[F.when(F.col("status") == "active", "archived").otherwise(F.col("status")).alias(c) if c == "status" else F.col(c) for c in columns])
    new = experiments.sparkSession.createDataFrame([(slug, material, "active", ingest_fp, answer_fp)], "slug string, material string, status string, ingest_fp string, answer_fp string")
    return old.union(new), cascade(facts, sources, ["owner_id", "project_id"]), cascade(cursors, sources, ["session_name"])


def text_fingerprint(version: str, *lines: str) -> str:
    return hashlib.sha256("\n".join([version, *lines]).encode()).hexdigest()


def create_tables(spark: SparkSession, schemas: dict[str, str]) -> None:
    """Create what is missing; existing tables are left alone, so the call may be repeated."""
    for name, ddl in schemas.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({ddl}) USING parquet")
