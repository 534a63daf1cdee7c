"""Queries on state kept in immutable tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lifecycle as ops
from ..operators import log as logs
from ..sources.tables import table


def answers_latest(spark: SparkSession, folder: str) -> DataFrame:
    """The latest order of each customer."""
    o = table(spark, folder, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    return ops.latest(o, ["o_custkey"], ["o_orderdate", "o_orderkey"])


def rows_upserted(spark: SparkSession, folder: str) -> DataFrame:
    """Portraits per owner and project, with what later batches of facts say written over what the history says."""
    f = table(spark, folder, "facts").where("owner_id is not null and project_id is not null")
    n = lambda rows: rows.groupBy("owner_id", "project_id").agg(F.count("*").alias("facts"), F.max("batch_no").alias("batch"))
    return ops.upsert(n(f.where("batch_no = 0")), n(f.where("batch_no > 0")), ["owner_id", "project_id"])


def insert_absent(spark: SparkSession, folder: str) -> DataFrame:
    """Predicates of the history, and those that only later batches bring."""
    f = table(spark, folder, "facts").where("predicate_norm is not null")
    first = lambda rows: rows.groupBy("predicate_norm").agg(F.min("fact_no").alias("fact_no"))
    return ops.insert_absent(first(f.where("batch_no = 0")), first(f.where("batch_no > 0")), ["predicate_norm"])


def cursor_max(spark: SparkSession, folder: str) -> DataFrame:
    return ops.cursor(table(spark, folder, "messages"), "session_name", "id")


def pending_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Messages beyond what facts have used of their session as evidence."""
    m = table(spark, folder, "messages").select("id", "session_name")
    used = table(spark, folder, "facts").select(F.explode("evidence").alias("id")).distinct()
    return ops.pending(m, ops.cursor(m.join(used, "id", "left_semi"), "session_name", "id"), "session_name", "id")


def run_cascade(spark: SparkSession, folder: str) -> DataFrame:
    """Messages of sessions none of whose rows lacks a time: deleting a session deletes its rows."""
    m = table(spark, folder, "messages")
    return ops.cascade(m.where("session_name is not null").select("session_name", "id"), m.where("created_at is null and session_name is not null"), ["session_name"])


def purged_facts(spark: SparkSession, folder: str) -> DataFrame:
    return ops.purge(table(spark, folder, "facts").select("fact_no", "owner_id", "project_id"), owner_id=" USER:helmvik", project_id="Orbita-Core ")


def run_economy(spark: SparkSession, folder: str) -> DataFrame:
    """Facts, distinct sessions and evidence per batch, with the time it was loaded."""
    f = table(spark, folder, "facts").groupBy("batch_no").agg(F.count("*").alias("facts"), F.count_distinct("session_id").alias("sessions"), F.sum(F.greatest(F.coalesce(F.size("evidence"), F.lit(0)), F.lit(0)).cast("long")).alias("evidence"))
    return table(spark, folder, "fact_batches").select("batch_no", "loaded_at").join(f, "batch_no")


def _used(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    m = table(spark, folder, "messages").select("id", "session_name")
    used = table(spark, folder, "facts").select(F.explode("evidence").alias("id")).distinct()
    return m, ops.cursor(m.join(used, "id", "left_semi"), "session_name", "id")


def processed_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Of each session's messages how many lie at or before what facts have used."""
    return ops.processed(*_used(spark, folder), "session_name", "id")


def checkpoint_reads(spark: SparkSession, folder: str) -> DataFrame:
    """The cursor of every named session, 0 where none was written."""
    m, cursors = _used(spark, folder)
    return ops.reads(cursors, m.where("session_name is not null").select("session_name").distinct(), ["session_name"], "position", 0)


def snapshot_listing(spark: SparkSession, folder: str) -> DataFrame:
    """The portraits of one owner, newest cutoff first."""
    return ops.listing(table(spark, folder, "portrait_snapshots").select("snapshot_id", "owner_id", "project_id", "cutoff"), "-cutoff", "snapshot_id", owner_id="user:helmvik")


def _runs(spark: SparkSession, folder: str) -> DataFrame:
    """Fifty messages by id are the events of one run: the first starts it, every fifth tells its progress, the last ends it, unless it is missing."""
    k, run = F.col("id") % 50, F.floor(F.col("id") / 50)
    events = table(spark, folder, "messages").select(
        run.alias("run_id"), F.col("id").alias("seq"), F.col("created_at").cast("timestamp_ntz").alias("at"), F.concat(F.lit("e"), run % 3).alias("experiment"), F.when(run % 2 == 0, "arms").otherwise("replay").alias("stage"),
        F.when(k == 0, "running").when((k == 49) & (run % 4 != 3), F.when(run % 4 == 2, "failed").otherwise("done")).alias("status"), F.when(k % 5 == 0, k).alias("calls"), F.when(k % 5 == 0, k * 10).alias("prompt_tokens"), F.when(k == 49, F.lit(7)).alias("completion_tokens"),
    )
    return ops.run_states(events)


def run_states(spark: SparkSession, folder: str) -> DataFrame:
    return _runs(spark, folder)


def runs_interrupted(spark: SparkSession, folder: str) -> DataFrame:
    """The runs with those of one experiment and stage that never ended set to interrupted, and how many that were."""
    r = _runs(spark, folder)
    n = r.agg(ops.interrupted(r, "e1", "replay").alias("n")).first().n
    return ops.interrupt(r, "e1", "replay").select("run_id", "status", F.lit(n).alias("interrupted"))


def run_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Calls and tokens of each experiment and stage."""
    return _runs(spark, folder).groupBy("experiment", "stage").agg(F.count("*").alias("runs"), F.sum("calls").alias("calls"), F.sum(F.coalesce("prompt_tokens", F.lit(0)) + F.coalesce("completion_tokens", F.lit(0))).alias("tokens"))


def run_deleted(spark: SparkSession, folder: str) -> DataFrame:
    """Facts without those that batch 8, as a run, still owns."""
    kept, _ = ops.delete_run({"facts": table(spark, folder, "facts").select("fact_no", F.col("batch_no").alias("run_id"))}, 8)
    return kept["facts"]


def _bounds(spark: SparkSession, folder: str) -> DataFrame:
    log = logs.message_log(table(spark, folder, "messages")).where("content is not null")
    return logs.window_start(log).select("id", "session_name", "w0").join(logs.window_start(log, 1).select("id", "previous"), "id").select(F.col("id").alias("point_id"), "session_name", "w0", "previous")


def work_order(spark: SparkSession, folder: str) -> DataFrame:
    """The order in which portraits at every message's window start and at the message before it are built."""
    return ops.works(_bounds(spark, folder))


def replay_branches(spark: SparkSession, folder: str) -> DataFrame:
    """What each message asks for, given how far its session has been ingested."""
    m, cursors = _used(spark, folder)
    c = cursors.select(F.col("session_name").alias("_s"), "position")
    j = m.join(c, m["session_name"].eqNullSafe(c["_s"]), "left")
    return j.select("id", ops.replay_branch(F.col("id"), F.col("position")).alias("branch"))


def points_checked(spark: SparkSession, folder: str) -> DataFrame:
    """Why points made from messages can't be appended, null if they can: bad and repeated ids, unknown levels, missing truths and markers."""
    m, k = table(spark, folder, "messages").select("id", "content"), F.col("id") % 8
    p = m.select(
        F.when(k == 1, F.concat(F.lit("p "), F.col("id"))).when(k == 2, F.concat(F.lit("twin-"), F.floor(F.col("id") / 16))).otherwise(F.concat(F.lit("p-"), F.col("id"))).alias("id"), F.col("id").alias("no"),
        F.when(k == 3, "L2").when(k > 5, "C").otherwise("L1").alias("level"), F.when(k == 4, " ").otherwise("t").alias("truth"), F.when(k == 6, F.array(F.lit("m"))).otherwise(F.array().cast("array<string>")).alias("must_not"),
    )
    return ops.check_points(p).select("no", "error")


def experiment_reset(spark: SparkSession, folder: str) -> DataFrame:
    """The facts that stay when an experiment over the owners and projects of batch 8 is begun anew."""
    f = table(spark, folder, "facts").select("fact_no", "owner_id", "project_id", "batch_no")
    old = spark.createDataFrame([("a", "x", "active", "f", "g")], "slug string, material string, status string, ingest_fp string, answer_fp string")
    cursors = table(spark, folder, "messages").select("session_name", F.col("id").alias("position")).where("false")
    sources = f.where("batch_no = 8").select("owner_id", "project_id", F.lit("s").alias("session_name"))
    _, facts, _ = ops.create_experiment(old, f, cursors, sources, slug="b", material="live", ingest_fp="h", answer_fp="i")
    return facts.select("fact_no")


QUERIES = {
    f.__name__: f
    for f in (
        answers_latest, rows_upserted, insert_absent, cursor_max, pending_messages, processed_messages, checkpoint_reads, snapshot_listing, run_states, runs_interrupted, run_totals, run_deleted, work_order,
        replay_branches, points_checked, experiment_reset, run_cascade, purged_facts, run_economy,
    )
}
_CURSOR = "used AS (SELECT DISTINCT unnest(evidence) AS id FROM facts), c AS (SELECT session_name, max(id) AS p FROM messages JOIN used USING (id) GROUP BY session_name)"
_RUNS = """WITH e AS (SELECT id // 50 AS run_id, id AS seq, id % 50 AS k, created_at AS moment FROM messages),
  s AS (SELECT *, CASE WHEN k = 0 THEN 'running' WHEN k = 49 AND run_id % 4 <> 3 THEN CASE WHEN run_id % 4 = 2 THEN 'failed' ELSE 'done' END END AS status FROM e),
  r AS (SELECT run_id, 'e' || run_id % 3 AS experiment, CASE WHEN run_id % 2 = 0 THEN 'arms' ELSE 'replay' END AS stage, first(moment ORDER BY seq) AS started_at, last(status ORDER BY seq) FILTER (status IS NOT NULL) AS status,
    max(k) FILTER (k % 5 = 0) AS calls, max(k * 10) FILTER (k % 5 = 0) AS prompt_tokens, max(7) FILTER (k = 49) AS completion_tokens, max(moment) FILTER (status IS NOT NULL AND status <> 'running') AS finished_at FROM s GROUP BY run_id)
"""
_N = "SELECT owner_id, project_id, count(*) AS facts, max(batch_no) AS batch FROM facts WHERE owner_id IS NOT NULL AND project_id IS NOT NULL AND batch_no {} 0 GROUP BY ALL"
_F = "SELECT predicate_norm, min(fact_no) AS fact_no FROM facts WHERE predicate_norm IS NOT NULL AND batch_no {} 0 GROUP BY ALL"
SQL = {
    "answers_latest": """SELECT o_custkey, o_orderdate, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1""",
    "rows_upserted": f"WITH a AS ({_N.format('=')}), b AS ({_N.format('>')}) SELECT * FROM b UNION ALL SELECT * FROM a WHERE (owner_id, project_id) NOT IN (SELECT (owner_id, project_id) FROM b)",
    "insert_absent": f"WITH a AS ({_F.format('=')}), b AS ({_F.format('>')}) SELECT * FROM a UNION ALL SELECT * FROM b WHERE predicate_norm NOT IN (SELECT predicate_norm FROM a)",
    "cursor_max": "SELECT session_name, max(id) AS position FROM messages GROUP BY session_name",
    "pending_messages": """WITH used AS (SELECT DISTINCT unnest(evidence) AS id FROM facts), c AS (SELECT session_name, max(id) AS p FROM messages JOIN used USING (id) GROUP BY session_name)
        SELECT m.id, m.session_name FROM messages m LEFT JOIN c ON c.session_name IS NOT DISTINCT FROM m.session_name WHERE m.id > coalesce(p, 0)""",
    "processed_messages": f"WITH {_CURSOR} SELECT m.session_name, count(*) AS total, count(*) FILTER (id <= coalesce(p, 0)) AS done FROM messages m LEFT JOIN c ON c.session_name IS NOT DISTINCT FROM m.session_name GROUP BY m.session_name",
    "checkpoint_reads": f"WITH {_CURSOR} SELECT DISTINCT m.session_name, coalesce(p, 0) AS position FROM messages m LEFT JOIN c USING (session_name) WHERE m.session_name IS NOT NULL",
    "snapshot_listing": "SELECT snapshot_id, owner_id, project_id, cutoff FROM portrait_snapshots WHERE owner_id = 'user:helmvik' ORDER BY cutoff DESC NULLS LAST, snapshot_id",
    "run_states": _RUNS + "SELECT run_id, experiment, stage, started_at, status, calls, prompt_tokens, completion_tokens, finished_at FROM r",
    "runs_interrupted": _RUNS + "SELECT run_id, CASE WHEN hit THEN 'interrupted' ELSE status END AS status, count(*) FILTER (hit) OVER () AS interrupted FROM (SELECT *, coalesce(experiment = 'e1' AND stage = 'replay' AND status = 'running', false) AS hit FROM r)",
    "run_totals": _RUNS + "SELECT experiment, stage, count(*) AS runs, CAST(sum(calls) AS BIGINT) AS calls, CAST(sum(coalesce(prompt_tokens, 0) + coalesce(completion_tokens, 0)) AS BIGINT) AS tokens FROM r GROUP BY ALL",
    "run_deleted": "SELECT fact_no, batch_no AS run_id FROM facts WHERE batch_no IS DISTINCT FROM 8",
    "work_order": """WITH w AS (SELECT id AS point_id, coalesce(lag(id, 6) OVER s, -1) AS w0, coalesce(lag(id) OVER s, 0) AS previous FROM messages WHERE content IS NOT NULL WINDOW s AS (PARTITION BY session_name ORDER BY id)),
        b AS (SELECT point_id, w0 AS bound, 'w0' AS kind FROM w UNION ALL SELECT point_id, previous, 'm' FROM w)
        SELECT row_number() OVER (ORDER BY bound, kind DESC, point_id) AS n, point_id, bound, kind FROM b WHERE bound >= 0""",
    "replay_branches": f"WITH {_CURSOR} SELECT id, CASE WHEN id > coalesce(p, 0) THEN 'ingest' WHEN id < coalesce(p, 0) THEN 'project' ELSE 'build' END AS branch FROM messages m LEFT JOIN c ON c.session_name IS NOT DISTINCT FROM m.session_name",
    "points_checked": """SELECT id AS no, CASE WHEN id % 8 = 1 THEN 'bad id' WHEN id % 8 = 2 AND count(*) FILTER (id % 8 = 2) OVER (PARTITION BY id // 16) > 1 THEN 'repeated id' WHEN id % 8 = 3 THEN 'bad level'
        WHEN id % 8 = 4 THEN 'L1 needs a truth' WHEN id % 8 = 7 THEN 'C needs must_not' END AS error FROM messages""",
    "experiment_reset": "SELECT fact_no FROM facts f WHERE NOT EXISTS (SELECT 1 FROM facts s WHERE s.batch_no = 8 AND s.owner_id = f.owner_id AND s.project_id = f.project_id)",
    "run_cascade": "SELECT session_name, id FROM messages WHERE session_name IS NOT NULL AND session_name NOT IN (SELECT session_name FROM messages WHERE created_at IS NULL AND session_name IS NOT NULL)",
    "purged_facts": "SELECT fact_no, owner_id, project_id FROM facts WHERE NOT coalesce(lower(trim(owner_id)) = 'user:helmvik' AND lower(trim(project_id)) = 'orbita-core', false)",
    "run_economy": """SELECT b.batch_no, b.loaded_at, count(*) AS facts, count(DISTINCT session_id) AS sessions, CAST(sum(coalesce(len(evidence), 0)) AS BIGINT) AS evidence
        FROM fact_batches b JOIN facts f USING (batch_no) GROUP BY ALL""",
}
