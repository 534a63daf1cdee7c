"""Queries on the message log, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.prompts import arm_prompt, batch_texts
from ..functions.text import fingerprint, owner_of, portrait_owner, portrait_project, speaker
from ..operators import log as ops
from ..operators.sequences import positions
from ..sources.tables import table

FIRST_DAY, LAST_DAY = "2025-03-01", "2025-05-31"


def _log(spark: SparkSession, folder: str) -> DataFrame:
    return ops.message_log(table(spark, folder, "messages"))


def message_log(spark: SparkSession, folder: str) -> DataFrame:
    return _log(spark, folder)


def log_day_slice(spark: SparkSession, folder: str) -> DataFrame:
    return ops.day_slice(table(spark, folder, "messages"), FIRST_DAY, LAST_DAY).select("id", "session_name", "created_at")


def log_positions(spark: SparkSession, folder: str) -> DataFrame:
    return positions(table(spark, folder, "messages").select("session_name", "id"), "session_name", "id")


def window_start(spark: SparkSession, folder: str) -> DataFrame:
    return ops.window_start(_log(spark, folder)).select("id", "w0")


def prev_bound(spark: SparkSession, folder: str) -> DataFrame:
    return ops.window_start(_log(spark, folder), 1).select("id", "previous")


def window_transcript(spark: SparkSession, folder: str) -> DataFrame:
    return ops.transcripts(_log(spark, folder))


def greedy_batches(spark: SparkSession, folder: str) -> DataFrame:
    return ops.greedy_batches(_log(spark, folder), ["session_name"], 20, 200)


def segmented_batches(spark: SparkSession, folder: str) -> DataFrame:
    """Batches within the segments that questions of users close."""
    log = _log(spark, folder)
    bounds = log.where((speaker(F.col("peer_name")) == "User") & F.col("content").rlike(r"\?$")).select("session_name", F.col("id").alias("bound_id"))
    seg = ops.segments(log, bounds)
    return ops.greedy_batches(seg, ["session_name", "segment"], 20, 200).join(seg.select("id", "segment"), "id")


def batch_prompts(spark: SparkSession, folder: str) -> DataFrame:
    """The text of each batch as it is put to the extracting model."""
    log = _log(spark, folder)
    b = ops.greedy_batches(log, ["session_name"], 20, 200).join(log.select("id", "session_name", "peer_name", "content"), "id")
    return batch_texts(b, ["session_name", "batch"]).select("first_id", "messages", "text")


def arm_prompts(spark: SparkSession, folder: str) -> DataFrame:
    """For each message the prompt of the arm without memory: the window before it and the message itself."""
    log = _log(spark, folder)
    t = ops.transcripts(log).join(log.select("id", "content"), "id")
    return t.select("id", arm_prompt(F.col("transcript"), F.col("content")).alias("prompt"))


def session_stats(spark: SparkSession, folder: str) -> DataFrame:
    return ops.session_stats(_log(spark, folder))


def reference_answer_asof(spark: SparkSession, folder: str) -> DataFrame:
    return ops.next_by_other(_log(spark, folder))


def speaker_roles(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "messages").select("id", speaker(F.col("peer_name")).alias("speaker"), owner_of(F.col("peer_name")).alias("owner"))


def portrait_keys(spark: SparkSession, folder: str) -> DataFrame:
    m = table(spark, folder, "messages").select("session_name", "peer_name").distinct()
    return m.select("session_name", "peer_name", portrait_owner(F.col("session_name"), owner_of(F.col("peer_name"))).alias("owner"), portrait_project(F.col("session_name"), F.lit("project")).alias("project"))


def message_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    m = table(spark, folder, "messages")
    return m.select("id", fingerprint("message-v1", session=F.col("session_name"), id=F.col("id"), content=F.col("content")).alias("fp"))


def material_label(spark: SparkSession, folder: str) -> DataFrame:
    """What kind of sessions each peer spoke in: live, other, mixed or unknown."""
    m = table(spark, folder, "messages").groupBy("peer_name").agg(
        F.bool_or(F.col("session_name").startswith("live/")).alias("l"), F.bool_or(~F.col("session_name").startswith("live/")).alias("o")
    )
    return m.select("peer_name", F.when(F.col("l") & F.col("o"), "mixed").when(F.col("l"), "live").when(F.col("o"), "other").otherwise("unknown").alias("material"))


_TOKENS = "coalesce(token_count, greatest(1, length(content) // 4), 1)"
_LOG = f"SELECT id, session_name, peer_name, content, CAST({_TOKENS} AS INT) AS tokens, created_at FROM messages"
_ROLE = "CASE WHEN peer_name IS NULL OR lower(peer_name) IN ('user', 'human') THEN 'User' WHEN lower(peer_name) IN ('assistant', 'ai') THEN 'Assistant' ELSE peer_name END"
_BATCHES = """
numbered AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY id) AS rn FROM src),
walk AS (
  SELECT k, id, rn, tokens, 1 AS n, tokens AS total, 1 AS batch FROM numbered WHERE rn = 1
  UNION ALL
  SELECT x.k, x.id, x.rn, x.tokens, CASE WHEN fresh THEN 1 ELSE n + 1 END, CASE WHEN fresh THEN x.tokens ELSE total + x.tokens END, batch + CAST(fresh AS INT)
  FROM (SELECT b.k, b.id, b.rn, b.tokens, w.n, w.total, w.batch, (w.n >= 20 OR w.total >= 200 OR w.total + b.tokens > 200) AS fresh
        FROM walk w JOIN numbered b ON b.k = w.k AND b.rn = w.rn + 1) x)
"""

QUERIES = {
    f.__name__: f
    for f in (
        message_log, log_day_slice, log_positions, window_start, prev_bound, window_transcript, greedy_batches, segmented_batches, batch_prompts, arm_prompts, session_stats,
        reference_answer_asof, speaker_roles, portrait_keys, message_fingerprints, material_label,
    )
}
SQL = {
    "message_log": _LOG,
    "log_day_slice": f"SELECT id, session_name, created_at FROM messages WHERE created_at >= DATE '{FIRST_DAY}' AND created_at < DATE '{LAST_DAY}' + INTERVAL 1 DAY",
    "log_positions": "SELECT session_name, id, row_number() OVER (PARTITION BY session_name ORDER BY id) AS pos FROM messages",
    "window_start": "SELECT id, coalesce(lag(id, 6) OVER (PARTITION BY session_name ORDER BY id), -1) AS w0 FROM messages",
    "prev_bound": "SELECT id, coalesce(lag(id) OVER (PARTITION BY session_name ORDER BY id), 0) AS previous FROM messages",
    "window_transcript": f"""SELECT id, coalesce(string_agg({_ROLE} || ': ' || coalesce(content, ''), chr(10)) OVER (
        PARTITION BY session_name ORDER BY id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), '') AS transcript FROM messages""",
    "greedy_batches": f"WITH RECURSIVE src AS (SELECT coalesce(session_name, '<null>') AS k, id, CAST({_TOKENS} AS BIGINT) AS tokens FROM messages), {_BATCHES} SELECT id, CAST(batch AS BIGINT) AS batch FROM walk",
    "segmented_batches": f"""WITH RECURSIVE marked AS (SELECT session_name, id, CAST({_TOKENS} AS BIGINT) AS tokens,
          coalesce(sum(CAST({_ROLE} = 'User' AND coalesce(regexp_matches(content, '\\?$'), false) AS INT)) OVER (PARTITION BY session_name ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS segment FROM messages),
        src AS (SELECT coalesce(session_name, '<null>') || '#' || segment AS k, id, tokens FROM marked), {_BATCHES}
        SELECT w.id, CAST(batch AS BIGINT) AS batch, CAST(segment AS BIGINT) AS segment FROM walk w JOIN marked USING (id)""",
    "batch_prompts": f"""WITH RECURSIVE src AS (SELECT coalesce(session_name, '<null>') AS k, id, CAST({_TOKENS} AS BIGINT) AS tokens FROM messages), {_BATCHES}
        SELECT min(id) AS first_id, count(*) AS messages, string_agg('[' || id || '] ' || coalesce(peer_name, 'user') || ': ' || coalesce(content, ''), chr(10) ORDER BY id) AS text FROM walk JOIN messages USING (id) GROUP BY k, batch""",
    "arm_prompts": f"""SELECT id, coalesce(string_agg({_ROLE} || ': ' || coalesce(content, ''), chr(10)) OVER (
        PARTITION BY session_name ORDER BY id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), '') || chr(10) || 'User: ' || coalesce(content, '') AS prompt FROM messages""",
    "session_stats": f"""SELECT session_name, count(*) AS messages, CAST(sum(tokens) AS BIGINT) AS tokens, min(id) AS first_id, max(id) AS last_id,
        min(created_at) AS first_at, max(created_at) AS last_at FROM ({_LOG}) GROUP BY session_name""",
    "reference_answer_asof": f"""SELECT id, first_value(CASE WHEN role <> 'User' THEN id END IGNORE NULLS) OVER (
        PARTITION BY session_name ORDER BY id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS reply_id FROM (SELECT *, {_ROLE} AS role FROM messages)""",
    "speaker_roles": f"SELECT id, {_ROLE} AS speaker, regexp_replace(lower(trim(peer_name)), '^user-', 'user:') AS owner FROM messages",
    "portrait_keys": """SELECT DISTINCT session_name, peer_name, CASE WHEN session_name LIKE 'lme-%' THEN 'user:' || session_name ELSE regexp_replace(lower(trim(peer_name)), '^user-', 'user:') END AS owner,
        CASE WHEN session_name LIKE 'lme-%' THEN session_name ELSE 'project' END AS project FROM messages""",
    "message_fingerprints": "SELECT id, sha256('message-v1' || chr(10) || 'session=' || coalesce(session_name, '') || chr(10) || 'id=' || id || chr(10) || 'content=' || coalesce(content, '')) AS fp FROM messages",
    "material_label": """SELECT peer_name, CASE WHEN l AND o THEN 'mixed' WHEN l THEN 'live' WHEN o THEN 'other' ELSE 'unknown' END AS material FROM (
        SELECT peer_name, bool_or(session_name LIKE 'live/%') AS l, bool_or(session_name NOT LIKE 'live/%') AS o FROM messages GROUP BY peer_name)""",
}
