"""Ordered conversations from message rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import cut, discard
from ..sources.tables import table

# White space of any kind, zero-width space and byte-order mark.
_NOTHING = r"^[\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200B}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}\x{001C}-\x{001F}]*$"


def shows_nothing(text: Column) -> Column:
    return text.isNull() | text.rlike(_NOTHING)


def resolve(nodes: DataFrame) -> DataFrame:
    """(node, root, depth, state) from (node, parent), by iterative pointer jumping.

    ``state`` is ``ok`` for a node
    whose ancestors end in a node without a parent (``depth`` 1 for that root itself), ``orphan`` where they end in a
    parent that no row has (root: the topmost existing ancestor; depth counts from it), ``cycle`` where they never end
    (root and depth null). ``node`` must be unique and non-null; a node that is its own parent is a cycle. An empty table gives an empty result.

    Every open node's pointer is replaced by its target's pointer and the distances add up, so paths
    of n nodes resolve in log2(n) joins; a target that is already resolved resolves at once. Only open
    nodes are joined again, against the state of all. Each round's tables are cut through the shared folder;
    those of open nodes are deleted when the next round is done.
    """
    n = nodes.select("node", "parent")
    known = n.select(F.col("node").alias("parent"), F.lit(True).alias("_known"))
    start = n.join(known, "parent", "left")
    state = cut(
        start.select(
            "node",
            F.when(F.col("_known"), F.col("parent")).otherwise(F.col("node")).alias("up"),
            F.when(F.col("_known"), F.lit(1)).otherwise(F.lit(0)).cast("long").alias("dist"),
            F.coalesce("_known", F.lit(False)).alias("open"),
            (F.col("parent").isNotNull() & F.col("_known").isNull()).alias("orphan"),
        ),
        parts="open",
    )
    rounds = max(1, state.count()).bit_length() + 1  # as many as a path through all nodes takes
    done, live, tables = state.where("not open"), state.where("open"), [state]
    for _ in range(rounds):
        if not live.take(1):
            break
        everyone = done.union(live).select(F.col("node").alias("up"), F.col("up").alias("_up"), F.col("dist").alias("_d"), F.col("open").alias("_open"), F.col("orphan").alias("_orphan"))
        jumped = live.join(everyone, "up").select(
            "node", F.col("_up").alias("up"), (F.col("dist") + F.col("_d")).alias("dist"), F.col("_open").alias("open"), F.col("_orphan").alias("orphan")
        )
        jumped = cut(jumped, parts="open")
        discard(tables[-1], part="open=true")
        tables.append(jumped)
        done, live = done.union(jumped.where("not open")), jumped.where("open")
    ok = done.select("node", F.col("up").alias("root"), (F.col("dist") + 1).alias("depth"), F.when(F.col("orphan"), "orphan").otherwise("ok").alias("state"))
    return ok.union(live.select("node", F.lit(None).cast(dict(nodes.dtypes)["node"]), F.lit(None).cast("long"), F.lit("cycle")))


def reply_to_previous(rows: DataFrame, *, thread: str, node: str, at: str) -> DataFrame:
    """(node, parent): a pointer from each row to the row before it in its thread by (``at``, ``node``); null from a thread's first row.

    The rows are sorted over the whole cluster by (thread, at, node) in ranges of equal size, so a thread that holds a third of
    all rows, or all of its rows in one hour, is spread over many tasks like any other. Each range looks back within itself; the
    first row of a range gets the last row of the range before from a table of one row a range.
    """
    ranges = rows.sparkSession.sparkContext.defaultParallelism * 2
    r = rows.select(F.col(thread).alias("_t"), F.col(at).alias("_at"), F.col(node).alias("node"))
    r = cut(r.repartitionByRange(ranges, "_t", "_at", "node").withColumn("_range", F.spark_partition_id()))
    w = Window.partitionBy("_range").orderBy("_t", "_at", "node")
    ends = r.groupBy("_range").agg(F.max(F.struct("_t", "_at", "node")).alias("_end"), F.min(F.struct("_t", "_at", "node"))["node"].alias("node"))
    over = Window.orderBy("_range")  # one row a range
    before = ends.select("node", F.lag("_end").over(over).alias("_end")).where("_end is not null")
    inner = r.select("node", "_t", F.lag("node").over(w).alias("_before"), F.lag("_t").over(w).alias("_bt"))
    joined = inner.join(F.broadcast(before), "node", "left")
    same = F.when(F.col("_t") == F.coalesce(F.col("_bt"), F.col("_end._t")), F.coalesce(F.col("_before"), F.col("_end.node")))
    out = joined.select("node", same.alias("parent"))
    out._scratch_path = r._scratch_path  # for ``discard``, once the pointers have been read
    return out


def role(peer: Column) -> Column:
    p = F.lower(F.regexp_replace(peer, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    user = p.isNull() | p.isin("user", "human") | p.startswith("user-") | p.startswith("human-")
    helper = p.isin("assistant", "ai") | p.startswith("agent-") | p.startswith("assistant-")
    return F.when(user, "User").when(helper, "Assistant").otherwise("Other")


def conversations(messages: DataFrame) -> DataFrame:
    """(session_name, turn_no, message_id, speaker) of every whole conversation, in order.

    Rows without a session name belong to none; a session with a row that lacks a time is broken
    and left out; of copies (session, peer, time and content, null equal to null) the smallest id
    stays; rows whose content shows nothing go. A session is kept if, ``Other`` aside, its first row
    is by ``User`` and its last by ``Assistant``. Equal times are ordered by id. Each row's parent is
    the row before it; the pointers of all rows are resolved by pointer jumping, and a row's turn is its depth on the path from its root.
    Orphans and cycles cannot arise from such pointers; were there any, they would be left out.
    An empty table gives an empty result; columns beyond the five used are ignored.
    """
    m = messages.select("id", "session_name", "peer_name", "content", "created_at").where(F.col("session_name").isNotNull() & ~shows_nothing(F.col("session_name")))
    broken = m.where("created_at is null").select("session_name").distinct()
    rows = m.where("created_at is not null").where(~shows_nothing(F.col("content")))
    kept = rows.groupBy("session_name", "peer_name", "created_at", "content").agg(F.min("id").alias("id"))
    kept = cut(kept.join(broken, "session_name", "left_anti").select("session_name", "id", "created_at", role(F.col("peer_name")).alias("speaker")))
    voices = kept.where("speaker <> 'Other'").groupBy("session_name").agg(
        F.min(F.struct("created_at", "id", "speaker"))["speaker"].alias("first"), F.max(F.struct("created_at", "id", "speaker"))["speaker"].alias("last")
    )
    whole = kept.join(voices.where("first = 'User' and last = 'Assistant'").select("session_name"), "session_name", "left_semi")
    whole = cut(whole)
    discard(kept)
    links = reply_to_previous(whole, thread="session_name", node="id", at="created_at")
    paths = resolve(links).where("state = 'ok'")
    discard(links)
    turns = paths.select(F.col("node").alias("id"), F.col("depth").alias("turn_no"))
    return whole.join(turns, "id").select("session_name", "turn_no", F.col("id").alias("message_id"), "speaker")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """The conversations of the message log."""
    return conversations(table(spark, folder, "messages"))


def planted(messages: DataFrame) -> DataFrame:
    """(node, parent) of all messages with a session and a time, each answering the row before it, with faults put in.

    A row whose id is divisible by 97 answers a message that doesn't exist; the first row of a session answers its last row if its own id
    is divisible by 3. The second is a cycle, unless one of the first kind stands between them.
    """
    m = messages.where("session_name is not null and created_at is not null").select("session_name", "id", "created_at")
    links = reply_to_previous(m, thread="session_name", node="id", at="created_at")
    sessions = m.groupBy("session_name").agg(F.min(F.struct("created_at", "id"))["id"].alias("node"), F.max(F.struct("created_at", "id"))["id"].alias("_last"))
    faulty = links.join(sessions.select("node", "_last"), "node", "left")
    parent = F.when(F.col("node") % 97 == 0, -F.col("node")).when(F.col("_last").isNotNull() & (F.col("node") % 3 == 0), F.col("_last")).otherwise(F.col("parent"))
    out = faulty.select("node", parent.alias("parent"))
    out._scratch_path = links._scratch_path
    return out


def p4_states(spark: SparkSession, folder: str) -> DataFrame:
    """(node, root, depth, state) of every message under reply pointers with planted orphans and cycles."""
    links = planted(table(spark, folder, "messages"))
    states = resolve(links)
    discard(links)
    return states


# Along a session a new path starts at its first row and at every orphan; a first row that points to the last one continues
# the last path, or closes a cycle if that is its own.
P4_STATES_SQL = """
WITH m AS (SELECT session_name, id, created_at, row_number() OVER w AS k, first(id) OVER w AS head
  FROM messages WHERE session_name IS NOT NULL AND created_at IS NOT NULL WINDOW w AS (PARTITION BY session_name ORDER BY created_at, id)),
p AS (SELECT *, count(*) FILTER (id % 97 = 0 OR k = 1) OVER (PARTITION BY session_name ORDER BY k) AS path FROM m),
q AS (SELECT *, max(path) OVER (PARTITION BY session_name) AS last_path, min(k) OVER (PARTITION BY session_name, path) AS k0,
  first(id) OVER (PARTITION BY session_name, path ORDER BY k) AS top, max(k) OVER (PARTITION BY session_name) AS n,
  head % 97 <> 0 AND head % 3 = 0 AS turned FROM p),
t AS (SELECT DISTINCT session_name, top AS last_top, k0 AS last_k0 FROM q WHERE path = last_path)
SELECT id AS node,
  CASE WHEN path > 1 OR NOT turned THEN top WHEN last_path = 1 THEN NULL ELSE last_top END AS root,
  CASE WHEN path > 1 OR NOT turned THEN k - k0 + 1 WHEN last_path = 1 THEN NULL ELSE k + n - last_k0 + 1 END AS depth,
  CASE WHEN path > 1 THEN 'orphan' WHEN turned THEN CASE WHEN last_path = 1 THEN 'cycle' ELSE 'orphan' END WHEN head % 97 = 0 THEN 'orphan' ELSE 'ok' END AS state
FROM q JOIN t USING (session_name)
"""
P4_SQL = r"""
WITH m AS (SELECT * FROM messages WHERE session_name IS NOT NULL AND NOT regexp_full_match(session_name, '[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200B}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]*')),
ok AS (SELECT * FROM m WHERE session_name NOT IN (SELECT session_name FROM m WHERE created_at IS NULL)),
one AS (SELECT min(id) AS id, session_name, peer_name, created_at, content FROM ok GROUP BY ALL),
shown AS (SELECT *, lower(regexp_replace(peer_name, '^[\s\x{A0}]+|[\s\x{A0}]+$', '', 'g')) AS p FROM one
  WHERE content IS NOT NULL AND NOT regexp_full_match(content, '[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200B}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]*')),
said AS (SELECT *, CASE WHEN p IS NULL OR p IN ('user', 'human') OR p LIKE 'user-%' OR p LIKE 'human-%' THEN 'User'
  WHEN p IN ('assistant', 'ai') OR p LIKE 'agent-%' OR p LIKE 'assistant-%' THEN 'Assistant' ELSE 'Other' END AS speaker FROM shown),
kept AS (SELECT session_name FROM (
  SELECT session_name, first(speaker ORDER BY created_at, id) AS a, last(speaker ORDER BY created_at, id) AS b FROM said WHERE speaker <> 'Other' GROUP BY session_name)
  WHERE a = 'User' AND b = 'Assistant')
SELECT session_name, row_number() OVER (PARTITION BY session_name ORDER BY created_at, id) AS turn_no, id AS message_id, speaker
FROM said WHERE session_name IN (SELECT session_name FROM kept)
"""
QUERIES = {"p4_found": p4_found, "p4_states": p4_states}
SQL = {"p4_found": P4_SQL, "p4_states": P4_STATES_SQL}
