"""Queries on benchmark records and on prompts with memory, with their SQL.

The records are made from the message log: twenty messages by id are one record, dealt into four dialogues by id, and written to the shared folder
as JSON arrays, so that they are read back by the same reader as a benchmark's file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.parsing import readable
from ..functions.prompts import arm_prompt, batch_line
from ..functions.text import cut_text, progress, project_of
from ..operators import lifecycle, providers
from ..operators import log as logs
from ..operators import portrait as portraits
from ..operators.sequences import positions
from ..shared import scratch
from ..sources import logs as sources
from ..sources import sinks
from ..sources.tables import table
from ..streaming import ingest
from .portraits import whole_sql

WINDOW, WORDS = 4, 8
DAY = "2025-03-30"
TOP = 10


def _dialogues(spark: SparkSession, folder: str) -> DataFrame:
    m = table(spark, folder, "messages").select((F.floor(F.col("id") / 20)).alias("q"), (F.col("id") % 4).alias("s"), "id", "peer_name", "content", "created_at")
    turns = F.transform(F.array_sort(F.collect_list(F.struct("id", "peer_name", "content"))), lambda x: F.struct(F.coalesce(x["peer_name"], F.lit("user")).alias("role"), F.coalesce(x["content"], F.lit("")).alias("content")))
    day = F.date_format(F.min("created_at"), "yyyy/MM/dd (EEE) HH:mm")
    return m.groupBy("q", "s").agg(turns.alias("turns"), F.coalesce(day, F.lit("unknown")).alias("day"))


def _record_rows(spark: SparkSession, folder: str) -> DataFrame:
    each = _dialogues(spark, folder).groupBy("q").agg(F.array_sort(F.collect_list(F.struct("s", "day", "turns"))).alias("d"))
    kind = F.when(F.col("q") % 3 == 0, "single").when(F.col("q") % 3 == 1, "multi").otherwise("other")
    answer = F.when(F.col("q") % 5 == 0, F.lit("one two three four five six seven eight nine")).when(F.col("q") % 7 == 0, F.lit(" ")).otherwise(F.concat(F.lit("answer "), F.col("q")))
    return each.select(
        F.concat(F.lit("q"), F.col("q")).alias("question_id"), kind.alias("question_type"), F.concat(F.lit('What of "}{" in '), F.col("q"), F.lit("?")).alias("question"), answer.alias("answer"),
        F.lit("2026/01/02 (Fri) 03:04").alias("question_date"), F.transform("d", lambda x: x["day"]).alias("haystack_dates"), F.transform("d", lambda x: x["turns"]).alias("haystack_sessions"),
    )


def _records(spark: SparkSession, folder: str) -> DataFrame:
    """The records, written as JSON arrays and read back."""
    path = scratch(spark, "records")
    sinks.json_arrays(_record_rows(spark, folder), path)
    return sources.records(spark, path)


def benchmark_log(spark: SparkSession, folder: str) -> DataFrame:
    """Every record as one log."""
    log = sources.record_log(sources.last_of(_records(spark, folder)))
    return log.select("question_id", "id", "session_name", "peer_name", "content", "token_count", F.col("created_at").cast("timestamp_ntz").alias("created_at"))


def benchmark_points(spark: SparkSession, folder: str) -> DataFrame:
    """Exam points of the records: of two types, with a short answer and more turns than the window."""
    p = sources.record_points(_records(spark, folder), ["single", "multi"], WINDOW, WORDS)
    return p.select("id", "level", "source_session", "source_message_id", "trigger", "truth", F.array_join("must", ",").alias("must"))


def record_days(spark: SparkSession, folder: str) -> DataFrame:
    """Dates of dialogues, read back from the benchmark's form."""
    return _dialogues(spark, folder).select("q", "s", sources.record_day(F.col("day")).cast("timestamp_ntz").alias("day"))


def session_projects(spark: SparkSession, folder: str) -> DataFrame:
    """The project that each session's name tells, also for names of working directories."""
    m = table(spark, folder, "messages").select("session_name").distinct()
    s = F.col("session_name")
    return m.select("session_name", project_of(s).alias("project"), project_of(F.concat(F.lit("per-directory-opencode-"), s, F.lit("-x1"))).alias("directory"))


def arm_prompts_memory(spark: SparkSession, folder: str) -> DataFrame:
    """The prompt of the arm with memory for each message whose id is divisible by 100: the digest of a portrait, the window before it and itself.

    Messages are put to portraits in turn, and the vectors of ``embeddings`` stand in for those of triggers and facts, likewise in turn.
    The ten items nearest to the trigger make the digest.
    """
    f, e, m = table(spark, folder, "facts"), table(spark, folder, "embeddings"), table(spark, folder, "messages")
    owners = f.where("owner_id is not null and project_id is not null").groupBy("owner_id", "project_id").agg(F.min("fact_no").alias("first_no"))
    n, o = e.count(), owners.count()
    vector = e.select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    numbered = positions(owners.withColumn("_one", F.lit(1)), "_one", "first_no").select("owner_id", "project_id", (F.col("pos") - 1).alias("_place"))
    log = logs.message_log(m)
    points = log.where("id % 100 = 0").select("id", "content", (F.floor(F.col("id") / 100) % o).alias("_place"), (F.col("id") % n).alias("vec_id"))
    asked = points.join(numbered, "_place").join(vector.withColumnRenamed("vector", "trigger"), "vec_id").select(F.col("id").alias("point_id"), "owner_id", "project_id", "trigger", "content")
    wanted = asked.select("owner_id", "project_id").distinct()
    items = portraits.ranked(f, also=("id", "reinforcement_count", "created_at")).join(wanted, ["owner_id", "project_id"], "left_semi")
    each = asked.select("point_id", "owner_id", "project_id").join(items, ["owner_id", "project_id"]).drop("owner_id", "project_id")
    vectors = f.select("id", (F.col("fact_no") % n).alias("vec_id")).join(vector, "vec_id").select("id", "vector")
    digest = portraits.selected_digests(each, asked.select("point_id", "trigger"), vectors, ["point_id"], TOP)
    t = logs.transcripts(log).select(F.col("id").alias("point_id"), "transcript")
    return asked.join(digest, "point_id").join(t, "point_id").select("point_id", arm_prompt(F.col("transcript"), F.col("content"), F.col("digest")).alias("prompt"))


def messages_from_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The messages written as JSON lines and read back."""
    m = table(spark, folder, "messages")
    path = scratch(spark, "lines")
    m.withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).write.json(path)
    r = sources.messages_jsonl(spark, path)
    return r.select("id", "session_name", "peer_name", F.md5(F.col("content").cast("binary")).alias("digest"), F.col("token_count").cast("int").alias("token_count"), F.unix_micros("created_at").alias("micros"))


def candidates_written(spark: SparkSession, folder: str) -> DataFrame:
    """The messages of one day, exported as candidates and read back."""
    log = logs.message_log(logs.day_slice(table(spark, folder, "messages"), DAY, DAY))
    path = scratch(spark, "candidates")
    sinks.candidates_jsonl(log, path)
    return spark.read.schema("id BIGINT, session STRING, peer STRING, tokens INT").json(path)


def routed_log(spark: SparkSession, folder: str) -> DataFrame:
    """The log of a session from a file of lines, found through its archive first and the live place next."""
    path = scratch(spark, "fixture")
    table(spark, folder, "messages").withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).write.json(path)
    place = sources.first_existing(spark, f"{path}-archived", path)
    return sources.route(spark, "live", fixture=place).select("id", "session_name")


def routed_record(spark: SparkSession, folder: str) -> DataFrame:
    """The log of one benchmark session, by its record."""
    path = scratch(spark, "records")
    sinks.json_arrays(_record_rows(spark, folder), path)
    return sources.route(spark, "lme-q3", record_file=path).select("id", "session_name", "peer_name", "content")


def points_from_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Exam points made from messages, written as lines and read back; a repeated id would raise."""
    path = scratch(spark, "points")
    m = table(spark, folder, "messages").select(F.concat(F.lit("p-"), F.col("id")).alias("id"), F.lit("L1").alias("level"), F.col("session_name").alias("sourceSession"), F.col("id").alias("sourceMessageId"), F.col("content").alias("trigger"))
    sinks.points_jsonl(m, path)
    p = sources.points_jsonl(spark, path)
    return p.select("id", "level", F.col("sourceSession").alias("source_session"), F.col("sourceMessageId").alias("source_message_id"), F.md5(F.col("trigger").cast("binary")).alias("digest"))


def session_day(spark: SparkSession, folder: str) -> DataFrame:
    """One session's messages of one day."""
    m = table(spark, folder, "messages")
    return logs.day_slice(m, DAY, DAY, m.where(F.col("created_at").cast("date") == F.lit(DAY).cast("date")).agg(F.min("session_name")).first()[0] or "").select("id", "session_name")


def texts_cut(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as a list shows them, with a mark where something was cut off, and their whole lengths."""
    return table(spark, folder, "documents").select("doc_id", cut_text(F.col("text"), 80).alias("opening"), F.length("text").alias("chars"))


def session_progress(spark: SparkSession, folder: str) -> DataFrame:
    """How far each session has been read, if reading a message took a second: percent, messages a minute and the time left."""
    m = table(spark, folder, "messages").select("id", "session_name")
    used = table(spark, folder, "facts").select(F.explode("evidence").alias("id")).distinct()
    n = lifecycle.processed(m, lifecycle.cursor(m.join(used, "id", "left_semi"), "session_name", "id"), "session_name", "id")
    p = progress(F.col("done"), F.col("total"), F.col("done"))
    return n.select("session_name", p["percent"].alias("percent"), p["per_minute"].alias("per_minute"), p["left"].alias("left"))


def extraction_costs(spark: SparkSession, folder: str) -> DataFrame:
    """Calls and tokens of the offline extractor over the statements of facts."""
    f = table(spark, folder, "facts").where("statement is not null")
    b = f.select("fact_no", batch_line(F.col("fact_no"), F.lit("user"), F.regexp_replace("statement", r"\s*[\n\r]+\s*", " ")).alias("text"))
    a = providers.complete(b, ["fact_no"], "", "text", providers.FieldExtractor(), readable)
    return a.agg(F.count("*").alias("answers"), F.sum("calls").alias("calls"), F.sum("prompt_tokens").alias("prompt_tokens"))


def messages_ingested(spark: SparkSession, folder: str) -> DataFrame:
    """The messages after they came as a stream of many files, a tenth of them twice, by session with its cursor."""
    m = table(spark, folder, "messages").withColumn("created_at", F.col("created_at").cast("timestamp")).select("id", "session_name", "peer_name", "content", "token_count", "created_at")
    came, out = scratch(spark, "came"), scratch(spark, "ingested")
    m.union(m.where("id % 10 = 0")).repartition(12).write.parquet(came)
    ingest.ingest(ingest.message_stream(spark, came, 5), out, f"{out}/checkpoint").awaitTermination()
    rows = spark.read.schema(ingest.MESSAGE).parquet(f"{out}/messages").groupBy("session_name").agg(F.count("*").alias("messages"))
    cursors = spark.read.schema("session_name STRING, position BIGINT").parquet(f"{out}/cursors").groupBy(F.col("session_name").alias("_s")).agg(F.max("position").alias("position"))
    return rows.join(cursors, rows["session_name"].eqNullSafe(cursors["_s"])).select("session_name", "messages", "position")


def session_activity(spark: SparkSession, folder: str) -> DataFrame:
    """Messages and tokens of each session between gaps of half an hour: the streaming operator over the whole table."""
    m = table(spark, folder, "messages").where("created_at is not null").withColumn("created_at", F.col("created_at").cast("timestamp"))
    a = ingest.session_activity(m)
    return a.select("session_name", F.col("started").cast("timestamp_ntz").alias("started"), F.col("ended").cast("timestamp_ntz").alias("ended"), "messages", "tokens")


QUERIES = {f.__name__: f for f in (routed_log, routed_record, points_from_lines, session_day, texts_cut, session_progress, extraction_costs, messages_from_lines, candidates_written, messages_ingested, session_activity, benchmark_log, benchmark_points, record_days, session_projects, arm_prompts_memory)}
_DAYS = "SELECT id // 20 AS q, id % 4 AS s, date_trunc('minute', min(created_at)) AS day FROM messages GROUP BY ALL"
_ROLE = "CASE WHEN peer_name IS NULL OR lower(peer_name) IN ('user', 'human') THEN 'User' WHEN lower(peer_name) IN ('assistant', 'ai') THEN 'Assistant' ELSE peer_name END"
SQL = {
    "benchmark_log": f"""WITH d AS ({_DAYS}), t AS (
        SELECT m.id // 20 AS q, 0 AS last, day, m.id % 4 AS s, m.id AS t, coalesce(peer_name, 'user') AS peer_name, coalesce(content, '') AS content FROM messages m JOIN d ON d.q = m.id // 20 AND d.s = m.id % 4
        UNION ALL SELECT q, 1, TIMESTAMP '2026-01-02 03:04:00', 0, 0, 'user', 'What of "}}{{" in ' || q || '?' FROM (SELECT DISTINCT q FROM d))
      SELECT 'q' || q AS question_id, row_number() OVER (PARTITION BY q ORDER BY last, day NULLS LAST, s, t) AS id, 'lme-q' || q AS session_name, peer_name, content, greatest(1, length(content) // 4)::INT AS token_count, day::TIMESTAMP AS created_at FROM t""",
    "benchmark_points": f"""SELECT 'lme-q' || q AS id, 'L1' AS level, 'lme-q' || q AS source_session, n + 1 AS source_message_id, 'What of "}}{{" in ' || q || '?' AS trigger, 'answer ' || q AS truth, 'answer ' || q AS must
      FROM (SELECT id // 20 AS q, count(*) AS n FROM messages GROUP BY 1) WHERE q % 3 < 2 AND q % 5 <> 0 AND q % 7 <> 0 AND n > {WINDOW}""",
    "routed_log": "SELECT id, session_name FROM messages",
    "routed_record": f"""WITH d AS ({_DAYS}), t AS (
        SELECT 0 AS last, day, m.id % 4 AS s, m.id AS t, coalesce(peer_name, 'user') AS peer_name, coalesce(content, '') AS content FROM messages m JOIN d ON d.q = m.id // 20 AND d.s = m.id % 4 WHERE q = 3
        UNION ALL SELECT 1, TIMESTAMP '2026-01-02 03:04:00', 0, 0, 'user', 'What of "}}{{" in 3?')
      SELECT row_number() OVER (ORDER BY last, day NULLS LAST, s, t) AS id, 'lme-q3' AS session_name, peer_name, content FROM t""",
    "points_from_lines": "SELECT 'p-' || id AS id, 'L1' AS level, session_name AS source_session, id AS source_message_id, md5(content) AS digest FROM messages",
    "session_day": f"""WITH d AS (SELECT id, session_name FROM messages WHERE created_at >= DATE '{DAY}' AND created_at < DATE '{DAY}' + INTERVAL 1 DAY) SELECT * FROM d WHERE session_name = (SELECT min(session_name) FROM d)""",
    "texts_cut": "SELECT doc_id, CASE WHEN length(text) > 80 THEN left(text, 80) || '…' ELSE text END AS opening, length(text)::INT AS chars FROM documents",
    "session_progress": """WITH used AS (SELECT DISTINCT unnest(evidence) AS id FROM facts), c AS (SELECT session_name, max(id) AS p FROM messages JOIN used USING (id) GROUP BY session_name),
        n AS (SELECT m.session_name, count(*) AS total, count(*) FILTER (id <= coalesce(p, 0)) AS done FROM messages m LEFT JOIN c ON c.session_name IS NOT DISTINCT FROM m.session_name GROUP BY m.session_name)
      SELECT session_name, done * 100 // total AS percent, CASE WHEN done > 0 THEN 60.0::DOUBLE END AS per_minute, CASE WHEN done > 0 THEN format('{}:{:02d}:{:02d}', (total - done) // 3600, (total - done) // 60 % 60, (total - done) % 60) END AS left FROM n""",
    "extraction_costs": r"""SELECT count(*) AS answers, count(*) AS calls, CAST(sum(length('[' || fact_no || '] user: ' || regexp_replace(statement, '\s*[\n\r]+\s*', ' ', 'g')) // 4) AS BIGINT) AS prompt_tokens FROM facts WHERE statement IS NOT NULL""",
    "messages_from_lines": "SELECT id, session_name, peer_name, md5(content) AS digest, token_count::INT AS token_count, epoch_us(created_at) AS micros FROM messages",
    "candidates_written": f"SELECT id, session_name AS session, peer_name AS peer, coalesce(token_count, greatest(1, length(content) // 4), 1)::INT AS tokens FROM messages WHERE created_at >= DATE '{DAY}' AND created_at < DATE '{DAY}' + INTERVAL 1 DAY",
    "messages_ingested": "SELECT session_name, count(*) AS messages, max(id) AS position FROM messages GROUP BY session_name",
    "session_activity": """WITH m AS (SELECT session_name, created_at, token_count, coalesce(created_at - lag(created_at) OVER (PARTITION BY session_name ORDER BY created_at) > INTERVAL 30 MINUTE, true) AS fresh FROM messages WHERE created_at IS NOT NULL),
        n AS (SELECT *, count(*) FILTER (fresh) OVER (PARTITION BY session_name ORDER BY created_at RANGE UNBOUNDED PRECEDING) AS k FROM m)
      SELECT session_name, min(created_at) AS started, max(created_at) + INTERVAL 30 MINUTE AS ended, count(*) AS messages, CAST(sum(coalesce(token_count, 0)) AS BIGINT) AS tokens FROM n GROUP BY session_name, k""",
    "record_days": f"SELECT q, s, day::TIMESTAMP AS day FROM ({_DAYS})",
    "session_projects": """SELECT DISTINCT session_name, CASE WHEN session_name IS NULL OR contains(session_name, 'jrestly') THEN 'project:jrestly' WHEN starts_with(session_name, 'per-directory-opencode-')
        THEN 'project:' || regexp_replace(session_name[24:], '-[^-]+$', '') ELSE 'project:libx' END AS project, CASE WHEN session_name IS NULL OR contains(session_name, 'jrestly') THEN 'project:jrestly' ELSE 'project:' || session_name END AS directory FROM messages""",
    "arm_prompts_memory": f"""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), n AS (SELECT count(*) AS n FROM embeddings),
        o AS (SELECT owner_id, project_id, row_number() OVER (ORDER BY min(fact_no)) - 1 AS place FROM facts WHERE owner_id IS NOT NULL AND project_id IS NOT NULL GROUP BY owner_id, project_id),
        p AS (SELECT m.id AS point_id, owner_id, project_id, v AS g, content FROM messages m JOIN o ON o.place = (m.id // 100) % (SELECT count(*) FROM o) JOIN v ON v.vec_id = m.id % (SELECT n FROM n) WHERE m.id % 100 = 0),
        r AS ({whole_sql("facts")}),
        c AS (SELECT point_id, section, line, row_number() OVER (PARTITION BY point_id ORDER BY list_cosine_similarity(v.v, g) DESC, coalesce(f.reinforcement_count, 0) DESC, f.created_at ASC NULLS FIRST,
            list_position(['critical', 'constructs', 'preferences'], section), place) AS rank FROM p JOIN r USING (owner_id, project_id) JOIN facts f ON f.fact_no = r.fact_no JOIN v ON v.vec_id = f.fact_no % (SELECT n FROM n)
            WHERE regexp_replace(line, '[\\x00-\\x20]+', '', 'g') <> ''),
        s AS (SELECT point_id, section, '[' || section || ']' || chr(10) || string_agg('- ' || line, chr(10) ORDER BY rank) AS t FROM c WHERE rank <= {TOP} GROUP BY point_id, section),
        d AS (SELECT point_id, regexp_replace(string_agg(t, chr(10) ORDER BY list_position(['critical', 'constructs', 'preferences'], section)), '[ \\t\\n\\x0B\\f\\r]+$', '') AS digest FROM s GROUP BY point_id),
        w AS (SELECT id AS point_id, coalesce(string_agg({_ROLE} || ': ' || coalesce(content, ''), chr(10)) OVER (PARTITION BY session_name ORDER BY id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), '') AS transcript FROM messages)
      SELECT point_id, 'Memory:' || chr(10) || coalesce(digest, '') || chr(10) || chr(10) || transcript || chr(10) || 'User: ' || coalesce(content, '') AS prompt FROM p LEFT JOIN d USING (point_id) JOIN w USING (point_id)""",
}
