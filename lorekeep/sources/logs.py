"""Message logs and exam points from files and databases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MESSAGE = "id BIGINT, session_name STRING, peer_name STRING, content STRING, token_count INT, created_at STRING"
POINT = "id STRING, level STRING, sourceSession STRING, sourceMessageId BIGINT, trigger STRING, truth STRING, must ARRAY<STRING>, mustNot ARRAY<STRING>, pattern STRING, coverage STRING, forkType STRING, truthMessageId BIGINT"
DIALOG = "ARRAY<ARRAY<STRUCT<role:STRING,content:STRING>>>"
RECORD = f"question_id STRING, question_type STRING, question STRING, answer STRING, question_date STRING, haystack_dates ARRAY<STRING>, haystack_sessions {DIALOG}"


def messages_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """A message per line; blank lines are skipped; a missing, empty or unreadable time is null."""
    m = spark.read.schema(MESSAGE).json(path)
    return m.where("id is not null").withColumn("created_at", F.try_to_timestamp(F.nullif("created_at", F.lit(""))))


def messages_jdbc(spark: SparkSession, url: str, properties: dict[str, str], session: str, first: str, last: str, parts: int = 16) -> DataFrame:
    """The messages of one session between two days, both included, read in ``parts`` time ranges."""
    import datetime as dt

    a, b = dt.date.fromisoformat(first), dt.date.fromisoformat(last) + dt.timedelta(days=1)
    edges = [a + (b - a) * k / parts for k in range(parts + 1)]
    quoted = session.replace("'", "''")
    predicates = [f"session_name = '{quoted}' AND created_at >= '{x}' AND created_at < '{y}'" for x, y in zip(edges, edges[1:]) if x < y]
    return spark.read.jdbc(url, "messages", predicates=predicates, properties=properties)


def records(spark: SparkSession, path: str) -> DataFrame:
    """Benchmark records of one JSON array, or of a folder of them, with ``file_place``, which grows along the files; answers that are numbers are read as text.

    A file is read in splits although it is one JSON value: it is cut at every closing brace, of which those within strings or nested
    objects are told by two running sums over the pieces (of quotation marks, then of braces), each added up within a split and
    over one row a split. The pieces of a record are joined again; they are as few as the record is long. Raises if
    a file isn't an array of objects.
    """
    split = [F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b")]
    raw = spark.read.option("lineSep", "}").text(path).select(*split, F.monotonically_increasing_id().alias("_i"), F.col("value").alias("_t"))
    plain = F.regexp_replace("_t", r"\\.", "")  # no escape reaches over a brace
    quotes = F.length(plain) - F.length(F.replace(plain, F.lit('"')))
    pieces = _running(raw.select("*", plain.alias("_p"), quotes.cast("long").alias("_q")), "_q", "_before")
    inside = F.col("_before") % 2 == 1
    bare = F.regexp_replace(F.concat(F.when(inside, '"').otherwise(""), F.col("_p")), r'"[^"]*("|$)', "")
    ends_outside = (F.col("_before") + F.col("_q")) % 2 == 0
    opened = F.length(bare) - F.length(F.replace(bare, F.lit("{")))
    key = ["_f", "_b", "_i", "_t"]
    deep = _running(pieces.select(*key, opened.cast("long").alias("_o"), (opened - ends_outside.cast("int")).cast("long").alias("_d")), "_d", "_depth")
    closes = (F.col("_depth") + F.col("_d") == 0) & ((F.col("_depth") > 0) | (F.col("_o") > 0))
    numbered = _running(deep.select(*key, "_depth", "_d", closes.cast("long").alias("_r")), "_r", "_no")
    part = F.when(F.col("_depth") == 0, F.regexp_extract("_t", r"(?s)^[^{]*(\{.*)$", 1)).otherwise(F.col("_t"))
    kept = numbered.where("_depth > 0 or _r = 1 or _d > 0")
    whole = kept.groupBy("_f", "_no").agg(F.array_sort(F.collect_list(F.struct("_b", "_i", part.alias("t")))).alias("_l"))
    text = F.concat(F.array_join(F.transform("_l", lambda x: x["t"]), "}"), F.lit("}"))
    heads = raw.where("_b = 0").groupBy("_f").agg(F.min_by("_t", "_i").alias("_t")).select("_f", F.ltrim("_t").startswith("[").alias("_ok"), (F.row_number().over(Window.orderBy("_f")) - 1).cast("long").alias("_k"))  # one row a file
    if not heads.agg(F.bool_and("_ok")).first()[0]:
        raise ValueError(f"{path} isn't a JSON array")
    parsed = whole.join(heads, "_f").select((F.col("_k") * (1 << 40) + F.col("_no")).alias("file_place"), F.from_json(text, RECORD).alias("r"))
    ok = F.when(F.col("r").isNull(), F.raise_error(F.lit("unreadable record")).cast("boolean")).otherwise(F.col("r.question_id").isNotNull())
    return parsed.where(ok).select("r.*", "file_place")


def _running(rows: DataFrame, value: str, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over all rows before in their file, by (_b, _i): within each split, and over one row a split."""
    earlier = Window.unboundedPreceding, -1
    inner = rows.withColumn("_s", F.coalesce(F.sum(value).over(Window.partitionBy("_f", "_b").orderBy("_i").rowsBetween(*earlier)), F.lit(0)))
    splits = rows.groupBy("_f", "_b").agg(F.sum(value).alias("_n"))
    offsets = splits.select("_f", "_b", F.coalesce(F.sum("_n").over(Window.partitionBy("_f").orderBy("_b").rowsBetween(*earlier)), F.lit(0)).alias("_off"))
    return inner.join(offsets, ["_f", "_b"]).withColumn(name, F.col("_s") + F.col("_off")).drop("_s", "_off")


def record_day(c: Column) -> Column:
    """Time from ``2023/05/20 (Sat) 02:21``; null if unreadable."""
    return F.try_to_timestamp(F.regexp_replace(c, r"\s*\([^)]*\)", ""), F.lit("yyyy/M/d HH:mm"))


def last_of(rows: DataFrame) -> DataFrame:
    """Of records with the same question id the last one in the file."""
    newest = rows.groupBy(F.col("question_id").alias("_q")).agg(F.max("file_place").alias("_m"))
    return rows.join(newest, (F.col("question_id") == F.col("_q")) & (F.col("file_place") == F.col("_m")), "left_semi")


def record_log(rows: DataFrame) -> DataFrame:
    """(question_id, id, session_name, peer_name, content, token_count, created_at): each record as one log.

    Its sessions by date (unknown dates last, equal ones as given), their turns in order, ids from 1, a
    quarter of the length as token count (1 at least), and the question as the last message.
    """
    zipped = rows.select("question_id", F.posexplode(F.arrays_zip("haystack_dates", "haystack_sessions")).alias("s", "z"))
    turns = zipped.select("question_id", "s", record_day(F.col("z.haystack_dates")).alias("at"), F.posexplode("z.haystack_sessions").alias("t", "d"))
    body = turns.select("question_id", "s", "t", "at", F.col("d.role").alias("peer_name"), F.col("d.content").alias("content"), F.lit(0).alias("last"))
    ask = rows.select("question_id", F.lit(0).alias("s"), F.lit(0).alias("t"), record_day(F.col("question_date")).alias("at"), F.lit("user").alias("peer_name"), F.col("question").alias("content"), F.lit(1).alias("last"))
    w = Window.partitionBy("question_id").orderBy("last", F.asc_nulls_last("at"), "s", "t")  # one record's log is one nested value to begin with
    out = body.union(ask).withColumn("id", F.row_number().over(w).cast("long"))
    tokens = F.greatest(F.lit(1), F.floor(F.length(F.coalesce("content", F.lit(""))) / 4)).cast("int")
    return out.select("question_id", "id", F.concat(F.lit("lme-"), F.col("question_id")).alias("session_name"), "peer_name", "content", tokens.alias("token_count"), F.col("at").alias("created_at"))


def record_points(rows: DataFrame, types: list[str], window: int, most_words: int = 8, limit: int | None = None) -> DataFrame:
    """Exam points of records: of the given types, with a non-blank answer of at most ``most_words`` words and more turns than the window.

    ``limit`` keeps the first of them in order of the file.
    """
    turns = F.aggregate("haystack_sessions", F.lit(0), lambda a, s: a + F.size(s))
    words = F.size(F.split(F.trim("answer"), r"\s+"))
    kept = rows.where(F.col("question_type").isin(types) & (F.trim(F.coalesce("answer", F.lit(""))) != "") & (words <= most_words) & (turns > window))
    if limit is not None:
        kept = kept.orderBy("file_place").limit(limit)
    return kept.select(
        F.concat(F.lit("lme-"), F.col("question_id")).alias("id"), F.lit("L1").alias("level"), F.concat(F.lit("lme-"), F.col("question_id")).alias("source_session"),
        (turns + 1).cast("long").alias("source_message_id"), F.col("question").alias("trigger"), F.col("answer").alias("truth"), F.array("answer").alias("must"),
    )


def points_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Exam points, one per line; raises if an id occurs twice."""
    p = spark.read.schema(POINT).json(path).where("id is not null")
    twice = p.groupBy("id").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"repeated point id {twice[0].id}")
    return p


def route(spark: SparkSession, session: str, *, record_file: str | None = None, fixture: str | None = None, jdbc: dict | None = None) -> DataFrame:
    """The log of a session: a benchmark record for ``lme-`` sessions, else the fixture file, else the database."""
    if session.startswith("lme-") and record_file:
        found = record_log(last_of(records(spark, record_file).where(F.col("question_id") == session[4:])))
        if not found.take(1):
            raise KeyError(session)
        return found.drop("question_id")
    if fixture:
        return messages_jsonl(spark, fixture)
    if jdbc:
        return messages_jdbc(spark, session=session, **jdbc)
    raise ValueError(f"no source for {session}")


def first_existing(spark: SparkSession, *paths: str) -> str:
    """The first path that exists, such as an archived file before the live one; raises if none does."""
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(conf).exists(p):
            return path
    raise FileNotFoundError(", ".join(paths))
