"""Queries on paired evaluation and similarity, with their SQL.

Each message with content is an exam point: its words of six letters and more are the markers, the next message by another
speaker than a user is the answer of arm a, the message before it that of arm b; questions are control points.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.parsing import judge_verdict, parse_facts
from ..functions.prompts import batch_line
from ..functions.similarity import cosine
from ..functions.similarity import jaccard, word_grams
from ..functions.text import blank_to_null, fact_line, literal, matches_marker, parse_vector, point_fingerprint, short
from ..operators import evaluate as ops
from ..operators import log as logs
from ..operators import providers
from ..operators import similar
from ..operators.sequences import looking_back, positions
from ..sources.tables import table

MARKER = r"\p{L}{6,}"
QUANTILES = [0.5, 0.9, 0.95, 0.99]


def _marks(c: str) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(f"({MARKER})"), F.lit(1))


def _points(spark: SparkSession, folder: str) -> DataFrame:
    m = table(spark, folder, "messages").where("content is not null")
    level = F.when(F.col("content").rlike(r"\?\s*$"), "C").otherwise("L1")
    none = F.array().cast("array<string>")
    return m.select(F.col("id").alias("point_id"), "session_name", level.alias("level"), F.col("content").alias("trigger"), F.when(level == "C", none).otherwise(_marks("content")).alias("must"), F.when(level == "C", _marks("content")).otherwise(none).alias("must_not"))


def _answers(spark: SparkSession, folder: str) -> DataFrame:
    log = table(spark, folder, "messages").select("id", "session_name", "peer_name", "content")
    text = log.select(F.col("id").alias("_id"), F.col("content").alias("answer")).where("answer is not null")
    a = logs.next_by_other(log).join(text, F.col("reply_id") == F.col("_id")).select(F.col("id").alias("point_id"), F.lit("a").alias("arm"), "answer")
    b = logs.window_start(log, 1).join(text, F.col("previous") == F.col("_id")).select(F.col("id").alias("point_id"), F.lit("b").alias("arm"), "answer")
    return a.union(b)


def _verdicts(spark: SparkSession, folder: str) -> DataFrame:
    return ops.arm_verdicts(_points(spark, folder), _answers(spark, folder))


def marker_match(spark: SparkSession, folder: str) -> DataFrame:
    """Of each message's markers, those that the message before it has and lacks."""
    p = _points(spark, folder).withColumn("marks", F.when(F.col("level") == "C", F.col("must_not")).otherwise(F.col("must")))
    b = _answers(spark, folder).where("arm = 'b'").select("point_id", "answer")
    j = p.join(b, "point_id", "left")
    return j.select("point_id", F.size(ops.hit(F.col("answer"), F.col("marks"))).alias("hits"), F.size(ops.missed(F.col("answer"), F.col("marks"))).alias("misses"))


def arm_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    return _verdicts(spark, folder)


def answer_pivot(spark: SparkSession, folder: str) -> DataFrame:
    """Length of each arm's answer per point."""
    return _answers(spark, folder).groupBy("point_id").pivot("arm", ["a", "b"]).agg(F.max(F.length("answer")))


def paired_stats(spark: SparkSession, folder: str) -> DataFrame:
    return ops.paired_stats(_verdicts(spark, folder))


def lift_report(spark: SparkSession, folder: str) -> DataFrame:
    """The paired report per calendar month."""
    m = table(spark, folder, "messages").select(F.col("id").alias("point_id"), F.date_trunc("month", "created_at").cast("timestamp_ntz").alias("month"))
    r = ops.report(_verdicts(spark, folder).join(m, "point_id"), ["month"])
    return r.withColumns({"lift": F.round("lift", 9), "p_value": F.round("p_value", 9)})


def _judged(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Machine verdicts with levels, and what a judge says of those worth one: that arm a passes where the id is even, arm b where it is divisible by 3."""
    v = _verdicts(spark, folder).join(_points(spark, folder).select("point_id", "level"), "point_id")
    return v, ops.to_judge(v).select("point_id", (F.col("point_id") % 2 == 0).alias("a_pass"), (F.col("point_id") % 3 == 0).alias("b_pass"))


def points_to_judge(spark: SparkSession, folder: str) -> DataFrame:
    return ops.to_judge(_verdicts(spark, folder))


def judge_overlay(spark: SparkSession, folder: str) -> DataFrame:
    """A judge's verdicts in the place of the machine's where it was asked."""
    v, judged = _judged(spark, folder)
    return ops.overlay(v, judged)


def judged_summary(spark: SparkSession, folder: str) -> DataFrame:
    """The aggregates of the overlaid verdicts, in all and of level L1."""
    v, judged = _judged(spark, folder)
    return ops.judged_summary(ops.overlay(v, judged).join(v.select("point_id", "level"), "point_id")).withColumn("p_value", F.round("p_value", 9))


def known_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """Verdicts whose point is still in a dataset that holds the points of named sessions only."""
    return ops.known_verdicts(_verdicts(spark, folder), _points(spark, folder).where("session_name is not null")).select("point_id", "a_pass", "b_pass")


def session_points(spark: SparkSession, folder: str) -> DataFrame:
    p = _points(spark, folder).select("session_name", F.col("point_id").alias("message_id"), F.concat(F.lit("p"), F.col("point_id")).alias("point_id"))
    return ops.points_by_session(p)


def delay_spread(spark: SparkSession, folder: str) -> DataFrame:
    """Least, greatest and mean delay of portraits."""
    p = table(spark, folder, "portrait_snapshots")
    s = F.unix_seconds(F.col("built_at").cast("timestamp")) - F.unix_seconds(F.col("cutoff").cast("timestamp"))
    return ops.spread_of(p.select(s.alias("s")), "s").withColumn("mean", F.round("mean", 3))


def marker_forms(spark: SparkSession, folder: str) -> DataFrame:
    """Markers of several forms in answers with mark-up and grouped numbers, made from the ids so that what matches is known."""
    m = table(spark, folder, "messages").select("id")
    n, mark = (F.col("id") * 1009 + 1000).cast("string"), F.element_at(F.array(F.lit(","), F.lit(" "), F.lit("\u00a0"), F.lit("\u202f"), F.lit("'")), (F.col("id") % 5 + 1).cast("int"))
    grouped = F.regexp_replace(n, r"\B(?=(\d{3})+$)", "_")
    answer = F.concat(F.lit('So **Ёлка** "stays" at '), F.translate(grouped, "_", "#").alias("x"), F.lit(" of `Release` *Notes*, v2."))
    answer = F.regexp_replace(answer, r"(?<=\d)#(?=\d)", mark)
    is_in = lambda marker: matches_marker(answer, marker)
    return m.select(
        "id", is_in(n).alias("number"), is_in(F.concat(n, F.lit("0"))).alias("longer"), is_in(F.left(n, F.length(n) - 1)).alias("shorter"), is_in(F.regexp_replace(grouped, "_", ",")).alias("grouped"),
        is_in(F.lit(" Release notes ")).alias("phrase"), is_in(F.lit("release note")).alias("part"), is_in(F.lit("елка")).alias("folded"), is_in(F.lit("")).alias("blank"), is_in(F.lit("v2.")).alias("stop"),
    )


def parse_facts_forms(spark: SparkSession, folder: str) -> DataFrame:
    """Answers of every form that is read: lists and wrapped lists, missing fields, unknown names, other kinds, bad ids, prose and broken JSON; by fact_no modulo 12."""
    f = table(spark, folder, "facts").select("fact_no", (F.col("fact_no") % 12).cast("int").alias("k"))
    n = F.col("fact_no").cast("string")
    forms = [
        '```json\n[{"kind":" state ","subject":" s@ ","predicate":"p","object":"o","evidence_ids":[@,"7","x",null]}]\n```', 'Sure: {"facts":[{"statement":"t@","domain":"psyche","scope":"user"}]} done',
        '[{"kind":"PSYCHE","subject":"s@","statement":" t "}]', '[{"kind":"rumour","subject":"s@","predicate":"p","object":"o","domain":"moon","scope":"galaxy"}]', '[{"kind":"rumour","subject":"s@","predicate":"p"}]',
        '[{"kind":"EVENT","predicate":"p@","object":"o"}]', '[]', 'no facts @', '[{"kind":"STATE","subject":"s@"', '{"other":[{"subject":"s@"}]}', '```\n[{"subject":"s@","conditions":{"env":"ci"},"evidence":["@"]}]', '[{"subject":"a@"},{"statement":"b@"},{"subject":" "}]',
    ]
    answer = F.replace(F.element_at(F.array(*map(F.lit, forms)), F.col("k") + 1), F.lit("@"), n)
    p = parse_facts(f.select("fact_no", answer.alias("answer")), "fact_no", "answer")
    return p.select("fact_no", "place", "kind", "domain", "scope", "subject", "predicate", "object", "statement", F.array_join("evidence", ",").alias("evidence"))


def judge_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Verdicts out of judges' answers in fences, in prose, cut off or without JSON; by id modulo 4."""
    m = table(spark, folder, "messages").select("id")
    a = F.when(F.col("id") % 3 == 0, "true").otherwise("false")
    forms = [F.concat(F.lit('```json\n{"a_pass": '), a, F.lit(', "b_pass": true, "reason": "r"}\n```')), F.concat(F.lit('I say {"b_pass": false, "a_pass": '), a, F.lit("}. Done")), F.lit('{"a_pass": tr'), F.lit("both fail")]
    v = judge_verdict(F.element_at(F.array(*forms), (F.col("id") % 4 + 1).cast("int")))
    return m.select("id", v["a_pass"].alias("a_pass"), v["b_pass"].alias("b_pass"), v["reason"].alias("reason"))


def _cached(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Points with fingerprints, and answers made with the right one, an older one (id divisible by 7) or none (by 11)."""
    p = _points(spark, folder)
    fp = point_fingerprint(F.lit("set-up"), F.col("trigger"), F.col("session_name"), F.col("point_id"))
    points = p.select("point_id", fp.alias("point_fp"))
    made = F.when(F.col("point_id") % 11 == 0, F.lit(None)).when(F.col("point_id") % 7 == 0, F.lit("older")).otherwise(F.col("point_fp"))
    return points, _answers(spark, folder).select("point_id", "arm").join(points, "point_id").select("point_id", "arm", made.alias("point_fp"))


def valid_answers(spark: SparkSession, folder: str) -> DataFrame:
    points, answers = _cached(spark, folder)
    return providers.valid_answers(points, answers).select("point_id", "arm")


def answers_to_make(spark: SparkSession, folder: str) -> DataFrame:
    """What is to be generated anew, for 500 points in one run: the limit is the feature."""
    points, answers = _cached(spark, folder)
    return providers.stale_answers(points, answers, 500)


def point_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    fp = point_fingerprint(F.lit("set-up"), F.col("trigger"), F.col("session_name"), F.col("point_id"))
    return _points(spark, folder).select("point_id", fp.alias("fp"), short(fp).alias("short"))


def word_similarity(spark: SparkSession, folder: str) -> DataFrame:
    """Similarity of each fact's subject and statement with every word padded by itself."""
    f = table(spark, folder, "facts")
    return f.select("fact_no", F.round(jaccard(word_grams(F.col("subject_norm")), word_grams(F.col("statement"))), 9).alias("similarity"))


def cosine_next(spark: SparkSession, folder: str) -> DataFrame:
    """The cosine of each vector and the one after it."""
    v = table(spark, folder, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    n = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    return v.join(n, "vec_id").select("vec_id", F.round(cosine(F.col("v"), F.col("w")), 6).alias("cosine"))


def vector_literals(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors written as text and read again: length and sum."""
    v = table(spark, folder, "embeddings").select("vec_id", parse_vector(literal(F.col("embedding"))).alias("v"))
    return v.select("vec_id", F.size("v").alias("n"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


def vectors_stored(spark: SparkSession, folder: str) -> DataFrame:
    """How long each fact's vector is once those of pending facts are written back: 64 for new ones, 8 or null for the others."""
    f = table(spark, folder, "facts").select("fact_no", "statement", "embedding")
    line = blank_to_null(F.col("statement"))
    made = providers.embed(f.where("embedding is null").select("fact_no", line.alias("line")).where("line is not null"), "fact_no", "line", providers.HashEmbedder(64))
    return providers.with_vectors(f.select("fact_no", "embedding"), made, "fact_no").select("fact_no", F.when(F.col("embedding").isNotNull(), F.size("embedding")).alias("length"))


def evidence_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """The vectors of a set of ids, here those that facts of batch 8 give by fact_no; ids without a vector give no row."""
    ids = table(spark, folder, "facts").where("batch_no = 8").select(F.col("fact_no").alias("vec_id")).distinct()
    v = table(spark, folder, "embeddings").where("embedding is not null").join(ids, "vec_id", "left_semi")
    return v.select("vec_id", F.round(F.element_at("embedding", 1).cast("double"), 6).alias("first"))


def span_validation(spark: SparkSession, folder: str) -> DataFrame:
    """Validation status of each message as a point: its text is the trigger, the next reply the anchor and its text the truth.

    So that every status occurs: where the id is divisible by 5 the trigger is the text of the message before; by 7 the truth is; questions are control points,
    whose words are forbidden; by 11 the point forbids a word that it requires; by 13 its anchor is the message itself; by 17 it is to be skipped.
    """
    log = table(spark, folder, "messages").select("id", "session_name", "peer_name", "content")
    w = looking_back(positions(log, "session_name", "id"), "session_name", 5, {"_w": lambda s: F.collect_list("content").over(s.rowsBetween(-5, 0)), "_prev": lambda s: F.lag("content").over(s)})
    replies = logs.next_by_other(log)
    text = log.select(F.col("id").alias("reply_id"), F.col("content").alias("reply"))
    j = w.join(replies, "id").join(text, "reply_id", "left")
    words = lambda c: F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"(\p{L}{8,})"), F.lit(1))
    by, none = lambda n: F.col("id") % n == 0, F.array().cast("array<string>")
    control = F.coalesce(F.col("content").rlike(r"\?\s*$"), F.lit(False))
    anchor = F.when(by(13), F.col("id")).otherwise(F.col("reply_id"))
    anchor_text = F.when(by(13), F.col("content")).otherwise(F.col("reply"))
    status = ops.span_status(
        trigger=F.when(by(5), F.col("_prev")).otherwise(F.col("content")), message=F.col("content"), truth=F.when(by(7), F.col("_prev")).otherwise(anchor_text), anchor=anchor_text, anchor_id=anchor, message_id=F.col("id"),
        level=F.when(control, "C").otherwise("L1"), must=F.when(control, none).otherwise(words("reply")), must_not=F.when(control, words("reply")).when(by(11), F.slice(words("reply"), 1, 1)).otherwise(none),
        window=F.col("_w"), skip=by(17),
    )
    return j.select("id", status.alias("status"))


def validation_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return span_validation(spark, folder).groupBy("status").agg(F.count("*").alias("points"))


def latency_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "portrait_snapshots")
    s = F.unix_seconds(F.col("built_at").cast("timestamp")) - F.unix_seconds(F.col("cutoff").cast("timestamp"))
    return ops.order_statistics(p.select(s.alias("s")), "s", QUANTILES)


def parse_facts_json(spark: SparkSession, folder: str) -> DataFrame:
    """The facts of model answers written as JSON in prose and fences, made from the stored facts themselves."""
    f = table(spark, folder, "facts")
    body = F.to_json(F.array(F.struct(F.col("kind"), F.col("subject_norm").alias("subject"), F.col("predicate_norm").alias("predicate"), F.col("object_value").alias("object"), F.col("statement"), F.col("fact_domain").alias("domain"), F.col("scope"), F.transform("evidence", lambda e: e.cast("string")).alias("evidence_ids"))))
    answers = f.select("fact_no", F.concat(F.lit("Here it is:\n```json\n"), body, F.lit("\n```\nDone.")).alias("answer"))
    p = parse_facts(answers, "fact_no", "answer")
    return p.select("fact_no", "kind", "domain", "scope", "subject", "predicate", "object", "statement", F.array_join("evidence", ",").alias("evidence"))


def embedding_backfill(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors of the facts that have none, by the offline embedder; facts without any text are left out."""
    f = table(spark, folder, "facts").where("embedding is null")
    line = blank_to_null(fact_line(F.col("statement"), F.col("subject_norm"), F.col("predicate_norm"), F.col("object_value")))
    return providers.embed(f.select("fact_no", line.alias("line")).where("line is not null"), "fact_no", "line", providers.HashEmbedder(64))


def extracted_facts(spark: SparkSession, folder: str) -> DataFrame:
    """What the offline extractor reads from the statements of facts, each as a batch of one line."""
    f = table(spark, folder, "facts").where("statement is not null")
    b = f.select(F.col("fact_no").alias("first_id"), batch_line(F.col("fact_no"), F.lit("user"), F.regexp_replace("statement", r"\s*[\n\r]+\s*", " ")).alias("text"))
    e = providers.extract(b, providers.FieldExtractor())
    return e.select("first_id", "kind", "domain", "scope", "subject", "predicate", "object", F.array_join("evidence", ",").alias("evidence"))


def trigram_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of similar predicates."""
    return similar.similar_pairs(table(spark, folder, "facts").select("predicate_norm"), 0.7).withColumn("similarity", F.round("similarity", 9))


def near_dup_top5(spark: SparkSession, folder: str) -> DataFrame:
    """For each predicate its five most similarly written other ones."""
    return similar.near_duplicates(table(spark, folder, "facts").select("predicate_norm"), 0.6).withColumn("similarity", F.round("similarity", 9))


def subject_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of subjects that may be one identity under two names."""
    return similar.many_similar_pairs(table(spark, folder, "facts").select("subject_norm"), 0.3)


def predicate_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of predicates that may mean the same."""
    return similar.similar_pairs(table(spark, folder, "facts").select("predicate_norm"), 0.45).withColumn("similarity", F.round("similarity", 9))


def near_dup_subjects(spark: SparkSession, folder: str) -> DataFrame:
    """For each subject its five most similarly written other ones."""
    return similar.near_duplicates(table(spark, folder, "facts").select("subject_norm"), 0.6).withColumn("similarity", F.round("similarity", 9))


def cosine_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The ten nearest vectors of every vector whose id is divisible by 100."""
    v = table(spark, folder, "embeddings")
    return similar.nearest(v, v.where("vec_id % 100 = 0"), "vec_id", "embedding", 10).withColumn("cosine", F.round("cosine", 6))


_ROLE = "CASE WHEN peer_name IS NULL OR lower(peer_name) IN ('user', 'human') THEN 'User' WHEN lower(peer_name) IN ('assistant', 'ai') THEN 'Assistant' ELSE peer_name END"
_HAY = lambda c: f"""regexp_replace(replace(lower({c}), 'ё', 'е'), '[*_`#"]', '', 'g')"""
_HIT = lambda t, m: f"list_contains(regexp_extract_all({_HAY(t)}, '[\\p{{L}}\\p{{N}}]+'), replace({m}, 'ё', 'е'))"  # noqa: E731  a marker is one word here
_POINTS = r"""
p AS (SELECT id AS point_id, session_name, created_at, CASE WHEN regexp_matches(content, '\?[ \t\n\x0B\f\r]*$') THEN 'C' ELSE 'L1' END AS level, regexp_extract_all(lower(content), '\p{L}{6,}') AS marks FROM messages WHERE content IS NOT NULL),
n AS (SELECT id, lag(id) OVER w AS prev, first_value(CASE WHEN role <> 'User' THEN id END IGNORE NULLS) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS reply
  FROM (SELECT *, """ + _ROLE + """ AS role FROM messages) WINDOW w AS (PARTITION BY session_name ORDER BY id)),
ans AS (SELECT n.id AS point_id, a.content AS a, b.content AS b FROM n LEFT JOIN messages a ON a.id = n.reply LEFT JOIN messages b ON b.id = n.prev)
"""
_VERDICTS = f"""WITH {_POINTS},
j AS (SELECT point_id, level, created_at, len(list_filter(marks, lambda m: {_HIT('a', 'm')})) AS ha, len(list_filter(marks, lambda m: {_HIT('b', 'm')})) AS hb, len(marks) AS k
  FROM p JOIN ans USING (point_id) WHERE a IS NOT NULL AND b IS NOT NULL),
v AS (SELECT point_id, level, created_at, CASE WHEN level = 'C' THEN ha = 0 ELSE ha = k END AS a_pass, CASE WHEN level = 'C' THEN hb = 0 ELSE hb = k END AS b_pass, level = 'C' AND ha > 0 AS leak FROM j)
"""
_STATS = """count(*) FILTER (NOT leak) AS n, count(*) FILTER (NOT leak AND a_pass) AS a_pass, count(*) FILTER (NOT leak AND b_pass) AS b_pass, count(*) FILTER (NOT leak AND a_pass AND NOT b_pass) AS a_only,
  count(*) FILTER (NOT leak AND b_pass AND NOT a_pass) AS b_only, count(*) FILTER (NOT leak AND a_pass AND b_pass) AS "both", count(*) FILTER (NOT leak AND NOT a_pass AND NOT b_pass) AS neither, count(*) FILTER (leak) AS leaks"""
_MCNEMAR = f"""CASE WHEN a_only + b_only = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least(a_only, b_only) + 1),
        lambda k: exp(lgamma(a_only + b_only + 1) - lgamma(k + 1) - lgamma(a_only + b_only - k + 1) - (a_only + b_only) * {math.log(2)!r}::DOUBLE)))) END"""
_OVERLAID = _VERDICTS + ", o AS (SELECT point_id, level, leak, CASE WHEN a_pass THEN true ELSE point_id % 2 = 0 END AS a_pass, CASE WHEN a_pass THEN b_pass ELSE point_id % 3 = 0 END AS b_pass FROM v) "
_CACHED = """made AS (SELECT point_id, 'a' AS arm, point_id % 7 = 0 OR point_id % 11 = 0 AS old FROM p JOIN ans USING (point_id) WHERE a IS NOT NULL
  UNION ALL SELECT point_id, 'b', point_id % 7 = 0 OR point_id % 11 = 0 FROM p JOIN ans USING (point_id) WHERE b IS NOT NULL)"""
_POINT_FP = "sha256('point-v1' || chr(10) || 'answer-fp=set-up' || chr(10) || 'trigger=' || sha256(content) || chr(10) || 'session=' || coalesce(session_name, '') || chr(10) || 'message=' || id)"
_WORD_GRAMS = lambda c: f"list_distinct(flatten(list_transform(regexp_extract_all(lower(coalesce({c}, '')), '[\\p{{L}}\\p{{N}}]+'), lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3)))))"
_FLAT = lambda c: f"trim(regexp_replace(replace(lower(coalesce({c}, '')), 'ё', 'е'), '[\\s\\x0B\\p{{Z}}]+', ' ', 'g'))"
_SPAN = f"""WITH base AS (SELECT id, session_name, content, lag(content) OVER (PARTITION BY session_name ORDER BY id) AS prev, list(content) FILTER (content IS NOT NULL) OVER (PARTITION BY session_name ORDER BY id ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS win,
    first_value(CASE WHEN role <> 'User' THEN id END IGNORE NULLS) OVER (PARTITION BY session_name ORDER BY id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS reply_id FROM (SELECT *, {_ROLE} AS role FROM messages)),
  i AS (SELECT base.*, coalesce(regexp_matches(base.content, '\\?[ \\t\\n\\x0B\\f\\r]*$'), false) AS c, regexp_extract_all(lower(coalesce(r.content, '')), '\\p{{L}}{{8,}}') AS ws,
    CASE WHEN base.id % 13 = 0 THEN base.id ELSE reply_id END AS anchor_id, CASE WHEN base.id % 13 = 0 THEN base.content ELSE r.content END AS anchor FROM base LEFT JOIN messages r ON r.id = reply_id),
  j AS (SELECT *, CASE WHEN id % 5 = 0 THEN prev ELSE content END AS trigger, CASE WHEN id % 7 = 0 THEN prev ELSE anchor END AS truth, CASE WHEN c THEN [] ELSE ws END AS must, CASE WHEN c THEN ws WHEN id % 11 = 0 THEN ws[1:1] ELSE [] END AS must_not FROM i)
  SELECT id, CASE WHEN id % 17 = 0 THEN 'skip'
    WHEN NOT (coalesce({_FLAT('trigger')} <> '' AND contains({_FLAT('content')}, {_FLAT('trigger')}), false)) OR (anchor_id IS NOT NULL AND truth IS NOT NULL AND NOT ({_FLAT('truth')} <> '' AND contains({_FLAT('anchor')}, {_FLAT('truth')}))) THEN 'span-miss'
    WHEN len(list_filter(CASE WHEN c THEN must_not ELSE must END, lambda m: len(list_filter(coalesce(win, []), lambda t: {_HIT('t', 'm')})) > 0)) > 0 THEN 'in-window'
    WHEN len(list_filter(must_not, lambda m: list_contains(list_transform(must, lambda y: replace(y, 'ё', 'е')), replace(m, 'ё', 'е')))) > 0 THEN 'marker-collision'
    WHEN anchor_id IS NOT NULL AND anchor_id <= id THEN 'causality' WHEN NOT c AND anchor_id IS NULL THEN 'unanchored' ELSE 'ok' END AS status FROM j"""
_GRAMS = lambda c: f"list_distinct(list_transform(range(1, length('  ' || {c} || ' ') - 1), lambda i: substring('  ' || {c} || ' ', i, 3)))"
_NORM = lambda c: rf"regexp_replace(lower(regexp_replace({c}, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')), '[ \t\n\x0B\f\r]+', ' ', 'g')"


def _pairs(column: str, source: str, least: float) -> str:
    return f"""WITH d AS (SELECT value, norm, {_GRAMS('norm')} AS g FROM (SELECT value, {_NORM('value')} AS norm FROM (SELECT DISTINCT {column} AS value FROM {source} WHERE {column} IS NOT NULL))),
      pairs AS (SELECT * FROM (SELECT x.value AS a, y.value AS b, CASE WHEN x.norm = y.norm THEN 1.0 WHEN x.norm = '' OR y.norm = '' THEN 0.0
        ELSE len(list_intersect(x.g, y.g))::DOUBLE / (len(x.g) + len(y.g) - len(list_intersect(x.g, y.g))) END AS similarity FROM d x JOIN d y ON x.value < y.value) WHERE similarity >= {least})"""


QUERIES = {
    f.__name__: f
    for f in (
        marker_match, marker_forms, arm_verdicts, answer_pivot, paired_stats, lift_report, points_to_judge, judge_overlay, judged_summary, known_verdicts, session_points, delay_spread,
        parse_facts_forms, judge_answers, valid_answers, answers_to_make, point_fingerprints, word_similarity, cosine_next, vector_literals, vectors_stored, evidence_vectors, span_validation, validation_histogram, latency_percentiles, parse_facts_json,
        embedding_backfill, extracted_facts, trigram_pairs, near_dup_top5, subject_pairs, predicate_pairs, near_dup_subjects, cosine_topk,
    )
}
SQL = {
    "marker_match": f"WITH {_POINTS} SELECT point_id, CASE WHEN b IS NULL THEN 0 ELSE len(list_filter(marks, lambda m: {_HIT('b', 'm')})) END::INT AS hits, CASE WHEN b IS NULL THEN len(marks) ELSE len(list_filter(marks, lambda m: NOT {_HIT('b', 'm')})) END::INT AS misses FROM p LEFT JOIN ans USING (point_id)",
    "arm_verdicts": _VERDICTS + "SELECT point_id, a_pass, b_pass, leak FROM v",
    "answer_pivot": f"WITH {_POINTS} SELECT point_id, length(a)::INT AS a, length(b)::INT AS b FROM ans WHERE a IS NOT NULL OR b IS NOT NULL",
    "paired_stats": _VERDICTS + f"SELECT {_STATS} FROM v",
    "lift_report": _VERDICTS + f""", s AS (SELECT date_trunc('month', created_at)::TIMESTAMP AS month, {_STATS} FROM v GROUP BY 1),
      t AS (SELECT *, CASE WHEN n > 0 THEN (a_pass - b_pass)::DOUBLE / n END AS l, CASE WHEN a_only + b_only = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least(a_only, b_only) + 1),
        lambda k: exp(lgamma(a_only + b_only + 1) - lgamma(k + 1) - lgamma(a_only + b_only - k + 1) - (a_only + b_only) * {math.log(2)!r}::DOUBLE)))) END AS p FROM s)
      SELECT * EXCLUDE (l, p), round(l, 9) AS lift, round(p, 9) AS p_value, coalesce(l > 0 AND p < 0.05, false) AS significant FROM t""",
    "points_to_judge": _VERDICTS + "SELECT point_id, CASE WHEN b_pass THEN 'b-only' ELSE 'both-fail' END AS reason FROM v WHERE NOT a_pass",
    "judge_overlay": _OVERLAID + "SELECT point_id, a_pass, b_pass, leak FROM o",
    "judged_summary": _OVERLAID + f""", s AS (SELECT slice, count(*) AS n, count(*) FILTER (a_pass) AS a_pass, count(*) FILTER (b_pass) AS b_pass, count(*) FILTER (NOT a_pass AND NOT b_pass) AS both_fail,
        count(*) FILTER (a_pass AND NOT b_pass) AS a_only, count(*) FILTER (b_pass AND NOT a_pass) AS b_only FROM (SELECT *, unnest(CASE WHEN level = 'L1' THEN ['all', 'L1'] ELSE ['all'] END) AS slice FROM o) GROUP BY slice)
      SELECT *, round_even((a_pass - b_pass)::DOUBLE * 100 / n, 0)::BIGINT AS lift_pp, round({_MCNEMAR}, 9) AS p_value FROM s""",
    "known_verdicts": _VERDICTS + "SELECT point_id, a_pass, b_pass FROM v WHERE point_id IN (SELECT id FROM messages WHERE session_name IS NOT NULL)",
    "session_points": """SELECT session_name, row_number() OVER (PARTITION BY session_name ORDER BY id) AS place, 'p' || id AS point_id, count(*) OVER (PARTITION BY session_name) AS points FROM messages WHERE content IS NOT NULL""",
    "delay_spread": """SELECT count(s) AS n, min(s) AS least, max(s) AS most, round(avg(s), 3) AS mean FROM (SELECT CAST(floor(epoch(built_at)) AS BIGINT) - CAST(floor(epoch(cutoff)) AS BIGINT) AS s FROM portrait_snapshots)""",
    "marker_forms": "SELECT id, true AS number, false AS longer, false AS shorter, true AS grouped, true AS phrase, false AS part, true AS folded, false AS blank, true AS stop FROM messages",
    "parse_facts_forms": """WITH f AS (SELECT fact_no, fact_no % 12 AS k, fact_no || '' AS n FROM facts)
      SELECT fact_no, 0 AS place, 'STATE' AS kind, 'WORLD' AS domain, 'PROJECT' AS scope, 's' || n AS subject, 'p' AS predicate, 'o' AS object, NULL AS statement, n || ',7' AS evidence FROM f WHERE k = 0
      UNION ALL SELECT fact_no, 0, 'STATE', 'PSYCHE', 'USER', NULL, NULL, NULL, 't' || n, '' FROM f WHERE k = 1
      UNION ALL SELECT fact_no, 0, 'NARRATIVE', 'PSYCHE', 'PROJECT', 's' || n, NULL, NULL, 't', '' FROM f WHERE k = 2
      UNION ALL SELECT fact_no, 0, 'STATE', 'WORLD', 'PROJECT', 's' || n, 'p', 'o', NULL, '' FROM f WHERE k = 3
      UNION ALL SELECT fact_no, 0, 'NARRATIVE', 'WORLD', 'PROJECT', 's' || n, 'p', NULL, NULL, '' FROM f WHERE k = 4
      UNION ALL SELECT fact_no, 0, 'STATE', 'WORLD', 'PROJECT', 's' || n, NULL, NULL, NULL, n FROM f WHERE k = 10
      UNION ALL SELECT fact_no, 0, 'STATE', 'WORLD', 'PROJECT', 'a' || n, NULL, NULL, NULL, '' FROM f WHERE k = 11
      UNION ALL SELECT fact_no, 1, 'STATE', 'WORLD', 'PROJECT', NULL, NULL, NULL, 'b' || n, '' FROM f WHERE k = 11""",
    "judge_answers": """SELECT id, CASE WHEN id % 4 < 2 THEN id % 3 = 0 END AS a_pass, CASE id % 4 WHEN 0 THEN true WHEN 1 THEN false END AS b_pass, CASE WHEN id % 4 = 0 THEN 'r' END AS reason FROM messages""",
    "valid_answers": f"WITH {_POINTS}, {_CACHED} SELECT point_id, arm FROM made WHERE NOT old",
    "answers_to_make": f"""WITH {_POINTS}, {_CACHED}, open AS (SELECT point_id, arm FROM p, (SELECT unnest(['a', 'b']) AS arm) WHERE (point_id, arm) NOT IN (SELECT (point_id, arm) FROM made WHERE NOT old))
      SELECT point_id, arm FROM open WHERE point_id IN (SELECT DISTINCT point_id FROM open ORDER BY point_id LIMIT 500)""",
    "point_fingerprints": f"SELECT point_id, fp, left(fp, 12) AS short FROM (SELECT id AS point_id, {_POINT_FP} AS fp FROM messages WHERE content IS NOT NULL)",
    "word_similarity": f"""WITH g AS (SELECT fact_no, {_WORD_GRAMS('subject_norm')} AS a, {_WORD_GRAMS('statement')} AS b FROM facts)
      SELECT fact_no, round(CASE WHEN len(a) + len(b) = 0 THEN 0.0 ELSE len(list_intersect(a, b))::DOUBLE / (len(a) + len(b) - len(list_intersect(a, b))) END, 9) AS similarity FROM g""",
    "cosine_next": "SELECT v.vec_id, round(list_cosine_similarity(v.embedding::DOUBLE[], w.embedding::DOUBLE[]), 6) AS cosine FROM embeddings v JOIN embeddings w ON w.vec_id = v.vec_id + 1",
    "vector_literals": "SELECT vec_id, len(embedding)::INT AS n, round(list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings",
    "vectors_stored": f"SELECT fact_no, CASE WHEN embedding IS NOT NULL THEN len(embedding) WHEN regexp_replace(coalesce(statement, ''), '[\\x00-\\x20]+', '', 'g') <> '' THEN 64 END::INT AS length FROM facts",
    "evidence_vectors": "SELECT vec_id, round(embedding[1]::DOUBLE, 6) AS first FROM embeddings WHERE embedding IS NOT NULL AND vec_id IN (SELECT fact_no FROM facts WHERE batch_no = 8)",
    "span_validation": _SPAN,
    "validation_histogram": f"SELECT status, count(*) AS points FROM ({_SPAN}) GROUP BY status",
    "latency_percentiles": f"""SELECT unnest({QUANTILES}::DOUBLE[]) AS quantile, unnest(list_transform({QUANTILES}::DOUBLE[], lambda q: l[floor(len(l) * q)::INT + 1])) AS value FROM (
      SELECT list_sort(list(CAST(floor(epoch(built_at)) AS BIGINT) - CAST(floor(epoch(cutoff)) AS BIGINT))) AS l FROM portrait_snapshots WHERE built_at IS NOT NULL AND cutoff IS NOT NULL)""",
    "parse_facts_json": r"""SELECT fact_no, kind, fact_domain AS domain, scope, """ + ", ".join(rf"regexp_replace({c}, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g') AS {n}" for c, n in (("subject_norm", "subject"), ("predicate_norm", "predicate"), ("object_value", "object"), ("statement", "statement"))) + r""", coalesce(array_to_string(evidence, ','), '') AS evidence
      FROM facts WHERE regexp_replace(coalesce(subject_norm, ''), '[\x00-\x20]+', '', 'g') <> '' OR regexp_replace(coalesce(statement, ''), '[\x00-\x20]+', '', 'g') <> ''""",
    "trigram_pairs": _pairs("predicate_norm", "facts", 0.7) + " SELECT a, b, round(similarity, 9) AS similarity FROM pairs",
    "near_dup_top5": _pairs("predicate_norm", "facts", 0.6) + """, two AS (SELECT a AS value, b AS other, similarity FROM pairs UNION ALL SELECT b, a, similarity FROM pairs)
      SELECT value, other, round(similarity, 9) AS similarity, place FROM (SELECT *, row_number() OVER (PARTITION BY value ORDER BY similarity DESC, other) AS place FROM two) WHERE place <= 5""",
    "subject_pairs": _pairs("subject_norm", "facts", 0.3) + " SELECT a, b, round(similarity, 9) AS similarity FROM pairs",
    "predicate_pairs": _pairs("predicate_norm", "facts", 0.45) + " SELECT a, b, round(similarity, 9) AS similarity FROM pairs",
    "near_dup_subjects": _pairs("subject_norm", "facts", 0.6) + """, two AS (SELECT a AS value, b AS other, similarity FROM pairs UNION ALL SELECT b, a, similarity FROM pairs)
      SELECT value, other, round(similarity, 9) AS similarity, place FROM (SELECT *, row_number() OVER (PARTITION BY value ORDER BY similarity DESC, other) AS place FROM two) WHERE place <= 5""",
    "cosine_topk": """SELECT query_id, vec_id, round(c, 6) AS cosine, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(c, 9) DESC, vec_id) AS place FROM (
      SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS c FROM embeddings q JOIN embeddings v ON v.vec_id <> q.vec_id
      WHERE q.vec_id % 100 = 0)) WHERE place <= 10""",
}
