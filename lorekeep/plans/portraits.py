"""Queries on portraits, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import duration_text
from ..operators import portrait as ops
from ..operators.evaluate import order_statistics
from ..operators.lifecycle import latest
from ..settings import Settings
from ..sources.tables import table

BOUND, EARLIER = 10_000, 5_000  # message ids
MUST = ["prod", "postgres"]
ACROSS = ["5 service:"]
DIGEST_TOP = Settings().digest_top
HALF, QUARTER = 0.5, 0.25  # quantiles of the message ids


def _facts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "facts")


def portrait_whole(spark: SparkSession, folder: str) -> DataFrame:
    """Every fact in its place of its portrait, with its whole line."""
    return ops.ranked(_facts(spark, folder))


def portrait_sections(spark: SparkSession, folder: str) -> DataFrame:
    """The first 40 lines of each section of ``portrait_whole``, cut to 200 characters."""
    return ops.ranked(_facts(spark, folder), 40, 200)


def digest_text(spark: SparkSession, folder: str) -> DataFrame:
    """The first three lines of each section, cut to 200 characters."""
    return ops.digests(_facts(spark, folder), 3, 200)


def digest_whole(spark: SparkSession, folder: str) -> DataFrame:
    """Each whole portrait as text."""
    return ops.digests(_facts(spark, folder))


def digest_selected(spark: SparkSession, folder: str) -> DataFrame:
    """Of each whole portrait the facts nearest to its newest one, which is its trigger.

    Most facts have no vector of their own yet; the vectors of ``embeddings`` stand in for all of them, by fact_no in turn.
    """
    f, e = _facts(spark, folder), table(spark, folder, "embeddings")
    n = e.count()
    v = f.select("id", "fact_no", (F.col("fact_no") % n).alias("vec_id")).join(e.select("vec_id", F.col("embedding").cast("array<double>").alias("vector")), "vec_id")
    newest = f.groupBy("owner_id", "project_id").agg(F.max("fact_no").alias("fact_no"))
    triggers = newest.join(v.select("fact_no", F.col("vector").alias("trigger")), "fact_no", "left")
    items = ops.ranked(f, also=("id", "reinforcement_count", "created_at"))
    return ops.selected_digests(items, triggers, v, ["owner_id", "project_id"], DIGEST_TOP)


def portrait_cutoff(spark: SparkSession, folder: str) -> DataFrame:
    return ops.cutoffs(_facts(spark, folder))


def facts_as_of(spark: SparkSession, folder: str) -> DataFrame:
    f = ops.at_bound(_facts(spark, folder), BOUND)
    return f.select("fact_no", "reinforcement_count", F.array_join("evidence", ",").alias("evidence"))


def portrait_as_of(spark: SparkSession, folder: str) -> DataFrame:
    """The first 40 places of each section of ``portrait_whole_as_of``."""
    return ops.ranked(ops.at_bound(_facts(spark, folder), BOUND), 40).select("owner_id", "project_id", "section", "place", "fact_no")


def portrait_whole_as_of(spark: SparkSession, folder: str) -> DataFrame:
    """The whole ranked portrait from the facts as they were at the bound."""
    return ops.ranked(ops.at_bound(_facts(spark, folder), BOUND)).select("owner_id", "project_id", "section", "place", "fact_no")


def portrait_diff(spark: SparkSession, folder: str) -> DataFrame:
    f = _facts(spark, folder)
    return ops.new_facts(ops.at_bound(f, EARLIER), ops.at_bound(f, BOUND)).select("fact_no", "owner_id")


def stale_portraits(spark: SparkSession, folder: str) -> DataFrame:
    return ops.stale(_facts(spark, folder), table(spark, folder, "portrait_snapshots"))


def portrait_items(spark: SparkSession, folder: str) -> DataFrame:
    return ops.items(table(spark, folder, "portrait_snapshots"))


def item_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """Each stored item with the evidence of its fact, none if the fact is gone."""
    i = ops.items(table(spark, folder, "portrait_snapshots")).select("snapshot_id", "section", "place", "id")
    f = _facts(spark, folder).select("id", F.size(F.coalesce("evidence", F.array().cast("array<bigint>"))).alias("evidence_count"))
    return i.join(f, "id", "left").select("snapshot_id", "section", "place", "id", F.coalesce("evidence_count", F.lit(0)).alias("evidence_count"))


def latest_portraits(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "portrait_snapshots").select("owner_id", "project_id", "built_at", "snapshot_id", "cutoff")
    return latest(p, ["owner_id", "project_id"], ["built_at", "snapshot_id"])


def build_delays(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "portrait_snapshots")
    s = F.unix_seconds(F.col("built_at").cast("timestamp")) - F.unix_seconds(F.col("cutoff").cast("timestamp"))
    return p.select("snapshot_id", s.alias("seconds"), duration_text(F.abs(s)).alias("delay"))


def provenance_verdict(spark: SparkSession, folder: str) -> DataFrame:
    return ops.provenance(_facts(spark, folder), BOUND)


def provenance_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return ops.provenance(_facts(spark, folder), BOUND).groupBy("provenance").agg(F.count("*").alias("facts"))


def answer_coverage(spark: SparkSession, folder: str) -> DataFrame:
    return ops.answer_coverage(_facts(spark, folder), MUST, BOUND)


def _id_at(spark: SparkSession, folder: str, quantile: float) -> int:
    """The message id at a quantile of the log, so that the same share of it is read at every scale; -1 without messages."""
    r = order_statistics(table(spark, folder, "messages").select("id"), "id", [quantile]).first()
    return r["value"] if r else -1


def facts_at_half(spark: SparkSession, folder: str) -> DataFrame:
    f = ops.at_bound(_facts(spark, folder), _id_at(spark, folder, HALF))
    return f.select("fact_no", "reinforcement_count", F.array_join("evidence", ",").alias("evidence"))


def portrait_at_half(spark: SparkSession, folder: str) -> DataFrame:
    """The whole ranked portrait from the facts as they were at half of the log."""
    return ops.ranked(ops.at_bound(_facts(spark, folder), _id_at(spark, folder, HALF))).select("owner_id", "project_id", "section", "place", "fact_no")


def portrait_diff_to_half(spark: SparkSession, folder: str) -> DataFrame:
    """The facts that came between a quarter and half of the log."""
    f = _facts(spark, folder)
    return ops.new_facts(ops.at_bound(f, _id_at(spark, folder, QUARTER)), ops.at_bound(f, _id_at(spark, folder, HALF))).select("fact_no", "owner_id")


def provenance_at_half(spark: SparkSession, folder: str) -> DataFrame:
    return ops.provenance(_facts(spark, folder), _id_at(spark, folder, HALF))


def provenance_histogram_at_half(spark: SparkSession, folder: str) -> DataFrame:
    return provenance_at_half(spark, folder).groupBy("provenance").agg(F.count("*").alias("facts"))


def coverage_at_half(spark: SparkSession, folder: str) -> DataFrame:
    return ops.answer_coverage(_facts(spark, folder), MUST, _id_at(spark, folder, HALF))


def coverage_across_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Whether some fact of a portrait ends in a 5 and the next one begins with a service: a marker that lies across two facts."""
    return ops.answer_coverage(_facts(spark, folder), ACROSS, _id_at(spark, folder, 1.0))


def portraits_built(spark: SparkSession, folder: str) -> DataFrame:
    """The portraits of the history, with those that a later batch makes stale built anew."""
    f = _facts(spark, folder).where("owner_id is not null")
    old = f.where("batch_no = 0").groupBy("owner_id", "project_id").agg(F.max("created_at").alias("cutoff"), F.count("*").alias("lines"))
    return ops.reconcile(f, old, only_stale=True)


_BLANK = lambda c: rf"CASE WHEN regexp_replace({c}, '[\x00-\x20]+', '', 'g') <> '' THEN {c} END"
_WHOLE = f"coalesce({_BLANK('statement')}, concat_ws(' · ', {_BLANK('subject_norm')}, {_BLANK('predicate_norm')}, {_BLANK('object_value')}))"
_LINE = f"left({_WHOLE}, 200)"
_P, _S = "lower(coalesce(predicate_norm, ''))", "lower(coalesce(statement, ''))"
_CRITICAL = (
    f"(list_has_any(map_keys(coalesce(conditions, MAP {{}})), ['organization', 'project_type']) OR {' OR '.join(f'contains({_P}, {chr(39)}{x}{chr(39)})' for x in ops.CRITICAL_PREDICATES)}"
    f" OR {' OR '.join(f'contains({_S}, {chr(39)}{x}{chr(39)})' for x in ops.CRITICAL_STEMS)})"
)
_SECTION = f"CASE WHEN {_CRITICAL} THEN 'critical' WHEN fact_domain = 'PSYCHE' THEN 'preferences' ELSE 'constructs' END"


def _ranked(source: str, most: int = 40) -> str:
    return f"""SELECT * FROM (SELECT owner_id, project_id, section, row_number() OVER (PARTITION BY owner_id, project_id, section
        ORDER BY reinforcement_count DESC NULLS LAST, created_at ASC NULLS LAST, fact_no) AS place, fact_no, line
        FROM (SELECT *, {_SECTION} AS section, {_LINE} AS line FROM {source})) WHERE place <= {most}"""


def whole_sql(source: str) -> str:
    return f"""SELECT owner_id, project_id, section, row_number() OVER (PARTITION BY owner_id, project_id, section
        ORDER BY reinforcement_count DESC NULLS LAST, created_at ASC NULLS LAST, fact_no) AS place, fact_no, line FROM (SELECT *, {_SECTION} AS section, {_WHOLE} AS line FROM {source})"""


_JOINED = """SELECT owner_id, project_id, string_agg(t, chr(10) ORDER BY list_position(['critical', 'constructs', 'preferences'], section)) AS digest FROM (
    SELECT owner_id, project_id, section, '[' || section || ']' || chr(10) || string_agg('- ' || line, chr(10) ORDER BY place) AS t FROM t GROUP BY owner_id, project_id, section) GROUP BY owner_id, project_id"""
_LINED = r"regexp_replace(line, '[\x00-\x20]+', '', 'g') <> ''"


def _at(bound: int) -> str:
    return f"(SELECT * REPLACE (kept AS evidence, least(len(kept), reinforcement_count)::INT AS reinforcement_count) FROM (SELECT *, list_filter(evidence, lambda e: e <= {bound}) AS kept FROM facts) WHERE len(kept) > 0)"


def _provenance(bound: int | str) -> str:
    return f"""SELECT fact_no, CASE WHEN coalesce(list_max(evidence), -1) < 0 THEN 'unknown' WHEN list_max(evidence) <= {bound} THEN 'valid'
    WHEN list_min(evidence) > {bound} THEN 'in-window' ELSE 'lag' END AS provenance FROM facts"""


def _id_sql(quantile: float) -> str:
    return f"(SELECT list_sort(list(id))[least(floor(count(id) * {quantile})::BIGINT, count(id) - 1) + 1] FROM messages)"


def _at_quantile(quantile: float) -> str:
    return f"""(SELECT * EXCLUDE (kept, bound) REPLACE (kept AS evidence, least(len(kept), reinforcement_count)::INT AS reinforcement_count) FROM (
        SELECT *, list_filter(evidence, lambda e: e <= bound) AS kept FROM facts, (SELECT {_id_sql(quantile)} AS bound)) WHERE len(kept) > 0)"""


_PROVENANCE, _PROVENANCE_HALF = _provenance(BOUND), _provenance(_id_sql(HALF))
_ITEMS = "SELECT snapshot_id, section, place, i->>'id' AS id, i->>'subject' AS subject, i->>'predicate' AS predicate, i->>'object' AS object, i->>'statement' AS statement FROM (" + " UNION ALL ".join(
    f"SELECT snapshot_id, '{s}' AS section, unnest(range(1, len(x) + 1))::INT AS place, unnest(x) AS i FROM (SELECT snapshot_id, CAST(json_extract(snapshot, '$.{s}') AS JSON[]) AS x FROM portrait_snapshots)" for s in ops.SECTIONS
) + ")"
_TEXT = f"lower(regexp_replace(concat_ws(' ', {', '.join(_BLANK(c) for c in ('subject_norm', 'predicate_norm', 'object_value', 'statement'))}), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))"


def _covered(provenance: str, must: list[str] = MUST) -> str:
    return f"""WITH j AS (SELECT f.owner_id, f.project_id, CASE WHEN provenance = 'valid' AND t <> '' THEN t END AS t, section, place FROM (SELECT *, {_TEXT} AS t FROM facts) f
          JOIN ({provenance}) USING (fact_no) JOIN ({whole_sql('facts')}) USING (fact_no)),
        h AS (SELECT owner_id, project_id, regexp_replace(coalesce(string_agg(t, ' ' ORDER BY list_position(['critical', 'constructs', 'preferences'], section), place), ''), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g') AS t FROM j GROUP BY ALL)
        SELECT owner_id, project_id, {' AND '.join(f"contains(t, '{m}')" for m in must)} AS covered FROM h"""


QUERIES = {
    f.__name__: f
    for f in (
        portrait_whole, portrait_sections, digest_text, digest_whole, digest_selected, portrait_cutoff, facts_as_of, portrait_as_of, portrait_whole_as_of, portrait_diff, stale_portraits, portrait_items, item_evidence, latest_portraits,
        build_delays, provenance_verdict, provenance_histogram, answer_coverage,
        coverage_across_facts, portraits_built, facts_at_half, portrait_at_half, portrait_diff_to_half, provenance_at_half, provenance_histogram_at_half, coverage_at_half,
    )
}
SQL = {
    "portrait_whole": whole_sql("facts"),
    "portrait_sections": _ranked("facts"),
    "digest_text": f"""WITH t AS ({_ranked('facts', 3)}), s AS (SELECT owner_id, project_id, section, '[' || section || ']' || chr(10) || string_agg('- ' || line, chr(10) ORDER BY place) AS t
        FROM t WHERE regexp_replace(line, '[\\x00-\\x20]+', '', 'g') <> '' GROUP BY owner_id, project_id, section)
        SELECT owner_id, project_id, string_agg(t, chr(10) ORDER BY list_position(['critical', 'constructs', 'preferences'], section)) AS digest FROM s GROUP BY owner_id, project_id""",
    "digest_whole": f"WITH t AS (SELECT * FROM ({whole_sql('facts')}) WHERE {_LINED}) {_JOINED}",
    "digest_selected": f"""WITH v AS (SELECT f.fact_no, f.reinforcement_count, f.created_at, e.embedding::DOUBLE[] AS vector FROM facts f JOIN embeddings e ON e.vec_id = f.fact_no % (SELECT count(*) FROM embeddings)),
        n AS (SELECT owner_id, project_id, max(fact_no) AS newest FROM facts GROUP BY ALL),
        r AS (SELECT * FROM ({whole_sql('facts')}) WHERE {_LINED}),
        t AS (SELECT * FROM (SELECT r.owner_id, r.project_id, section, line, row_number() OVER (PARTITION BY r.owner_id, r.project_id ORDER BY list_cosine_similarity(v.vector, g.vector) DESC,
            coalesce(v.reinforcement_count, 0) DESC, v.created_at ASC NULLS FIRST, list_position(['critical', 'constructs', 'preferences'], section), r.place) AS place
            FROM r JOIN v USING (fact_no) JOIN n ON n.owner_id IS NOT DISTINCT FROM r.owner_id AND n.project_id IS NOT DISTINCT FROM r.project_id JOIN v g ON g.fact_no = n.newest) WHERE place <= {DIGEST_TOP}),
        d AS ({_JOINED})
        SELECT n.owner_id, n.project_id, regexp_replace(coalesce(digest, ''), '[ \\t\\n\\x0B\\f\\r]+$', '') AS digest FROM n LEFT JOIN d ON d.owner_id IS NOT DISTINCT FROM n.owner_id AND d.project_id IS NOT DISTINCT FROM n.project_id""",
    "portrait_cutoff": "SELECT owner_id, project_id, max(created_at) AS cutoff FROM facts GROUP BY ALL",
    "facts_as_of": f"SELECT fact_no, reinforcement_count, array_to_string(evidence, ',') AS evidence FROM {_at(BOUND)}",
    "portrait_as_of": f"SELECT owner_id, project_id, section, place, fact_no FROM ({_ranked(_at(BOUND))})",
    "portrait_whole_as_of": f"SELECT owner_id, project_id, section, place, fact_no FROM ({whole_sql(_at(BOUND))})",
    "portrait_diff": f"SELECT fact_no, owner_id FROM {_at(BOUND)} WHERE fact_no NOT IN (SELECT fact_no FROM {_at(EARLIER)})",
    "stale_portraits": """SELECT snapshot_id FROM portrait_snapshots s JOIN (SELECT owner_id, coalesce(project_id, '') AS p, max(created_at) AS m FROM facts GROUP BY ALL) f
        ON f.owner_id = s.owner_id AND f.p = coalesce(s.project_id, '') WHERE m > cutoff""",
    "portrait_items": _ITEMS,
    "item_evidence": f"SELECT snapshot_id, section, place, i.id, coalesce(len(evidence), 0)::INT AS evidence_count FROM ({_ITEMS}) i LEFT JOIN facts f ON f.id = i.id",
    "latest_portraits": """SELECT owner_id, project_id, built_at, snapshot_id, cutoff FROM (SELECT *, row_number() OVER (PARTITION BY owner_id, project_id
        ORDER BY built_at DESC NULLS LAST, snapshot_id DESC) AS rn FROM portrait_snapshots) WHERE rn = 1""",
    "build_delays": """SELECT snapshot_id, seconds, format('{}:{:02d}:{:02d}', abs(seconds) // 3600, abs(seconds) // 60 % 60, abs(seconds) % 60) AS delay
        FROM (SELECT snapshot_id, CAST(floor(epoch(built_at)) AS BIGINT) - CAST(floor(epoch(cutoff)) AS BIGINT) AS seconds FROM portrait_snapshots)""",
    "provenance_verdict": _PROVENANCE,
    "provenance_histogram": f"SELECT provenance, count(*) AS facts FROM ({_PROVENANCE}) GROUP BY ALL",
    "answer_coverage": _covered(_PROVENANCE),
    "coverage_across_facts": _covered(_provenance(_id_sql(1.0)), ACROSS),
    "portraits_built": """WITH n AS (SELECT owner_id, project_id, max(created_at) AS cutoff, count(*) AS lines FROM facts WHERE owner_id IS NOT NULL GROUP BY ALL),
        o AS (SELECT owner_id, project_id, max(created_at) AS cutoff, count(*) AS lines FROM facts WHERE owner_id IS NOT NULL AND batch_no = 0 GROUP BY ALL)
        SELECT n.owner_id, n.project_id, CASE WHEN o.lines IS NULL OR n.cutoff > o.cutoff THEN n.cutoff ELSE o.cutoff END AS cutoff, CASE WHEN o.lines IS NULL OR n.cutoff > o.cutoff THEN n.lines ELSE o.lines END AS lines
        FROM n LEFT JOIN o ON o.owner_id = n.owner_id AND o.project_id IS NOT DISTINCT FROM n.project_id""",
    "facts_at_half": f"SELECT fact_no, reinforcement_count, array_to_string(evidence, ',') AS evidence FROM {_at_quantile(HALF)}",
    "portrait_at_half": f"SELECT owner_id, project_id, section, place, fact_no FROM ({whole_sql(_at_quantile(HALF))})",
    "portrait_diff_to_half": f"SELECT fact_no, owner_id FROM {_at_quantile(HALF)} WHERE fact_no NOT IN (SELECT fact_no FROM {_at_quantile(QUARTER)})",
    "provenance_at_half": _PROVENANCE_HALF,
    "provenance_histogram_at_half": f"SELECT provenance, count(*) AS facts FROM ({_PROVENANCE_HALF}) GROUP BY ALL",
    "coverage_at_half": _covered(_PROVENANCE_HALF),
}
