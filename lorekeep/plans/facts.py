"""Queries on stored facts, with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dynamics import fact_weight as weight
from ..functions.dynamics import rate_of_half_life, register
from ..functions.text import base64_text, from_base64, row_key
from ..functions.text import canonical_key as key_of
from ..functions.text import fact_line, normalize, speaker
from ..operators import facts as ops
from ..sources.tables import table

HALF_LIFE, FLOOR = 30.0, 0.2


def _facts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "facts")


def normalize_text(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", F.md5(normalize(F.col("text")).cast("binary")).alias("digest"), F.length(normalize(F.col("text"))).alias("chars"))


def canonical_key(spark: SparkSession, folder: str) -> DataFrame:
    c = [F.col(x) for x in ("owner_id", "scope", "project_id", "subject_norm", "predicate_norm", "conditions")]
    return _facts(spark, folder).select("fact_no", key_of(*c).alias("canonical_key"))


def fact_lines(spark: SparkSession, folder: str) -> DataFrame:
    return _facts(spark, folder).select("fact_no", fact_line(*[F.col(c) for c in ("statement", "subject_norm", "predicate_norm", "object_value")]).alias("line"))


def dedup_facts(spark: SparkSession, folder: str) -> DataFrame:
    return ops.dedup(_facts(spark, folder))


def dedup_converged(spark: SparkSession, folder: str) -> DataFrame:
    return ops.dedup(_facts(spark, folder), "converged").select("fact_no", "reinforced", "evidence_count")


def dedup_stats(spark: SparkSession, folder: str) -> DataFrame:
    return ops.dedup_stats(_facts(spark, folder))


def rows_inserted(spark: SparkSession, folder: str) -> DataFrame:
    """The rows that an insert of each fact stores."""
    return ops.as_stored(_facts(spark, folder))


def dedup_rows(spark: SparkSession, folder: str) -> DataFrame:
    return ops.dedup_rows(_facts(spark, folder)).select("fact_no", "owner_id", "subject_norm", "predicate_norm", "object_value", "reinforcement_count", "evidence_count", "permanence")


def dedup_evidence(spark: SparkSession, folder: str) -> DataFrame:
    return ops.dedup_evidence(_facts(spark, folder))


def near_inserts(spark: SparkSession, folder: str) -> DataFrame:
    """Facts stored under a subject that is written almost like an earlier one."""
    return ops.near_inserts(_facts(spark, folder), 0.8)


def row_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Keys of facts made from what they say, in the form of UUIDs."""
    return _facts(spark, folder).select("fact_no", row_key(*[F.col(c) for c in ("owner_id", "project_id", "subject_norm", "fact_no")]).alias("key"))


def statements_base64(spark: SparkSession, folder: str) -> DataFrame:
    b = base64_text(F.col("statement"))
    return _facts(spark, folder).select("fact_no", b.alias("encoded"), from_base64(b).alias("decoded"))


def weights_in_sql(spark: SparkSession, folder: str) -> DataFrame:
    """The decaying weight as the registered SQL function."""
    register(spark)
    _facts(spark, folder).select("fact_no", "reinforcement_count").createOrReplaceTempView("_weighed")
    return spark.sql(f"SELECT fact_no, round(fact_weight({rate_of_half_life(HALF_LIFE)!r}D, {FLOOR}D, CAST(reinforcement_count AS DOUBLE)), 9) AS weight FROM _weighed")


def predicate_frequency(spark: SparkSession, folder: str) -> DataFrame:
    return ops.predicate_counts(_facts(spark, folder))


def known_predicates(spark: SparkSession, folder: str) -> DataFrame:
    return ops.vocabulary(_facts(spark, folder), 40)


def fact_experience(spark: SparkSession, folder: str) -> DataFrame:
    return ops.experience(_facts(spark, folder))


def fact_weight(spark: SparkSession, folder: str) -> DataFrame:
    """Weight by how many sessions of its pool came after a fact; what the user asserted doesn't decay."""
    e = ops.experience(_facts(spark, folder)).join(_facts(spark, folder).select("fact_no", "permanence"), "fact_no")
    w = weight(rate_of_half_life(HALF_LIFE), FLOOR, F.col("pool") - F.col("experience"))
    return e.select("fact_no", F.when(F.col("permanence") == "USER_ASSERTED", F.lit(1.0)).otherwise(F.round(w, 9)).alias("weight"))


def visible_counts(spark: SparkSession, folder: str) -> DataFrame:
    return ops.visible_counts(_facts(spark, folder))


def scoped_facts(spark: SparkSession, folder: str) -> DataFrame:
    """The facts that one project of one owner sees."""
    return ops.visible(_facts(spark, folder), "user:helmvik", "orbita-core").select("fact_no", "scope", "project_id")


def evidence_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """Facts with a question of a user among their evidence."""
    m = table(spark, folder, "messages")
    return ops.with_evidence_in(_facts(spark, folder), m.where((speaker(F.col("peer_name")) == "User") & F.col("content").rlike(r"\?$")))


def pending_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return _facts(spark, folder).where("embedding is null").groupBy("owner_id").agg(F.count("*").alias("pending"))


def shared_projects(spark: SparkSession, folder: str) -> DataFrame:
    return ops.shared_projects(_facts(spark, folder))


def fact_kind_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _facts(spark, folder).groupBy("kind", "fact_domain", "scope", "permanence").agg(F.count("*").alias("facts"))


def axis_states(spark: SparkSession, folder: str) -> DataFrame:
    return ops.axis_states(_facts(spark, folder))


def acceptance_checks(spark: SparkSession, folder: str) -> DataFrame:
    return ops.acceptance(_facts(spark, folder))


_N = lambda c: rf"regexp_replace(lower(regexp_replace(coalesce({c}, ''), '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')), '[ \t\n\x0B\f\r]+', ' ', 'g')"
_COND = "coalesce(array_to_string(list_transform(list_sort(list_transform(map_entries(conditions), lambda e: {'k': e.key, 'v': e.value})), lambda e: e.k || '=' || coalesce(e.v, '')), ';'), '')"
_BLANK = lambda c: rf"CASE WHEN regexp_replace({c}, '[\x00-\x20]+', '', 'g') <> '' THEN {c} END"
_STATE = f"""
WITH f AS (SELECT fact_no, kind, coalesce(len(evidence), 0) AS n, {_N('object_value')} AS obj,
    {_N('owner_id')} AS o, scope, {_BLANK('project_id')} AS p, {_N('subject_norm')} AS s, {_N('predicate_norm')} AS r, {_COND} AS c FROM facts),
g AS (SELECT *, first_value(obj) OVER w AS obj1, first_value(fact_no) OVER w AS no1 FROM f WHERE kind = 'STATE' WINDOW w AS (PARTITION BY o, scope, p, s, r, c ORDER BY fact_no)),
folded AS (SELECT CASE WHEN obj = obj1 THEN no1 ELSE fact_no END AS fact_no, n, obj <> obj1 AS conflict FROM g),
kept AS (SELECT fact_no, count(*) AS reinforced, CAST(sum(n) AS BIGINT) AS evidence_count, bool_or(conflict) AS conflict FROM folded GROUP BY fact_no
  UNION ALL SELECT fact_no, 1, n, false FROM f WHERE kind IS NULL OR kind <> 'STATE')
"""
_EXPERIENCE = """
SELECT f.fact_no, any_value(f.permanence) AS permanence, CASE WHEN any_value(f.created_at) IS NOT NULL THEN count(DISTINCT o.session_id) END AS experience,
  any_value(p.pool) AS pool
FROM facts f LEFT JOIN facts o ON o.owner_id IS NOT DISTINCT FROM f.owner_id AND o.scope IS NOT DISTINCT FROM f.scope AND o.created_at <= f.created_at
JOIN (SELECT owner_id, scope, count(DISTINCT CASE WHEN created_at IS NOT NULL THEN session_id END) AS pool FROM facts GROUP BY ALL) p
  ON p.owner_id IS NOT DISTINCT FROM f.owner_id AND p.scope IS NOT DISTINCT FROM f.scope
GROUP BY f.fact_no
"""
_ROLE_USER = "(peer_name IS NULL OR lower(peer_name) IN ('user', 'human'))"

QUERIES = {
    f.__name__: f
    for f in (
        normalize_text, canonical_key, fact_lines, dedup_facts, dedup_converged, dedup_stats, rows_inserted, dedup_rows, dedup_evidence, near_inserts, row_keys, statements_base64, weights_in_sql, predicate_frequency, known_predicates, fact_experience, fact_weight,
        visible_counts, scoped_facts, evidence_overlap, pending_embeddings, shared_projects, fact_kind_counts, axis_states, acceptance_checks,
    )
}
SQL = {
    "normalize_text": f"SELECT doc_id, md5({_N('text')}) AS digest, length({_N('text')}) AS chars FROM documents",
    "canonical_key": f"SELECT fact_no, {_N('owner_id')} || '|' || {_N('scope')} || '|' || {_N('project_id')} || '|' || {_N('subject_norm')} || '|' || {_N('predicate_norm')} || '|' || {_COND} AS canonical_key FROM facts",
    "fact_lines": f"SELECT fact_no, coalesce({_BLANK('statement')}, concat_ws(' · ', {_BLANK('subject_norm')}, {_BLANK('predicate_norm')}, {_BLANK('object_value')})) AS line FROM facts",
    "dedup_facts": _STATE + "SELECT fact_no, reinforced, evidence_count, conflict FROM kept",
    "dedup_converged": _STATE + """SELECT min(fact_no) AS fact_no, count(*) AS reinforced, CAST(sum(n) AS BIGINT) AS evidence_count FROM f WHERE kind = 'STATE' GROUP BY o, scope, p, s, r, c, obj
        UNION ALL SELECT fact_no, 1, n FROM f WHERE kind IS NULL OR kind <> 'STATE'""",
    "dedup_stats": _STATE + """SELECT CAST(sum(reinforced) AS BIGINT) AS total, count(*) AS inserted, CAST(sum(reinforced) - count(*) AS BIGINT) AS reinforced, count(*) FILTER (conflict) AS conflicts,
        CAST(sum(reinforced) - count(*) AS DOUBLE) / sum(reinforced) AS ratio FROM kept""",
    "predicate_frequency": "SELECT predicate_norm, count(*) AS uses, max(created_at) AS last_used FROM facts WHERE predicate_norm IS NOT NULL GROUP BY predicate_norm",
    "known_predicates": """WITH c AS (SELECT predicate_norm, count(*) AS uses, max(created_at) AS last_used FROM facts WHERE predicate_norm IS NOT NULL GROUP BY predicate_norm)
        SELECT predicate_norm FROM (SELECT predicate_norm FROM c ORDER BY uses DESC, predicate_norm LIMIT 30)
        UNION SELECT predicate_norm FROM (SELECT predicate_norm FROM c ORDER BY last_used DESC NULLS LAST, predicate_norm LIMIT 10)""",
    "fact_experience": f"SELECT fact_no, experience, pool FROM ({_EXPERIENCE})",
    "fact_weight": f"SELECT fact_no, CASE WHEN permanence = 'USER_ASSERTED' THEN 1.0::DOUBLE ELSE round({FLOOR}::DOUBLE + {1 - FLOOR}::DOUBLE * exp({-math.log(2) / HALF_LIFE!r}::DOUBLE * (pool - experience)), 9) END AS weight FROM ({_EXPERIENCE})",
    "visible_counts": """SELECT p.owner_id, p.project_id, count(*) AS visible FROM (SELECT DISTINCT owner_id, project_id FROM facts WHERE owner_id IS NOT NULL AND project_id IS NOT NULL) p
        JOIN facts f ON f.owner_id = p.owner_id AND (f.scope = 'USER' OR f.project_id = p.project_id OR f.project_id IS NULL) GROUP BY ALL""",
    "scoped_facts": "SELECT fact_no, scope, project_id FROM facts WHERE owner_id = 'user:helmvik' AND (scope = 'USER' OR project_id = 'orbita-core' OR project_id IS NULL)",
    "evidence_overlap": f"SELECT DISTINCT fact_no FROM (SELECT fact_no, unnest(evidence) AS id FROM facts) JOIN messages USING (id) WHERE {_ROLE_USER} AND regexp_matches(content, '\\?$')",
    "pending_embeddings": "SELECT owner_id, count(*) AS pending FROM facts WHERE embedding IS NULL GROUP BY owner_id",
    "shared_projects": "SELECT project_id, count(DISTINCT owner_id) AS owners FROM facts WHERE project_id IS NOT NULL AND owner_id IS NOT NULL GROUP BY project_id HAVING count(DISTINCT owner_id) > 1",
    "fact_kind_counts": "SELECT kind, fact_domain, scope, permanence, count(*) AS facts FROM facts GROUP BY ALL",
    "axis_states": """SELECT owner_id, predicate_norm, count(DISTINCT session_id) AS sessions, CASE WHEN count(DISTINCT session_id) >= 2 THEN 'active' ELSE 'emerging' END AS state
        FROM facts WHERE owner_id IS NOT NULL AND predicate_norm IS NOT NULL AND session_id IS NOT NULL GROUP BY ALL""",
    "acceptance_checks": f"""SELECT owner_id, coalesce(bool_or(contains(statement, '@')), false) AS has_email, bool_and(coalesce(len(evidence), 0) > 0) AS all_evidenced,
        bool_or(({_BLANK('statement')}) IS NULL) AS has_blank,
        bool_or(contains(lower(coalesce(predicate_norm, '')), 'branch') AND (contains(lower(coalesce(object_value, '')), 'main') OR contains(lower(coalesce(object_value, '')), 'master'))) AS has_branch,
        bool_or((contains(lower(coalesce(predicate_norm, '')), 'build') OR contains(lower(coalesce(predicate_norm, '')), 'stack')) AND contains(lower(coalesce(object_value, '')), 'gradle')) AS has_build,
        bool_and(NOT contains(lower(coalesce(subject_norm, '')), 'compressed')) AS no_noise FROM facts GROUP BY owner_id""",
    "rows_inserted": f"""SELECT fact_no, {_N('owner_id')} AS owner_id, {_BLANK('project_id')} AS project_id, kind, fact_domain, scope, {_N('subject_norm')} AS subject_norm, {_N('predicate_norm')} AS predicate_norm,
        object_value, statement, 1 AS reinforcement_count, 'USER_ASSERTED' AS permanence, 1.0::DOUBLE AS w FROM facts""",
    "dedup_rows": _STATE + f"""SELECT fact_no, {_N('owner_id')} AS owner_id, {_N('subject_norm')} AS subject_norm, {_N('predicate_norm')} AS predicate_norm, object_value, reinforced::INT AS reinforcement_count, evidence_count,
        'USER_ASSERTED' AS permanence FROM kept JOIN facts USING (fact_no)""",
    "dedup_evidence": _STATE + """, target AS (SELECT fact_no AS own, CASE WHEN obj = obj1 THEN no1 ELSE fact_no END AS fact_no FROM g UNION ALL SELECT fact_no, fact_no FROM f WHERE kind IS NULL OR kind <> 'STATE'),
        bag AS (SELECT t.fact_no, flatten(list(coalesce(evidence, []) ORDER BY own)) AS e FROM target t JOIN facts s ON s.fact_no = t.own GROUP BY t.fact_no)
        SELECT fact_no, unnest(range(1, len(e) + 1)) AS place, unnest(e) AS message_id FROM bag""",
    "near_inserts": f"""WITH f AS (SELECT fact_no, kind, {_N('owner_id')} AS o, scope, {_BLANK('project_id')} AS p, {_N('subject_norm')} AS s, {_N('predicate_norm')} AS r, {_COND} AS c, subject_norm IS NOT NULL AS named FROM facts),
        d AS (SELECT s, min(fact_no) AS first, list_distinct(list_transform(range(1, length('  ' || s || ' ') - 1), lambda i: substring('  ' || s || ' ', i, 3))) AS g FROM f WHERE named GROUP BY s),
        near AS (SELECT a.s, min(b.first) AS first FROM d a JOIN d b ON a.s <> b.s AND a.s <> '' AND b.s <> '' AND len(list_intersect(a.g, b.g))::DOUBLE / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g))) >= 0.8 GROUP BY a.s),
        opening AS (SELECT min(fact_no) AS fact_no, s FROM f WHERE kind = 'STATE' GROUP BY o, scope, p, s, r, c)
        SELECT fact_no FROM opening JOIN near USING (s) WHERE first < fact_no""",
    "row_keys": """SELECT fact_no, left(h, 8) || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] AS key FROM (
        SELECT fact_no, sha256(concat_ws(chr(1), coalesce('=' || owner_id, '-'), coalesce('=' || project_id, '-'), coalesce('=' || subject_norm, '-'), '=' || fact_no)) AS h FROM facts)""",
    "statements_base64": "SELECT fact_no, base64(encode(statement)) AS encoded, statement AS decoded FROM facts",
    "weights_in_sql": f"SELECT fact_no, round({FLOOR}::DOUBLE + {1 - FLOOR}::DOUBLE * exp({-math.log(2) / HALF_LIFE!r}::DOUBLE * reinforcement_count), 9) AS weight FROM facts",
}
