"""The driver's contract, the SQL of the core queries on the small tables, and what may import what."""

import ast
import os
from pathlib import Path

import pytest

import __spark_entry__ as entry
from lorekeep.plans import catalogue

ROOT = Path(__file__).resolve().parent.parent
DATA = "/root/testdata/sf0.001"


def compare(spark, query, sql, folder=DATA):
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in os.listdir(folder):
        con.execute(f"create view {f[:-8]} as select * from '{folder}/{f}'")
    df = query(spark, folder)
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    tidy = lambda v: round(v, 6) + 0.0 if isinstance(v, float) else v
    ours = sorted(tuple(repr(tidy(r[c])) for c in order) for r in df.collect())
    theirs = sorted(tuple(repr(tidy(r[names.index(c)])) for c in order) for r in cur.fetchall())
    assert ours == theirs


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    compare(spark, catalogue.queries()[name], catalogue.oracle_sql()[name])


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_as_of_queries_have_something_to_do_on_small_tables(spark):
    q = catalogue.queries()
    evidence = {r.fact_no: len(r.evidence) for r in spark.read.parquet(f"{DATA}/facts.parquet").where("size(evidence) > 0").collect()}
    kept = {r.fact_no: len(r.evidence.split(",")) for r in q["facts_at_half"](spark, DATA).collect()}
    assert 0 < len(kept) < len(evidence) and any(n < evidence[f] for f, n in kept.items())
    assert 0 < q["portrait_diff_to_half"](spark, DATA).count() < len(kept) == q["portrait_at_half"](spark, DATA).count()
    assert {r.provenance for r in q["provenance_histogram_at_half"](spark, DATA).collect()} == {"unknown", "valid", "lag", "in-window"}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_dictionary_scans_cover_subjects_and_loosely_similar_predicates(spark):
    q = catalogue.queries()
    column = lambda c: {r[0] for r in spark.read.parquet(f"{DATA}/facts.parquet").select(c).distinct().collect()}
    subjects, predicates = q["subject_pairs"](spark, DATA).collect(), q["predicate_pairs"](spark, DATA).collect()
    assert subjects and {x for r in subjects for x in (r.a, r.b)} <= column("subject_norm") and min(r.similarity for r in subjects) < 0.6
    assert predicates and {x for r in predicates for x in (r.a, r.b)} <= column("predicate_norm") and min(r.similarity for r in predicates) < 0.7
    assert {r.value for r in q["near_dup_subjects"](spark, DATA).collect()} == {x for r in subjects if r.similarity >= 0.6 for x in (r.a, r.b)}


def test_entry_has_a_stable_schema(spark):
    if os.path.isdir(DATA):
        assert entry.entry(spark).columns == ["snapshot_id", "fact_no"]


def test_every_core_query_has_sql_but_the_model_calls(spark):
    assert set(catalogue.queries()) - set(catalogue.oracle_sql()) == {"embedding_backfill", "extracted_facts"}
    if os.path.isdir(DATA):
        assert all(catalogue.queries()[n](spark, DATA).count() for n in ("embedding_backfill", "extracted_facts"))
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_in_the_core_imports_the_training_data_subpackage():
    for path in (ROOT / "lorekeep").rglob("*.py"):
        if "llm" in path.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [f"{node.module or ''}.{a.name}" for a in node.names] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n.split(".") for n in names), path


def test_a_missing_library_costs_the_training_data_queries_only():
    import subprocess
    import sys

    code = "import sys; sys.modules['regex'] = None; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-W", "ignore", "-c", code], cwd=ROOT, capture_output=True, text=True, check=True)
    assert done.stdout.split() == [str(len(catalogue.queries())), str(len(catalogue.oracle_sql()))]
