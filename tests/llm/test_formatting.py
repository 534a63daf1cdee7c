"""Copies that differ in formatting."""

from pyspark.sql import functions as F

from lorekeep.llm import formatting

DDL = "fact_no long, owner_id string, project_id string, subject_norm string, predicate_norm string, statement string"


def found(spark, tmp_path, rows):
    spark.createDataFrame(rows, DDL).withColumn("first", F.lit("clash")).write.mode("overwrite").parquet(f"{tmp_path}/facts.parquet")
    pairs = sorted((r.first_no, r.fact_no) for r in formatting.p6_found(spark, str(tmp_path)).collect())
    counts = {r.fact_no: r.copies for r in formatting.p6_records(spark, str(tmp_path)).collect()}
    return pairs, counts


def test_guises(spark, tmp_path):
    base = ("o", "p", "Host: A", "deploy_target")
    rows = [
        (1, *base, "a: B; c - d"), (2, "o", "p", "host a", "Deploy  target", "C D|  A b!!"), (3, *base, "c d\n·a b;;"), (4, *base, "b a; c d"), (5, *base, "a b; a b; c d"), (6, *base, "a b; c d; c d"),
        (7, "o", None, "host a", "deploy target", "a b; c d"), (8, "o", None, "host a", "deploy target", "c d; a b"), (9, *base, None), (10, *base, "..."), (11, None, None, None, None, "z"), (12, None, None, "", "", "Z."),
        (13, *base, "a b; c d; a b"), (14, *base, "a; b c d"),
    ]
    pairs, counts = found(spark, tmp_path, rows)
    assert pairs == [(1, 2), (1, 3), (5, 13), (7, 8), (11, 12)]
    assert counts == {1: 3, 4: 1, 5: 2, 6: 1, 7: 2, 11: 2, 14: 1}


def test_empty_and_long(spark, tmp_path):
    assert found(spark, tmp_path, []) == ([], {})
    text = "; ".join(f"word{i} x" for i in range(3000))
    back = "|".join(f"WORD{i}  X" for i in reversed(range(3000)))
    assert found(spark, tmp_path, [(2, "o", "p", "s", "r", back), (1, "o", "p", "s", "r", text)]) == ([(1, 2)], {1: 2})


def test_hot_group(spark, tmp_path):
    rows = [(i, "o", "p", "s", "r", "same thing" + "!" * (i % 5)) for i in range(1, 400)]
    pairs, counts = found(spark, tmp_path, rows)
    assert pairs == [(1, i) for i in range(2, 400)] and counts == {1: 399}


def test_equal_fingerprints_are_compared(spark, monkeypatch):
    monkeypatch.setattr(formatting, "_multiset_hash", lambda fields, seed: F.size(fields).cast("long"))
    df = spark.createDataFrame([(1, ["a", "b"]), (2, ["b", "a"]), (3, ["a", "c"]), (4, ["c", "a"]), (5, ["a", "a"])], "n long, f array<string>")
    got = sorted((r["first"], r["number"]) for r in formatting.copies(df, number="n", same={"k": F.lit(1)}, fields=F.col("f")).collect())
    assert got == [(1, 1), (1, 2), (3, 3), (3, 4), (5, 5)]
