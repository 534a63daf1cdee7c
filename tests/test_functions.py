"""Golden cases of the scalar functions."""

import math

import pytest
from pyspark.sql import functions as F

from lorekeep.functions import dynamics, parsing, similarity, text


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], [*values]) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize(("given", "wanted"), [("  A\t b\n\nC ", "a b c"), (None, ""), ("", ""), ("Ёж", "ёж")])
def test_normalize(spark, given, wanted):
    df = spark.createDataFrame([(given,)], "s string")
    assert df.select(text.normalize(F.col("s"))).first()[0] == wanted


def test_canonical_key_ignores_order_case_and_space(spark):
    rows = [("u", "USER", None, " Host ", "ip", {"b": "2", "a": "1"}), ("U", "user", "", "host", "IP", {"a": "1", "b": "2"}), ("u", "PROJECT", None, "host", "ip", {"a": "1", "b": "2"})]
    df = spark.createDataFrame(rows, "o string, s string, p string, j string, r string, c map<string,string>")
    a, b, c = [r[0] for r in df.select(text.canonical_key(*[F.col(x) for x in "ospjrc"])).collect()]
    assert a == b != c


@pytest.mark.parametrize(
    ("answer", "marker", "wanted"),
    [
        ("takes 18 minutes", "18", True), ("in 180 s", "18", False), ("in 2018", "18", False), ("the 18th", "18", False), ("тестирование", "тест", False), ("рост 10% за год", "10%", True),
        ("it is $800 now", "$800", True), ("**host** `ip`", "host ip", True), ("ещё раз", "еще", True), ("19 544 rows", "19544", True), ("19,544", "19 544", True), ("19'544", "19544", True),
        ("19 544", "19544", True), ("1 234 567", "1234567", True), ("19 5444", "195444", False), ("19,5", "195", False), (None, "x", False), ("x", None, False), ("x", "  ", False), (r"a \E b", r"\E", True), ("a.c", "a.c", True), ("abc", "a.c", False),
    ],
)
def test_markers(spark, answer, marker, wanted):
    df = spark.createDataFrame([(answer, marker)], "a string, m string")
    assert df.select(text.matches_marker(F.col("a"), F.col("m"))).first()[0] is wanted


def test_fact_line_and_span(spark):
    df = spark.createDataFrame([(None, "s", " ", "o"), ("st", "s", "p", "o")], "t string, s string, p string, o string")
    assert [r[0] for r in df.select(text.fact_line(*[F.col(c) for c in "tspo"])).collect()] == ["s · o", "st"]
    assert one(spark, text.contains_span(F.lit("Всё   хорошо"), F.lit("все хорошо"))) is True
    assert one(spark, text.contains_span(F.lit("abc"), F.lit("  "))) is False


def test_thousands_and_duration(spark):
    assert one(spark, text.strip_thousands(F.lit("1 234 567 8901 a,123"))) == "1234567 8901 a,123"
    assert one(spark, text.duration_text(F.lit(3725))) == "1:02:05"
    assert one(spark, text.cut_text(F.lit("abcdef"), 3)) == "abc…"


@pytest.mark.parametrize(("a", "b", "low", "high"), [("User:Anton", "user:anton ", 1, 1), ("", "", 1, 1), ("abc", "", 0, 0), ("deploy target", "deploy targte", 0.5, 0.99), ("кластер", "orange", 0, 0.2)])
def test_trigram_similarity(spark, a, b, low, high):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert low <= df.select(similarity.trigram_similarity(F.col("a"), F.col("b"))).first()[0] <= high


def test_word_grams_differ_on_punctuation(spark):
    df = spark.createDataFrame([("user:anton",)], "a string")
    row = df.select(similarity.grams(F.col("a")).alias("w"), similarity.word_grams(F.col("a")).alias("p")).first()
    assert "r:a" in row.w and "r:a" not in row.p and "  a" in row.p


def test_cosine(spark):
    v = lambda *x: F.array(*map(F.lit, x))
    assert one(spark, similarity.cosine(v(1.0, 0.0), v(2.0, 0.0))) == pytest.approx(1)
    assert one(spark, similarity.cosine(v(1.0, 0.0), v(0.0, 3.0))) == pytest.approx(0)
    assert one(spark, similarity.cosine(v(1.0, 0.0), v(1.0, 1.0))) == pytest.approx(math.sqrt(0.5))
    for bad in (v(1.0, 0.0, 0.0), v(0.0, 0.0)):
        with pytest.raises(Exception, match="vector"):
            one(spark, similarity.cosine(v(1.0, 0.0), bad))


def test_weight_as_column_and_sql(spark):
    dynamics.register(spark)
    rate = dynamics.rate_of_half_life(30)
    assert one(spark, dynamics.fact_weight(rate, 0.2, F.lit(30.0))) == pytest.approx(0.6)
    assert spark.sql(f"SELECT fact_weight({rate}D, 0.2D, 30D) AS w").first().w == pytest.approx(0.6)


def test_parse_facts(spark):
    rows = [
        (1, '```json\n[{"kind":"state","subject":"s","predicate":"p","object":"o","evidence_ids":["7", 8, "x"]}]\n``` bye'),
        (2, 'Sure! {"facts":[{"statement":"t","domain":"psyche","scope":"galaxy","conditions":{"n":1}},{"object":"dropped"}]}'),
        (3, '[{"kind":"PSYCHE","subject":"s","predicate":"p","object":"o"}]'), (4, '[{"kind":"weird","subject":"s"}]'), (5, "no json"), (6, None), (7, ""), (8, "```\n[{\"subject\":\"open\"}]"), (9, "{broken"),
    ]
    got = {r.k: r for r in parsing.parse_facts(spark.createDataFrame(rows, "k int, t string"), "k", "t").collect()}
    assert sorted(got) == [1, 2, 3, 4, 8]
    assert (got[1].kind, got[1].evidence, got[1].domain, got[1].scope) == ("STATE", [7, 8], "WORLD", "PROJECT")
    assert (got[2].domain, got[2].scope, got[2].kind, got[2].conditions) == ("PSYCHE", "PROJECT", "STATE", {"n": "1"})
    assert (got[3].kind, got[3].domain) == ("STATE", "PSYCHE")
    assert got[4].kind == "NARRATIVE"
    assert got[8].subject == "open"


def test_fingerprint_is_stable(spark):
    a = one(spark, text.fingerprint("v1", x=F.lit(1), y=F.lit(None).cast("string")))
    assert a == one(spark, text.fingerprint("v1", x=F.lit("1"), y=F.lit("")))
    assert len(a) == 64


def test_progress(spark):
    df = spark.createDataFrame([(50, 200, 100), (0, 10, 5), (3, 0, 0)], "d long, t long, s long").select(text.progress(F.col("d"), F.col("t"), F.col("s")).alias("p"))
    assert [(r.p.percent, r.p.per_minute, r.p.left) for r in df.collect()] == [(25, 30.0, "0:05:00"), (0, None, None), (None, None, None)]


def test_judge_verdict(spark):
    df = spark.createDataFrame([('Well: {"a_pass": true, "b_pass": false, "reason": "r"} ok',), ("none",), (None,)], "t string")
    assert [r[0] and (r[0].a_pass, r[0].b_pass, r[0].reason) for r in df.select(parsing.judge_verdict(F.col("t"))).collect()] == [(True, False, "r"), None, None]
