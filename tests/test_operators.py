"""Operators on small fixtures, against golden values and brute force."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lorekeep.operators import asof, evaluate, facts, lifecycle, portrait, sequences, similar
from lorekeep.operators import log as logs

T0 = dt.datetime(2025, 1, 1)
LOG = "id long, session_name string, peer_name string, content string, tokens int"


def log_of(spark, tokens, session="s"):
    return spark.createDataFrame([(i, session, "user", f"m{i}", t) for i, t in enumerate(tokens, 1)], LOG)


def sizes(spark, tokens, most, limit, chunk=8192):
    got = logs.greedy_batches(log_of(spark, tokens), ["session_name"], most, limit, chunk).groupBy("batch").count().orderBy("batch").collect()
    return [r["count"] for r in got]


@pytest.mark.parametrize(("tokens", "most", "limit", "wanted"), [([30] * 5, 20, 100, [3, 2]), ([500, 400, 5000, 100], 20, 1000, [2, 1, 1]), ([1] * 5, 2, 100, [2, 2, 1]), ([100], 2, 100, [1])])
def test_batches_golden(spark, tokens, most, limit, wanted):
    assert sizes(spark, tokens, most, limit) == wanted


def test_batches_in_pieces_equal_the_fold(spark):
    rng = random.Random(5)
    tokens = [rng.choice([0, 1, 5, 20, 60, 150, 400]) for _ in range(300)]
    whole = sizes(spark, tokens, 6, 200)
    assert sizes(spark, tokens, 6, 200, chunk=8) == whole == sizes(spark, tokens, 6, 200, chunk=50)
    assert sum(whole) == 300


def test_batches_of_empty_and_null(spark):
    assert logs.greedy_batches(spark.createDataFrame([], LOG), ["session_name"]).count() == 0
    got = logs.greedy_batches(spark.createDataFrame([(1, None, None, None, None), (2, None, None, None, None)], LOG), ["session_name"]).collect()
    assert sorted((r.id, r.batch) for r in got) == [(1, 1), (2, 1)]


def test_window_start_golden(spark):
    ids = list(range(1, 20, 2))
    df = spark.createDataFrame([(i, "s", "user", "x", 1) for i in ids], LOG)
    w0 = {r.id: r.w0 for r in logs.window_start(df, 5).collect()}
    assert (w0[ids[9]], w0[ids[6]], w0[ids[5]]) == (7, 1, -1)


def test_positions_and_looking_back_in_pieces(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a", "b", None])) for i in rng.sample(range(1, 5000), 400)]
    df = spark.createDataFrame(rows, "id long, k string")
    p = sequences.positions(df, "k", "id", chunk=64)
    got = {(r.k, r.id): r.pos for r in p.collect()}
    for key in ("a", "b", None):
        for n, i in enumerate(sorted(i for i, k in rows if k == key), 1):
            assert got[(key, i)] == n
    back = sequences.looking_back(p, "k", 3, {"x": lambda w: F.lag("id", 3).over(w)}, chunk=16)
    by = {k: sorted(i for i, x in rows if x == k) for k in ("a", "b", None)}
    for r in back.collect():
        assert r.x == (by[r.k][r.pos - 4] if r.pos > 3 else None)


def test_next_by_other(spark):
    df = spark.createDataFrame([(1, "s", "user", "", 1), (2, "s", None, "", 1), (3, "s", "ai", "", 1), (4, "s", "human", "", 1), (5, "t", "ai", "", 1)], LOG)
    assert {r.id: r.reply_id for r in logs.next_by_other(df).collect()} == {1: 3, 2: 3, 3: None, 4: None, 5: None}


def test_segments(spark):
    df = log_of(spark, [1] * 6)
    b = spark.createDataFrame([("s", 2), ("s", 4), ("other", 1)], "session_name string, bound_id long")
    assert [r.segment for r in logs.segments(df, b).orderBy("id").collect()] == [0, 0, 1, 1, 2, 2]


FACT = "fact_no long, id string, owner_id string, session_id string, project_id string, fact_domain string, scope string, kind string, subject_norm string, predicate_norm string, object_value string, statement string, conditions map<string,string>, evidence array<long>, reinforcement_count int, created_at timestamp_ntz"


def fact(no, obj="x", kind="STATE", evidence=(), owner="o", project="p", session="s1", scope="USER", domain="WORLD", rc=1, statement="st", conditions=None, day=0, predicate="r"):
    return (no, str(no), owner, session, project, domain, scope, kind, "subj", predicate, obj, statement, conditions, list(evidence), rc, T0 + dt.timedelta(days=day))


def fold(rows):
    kept, first = {}, {}
    for r in sorted(rows):
        if r[7] != "STATE":
            kept[r[0]] = 1
            continue
        key = (r[2], r[6], r[4], r[9])
        if key in first and first[key][1] == r[10].lower():
            kept[first[key][0]] += 1
        else:
            first.setdefault(key, (r[0], r[10].lower()))
            kept[r[0]] = 1
    return kept


def test_dedup_equals_the_fold(spark):
    rng = random.Random(2)
    rows = [fact(n, rng.choice("xXyz"), rng.choice(["STATE", "STATE", "EVENT"]), owner=rng.choice("ab"), project=rng.choice(["p", None])) for n in range(1, 120)]
    df = spark.createDataFrame(rows, FACT)
    assert {r.fact_no: r.reinforced for r in facts.dedup(df).collect()} == fold(rows)
    stats = facts.dedup_stats(df).first()
    assert (stats.total, stats.inserted) == (len(rows), len(fold(rows)))
    assert facts.dedup_stats(df.where("false")).first().ratio == 0


def test_vocabulary_order(spark):
    df = spark.createDataFrame([fact(1, predicate="host_ip"), fact(2, predicate="host_ip"), fact(3, predicate="ssh_user")], FACT)
    assert [r.predicate_norm for r in facts.vocabulary(df, 4).orderBy("predicate_norm").collect()] == ["host_ip", "ssh_user"]


def test_experience_counts_ties(spark):
    df = spark.createDataFrame([fact(1, session="a"), fact(2, session="b", day=1), fact(3, session="c", day=1), fact(4, session="a", day=2), fact(5, session=None, day=3)], FACT)
    assert {r.fact_no: (r.experience, r.pool) for r in facts.experience(df).collect()} == {1: (1, 3), 2: (3, 3), 3: (3, 3), 4: (3, 3), 5: (3, 3)}


def test_visibility_with_a_null_project(spark):
    df = spark.createDataFrame([fact(1, scope="USER", project="q"), fact(2, scope="PROJECT", project=None), fact(3, scope="PROJECT", project="p"), fact(4, scope="PROJECT", project="q")], FACT)
    assert {r.fact_no for r in facts.visible(df, "o", "p").collect()} == {1, 2, 3}
    assert {r.fact_no for r in facts.visible(df, "o", None).collect()} == {1, 2}


def test_as_of_projection(spark):
    df = spark.createDataFrame([fact(1, evidence=[10]), fact(2, evidence=[150]), fact(3), fact(4, evidence=[10, 20, 30], rc=2), fact(5, evidence=[10, 200], rc=5)], FACT)
    assert {r.fact_no: (r.reinforcement_count, r.evidence) for r in portrait.at_bound(df, 100).collect()} == {1: (1, [10]), 4: (2, [10, 20, 30]), 5: (1, [10])}


def test_provenance(spark):
    df = spark.createDataFrame([fact(1, evidence=[10, 12]), fact(2, evidence=[18]), fact(3, evidence=[10, 18]), fact(4)], FACT)
    assert [r.provenance for r in portrait.provenance(df, 15).orderBy("fact_no").collect()] == ["valid", "in-window", "lag", "unknown"]


def test_answer_coverage_needs_all_markers_in_valid_facts(spark):
    df = spark.createDataFrame([fact(1, evidence=[1], statement="Port  443"), fact(2, evidence=[99], statement="nginx")], FACT)
    cover = lambda must: portrait.answer_coverage(df, must, 50).first().covered
    assert cover(["port 443"]) and cover(["443", "subj"]) and not cover(["443", "nginx"]) and not cover([])


def test_sections_and_digest(spark):
    df = spark.createDataFrame([fact(1, conditions={"organization": "x"}, statement="crit"), fact(2, domain="PSYCHE", statement="pref"), fact(3, statement="one", rc=1, day=2), fact(4, statement="two", rc=1, day=1), fact(5, statement="three", rc=9, day=3)], FACT)
    order = [(r.section, r.place, r.fact_no) for r in portrait.ranked(df).orderBy("section", "place").collect()]
    assert order == [("constructs", 1, 5), ("constructs", 2, 4), ("constructs", 3, 3), ("critical", 1, 1), ("preferences", 1, 2)]
    assert portrait.digests(df, 2).first().digest == "[critical]\n- crit\n[constructs]\n- three\n- two\n[preferences]\n- pref"


def test_portrait_keeps_every_fact_with_its_whole_line(spark):
    rng = random.Random(6)
    hot = [fact(n, rc=rng.choice([1, 2, None]), day=rng.choice([0, 0, 0.01, 1, 2, 30]), statement=f"{n} " * 90, owner=rng.choice(["o", None])) for n in range(1, 200)]
    hot = [r if n % 9 else (*r[:-1], None) for n, r in enumerate(hot)]
    got = {r.fact_no: (r.owner_id, r.place, r.line) for r in portrait.ranked(spark.createDataFrame(hot, FACT)).collect()}
    wanted = {}
    for owner in ("o", None):
        mine = sorted((r for r in hot if r[2] == owner), key=lambda r: (-(r[14] or 0), r[15] or dt.datetime.max, r[0]))
        wanted |= {r[0]: (owner, place, r[11]) for place, r in enumerate(mine, 1)}
    assert got == wanted


def test_digest_selects_by_similarity_over_all_sections(spark):
    rows = [("p", "constructs", 1, "a", "far", 9, T0), ("p", "constructs", 2, "b", "near", 1, T0), ("p", "constructs", 3, "c", "tie late", 2, T0), ("p", "preferences", 1, "d", "tie early", 2, None), ("p", "critical", 1, "e", " ", 1, T0), ("q", "constructs", 1, "f", "only", 1, T0)]
    items = spark.createDataFrame(rows, "k string, section string, place int, id string, line string, reinforcement_count int, created_at timestamp_ntz")
    vectors = spark.createDataFrame([("a", [0.0, 1.0]), ("b", [1.0, 0.0]), ("c", [1.0, 1.0]), ("d", [1.0, 1.0])], "id string, vector array<double>")
    triggers = lambda *t: spark.createDataFrame(t, "k string, trigger array<double>")
    digest = lambda t, most=50, v=vectors: {r.k: r.digest for r in portrait.selected_digests(items, triggers(*t), v, ["k"], most).collect()}
    assert digest([("p", [2.0, 0.0])], 2) == {"p": "[constructs]\n- near\n[preferences]\n- tie early"}
    assert digest([("p", [2.0, 0.0])], 3) == {"p": "[constructs]\n- near\n- tie late\n[preferences]\n- tie early"}
    assert digest([("p", None), ("q", None), ("none", [1.0, 0.0])], 1) == {"p": "[constructs]\n- far\n- near\n- tie late\n[preferences]\n- tie early", "q": "[constructs]\n- only", "none": ""}
    with pytest.raises(Exception, match="without a vector: f"):
        digest([("q", [1.0, 0.0])])
    with pytest.raises(Exception, match="without an id"):
        portrait.selected_digests(items.withColumn("id", F.lit("")), triggers(("p", None)), vectors, ["k"]).collect()
    with pytest.raises(ValueError, match="at least one"):
        digest([("p", None)], 0)


def test_digest_without_a_trigger_is_the_whole_portrait(spark):
    rows = [fact(n, statement=f"line {n} " + "x" * 250, day=n) for n in range(1, 60)]
    assert portrait.digests(spark.createDataFrame(rows, FACT)).first().digest == "\n".join(["[constructs]", *[f"- {r[11]}" for r in rows]])


def test_items_keep_json_null_null(spark):
    df = spark.createDataFrame([(1, '{"critical":[{"id":"a","subject":null}],"constructs":[{"id":"b","subject":"s"}]}'), (2, None), (3, "broken")], "snapshot_id long, snapshot string")
    assert [(r.section, r.place, r.id, r.subject) for r in portrait.items(df).orderBy("id").collect()] == [("critical", 1, "a", None), ("constructs", 1, "b", "s")]


def test_known_at_equals_brute_force(spark):
    rng = random.Random(3)
    when = lambda: T0 + dt.timedelta(hours=rng.randrange(0, 9000))
    rows = [(n, rng.choice("ab"), rng.choice(["x", "y", None]), when(), rng.choice([None, when()]), rng.choice([None, None, when()])) for n in range(1, 250)]
    rows += [(n + 1000, *r[1:]) for n, r in enumerate(rows[:20])]
    moments = [(k, rng.choice(["a", "b", None]), rng.choice([when(), None])) for k in range(60)]
    f = spark.createDataFrame(rows, "no long, e string, i string, known timestamp_ntz, fr timestamp_ntz, til timestamp_ntz").withColumn("at", F.lit("clash"))
    m = spark.createDataFrame(moments, "mid long, e string, at timestamp_ntz").withColumn("known", F.lit(0))
    args = dict(entity={"e": (F.col("e"), F.col("e"))}, item={"i": F.col("i")}, start=F.coalesce("fr", "known"), known=F.col("known"), end=F.col("til"), fact_id="no", at=F.col("at"), moment_id="mid")
    got = {(r.mid, r.no) for r in asof.known_at(f, m, **args).collect()}
    wanted = set()
    for mid, e, at in moments:
        best = {}
        for no, fe, i, known, fr, til in rows:
            if e is not None and at is not None and fe == e and known <= at and (fr or known) <= at and (til is None or til > at):
                best[i] = max(best.get(i, (dt.datetime.min, dt.datetime.min, 0)), (fr or known, known, no))
        wanted |= {(mid, b[2]) for b in best.values()}
    assert got == wanted and wanted
    assert asof.known_at(f, m.where("false"), **args).count() == 0
    assert asof.known_at(f.where("false"), m, **args).count() == 0


def test_paired_stats_golden(spark):
    rows = [("1", True, False, False), ("2", True, False, False), ("3", False, True, False), ("4", True, True, False), ("5", False, False, False), ("6", True, True, True)]
    r = evaluate.report(spark.createDataFrame(rows, "point_id string, a_pass boolean, b_pass boolean, leak boolean")).first()
    assert (r.n, r.a_pass, r.b_pass, r.a_only, r.b_only, r.both, r.neither, r.leaks) == (5, 3, 2, 2, 1, 1, 1, 1)
    assert r.lift == pytest.approx(0.2) and not r.significant


@pytest.mark.parametrize(("b", "c", "p"), [(0, 0, 1.0), (0, 30, 2 / 2**30), (5, 5, 1.0), (1, 9, 22 / 1024), (2, 0, 0.5)])
def test_mcnemar(spark, b, c, p):
    assert spark.createDataFrame([(b, c)], "b long, c long").select(evaluate.mcnemar(F.col("b"), F.col("c"))).first()[0] == pytest.approx(p)


def test_mcnemar_doesnt_overflow(spark):
    assert spark.createDataFrame([(1500, 1600)], "b long, c long").select(evaluate.mcnemar(F.col("b"), F.col("c"))).first()[0] == pytest.approx(0.0754, abs=2e-3)


def test_verdict_and_leak(spark):
    points = spark.createDataFrame([("p", "C", [], ["secret"]), ("q", "L1", ["go"], None)], "point_id string, level string, must array<string>, must_not array<string>")
    answers = spark.createDataFrame([("p", "a", "a secret"), ("p", "b", "nothing"), ("q", "a", "go now"), ("q", "b", "stop"), ("r", "a", "x")], "point_id string, arm string, answer string")
    assert {r.point_id: (r.a_pass, r.b_pass, r.leak) for r in evaluate.arm_verdicts(points, answers).collect()} == {"p": (False, True, True), "q": (True, False, False)}


def status(spark, **over):
    base = {"trigger": "ask", "message": "Please ask me", "truth": "ответ", "anchor": "Вот ответ", "anchor_id": 9, "message_id": 5, "level": "L1", "must": ["ключ"], "must_not": [], "window": ["текст"], "skip": False} | over
    ddl = "trigger string, message string, truth string, anchor string, anchor_id long, message_id long, level string, must array<string>, must_not array<string>, window array<string>, skip boolean"
    df = spark.createDataFrame([tuple(base.values())], ddl)
    return df.select(evaluate.span_status(**{k: F.col(k) for k in base})).first()[0]


@pytest.mark.parametrize(
    ("over", "wanted"),
    [
        ({}, "ok"), ({"skip": True}, "skip"), ({"trigger": "absent"}, "span-miss"), ({"truth": "нет"}, "span-miss"), ({"window": ["тут ключ."]}, "in-window"), ({"must_not": ["ключ"]}, "marker-collision"),
        ({"anchor_id": 5}, "causality"), ({"anchor_id": None, "anchor": None}, "unanchored"), ({"level": "C", "must_not": ["яд"], "window": ["яд"]}, "in-window"), ({"must": None, "must_not": None}, "ok"),
    ],
)
def test_span_statuses(spark, over, wanted):
    assert status(spark, **over) == wanted


def test_order_statistics(spark):
    df = spark.range(1, 201).toDF("v")
    assert [r.value for r in evaluate.order_statistics(df, "v", [0.5, 0.9, 0.95, 0.99]).collect()] == [101, 181, 191, 199]
    assert evaluate.order_statistics(df.where("false"), "v", [0.5]).count() == 0


def test_similar_pairs_equal_the_cross_product(spark):
    from lorekeep.functions.similarity import trigram_similarity

    values = ["deploy target", "deploy  target", "Deploy targte", "retry limit", "retry_limit", "retry", "", " ", "ab", "абв гд", "абв где"]
    df = spark.createDataFrame([(v,) for v in [*values, None, "retry"]], "v string")
    for least in (0.3, 0.6, 0.9):
        got = {(r.a, r.b): round(r.similarity, 9) for r in similar.similar_pairs(df, least).collect()}
        a, b = (df.where("v is not null").distinct().select(F.col("v").alias(x)) for x in "ab")
        s = a.crossJoin(b).where("a < b").withColumn("s", trigram_similarity(F.col("a"), F.col("b"))).where(F.col("s") >= least)
        assert got == {(r.a, r.b): round(r.s, 9) for r in s.collect()}


def test_nearest_is_exact(spark):
    rng = random.Random(4)
    df = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(80)] + [(99, None)], "id long, v array<double>")
    got = similar.nearest(df, df.where("id % 10 = 0"), "id", "v", 3).collect()
    from lorekeep.functions.similarity import cosine

    x = df.where("v is not null")
    full = x.where("id % 10 = 0").select(F.col("id").alias("q"), F.col("v").alias("w")).crossJoin(x).where("q <> id").withColumn("c", cosine(F.col("w"), F.col("v")))
    best = {}
    for r in full.collect():
        best.setdefault(r.q, []).append((-r.c, r.id))
    assert {(r.query_id, r.id) for r in got} == {(q, i) for q, v in best.items() for _, i in sorted(v)[:3]}
    assert similar.nearest(df, df.where("false"), "id", "v").count() == 0


def test_lifecycle(spark):
    t = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "k string, v int, d string")
    assert {(r.k, r.d) for r in lifecycle.latest(t, ["k"], ["v"]).collect()} == {("a", "y"), ("b", "z")}
    cur = spark.createDataFrame([("s", 5)], "session_name string, position long")
    log = spark.createDataFrame([(i, s) for i in (4, 5, 6) for s in ("s", "t", None)], "id long, session_name string")
    assert {(r.id, r.session_name) for r in lifecycle.pending(log, cur, "session_name", "id").collect()} == {(6, "s"), *[(i, s) for i in (4, 5, 6) for s in ("t", None)]}
    runs = spark.createDataFrame([("e", "arms", "running"), ("e", "arms", "done"), ("f", "arms", "running")], "experiment string, stage string, status string")
    assert [r.status for r in lifecycle.interrupt(runs, "e", "arms").collect()] == ["interrupted", "done", "running"]
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "run_id int, x string")
    kept, gone = lifecycle.delete_run({"answers": rows}, 1)
    assert {r.x for r in kept["answers"].collect()} == {"b", "c"} and rows.agg(gone["answers"]).first()[0] == 1


def test_points_are_checked(spark):
    ddl = "id string, level string, truth string, must_not array<string>"
    rows = [("ok-1", "L1", "t", None), ("bad id", "L1", "t", None), ("x", "L2", "t", None), ("y", "L1", " ", None), ("z", "C", None, []), ("w", "C", None, ["m"]), ("d", "L1", "t", None), ("d", "L1", "t", None), (None, "L1", "t", None)]
    got = [(r.id, r.error) for r in lifecycle.check_points(spark.createDataFrame(rows, ddl)).collect()]
    assert sorted(got, key=str) == sorted([("ok-1", None), ("bad id", "bad id"), ("x", "bad level"), ("y", "L1 needs a truth"), ("z", "C needs must_not"), ("w", None), ("d", "repeated id"), ("d", "repeated id"), (None, "bad id")], key=str)


def test_experiments_are_resolved(spark):
    e = spark.createDataFrame([("a", "active", "fp"), ("b", "archived", "fp")], "slug string, status string, ingest_fp string")
    assert lifecycle.resolve_experiment(e, "fp") == "a"
    for args in (("other",), ("fp", "b"), ("fp", "none")):
        with pytest.raises(ValueError):
            lifecycle.resolve_experiment(e, *args)


def test_a_marker_may_lie_across_two_facts(spark):
    rows = [fact(1, evidence=[1], statement="ends with alpha", predicate=None, obj=None, rc=9), fact(2, evidence=[1], statement="beta begins", predicate=None, obj=None, rc=5), fact(3, evidence=[99], statement="gamma", rc=1)]
    rows = [(*r[:8], None, *r[9:]) for r in rows]  # no subject
    df = spark.createDataFrame([*rows, fact(4, evidence=[99], owner="late", statement="alpha beta")], FACT)
    cover = lambda must: {r.owner_id: r.covered for r in portrait.answer_coverage(df, must, 50).collect()}
    assert cover(["Alpha Beta"]) == {"o": True, "late": False}
    assert cover(["beta alpha"]) == {"o": False, "late": False} and cover(["begins gamma"]) == {"o": False, "late": False}
    assert cover(["with alpha beta begins"])["o"] and cover(["ends"])["o"]


def test_coverage_over_many_short_facts(spark):
    rows = [(*fact(n, evidence=[1], statement=str(n % 10), rc=1, day=n)[:8], None, None, None, str(n % 10), None, [1], 1, T0 + dt.timedelta(days=n)) for n in range(30)]
    df = spark.createDataFrame(rows, FACT)
    text = " ".join(str(n % 10) for n in range(30))
    for must in ("0 1 2 3 4 5 6 7", "9 0 1", "9 1", text, text + " 0"):
        assert portrait.answer_coverage(df, [must], 5).first().covered is (must in text)


def test_fold_keeps_evidence_in_order(spark):
    rows = [fact(1, evidence=[5, 5]), fact(2, evidence=[]), fact(3, evidence=[9], obj="other"), fact(4, evidence=[1, 2]), fact(5, kind="EVENT", evidence=[7]), fact(6, evidence=[5])]
    df = spark.createDataFrame(rows, FACT)
    got = {}
    for r in facts.dedup_evidence(df).orderBy("fact_no", "place").collect():
        got.setdefault(r.fact_no, []).append((r.place, r.message_id))
    assert got == {1: [(1, 5), (2, 5), (3, 1), (4, 2), (5, 5)], 3: [(1, 9)], 5: [(1, 7)]}
    kept = {r.fact_no: (r.reinforcement_count, r.permanence, r.subject_norm) for r in facts.dedup_rows(df).collect()}
    assert kept == {1: (4, "USER_ASSERTED", "subj"), 3: (1, "USER_ASSERTED", "subj"), 5: (1, "USER_ASSERTED", "subj")}


def test_near_inserts(spark):
    rows = [(*fact(n)[:8], s, "r", *fact(n)[10:]) for n, s in enumerate(["deploy target", "deploy targets", "Deploy  Target", "retry", "deploy targets"], 1)]
    assert [r.fact_no for r in facts.near_inserts(spark.createDataFrame(rows, FACT)).collect()] == [2]


def test_totals_before_in_ranges(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["a", "b", None]), i, rng.choice([None, 0, 1, 5])) for i in rng.sample(range(4000), 300)]
    got = {r.i: r.before for r in sequences.totals_before(spark.createDataFrame(rows, "k string, i long, v long"), "k", "i", "v", chunk=100).collect()}
    assert got == {i: sum(w or 0 for q, j, w in rows if q == k and j < i) for k, i, _ in rows}


@pytest.mark.parametrize("chunk", [7, 1000])
def test_nearest_in_chunks(spark, chunk):
    rng = random.Random(5)
    vs = {i: [rng.gauss(0, 1) for _ in range(3)] for i in range(60)}
    df = spark.createDataFrame(list(vs.items()), "id long, v array<double>")
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
    wanted = {(q, i) for q in range(0, 60, 3) for _, i in sorted((-cos(vs[q], v), i) for i, v in vs.items() if i != q)[:4]}
    assert {(r.query_id, r.id) for r in similar.nearest(df, df.where("id % 3 = 0"), "id", "v", 4, chunk).collect()} == wanted
    with pytest.raises(Exception, match="zero vector"):
        similar.nearest(df.union(spark.createDataFrame([(99, [0.0, 0.0, 0.0])], df.schema)), df.where("id = 1"), "id", "v").collect()


def test_runs_are_folded_from_events(spark):
    t = lambda m: T0 + dt.timedelta(minutes=m)
    rows = [(1, 1, t(0), "e", "arms", "running", None, None, None), (1, 2, t(1), None, None, None, 5, 50, None), (1, 3, t(2), None, None, None, 9, 90, 1), (1, 4, t(3), None, None, "done", None, None, None), (2, 1, t(0), "e", "arms", "running", None, None, None)]
    r = lifecycle.run_states(spark.createDataFrame(rows, lifecycle.RUN_EVENT))
    got = {x.run_id: (x.status, x.calls, x.prompt_tokens, x.completion_tokens, x.started_at, x.finished_at) for x in r.collect()}
    assert got == {1: ("done", 9, 90, 1, t(0), t(3)), 2: ("running", None, None, None, t(0), None)}
    assert r.agg(lifecycle.interrupted(r, "e", "arms")).first()[0] == 1


def test_works_are_in_order(spark):
    df = spark.createDataFrame([("b", 5, 9000), ("a", 5, 5), ("c", -1, 3)], "point_id string, w0 long, previous long")
    assert [(r.point_id, r.bound, r.kind) for r in lifecycle.works(df).orderBy("n").collect()] == [("c", 3, "m"), ("a", 5, "w0"), ("b", 5, "w0"), ("a", 5, "m"), ("b", 9000, "m")]
    b = spark.createDataFrame([(5, 3), (3, 3), (2, 3), (1, None), (0, None)], "b long, c long").select(lifecycle.replay_branch(F.col("b"), F.col("c")))
    assert [r[0] for r in b.collect()] == ["ingest", "build", "project", "ingest", "build"]


def test_an_experiment_is_begun_anew(spark):
    e = spark.createDataFrame([("a", "live", "active", "f", "g"), ("z", "live", "archived", "f", "g"), ("b", "live", "active", "f", "g")], "slug string, material string, status string, ingest_fp string, answer_fp string")
    f = spark.createDataFrame([(1, "o", "p"), (2, "o", "q"), (3, "o", None)], "fact_no long, owner_id string, project_id string")
    c = spark.createDataFrame([("s", 5), ("t", 6)], "session_name string, position long")
    src = spark.createDataFrame([("o", "p", "s")], "owner_id string, project_id string, session_name string")
    e2, f2, c2 = lifecycle.create_experiment(e, f, c, src, slug="b", material="m", ingest_fp="h", answer_fp="i")
    assert {(r.slug, r.status, r.ingest_fp) for r in e2.collect()} == {("a", "archived", "f"), ("z", "archived", "f"), ("b", "active", "h")}
    assert {r.fact_no for r in f2.collect()} == {2, 3} and {r.session_name for r in c2.collect()} == {"t"}


def test_reads_and_listing(spark):
    t = spark.createDataFrame([("a", 1), ("b", None)], "k string, v int")
    keys = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "k string")
    assert {r.k: r.v for r in lifecycle.reads(t, keys, ["k"], "v", 0).collect()} == {"a": 1, "b": 0, "c": 0, None: 0}
    assert [r.k for r in lifecycle.listing(t, "-v").collect()] == ["a", "b"] and lifecycle.listing(t, "v", k="b").count() == 1


def test_portraits_are_reconciled(spark):
    f = spark.createDataFrame([fact(1, day=1), fact(2, day=5), fact(3, owner="n", project=None, day=2)], FACT)
    old = spark.createDataFrame([("o", "p", T0 + dt.timedelta(days=9), 7), ("gone", "p", T0, 1)], "owner_id string, project_id string, cutoff timestamp_ntz, lines long")
    rows = lambda **k: {(r.owner_id, r.lines) for r in portrait.reconcile(f, old, **k).collect()}
    assert rows() == {("o", 2), ("n", 1), ("gone", 1)} and rows(only_stale=True) == {("o", 7), ("n", 1), ("gone", 1)}


def test_tables_are_created_once(spark):
    try:
        for _ in range(2):
            lifecycle.create_tables(spark, {"runs_of_a_test": "id BIGINT, status STRING"})
        spark.sql("INSERT INTO runs_of_a_test VALUES (1, 'x')")
        lifecycle.create_tables(spark, {"runs_of_a_test": "id BIGINT, status STRING"})
        assert spark.table("runs_of_a_test").count() == 1
    finally:
        spark.sql("DROP TABLE IF EXISTS runs_of_a_test")


def test_signatures_lose_no_pair(spark):
    """Many long values that differ by letters: what the signatures let through must hold every similar pair."""
    from lorekeep.functions.similarity import trigram_similarity

    rng = random.Random(12)
    base = ["listens on port", "service:yonder-domino-22323", "deploy window of the whole cluster"]
    values = sorted({"".join(c if rng.random() > 0.06 else rng.choice("abcdefgxyz ") for c in rng.choice(base)) for _ in range(150)})
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = {(r.a, r.b): round(r.similarity, 9) for r in similar.similar_pairs(df, 0.5).collect()}
    a, b = (df.select(F.col("v").alias(x)) for x in "ab")
    wanted = a.crossJoin(b).where("a < b").withColumn("s", trigram_similarity(F.col("a"), F.col("b"))).where("s >= 0.5")
    assert got == {(r.a, r.b): round(r.s, 9) for r in wanted.collect()} and len(got) > 300


def test_many_similar_pairs_equal_the_cross_product_over_many_ranges(spark):
    from lorekeep.functions.similarity import trigram_similarity

    rng = random.Random(4)
    base = ["service:yonder-domino-22323", "Service : yonder-domino-2232", "queue_обед 17", "x", "ab", "\U0001f4a1 idea \U0001f4a1", "l" * 300, "".join(rng.choice("abcdef") for _ in range(600))]
    values = sorted({"".join(c if rng.random() > 0.08 else rng.choice("xyzXYZ -") for c in rng.choice(base)) for _ in range(120)} | {"", " ", "\t", "  x", "X"})
    df = spark.createDataFrame([(v,) for v in [*values, None, *values[:5]]], "v string")
    a, b = (df.where("v is not null").distinct().select(F.col("v").alias(x)) for x in "ab")
    s = a.crossJoin(b).where("a < b").withColumn("s", trigram_similarity(F.col("a"), F.col("b"))).cache()
    for least, chunk in ((0.05, 10_000), (0.3, 40), (0.3, 10_000), (0.5, 20), (1.0, 50)):
        wanted = {(r.a, r.b): round(r.s, 9) for r in s.where(F.col("s") >= least).collect()}
        got = similar.many_similar_pairs(df, least, chunk).collect()
        assert len(got) == len(wanted) > 5 and {(r.a, r.b): round(r.similarity, 9) for r in got} == wanted
    assert similar.many_similar_pairs(df.where("v is null"), 0.3).count() == 0
    assert similar.many_similar_pairs(df.where("v = 'x'"), 0.3).count() == 0


def test_subject_pairs_are_not_shuffled(spark, tmp_path):
    """Two million pairs of two thousand subjects: what is shuffled is the subjects."""
    from lorekeep.plans import evaluation

    def shuffled():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        found = spark.sparkContext._jsc.sc().statusStore().executorList(False)
        return sum(found.apply(k).totalShuffleWrite() for k in range(found.size()))

    spark.range(2000).select(F.format_string("service:amber-falcon-%d", F.col("id") + 10_000).alias("subject_norm")).write.parquet(f"{tmp_path}/facts.parquet")
    before = shuffled()
    pairs = evaluation.subject_pairs(spark, str(tmp_path))
    assert pairs.agg(F.count("*"), F.min("similarity")).first()[0] == 2000 * 1999 // 2
    assert shuffled() - before < 2000 * 1000
