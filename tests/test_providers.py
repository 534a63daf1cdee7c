"""Model calls with offline stand-ins, prompts and settings."""

import pytest
from pyspark.sql import functions as F

from lorekeep import settings
from lorekeep.functions import prompts
from lorekeep.functions.parsing import readable
from lorekeep.functions.similarity import cosine
from lorekeep.operators import providers


def test_embeddings_are_unit_vectors_and_follow_the_text(spark):
    df = spark.createDataFrame([(1, "deploy target"), (2, "deploy targets"), (3, "сон"), (4, "deploy target")], "id long, t string")
    e = {r.id: r.embedding for r in providers.embed(df, "id", "t", providers.HashEmbedder(32), 2).collect()}
    assert e[1] == e[4] and len(e[1]) == 32 and sum(x * x for x in e[3]) == pytest.approx(1)
    near = spark.createDataFrame([(e[1], e[2], e[3])], "a array<double>, b array<double>, c array<double>")
    r = near.select(cosine(F.col("a"), F.col("b")).alias("x"), cosine(F.col("a"), F.col("c")).alias("y")).first()
    assert r.x > 0.7 > r.y


@pytest.mark.parametrize("text", [None, " "])
def test_blank_texts_are_refused(spark, text):
    df = spark.createDataFrame([(1, text)], "id long, t string")
    with pytest.raises(Exception, match="blank"):
        providers.embed(df, "id", "t", providers.HashEmbedder()).collect()


def test_incomplete_vectors_are_refused(spark):
    class Short(providers.HashEmbedder):
        def embed(self, texts):
            return super().embed(texts)[:-1]

    with pytest.raises(Exception, match="incomplete"):
        providers.embed(spark.createDataFrame([(1, "a")], "id long, t string"), "id", "t", Short()).collect()


def test_batches_to_facts(spark):
    rows = [(1, 1, "user", "subject: repo a; attr: port; value: 80"), (2, 1, None, "just talk"), (3, 2, "ai", None)]
    df = spark.createDataFrame(rows, "id long, batch long, peer_name string, content string")
    b = prompts.batch_texts(df, ["batch"])
    assert [r.text for r in b.orderBy("batch").collect()] == ["[1] user: subject: repo a; attr: port; value: 80\n[2] user: just talk", "[3] ai: "]
    got = providers.extract(b, providers.FieldExtractor()).collect()
    assert [(r.subject, r.predicate, r.object, r.evidence) for r in got] == [("repo a", "port", "80", [1])]
    assert providers.extract(b.where("false"), providers.FieldExtractor()).count() == 0


def test_unreadable_answers_are_asked_for_again(spark):
    class Shy:
        def complete(self, system, user, temperature):
            return ("[]" if temperature > 0 else "hm"), 1, 1

    df = spark.createDataFrame([("k", "u")], "k string, u string")
    r = providers.complete(df, ["k"], "", "u", Shy(), lambda a: "[" in a).first()
    assert (r.answer, r.calls, r.prompt_tokens) == ("[]", 2, 2)


def test_stale_answers(spark):
    p = spark.createDataFrame([("p", "f1"), ("q", "f2")], "point_id string, point_fp string")
    a = spark.createDataFrame([("p", "a", "f1"), ("p", "b", "old"), ("q", "a", None), ("gone", "a", "f")], "point_id string, arm string, point_fp string")
    assert sorted((r.point_id, r.arm) for r in providers.stale_answers(p, a).collect()) == [("p", "b"), ("q", "a"), ("q", "b")]
    assert [(r.point_id, r.arm) for r in providers.stale_answers(p, a, 1).collect()] == [("p", "b")]


def test_arms_differ_in_the_digest_only(spark):
    df = spark.range(1).select(prompts.arm_prompt(F.lit("t"), F.lit("q")).alias("b"), prompts.arm_prompt(F.lit("t"), F.lit("q"), F.lit("d")).alias("a")).first()
    assert df.a.endswith(df.b) and "d" in df.a.removesuffix(df.b)
    assert prompts.vocabulary_text([]) != "" and prompts.vocabulary_text(["a", "b"]) == "a, b"


def test_settings(tmp_path):
    f = tmp_path / "s.properties"
    f.write_text("# c\nmodel_url=u\nmodel = m\nwindow=7\nembedding_url=e\n")
    s = settings.load(str(f), env={"LOREKEEP_MODEL": "n", "LOREKEEP_WINDOW": " "})
    assert (s.model_url, s.model, s.answer_model, s.window, s.embedding_url, s.selects) == ("u", "n", "n", 7, "", False)
    assert settings.load(None, env={"LOREKEEP_EMBEDDING_URL": "e", "LOREKEEP_EMBEDDING_MODEL": "x"}).selects
    assert settings.load(str(tmp_path / "none"), env={}).batch_tokens == 2000


def test_broken_json_is_asked_for_again_and_fails_at_last(spark):
    class Broken:
        """Answers with broken, then with cut-off JSON, then well, or never."""

        def __init__(self, heals):
            self.heals = heals

        def complete(self, system, user, temperature):
            if temperature == 0:
                return '[{"kind": "STATE", "subj', 1, 1
            if temperature < 0.5:
                raise providers.Truncated("cut")
            return ('Here: [{"subject": "s"}]' if self.heals else "[{]"), 1, 1

    df = spark.createDataFrame([(1, "u")], "first_id long, text string")
    assert [r.subject for r in providers.extract(df, Broken(True)).collect()] == ["s"]
    with pytest.raises(Exception, match="no readable answer in 3 tries"):
        providers.extract(df, Broken(False)).collect()


@pytest.mark.parametrize(("text", "ok"), [("[]", True), ('{"facts": []}', True), ("```json\n[1]\n```", True), ("```\n[1", False), ('see [{"a": 1}] there', True), ('[{"a": 1}', False), ("none", False), (None, False), ("", False)])
def test_readable(text, ok):
    assert readable(text) is ok


def test_vectors_are_joined_back(spark):
    t = spark.createDataFrame([(1, [1.0], "x"), (2, None, "y"), (3, None, "z")], "id long, embedding array<double>, c string")
    v = spark.createDataFrame([(2, [2.0])], "id long, embedding array<double>")
    out = providers.with_vectors(t, v, "id")
    assert out.columns == t.columns and {r.id: r.embedding for r in out.collect()} == {1: [1.0], 2: [2.0], 3: None}
