"""Files in, files out, and the streaming twin of the ingest."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from lorekeep.sources import logs, sinks
from lorekeep.streaming import ingest

RECORDS = [
    {"question_id": "q1", "question_type": "t", "question": "Who?", "answer": 7, "question_date": "2023/06/01 (Thu) 10:00", "haystack_dates": ["2023/05/21 (Sun) 02:21", "2023/05/20 (Sat) 02:21", "bad"],
     "haystack_sessions": [[{"role": "user", "content": "later"}], [{"role": "user", "content": "first"}, {"role": "assistant", "content": "reply"}], [{"role": "user", "content": "undated"}]]},
    {"question_id": "q2", "question_type": "t", "question": "?", "answer": "a b c d e f g h i", "question_date": None, "haystack_dates": ["2023/05/20 (Sat) 02:21"], "haystack_sessions": [[{"role": "user", "content": "x"}]]},
]


@pytest.fixture
def record_file(tmp_path):
    p = tmp_path / "records.json"
    p.write_text(json.dumps(RECORDS))
    return str(p)


def test_record_log_and_points(spark, record_file):
    r = logs.records(spark, record_file)
    log = logs.record_log(r.where("question_id = 'q1'")).orderBy("id").collect()
    assert [(x.id, x.content) for x in log] == [(1, "first"), (2, "reply"), (3, "later"), (4, "undated"), (5, "Who?")]
    assert log[0].created_at == dt.datetime(2023, 5, 20, 2, 21) and log[3].created_at is None and log[0].token_count == 1
    points = logs.record_points(r, ["t"], 2).collect()
    assert [(p.id, p.source_message_id, p.must) for p in points] == [("lme-q1", 5, ["7"])]
    assert logs.route(spark, "lme-q1", record_file=record_file).count() == 5
    with pytest.raises(KeyError):
        logs.route(spark, "lme-none", record_file=record_file)


def test_messages_jsonl(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"id":1,"session_name":"s","peer_name":"u","content":"c","token_count":3,"created_at":"2025-01-01T00:00:00Z"}\n\n{"id":2,"content":"d","created_at":""}\n{"id":3}\n')
    got = logs.messages_jsonl(spark, str(tmp_path / "m.jsonl")).orderBy("id").collect()
    assert [r.id for r in got] == [1, 2, 3] and got[0].created_at is not None and got[1].created_at is None


def test_points_jsonl_refuses_repeated_ids(spark, tmp_path):
    p = tmp_path / "p.jsonl"
    p.write_text('{"id":"a","level":"L1"}\n{"id":"a","level":"C"}\n')
    with pytest.raises(ValueError, match="repeated"):
        logs.points_jsonl(spark, str(p))


def test_replace_table_from_itself(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    spark.range(3).write.parquet(path)
    sinks.replace_table(spark.read.parquet(path).where("id > 0"), path)
    assert spark.read.parquet(path).count() == 2


def test_candidates(spark, tmp_path):
    df = spark.createDataFrame([(1, "s", "p", 2, dt.datetime(2025, 1, 1), "c")], "id long, session_name string, peer_name string, tokens int, created_at timestamp, content string")
    sinks.candidates_jsonl(df, f"{tmp_path}/out")
    assert spark.read.json(f"{tmp_path}/out").first().session == "s"
    assert "| n | 1 |" in sinks.report_markdown({"n": 1})


def test_stream_ingests_each_message_once(spark, tmp_path):
    src, out, check = (f"{tmp_path}/{x}" for x in ("in", "out", "check"))
    row = lambda i: (i, "s", "user", f"m{i}", 1, dt.datetime(2025, 1, 1, 0, i % 60))
    ddl = "id long, session_name string, peer_name string, content string, token_count int, created_at timestamp"
    spark.createDataFrame([row(1), row(2), row(2)], ddl).coalesce(1).write.mode("append").parquet(src)
    ingest.ingest(ingest.message_stream(spark, src), out, check).awaitTermination()
    spark.createDataFrame([row(2), row(3)], ddl).coalesce(1).write.mode("append").parquet(src)
    ingest.ingest(ingest.message_stream(spark, src), out, check).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(f"{out}/messages").collect()) == [1, 2, 3]
    assert spark.read.parquet(f"{out}/cursors").agg(F.max("position")).first()[0] == 3


def test_stream_keeps_messages_weeks_late(spark, tmp_path):
    src, out, check = (f"{tmp_path}/{x}" for x in ("in", "out", "check"))
    row = lambda i, day: (i, "s", "user", f"m{i}", 1, dt.datetime(2025, 1, 1) + dt.timedelta(days=day))
    ddl = "id long, session_name string, peer_name string, content string, token_count int, created_at timestamp"
    rows = [row(i, 200 - i) for i in range(1, 121)]
    spark.createDataFrame(rows + rows[:5], ddl).repartition(130).write.option("maxRecordsPerFile", 1).parquet(src)
    assert len(list((tmp_path / "in").glob("*.parquet"))) > 100
    ingest.ingest(ingest.message_stream(spark, src), out, check).awaitTermination()
    spark.createDataFrame([row(7, 0), row(121, 0), row(122, -60)], ddl).coalesce(1).write.mode("append").parquet(src)
    ingest.ingest(ingest.message_stream(spark, src), out, check).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(f"{out}/messages").collect()) == list(range(1, 123))


def test_session_activity(spark, tmp_path):
    src = f"{tmp_path}/in"
    ddl = "id long, session_name string, peer_name string, content string, token_count int, created_at timestamp"
    at = lambda m: dt.datetime(2025, 1, 1) + dt.timedelta(minutes=m)
    spark.createDataFrame([(1, "s", "u", "", 2, at(0)), (2, "s", "u", "", 3, at(10)), (3, "s", "u", "", 4, at(200)), (4, "s", "u", "", None, at(2000))], ddl).write.parquet(src)
    q = ingest.session_activity(ingest.message_stream(spark, src)).writeStream.format("memory").queryName("activity").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.messages, r.tokens) for r in spark.table("activity").collect()) == [(1, 4), (2, 5)]


def test_first_existing(spark, tmp_path):
    (tmp_path / "b").write_text("x")
    assert logs.first_existing(spark, f"{tmp_path}/a", f"{tmp_path}/b") == f"{tmp_path}/b"
    with pytest.raises(FileNotFoundError):
        logs.first_existing(spark, f"{tmp_path}/a")


def test_records_are_cut_out_of_many_splits(spark, tmp_path, monkeypatch):
    rng = random.Random(11)
    bits = ['a "quoted" }', "{", "}", "\\", 'end\\"', "plain", "[x]", "ж}", '{"role": "user"}', "\n", "}}{{"]
    rows = []
    for k in range(60):
        turns = [[{"role": rng.choice(["user", "assistant"]), "content": " ".join(rng.choice(bits) for _ in range(rng.randrange(0, 6)))} for _ in range(rng.randrange(0, 4))] for _ in range(rng.randrange(0, 4))]
        rows.append({"question_id": f"q{k % 50}", "question_type": "t", "question": rng.choice(bits), "answer": rng.choice([7, "x", None]), "question_date": None, "haystack_dates": ["bad"] * len(turns), "haystack_sessions": turns, "more": {"deep": [{"x": "}"}]}})
    for text in (json.dumps(rows), json.dumps(rows, indent=2, ensure_ascii=False)):
        (tmp_path / "r.json").write_text(text)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
        try:
            got = sorted(logs.records(spark, str(tmp_path / "r.json")).collect(), key=lambda r: r.file_place)
            assert spark.read.option("lineSep", "}").text(str(tmp_path / "r.json")).rdd.getNumPartitions() > 3
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert [(r.question_id, r.question, [[(t.role, t.content) for t in s] for s in r.haystack_sessions]) for r in got] == [(r["question_id"], r["question"], [[(t["role"], t["content"]) for t in s] for s in r["haystack_sessions"]]) for r in rows]
        last = {r.question_id: r.file_place for r in logs.last_of(logs.records(spark, str(tmp_path / "r.json"))).collect()}
        assert len(last) == 50 and all(last[f"q{k}"] == k + 50 for k in range(10))
    points = logs.record_points(logs.records(spark, str(tmp_path / "r.json")), ["t"], 2, limit=3).collect()
    assert len(points) == 3


@pytest.mark.parametrize("text", ['{"question_id": "a"}', "", "7"])
def test_files_that_are_no_array_are_refused(spark, tmp_path, text):
    (tmp_path / "r.json").write_text(text)
    with pytest.raises(ValueError, match="JSON array"):
        logs.records(spark, str(tmp_path / "r.json"))


def test_a_failing_rename_keeps_the_old_table(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/t"
    spark.range(3).write.parquet(path)
    real = spark._jvm.org.apache.hadoop.fs.Path

    class Failing:
        """A file system whose renames to the table's own place fail once."""

        def __init__(self, fs):
            self.fs, self.failed = fs, False

        def exists(self, p):
            return self.fs.exists(p)

        def delete(self, p, deep):
            return self.fs.delete(p, deep)

        def rename(self, a, b):
            if str(b.toString()).endswith("/t") and not self.failed:
                self.failed = True
                return False
            return self.fs.rename(a, b)

    monkeypatch.setattr(sinks, "_file_system", lambda rows, p: Failing(p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())))
    with pytest.raises(OSError, match="the old table stays"):
        sinks.replace_table(spark.range(5), path)
    assert spark.read.parquet(path).count() == 3 and real is not None


def test_points_and_journal(spark, tmp_path):
    p = spark.createDataFrame([("b", None), ("a", "bad level")], "id string, error string")
    sinks.points_jsonl(p.select("id"), f"{tmp_path}/p")
    sinks.journal_jsonl(p, f"{tmp_path}/j")
    sinks.journal_jsonl(p.limit(1), f"{tmp_path}/j")
    assert {r.id for r in spark.read.json(f"{tmp_path}/p").collect()} == {"a", "b"}
    assert sorted((r.id, r.ok) for r in spark.read.json(f"{tmp_path}/j").collect()) == [("a", False), ("b", True), ("b", True)]


def test_json_arrays_are_read_back(spark, tmp_path):
    rows = spark.range(100).selectExpr("concat('q', id) AS question_id", "'a}\"{' AS question")
    sinks.json_arrays(rows.repartition(3), f"{tmp_path}/r")
    got = logs.records(spark, f"{tmp_path}/r").collect()
    assert {r.question_id for r in got} == {f"q{k}" for k in range(100)} and {r.question for r in got} == {'a}"{'} and len({r.file_place for r in got}) == 100
