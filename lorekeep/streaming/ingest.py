"""Incremental ingest with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

MESSAGE = "id BIGINT, session_name STRING, peer_name STRING, content STRING, token_count INT, created_at TIMESTAMP"


def message_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Messages from the parquet files that arrive in a folder."""
    return spark.readStream.schema(MESSAGE).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def ingest(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append new messages once each, by id, however late they come, and let every session's cursor advance.

    Each micro-batch is written to a folder of its own number, so that a repeated batch overwrites itself; it leaves out the
    ids of the batches before it. Their ids are read again for each batch. Of one id's rows in a batch any one stays; a null
    id is one id.
    """

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        new = rows.dropDuplicates(["id"])
        if number and (path := _earlier(spark, f"{out}/messages", number)):
            old = spark.read.schema("id BIGINT").parquet(*path).select(F.col("id").alias("_id"))
            new = new.join(old, F.col("id").eqNullSafe(F.col("_id")), "left_anti")
        new.write.mode("overwrite").parquet(f"{out}/messages/batch={number}")
        written = spark.read.schema(rows.schema).parquet(f"{out}/messages/batch={number}")
        written.groupBy("session_name").agg(F.max("id").alias("position")).write.mode("overwrite").parquet(f"{out}/cursors/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _earlier(spark: SparkSession, folder: str, number: int) -> list[str]:
    """The folders of the batches before ``number`` that exist; one of a later number was left by a failure."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(folder)
    fs = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not fs.exists(p):
        return []
    names = [x.getPath().getName() for x in fs.listStatus(p)]
    return [f"{folder}/{n}" for n in names if n.startswith("batch=") and int(n[6:]) < number]


def session_activity(stream: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Messages and tokens per session and activity window; a window closes after a gap."""
    return (
        stream.withWatermark("created_at", late)
        .groupBy("session_name", F.session_window("created_at", gap).alias("w"))
        .agg(F.count("*").alias("messages"), F.sum(F.coalesce("token_count", F.lit(0))).alias("tokens"))
        .select("session_name", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "messages", "tokens")
    )
