"""Writing results."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def candidates_jsonl(log: DataFrame, path: str) -> None:
    """Messages as JSON lines: id, session, peer, tokens, time, content."""
    log.select("id", F.col("session_name").alias("session"), F.col("peer_name").alias("peer"), "tokens", F.col("created_at").alias("time"), "content").write.mode("overwrite").json(path)


def json_arrays(rows: DataFrame, path: str) -> None:
    """One JSON array a file, of the rows as objects."""

    def run(frames):
        import pandas as pd

        begun = False
        for f in frames:
            for t in f["t"]:
                yield pd.DataFrame({"t": [("," if begun else "[") + t]})
                begun = True
        yield pd.DataFrame({"t": ["]" if begun else "[]"]})

    rows.select(F.to_json(F.struct("*")).alias("t")).mapInPandas(run, "t string").write.mode("overwrite").text(path)


def _file_system(rows: DataFrame, path):
    return path.getFileSystem(rows.sparkSession._jsparkSession.sessionState().newHadoopConf())


def replace_table(rows: DataFrame, path: str) -> None:
    """Write beside the old table and move into its place, so that a table can be rewritten from itself.

    The old table is moved aside first and deleted last; where a move fails it is put back, and the call raises.
    """
    jvm, fresh = rows.sparkSession._jvm, f"{path}.{uuid.uuid4().hex}"
    rows.write.parquet(fresh)
    p, q = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(fresh)
    fs = _file_system(rows, p)
    aside = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.old")
    had = fs.exists(p)
    if had and not fs.rename(p, aside):
        raise OSError(f"{path} can't be moved aside; the new table is {fresh}")
    if not fs.rename(q, p):
        if had:
            fs.rename(aside, p)
        raise OSError(f"{fresh} can't be moved to {path}; the old table stays")
    if had:
        fs.delete(aside, True)


def points_jsonl(points: DataFrame, path: str) -> None:
    """Exam points as JSON lines, in order of their ids within each file."""
    points.sortWithinPartitions("id").write.mode("overwrite").json(path)


def journal_jsonl(points: DataFrame, path: str) -> None:
    """Appends one line for each checked point (``check_points``): its id, whether it was taken, and why not."""
    points.select("id", F.col("error").isNull().alias("ok"), "error").write.mode("append").json(path)


def report_markdown(row: dict) -> str:
    """One report row as a small table."""
    return "\n".join(["| measure | value |", "| --- | --- |", *[f"| {k} | {v} |" for k, v in row.items()]])
