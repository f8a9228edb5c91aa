"""Streams over ``events``, run to the end of what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..streaming import dedup as stream_dedup
from ..streaming import facts as stream_facts
from ..streaming import keyed_state, resume, shared
from .base import Book, table
from .facts import ACTED, statements
from .scoring import ORACLES as SCORED

book = Book()
QUERIES, ORACLES = book.queries, book.oracles
GAP = "30 minutes"
#: How late a row may come; the tables' files are in no order of time.
LATE = "36500 days"


def stream(spark: SparkSession, sf_dir: str, name: str = "events") -> DataFrame:
    # as a pattern, as the source takes a plain path for a folder, and the table may be one file
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name[:-1]}[{name[-1]}].parquet")


#: After all times of the tables: a row of this time brings the watermark to the end.
END = "2200-01-01 00:00:00"


def closed(rows: DataFrame, time: str) -> DataFrame:
    """The stream and, after all that is there, one row of nulls at the end of times, so the watermark passes every row and nothing stays open."""
    spark = rows.sparkSession
    path = shared(spark, "end")
    spark.range(1).select(*(F.lit(END if f.name == time else None).cast(f.dataType).alias(f.name) for f in rows.schema)).write.parquet(path)
    return rows.unionByName(spark.readStream.schema(rows.schema).parquet(path))


def drained(out: DataFrame, name: str) -> DataFrame:
    """Runs a stream over all that is there into a Parquet sink in the shared folder, and reads it."""
    path = shared(out.sparkSession, name)
    query = out.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/progress").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return out.sparkSession.read.schema(out.schema).parquet(f"{path}/rows")


@book.query(f"{ACTED} SELECT id, subject, predicate, object, action FROM acted")
def stream_fact_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D1 as a stream; it must agree with the batch."""
    keyed_state(spark)
    return drained(stream_facts.actions(statements(stream(spark, sf_dir)), DEFAULT), "facts")


@book.query(SCORED["event_dedup"])
def stream_event_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D2 and T2 as a stream with a turn a second; it must agree with the batch. At the end of the stream no bucket's state is left."""
    t = stream(spark, sf_dir, "conversations").where("role <> 'system'").select(F.col("conv_id").alias("chat"), F.col("turn").alias("seq"), F.col("text").alias("summary"))
    timed = closed(t.withColumn("at", F.timestamp_seconds(F.col("seq") + 1)), "at").withWatermark("at", LATE)
    return drained(stream_dedup.dedup(timed, DEFAULT), "events")


@book.query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM e),
g AS (SELECT user_id, n, min(ts) AS started, count(*) AS events FROM s GROUP BY ALL)
SELECT user_id, started, events FROM g""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sessions of users with a gap of half an hour, by event time; a session is told once the watermark has passed its end."""
    e = closed(stream(spark, sf_dir).select("user_id", F.col("ts").cast("timestamp").alias("ts"), F.lit(1).alias("one")), "ts").withWatermark("ts", LATE)
    s = e.groupBy("user_id", F.session_window("ts", GAP).alias("w")).agg(F.count("one").alias("events"))
    return drained(s.where("events > 0").select("user_id", F.col("w.start").alias("started"), "events"), "sessions").withColumn("started", F.col("started").cast("timestamp_ntz"))


class Stopped(Exception):
    """A run that ends in the middle."""


@book.query("SELECT role, 'done' AS status, count(*) AS turns, sum(length(text))::BIGINT AS signs FROM conversations GROUP BY 1")
def stream_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4, T5: turns taken file by file; the run is broken off after a batch is written and before it is committed, and a second run goes on from there. Every turn is there once, and done."""
    files, path = shared(spark, "turns"), shared(spark, "resumed")
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length("text").cast("long").alias("signs"))
    t.repartition(4, "conv_id").write.parquet(files)
    rows = spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 1).parquet(files)

    def stop(number: int) -> None:
        if number == 1:
            raise Stopped

    try:
        resume.run(rows, path, stop)
    except Exception as gone:  # the stream wraps what its batches raise
        if "Stopped" not in str(gone):
            raise
    resume.run(rows, path)
    told = resume.written(spark, path, t.schema).join(resume.status(spark, path, t, ["conv_id", "turn"]), ["conv_id", "turn"])
    return told.groupBy("role", "status").agg(F.count("*").alias("turns"), F.sum("signs").alias("signs"))
