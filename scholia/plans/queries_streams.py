"""Queries that run a stream over what there is and stop."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.evaluate import all_positive
from ..session import scratch
from ..streaming import state as S
from .registry import query
from .relations import TURNS, turns

#: Sessions are saved at this time; what comes later is streamed.
SAVED_AT = "2024-01-11"
#: A turn arrives up to two days late; arrivals of eight days come together.
LATE, TOGETHER = 2 * 86400, 8 * 86400
#: Files of each arrival, read by one micro-batch.
FILES = 2


def _saved(rows: DataFrame) -> DataFrame:
    """Each session's failures as a line of JSON; every tenth session's is cut off."""
    failed = rows.where(F.col("ts") < F.lit(SAVED_AT).cast("timestamp")).groupBy("session", "node").agg(F.count_if(~all_positive(F.col("c"), F.col("k"), F.col("e"))).alias("failed"))
    line = F.to_json(F.struct("session", F.col("nodes")))
    lines = failed.groupBy("session").agg(F.sort_array(F.collect_list(F.struct(F.col("node").cast("long").alias("node"), "failed"))).alias("nodes"))
    return lines.withColumn("line", line).select(F.when(F.col("session") % 10 == 3, F.substring("line", 1, 20)).otherwise(F.col("line")).alias("value"))


@query(f"""WITH {TURNS}, r AS (SELECT *, sum(CASE WHEN (c = 'alta' AND k = 'corretta' AND e = 'rielaborata') OR (ts < TIMESTAMP '{SAVED_AT}' AND session % 10 = 3) THEN 0 ELSE 1 END) OVER (PARTITION BY session, node ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS failed,
  (c = 'alta' AND k = 'corretta' AND e = 'rielaborata') AS ok FROM turns)
SELECT session, node::BIGINT AS node, id, (failed - (NOT ok)::INT + 1)::BIGINT AS attempt, failed - (NOT ok)::INT >= 1 AS second, failed::BIGINT AS failed_attempts FROM r WHERE ts >= TIMESTAMP '{SAVED_AT}'""")
def resumed_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts of turns that arrive out of order, streamed on from saved sessions, some unreadable."""
    rows = turns(spark, sf_dir).select("session", "node", F.col("ts").cast("timestamp").alias("ts"), "id", "c", "k", "e")
    saved = scratch(spark, "saved-sessions")
    _saved(rows).write.text(saved)
    begin = F.lit(SAVED_AT).cast("timestamp").cast("long")
    arrival = F.col("ts").cast("long") - begin + F.pmod(F.xxhash64("id"), F.lit(LATE))
    feed = rows.where(F.col("ts") >= F.lit(SAVED_AT).cast("timestamp")).withColumn("chunk", F.floor(arrival / TOGETHER))
    path = scratch(spark, "turns")
    found = feed.agg(F.max("chunk").alias("chunk"), F.max("ts").alias("ts")).first()
    for chunk in range((found.chunk or 0) + 1):  # files are read in the order of their times
        feed.where(F.col("chunk") == chunk).drop("chunk").repartition(FILES, F.xxhash64("id")).write.mode("append").parquet(path)
    end = spark.range(1).select(F.lit(-1).cast("long").alias("session"), F.lit(0).alias("node"), F.timestamp_add("DAY", F.lit(4), F.lit(found.ts).cast("timestamp")).alias("ts"), F.lit(-1).cast("long").alias("id"), F.lit("").alias("c"), F.lit("").alias("k"), F.lit("").alias("e"))
    end.write.mode("append").parquet(path)  # moves the watermark past all turns
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", FILES).parquet(path)
    found = S.resumed_attempts(stream, S.read_sessions(spark.read.text(saved)), f"{LATE} seconds")
    return S.drained(found, scratch(spark, "attempts"), scratch(spark, "attempts-checkpoint"))


def _feed(rows: DataFrame, label: str) -> DataFrame:
    """The rows as a stream of files."""
    path = scratch(rows.sparkSession, label)
    rows.write.parquet(path)
    return rows.sparkSession.readStream.schema(rows.schema).parquet(path)


@query(f"""WITH {TURNS}, w AS (SELECT date_trunc('hour', ts) AS hour, count(*) AS turns, count(*) FILTER (NOT (c = 'alta' AND k = 'corretta' AND e = 'rielaborata')) AS failed FROM turns GROUP BY ALL)
SELECT strftime(hour, '%Y-%m-%d %H:%M:%S') AS hour, turns, failed FROM w WHERE hour + INTERVAL 70 MINUTE <= (SELECT max(ts) FROM turns)""")
def hourly_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns and failures of each hour that the watermark has closed, as a stream."""
    rows = turns(spark, sf_dir).select(F.col("ts").cast("timestamp").alias("ts"), "c", "k", "e")
    found = S.drained(S.turn_rates(_feed(rows, "turns")), scratch(spark, "rates"), scratch(spark, "rates-checkpoint"))
    return found.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "turns", "failed")


@query(f"""WITH {TURNS} SELECT session, count(*) AS n, min(id) AS first, max(id) AS last, strftime(max(ts), '%Y-%m-%dT%H:%M:%S') AS at FROM turns GROUP BY session""")
def trace_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trace events appended as JSON below a folder for each session by a stream, and read back (K4)."""
    rows = turns(spark, sf_dir).select("session", "id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("at"), "c", "k", "e")
    path = scratch(spark, "traces")
    S.trace_sink(_feed(rows, "events"), path, scratch(spark, "traces-checkpoint")).awaitTermination()
    return S.trace_totals(spark, path)
