"""Keeps a curated event table and its daily activity reports up to date as files arrive.

A file stream with a checkpoint hands out only files that no earlier run has seen. Each batch is
cleaned and written to ``events``, partitioned by day and batch; the days that it touches
are then summed anew from their partitions, and replace these days in ``daily`` (rows,
users, repeats, first and last time, share of time bins with any event, and a status by the
share of rows that are no repeats) and ``activity`` (a row a bin, quiet ones with 0);
``summary`` has the days by status and the events of all. Rows without a time or an id go to the partition of
``events`` that has no day (``read_rejected``) and are not reported.

A batch that is repeated after a failure overwrites its own partitions and the same days,
so a rerun gives the same tables. An event delivered again, in the same or a later file,
counts once: of rows of a day that share an id the smallest (ts, user_id, event_type, value) stays.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.operators.quality import rate_status, roll_up, uniqueness_by_day
from colloquy.operators.timeseries import binned_counts
from jobs.common import command_line, table_at

log = logging.getLogger("jobs.daily_activity")

SOURCE = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"
EVENTS = f"{SOURCE}, day date, batch long"
DAILY = "n_rows long, n_events long, n_repeats long, n_users long, first_at timestamp_ntz, last_at timestamp_ntz, active_bins long, coverage double, status string, day date"
ACTIVITY = "bin timestamp_ntz, n long, day date"
ONCE = ["ts", "user_id", "event_type", "value"]


@dataclass
class Settings:
    bin_minutes: int = 15
    files_per_batch: int = 64


def distinct_events(events: DataFrame) -> DataFrame:
    """One row an event and day."""
    return events.groupBy("day", "event_id").agg(F.min(F.struct(*ONCE)).alias("r")).select("day", "event_id", "r.*")


def daily_report(events: DataFrame, bin_minutes: int) -> DataFrame:
    once = distinct_events(events)
    rows = uniqueness_by_day(events, "event_id", F.col("day")).select("day", "n_rows", F.col("n_extra_rows").alias("n_repeats"))
    bins = 24 * 60 // bin_minutes
    at = F.floor((F.hour("ts") * 60 + F.minute("ts")) / bin_minutes)
    sums = once.groupBy("day").agg(
        F.count("*").alias("n_events"), F.count_distinct("user_id").alias("n_users"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"), F.count_distinct(at).alias("active_bins"),
    )
    return sums.join(rows, "day").select("n_rows", "n_events", "n_repeats", "n_users", "first_at", "last_at", "active_bins", (F.col("active_bins") / bins).alias("coverage"), rate_status(F.col("n_events") / F.col("n_rows")).alias("status"), "day")


def replace_days(df: DataFrame, path: str, *by: str) -> None:
    """Writes partitions; those that it holds replace the ones there, all others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def run(spark: SparkSession, source: str, out: str, checkpoint: str, settings: Settings | None = None) -> dict:
    """Takes what is new at ``source`` (a folder or glob of Parquet files) into the tables below ``out``."""
    s = settings or Settings()

    def take(batch: DataFrame, batch_id: int) -> None:
        own = batch.sparkSession
        day = F.when(F.col("event_id").isNotNull(), F.to_date("ts"))
        replace_days(batch.withColumns({"day": day, "batch": F.lit(batch_id)}), f"{out}/events", "day", "batch")  # the only pass over the batch
        events = table_at(own, f"{out}/events", EVENTS).where("day is not null")
        days = [r.day for r in events.where(F.col("batch") == batch_id).select("day").distinct().collect()]  # a row a day
        if not days:
            return
        touched = events.where(F.col("day").isin(days))
        replace_days(daily_report(touched, s.bin_minutes), f"{out}/daily", "day")
        bins = binned_counts(distinct_events(touched), "ts", s.bin_minutes)
        bins = bins.withColumn("day", F.to_date("bin")).where(F.col("day").isin(days))
        replace_days(bins.select(F.col("bin").cast("timestamp_ntz").alias("bin"), F.col("n").cast("long").alias("n"), "day"), f"{out}/activity", "day")
        log.info("batch %d: %d days summed anew", batch_id, len(days))

    replace_days(spark.createDataFrame([], DAILY), f"{out}/daily", "day")  # the table is there even if no event is; days that it has stay
    stream = spark.readStream.schema(SOURCE).option("maxFilesPerTrigger", s.files_per_batch).parquet(source)
    q = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    daily = read_daily(spark, out)
    total = daily.agg(F.count("*").alias("n_days"), F.sum("n_events").alias("n_events"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"))
    total.crossJoin(F.broadcast(roll_up(daily))).coalesce(1).write.mode("overwrite").json(f"{out}/summary")
    found = {"source": source, "out": out, "rows_read": sum(p["numInputRows"] for p in q.recentProgress), "batches": len([p for p in q.recentProgress if p["numInputRows"]])}
    log.info("read %(rows_read)d new rows in %(batches)d batches from %(source)s into %(out)s", found)
    return found


def read_daily(spark: SparkSession, out: str) -> DataFrame:
    return table_at(spark, f"{out}/daily", DAILY)


def read_summary(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema("n_days long, n_events long, first_at timestamp_ntz, last_at timestamp_ntz, n_pass long, n_warn long, n_fail long, overall string").json(f"{out}/summary")


def read_rejected(spark: SparkSession, out: str) -> DataFrame:
    return table_at(spark, f"{out}/events", EVENTS).where("day is null")


if __name__ == "__main__":
    command_line("daily_activity", __doc__, Settings, {"source": "folder or glob of event files", "out": "folder of the tables", "checkpoint": "folder of the stream's checkpoint"}, run)
