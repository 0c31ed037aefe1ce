"""Streaming forms: windows, sessions, de-duplication, first replies with censoring, re-entry and chains."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def event_stream(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """A Parquet file or folder as a stream with event time."""
    schema = spark.read.parquet(path).schema
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(stream: DataFrame, ts: str, width: str, by: list[str], late: str = "300 seconds") -> DataFrame:
    return stream.withWatermark(ts, late).groupBy(*by, F.window(ts, width)).agg(F.count("*").alias("n")).select(*by, F.col("window.start").alias("start"), "n")


def sessions(stream: DataFrame, ts: str, gap: str, by: list[str], late: str = "300 seconds") -> DataFrame:
    """Sessions by gap; their end is the last event and not the end of the gap."""
    t = stream.withWatermark(ts, late).groupBy(*by, F.session_window(ts, gap)).agg(F.count("*").alias("n"), F.max(ts).alias("last"))
    return t.select(*by, F.col("session_window.start").alias("start"), F.col("last").alias("end"), "n")


def first_seen(stream: DataFrame, ts: str, key: str, horizon: str = "2 days") -> DataFrame:
    """The first observation of each key within the horizon."""
    return stream.withWatermark(ts, horizon).dropDuplicatesWithinWatermark([key])


def first_replies(comments: DataFrame, horizon_seconds: int, late: str = "1 minute") -> DataFrame:
    """(comment_id, created_at, reply_seconds): reply_seconds null if none came within the horizon; times in whole milliseconds.

    The interval join of ``replies_within``, then the earliest reply of each comment: the row is emitted when
    event time has passed the horizon, so a reply that arrives later than the watermark is lost.
    All state is native and kept for the horizon alone. Input: comment_id, parent_id, ts.
    Start the query within ``state_of_one_stream``.
    """
    t = comments.where("ts is not null").withColumn("ts", F.date_trunc("millisecond", "ts"))
    t = replies_within(t, horizon_seconds, late).groupBy("comment_id", "created_at").agg(F.min("reply_at").alias("reply_at"))
    return t.select("comment_id", "created_at", ((F.unix_millis("reply_at") - F.unix_millis("created_at")) / F.lit(1000.0)).alias("reply_seconds"))


def running_reentry(comments: DataFrame) -> DataFrame:
    """Comments so far by thread and known author, update mode: all but the first of an author are re-entries.

    The state is a number a thread and author, so no state grows with a thread.
    """
    return comments.where("comment_agent_id is not null").groupBy("thread_id", "comment_agent_id").agg(F.count("*").alias("n"))


def replies_within(comments: DataFrame, horizon_seconds: int, late: str = "1 minute") -> DataFrame:
    """(comment_id, created_at, reply_at): a row for each reply that came within the horizon, one with null where none did.

    An outer interval join of the stream with itself: state is kept for the horizon alone. A comment without
    a reply comes out when the watermark has passed its horizon. Input: comment_id, parent_id, ts.
    """
    own = comments.select("comment_id", F.col("ts").alias("created_at")).withWatermark("created_at", late)
    replies = comments.where("parent_id is not null").select("parent_id", F.col("ts").alias("reply_at")).withWatermark("reply_at", late)
    inside = F.expr(f"reply_at >= created_at and reply_at <= created_at + INTERVAL {int(horizon_seconds)} SECONDS")
    return own.join(replies, (F.col("comment_id") == F.col("parent_id")) & inside, "left_outer").select("comment_id", "created_at", "reply_at")


CHAIN = "thread_id long, first_id long, start timestamp, length long"


class ChainState(StatefulProcessor):
    """Reciprocal chains of a thread, in event time whatever the order of arrival.

    Edges wait in a list until the watermark has passed them; a timer then takes those that are
    due in the order (ts, comment_id). Lists are appended to and read whole, so what a thread
    asks of the state store in a batch does not grow with its edges. The last edge and its chain are a
    value; both go when a thread has been idle for long.
    """

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us array<long>, comment_id array<long>, src array<string>, dst array<string>")
        self.chain = handle.getValueState("chain", "src string, dst string, first_id long, start_us long, last_us long, length long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for pdf in rows:
            us = pdf.ts.astype("datetime64[us]").astype("int64").tolist()
            self.waiting.appendValue((us, pdf.comment_id.tolist(), pdf.src.tolist(), pdf.dst.tolist()))
            first = min(us) if first is None else min(first, *us)
        if first is not None:
            self.handle.registerTimer(first // 1000 + 1)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        edges = {}  # an edge that came twice counts once
        for part in self.waiting.get():
            edges.update(((us, comment_id), (src, dst)) for us, comment_id, src, dst in zip(*part, strict=True))
        waiting = sorted(edges.items())
        due = [w for w in waiting if w[0][0] // 1000 < now]
        held = self.chain.get() if self.chain.exists() else None
        out = []
        for (us, comment_id), (src, dst) in due:
            if held and (src, dst) == (held[1], held[0]) and us - held[4] < 1000 * self.idle_ms:
                held = (src, dst, held[2], held[3], us, held[5] + 1)
                grown = {"thread_id": key[0], "first_id": held[2], "start": pd.Timestamp(held[3], unit="us"), "length": held[5]}
                if out and out[-1]["first_id"] == held[2]:
                    out[-1] = grown
                else:
                    out.append(grown)
            else:
                held = (src, dst, comment_id, us, us, 1)
        rest = waiting[len(due) :]
        if rest:
            if due:
                self.waiting.put([([k[0] for k, _ in rest], [k[1] for k, _ in rest], [v[0] for _, v in rest], [v[1] for _, v in rest])])
            self.handle.registerTimer(rest[0][0][0] // 1000 + 1)
        elif waiting:
            self.waiting.clear()
        if held and held[4] // 1000 + self.idle_ms <= now:  # edges that wait come too late for its chain
            self.chain.clear()
        elif held:
            if due:
                self.chain.update(held)
            self.handle.registerTimer(held[4] // 1000 + self.idle_ms)
        if out:
            yield pd.DataFrame(out)

    def close(self) -> None:
        pass


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Queries started inside have these settings; those of before come back."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v else spark.conf.unset(k)


ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def state_in_rocksdb(spark: SparkSession):
    """Queries started inside keep their state in RocksDB, which processors with timers and lists need."""
    return settings(spark, ROCKSDB)


def state_of_one_stream(spark: SparkSession):
    """For a stream joined with a part of itself: its watermark is that of the whole stream, the faster one; state in RocksDB, off the heap."""
    return settings(spark, {**ROCKSDB, "spark.sql.streaming.multipleWatermarkPolicy": "max"})


def running_chains(edges: DataFrame, late: str = "1 minute", idle_hours: int = 24 * 30) -> DataFrame:
    """(thread_id, first_id, start, length) of reciprocal chains of two or more edges, again whenever one has grown.

    Edges later than the watermark are left out; a chain goes on unless its thread is idle for
    ``idle_hours``, after which its state is removed.
    Start the query within ``state_in_rocksdb``.
    """
    # the processor travels by value: the driver's own worker, which sets its state up, sees no shipped package
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    t = edges.withWatermark("ts", late).groupBy("thread_id")
    return t.transformWithStateInPandas(ChainState(idle_hours * 3_600_000), CHAIN, "Update", "EventTime")


def _versions(spark: SparkSession, path: str, before: int | None = None) -> dict[int, str]:
    """The newest written version of each bucket, of batches before the given one."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/v=*/bucket=*")
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at) or []
    out: dict[int, tuple[int, str]] = {}
    for s in found:
        p = s.getPath()
        v, bucket = int(p.getParent().getName()[2:]), int(p.getName()[7:])
        if before is None or v < before:
            out[bucket] = max(out.get(bucket, (v, p.toString())), (v, p.toString()))
    return {b: p for b, (_, p) in out.items()}


def upsert_latest(stream: DataFrame, keys: list[str], order: str, path: str, buckets: int = 16):
    """foreachBatch: keeps the latest row of each key in a table cut into buckets by a hash of the key.

    A batch reads and rewrites the buckets that it touches only, as a new version below its
    own number; a repeated batch writes the same version again.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")).persist()
        touched = [r.bucket for r in batch.select("bucket").distinct().collect()]  # at most ``buckets``
        held = _versions(spark, path, batch_id)
        t = batch
        for b in touched:
            if b in held:
                t = t.unionByName(spark.read.schema(batch.drop("bucket").schema).parquet(held[b]).withColumn("bucket", F.lit(b)))
        rest = F.struct(order, *[c for c in batch.columns if c not in (*keys, order, "bucket")])
        latest = t.groupBy("bucket", *keys).agg(F.max(rest).alias("r")).select("bucket", *keys, "r.*")
        if touched:
            latest.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/v={batch_id}")
        batch.unpersist()

    return stream.writeStream.foreachBatch(merge)


def upserted(stream: DataFrame, keys: list[str], order: str, path: str, checkpoint: str, mode: str = "append") -> None:
    """Runs all that is there now into the table of ``upsert_latest``."""
    upsert_latest(stream, keys, order, path).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def read_latest(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The table that ``upsert_latest`` keeps; with a schema one that has no batch yet is empty."""
    held = _versions(spark, path).values()
    if schema and not held:
        return spark.createDataFrame([], schema)
    return spark.read.parquet(*held)


def every_nth(batch_id: int, n: int) -> bool:
    """Whether the costly part of a poll (comments of the top posts) is due in this round."""
    return batch_id % n == 0


def polled_rounds(stream: DataFrame, comments_of: Callable[[DataFrame], DataFrame], every: int, k: int, path: str):
    """foreachBatch: writes each round's feed, and in every n-th round the comments of its top k posts."""
    from colloquy.operators.quality import top_posts

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/feed/round={batch_id}")
        if every_nth(batch_id, every):
            comments_of(top_posts(batch, k)).write.mode("overwrite").parquet(f"{path}/comments/round={batch_id}")

    return stream.writeStream.foreachBatch(write)


def untimed(df: DataFrame) -> DataFrame:
    """Timestamps without zone again, as the tables have them; sessions run in UTC."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c, t in df.dtypes if t == "timestamp"})


def run_to_end(stream: DataFrame, path: str, paged: bool = False) -> DataFrame:
    """Runs all that is there now into a table below ``path`` and reads it back.

    paged: the source hands out one page a batch and knows no end, so batches go on until one is empty.
    """
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{path}/state").option("path", f"{path}/rows")
    q = (writer if paged else writer.trigger(availableNow=True)).start()
    if paged:
        q.processAllAvailable()
        q.stop()
    else:
        q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")
