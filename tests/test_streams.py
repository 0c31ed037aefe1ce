"""Streams with state: chains out of order and over restarts, replies by an interval join."""

import datetime as dt
import random

from pyspark.sql import functions as F

from colloquy.streaming import operators as so

T0 = dt.datetime(2024, 3, 1)
EDGE = "thread_id long, ts timestamp_ntz, comment_id long, src string, dst string"


def chains(edges):
    """(thread, first id, start, length) of runs of two or more, of edges in time order."""
    out, run = [], []
    for e in [*sorted(edges, key=lambda e: (e[0], e[1], e[2])), (None, None, None, None, None)]:
        if run and e[0] == run[-1][0] and (e[3], e[4]) == (run[-1][4], run[-1][3]):
            run.append(e)
            continue
        if len(run) >= 2:
            out.append((run[0][0], run[0][2], run[0][1], len(run)))
        run = [e]
    return sorted(out)


def made(n, seed):
    r = random.Random(seed)
    return [(k % 3, T0 + dt.timedelta(seconds=40 * k), k, *(("a", "b") if r.random() < 0.5 else ("b", "a") if r.random() < 0.7 else ("c", "a"))) for k in range(n)]


def run(spark, source, out, state, idle_hours=720):
    s = so.event_stream(spark, source, 1).select("thread_id", "ts", "comment_id", "src", "dst")
    with so.state_in_rocksdb(spark):
        so.upserted(so.running_chains(s, "1 hour", idle_hours), ["thread_id", "first_id"], "length", out, state, "update")
    return sorted(map(tuple, so.untimed(so.read_latest(spark, out, so.CHAIN)).select("thread_id", "first_id", "start", "length").collect()))


def test_chains_out_of_order_and_over_a_restart(spark, tmp_path):
    edges = made(200, 3)
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    late = edges[-1][1] - dt.timedelta(hours=1)
    for k in range(4):  # files overlap in time by up to 80 edges, less than the hour that the watermark waits
        part = [e for i, e in enumerate(edges) if min(3, (i // 25 + 2 * (i % 2)) // 2) == k]
        random.Random(k).shuffle(part)
        spark.createDataFrame(part, EDGE).coalesce(1).write.mode("append").parquet(source)
        got = run(spark, source, out, state)
    passed = [e for e in edges if e[1] < late]
    assert got == chains(passed) and len(got) > 5


def test_an_idle_thread_starts_anew(spark, tmp_path):
    hour = dt.timedelta(hours=1)
    edges = [(1, T0, 1, "a", "b"), (1, T0 + hour, 2, "b", "a"), (1, T0 + 60 * hour, 3, "a", "b"), (1, T0 + 61 * hour, 4, "b", "a"), (2, T0 + 200 * hour, 5, "x", "y")]
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for e in edges:
        spark.createDataFrame([e], EDGE).coalesce(1).write.mode("append").parquet(source)
        got = run(spark, source, out, state, 24)
    assert [(g[1], g[3]) for g in got] == [(1, 2), (3, 2)]
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")


def test_replies_by_an_interval_join(spark, tmp_path):
    r = random.Random(8)
    rows = [(k, None if k % 3 == 0 else r.randrange(k), T0 + dt.timedelta(seconds=30 * k)) for k in range(1, 300)]
    source = str(tmp_path / "in")
    df = spark.createDataFrame(rows, "comment_id long, parent_id long, ts timestamp_ntz")
    df.orderBy(F.rand(4)).coalesce(1).write.parquet(source)
    for horizon in (600, 3600):
        got = so.untimed(so.run_to_end(so.replies_within(so.event_stream(spark, source), horizon), str(tmp_path / str(horizon))))
        best = {}
        for x in got.collect():
            best[x.comment_id] = min(filter(None, (best.get(x.comment_id), x.reply_at)), default=None)
        born = {k: t for k, _, t in rows}
        end = max(born.values()) - dt.timedelta(seconds=60 + horizon)
        for k, t in born.items():
            inside = [u for _, p, u in rows if p == k and t <= u <= t + dt.timedelta(seconds=horizon)]
            if t < end:
                assert k in best and best[k] == min(inside, default=None)


def test_first_replies_are_native_and_keep_to_the_watermark(spark, tmp_path):
    """Rows of a comment whose id comes twice, replies at and after the horizon, comments at the watermark's edge."""
    s, ms = (lambda x: dt.timedelta(seconds=x)), dt.timedelta(milliseconds=1)
    end = T0 + s(20_000)  # the last comment, a root: the watermark is that of all comments, not of replies
    rows = [(1, None, T0), (2, 1, T0 + s(3600)), (3, None, T0), (4, 3, T0 + s(3600) + ms), (5, None, T0 + s(7)), (5, None, T0 + s(9)), (6, 5, T0 + s(10)), (7, 5, T0 + s(20))]
    rows += [(8, None, end - s(3660)), (9, None, end - s(3660) - ms), (10, None, end), (11, 9, end - s(3000))]
    source = str(tmp_path / "in")
    spark.createDataFrame(rows, "comment_id long, parent_id long, ts timestamp_ntz").coalesce(1).write.parquet(source)
    t = so.first_replies(so.event_stream(spark, source), 3600)
    assert "InPandas" not in t._jdf.queryExecution().analyzed().toString()
    with so.state_of_one_stream(spark):
        got = so.untimed(so.run_to_end(t, str(tmp_path / "out"))).collect()
    assert spark.conf.get("spark.sql.streaming.multipleWatermarkPolicy") == "min"
    want = {(1, T0, 3600.0), (2, T0 + s(3600), None), (3, T0, None), (4, T0 + s(3600) + ms, None), (5, T0 + s(7), 3.0), (5, T0 + s(9), 1.0), (6, T0 + s(10), None), (7, T0 + s(20), None), (9, end - s(3660) - ms, 660.001)}
    assert len(got) == len(want) and set(map(tuple, got)) == want


class Held:
    """A state of any kind that counts what is asked of it."""

    def __init__(self):
        self.asked, self.rows, self.timers = 0, [], []

    def __getattr__(self, name):
        def call(*args):
            self.asked += 1
            if name.startswith("get") and name != "get":
                return self
            if name == "registerTimer":
                self.timers.append(args[0])
            elif name == "appendValue":
                self.rows.append(args[0])
            elif name == "put":
                self.rows = list(args[0])
            elif name == "clear":
                self.rows = []
            return iter(self.rows) if name == "get" else False if name == "exists" else None

        return call


class Now:
    def __init__(self, ms):
        self.getCurrentWatermarkInMs = lambda: ms


def test_what_a_thread_asks_of_its_state_does_not_grow_with_its_edges():
    import pandas as pd

    asked = {}
    for n in (10, 1000):
        p, state = so.ChainState(10**9), Held()
        p.init(state)
        ts = pd.Timestamp(0) + pd.to_timedelta(range(n), unit="s")
        pdf = pd.DataFrame({"ts": ts, "comment_id": range(n), "src": ["ab"[k % 2] for k in range(n)], "dst": ["ba"[k % 2] for k in range(n)]})
        assert list(p.handleInputRows((1,), iter([pdf.sample(frac=1, random_state=1), pdf.head(5)]), Now(0))) == [] and state.timers == [1]
        out = list(p.handleExpiredTimer((1,), Now(1000 * n - 4999), None))  # four edges wait
        assert [(r.first_id, r.length) for r in out[0].itertuples()] == [(0, n - 4)] and len(state.rows) == 1 and len(state.rows[0][0]) == 4
        asked[n] = state.asked
    assert asked[10] == asked[1000]
