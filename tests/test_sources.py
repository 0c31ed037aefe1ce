import json
import urllib.error

import pytest


from colloquy.operators import quality as ql
from colloquy.sources import feeds, files
from colloquy.streaming import operators as so


def test_runs_are_written_once(spark, tmp_path):
    df = spark.createDataFrame([("a", "2024-01-01"), ("b", "2024-01-02")], "v string, dt string")
    files.write_run(df, str(tmp_path), "t", "001")
    with pytest.raises(FileExistsError):
        files.write_run(df, str(tmp_path), "t", "001")
    files.write_run(df, str(tmp_path), "t", "002")
    back = files.read_run(spark, str(tmp_path), "t", "001")
    assert back.count() == 2 and {r.run_id for r in back.collect()} == {"001"}


def test_bad_documents_are_set_aside(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"posts":[{"id":1},{"id":2}]}')
    (tmp_path / "b.json").write_text("not json {")
    ok, bad = files.read_documents(spark, f"{tmp_path}/*.json")
    assert ok.count() == 1 and bad.count() == 1 and len(bad.first().sha256) == 64
    items = files.ordered_payloads(spark, f"{tmp_path}/*.json").orderBy("position").collect()
    assert [i.item for i in items] == ['{"id":1}', '{"id":2}']


def test_logs_and_missing_logs(spark, tmp_path):
    assert files.read_jsonl(spark, f"{tmp_path}/none").count() == 0
    log = spark.createDataFrame([("x", 200)], "endpoint string, http_status int").coalesce(1)
    files.append_jsonl(log, f"{tmp_path}/log", "gzip")
    files.append_jsonl(log, f"{tmp_path}/log")
    assert files.read_jsonl(spark, f"{tmp_path}/log").count() == 2
    s = files.storage(spark, {"log": f"{tmp_path}/log/part-*"}).first()
    assert s.files == 2 and s.bytes > 0
    assert files.latest_artifact(spark, [f"{tmp_path}/log/part-*"]) and files.latest_artifact(spark, [f"{tmp_path}/zzz*"]) is None


def test_summaries(spark):
    df = spark.createDataFrame([(1, float("nan"), float("inf"))], "a int, b double, c double")
    assert files.summary_json(df) == '{"a": 1, "b": null, "c": null}'
    assert '"inf"' in files.summary_json(df, "text")
    assert files.json_rows(df.drop("c")).first().json == '{"a":1,"b":null}'
    assert files.latex_rows(spark.createDataFrame([(1234567, 2.5, None)], "a long, b double, c double")).first().line == "1,234,567 & 2.50 &  \\\\"


def test_export_manifest(spark, tmp_path):
    m = files.export_table(spark.range(10), f"{tmp_path}/x", "csv", 4)
    assert m["rows"] == 4 and m["columns"] == ["id"]
    assert files.read_csv(spark, f"{tmp_path}/none") is None


def test_retries(monkeypatch):
    calls, waits = [], []

    class Answer:
        status = 200

        def __enter__(self):
            return self

        def __exit__(self, *a):
            pass

        def read(self):
            return b"[]"

    def opener(request, timeout):
        calls.append(1)
        if len(calls) < 3:
            raise urllib.error.HTTPError("u", 429, "", {"Retry-After": "7"} if len(calls) == 1 else {}, None)
        return Answer()

    assert feeds.http_get("http://x", opener=opener, sleep=waits.append) == (200, "[]")
    assert waits == [7.0, 2.0]
    assert feeds.backoff_seconds(10, None, 1.0) == 60.0


def test_paging_stops():
    assert len(list(feeds.pages(feeds.stub_page, 0, 10_000, 3, 1000))) == 10
    assert len(list(feeds.pages(feeds.stub_page, 0, 10_000, 3, 4))) == 4
    still = lambda a, b, n: [{"id": "x", "created_at_ms": -5}]
    assert len(list(feeds.pages(still, 0, 10, 3, 100))) == 1


def tied(n, at, step=0):
    return [{"id": f"i{k}", "created_at_ms": at + k * step, "comment_count": k} for k in range(n)]


def server(items, most=10**9):
    """Answers as a feed does: items of the window in order, at most ``most`` at once."""
    return lambda after, before, size: [i for i in sorted(items, key=lambda i: i["created_at_ms"]) if after <= i["created_at_ms"] < before][: min(size, most)]


@pytest.mark.parametrize("size", [1, 2, 7, 100, 150])
def test_items_that_share_a_time_are_all_read(size):
    items = tied(40, 0, 10) + [{**i, "id": "t" + i["id"]} for i in tied(150, 200)] + [{**i, "id": "u" + i["id"]} for i in tied(10, 500, 1)]
    assert len(list(feeds.pages(server(items), 0, 1000, size, 10**6))) == 200


def test_a_server_that_hides_tied_items_is_an_error():
    items = tied(150, 200) + [{"id": "later", "created_at_ms": 300}]
    with pytest.raises(feeds.FeedError, match="share the time"):
        list(feeds.pages(server(items, 100), 0, 1000, 100, 10**6))


@pytest.mark.parametrize("answer", [(503, ""), (403, ""), (200, "not json"), (200, '{"error": "x"}'), (200, ""), OSError("down")])
def test_errors_are_no_end_of_the_window(answer):
    def get(url):
        if isinstance(answer, OSError):
            raise answer
        return answer

    log = []
    with pytest.raises(feeds.FeedError):
        list(feeds.pages(feeds.http_page("http://feed/items", get, log.append), 0, 1000, 10, 100))
    assert len(log) == 1 and log[0]["endpoint"] == "/items" and log[0]["params"]["limit"] == "10"
    assert (log[0]["http_status"], log[0]["error"] is None) == ((None, False) if isinstance(answer, OSError) else (answer[0], True))


def test_pages_of_a_server():
    get = lambda url: (200, json.dumps({"items": tied(3, 0, 5) if "after=0&" in url else []}))
    assert [i["id"] for i in feeds.pages(feeds.http_page("http://feed/items", get), 0, 1000, 10, 100)] == ["i0", "i1", "i2"]


def test_cursor_source_as_table_and_stream(spark, tmp_path):
    feeds.register(spark)
    t = spark.read.format("cursor_feed").options(after_ms=0, before_ms=500_000, page_size=64, partitions=4).load()
    assert t.count() == 500 and t.select("id").distinct().count() == 500 and t.agg({"created_at_ms": "max"}).first()[0] == 499_000
    s = spark.readStream.format("cursor_feed").options(after_ms=0, before_ms=100_000, page_size=40).load()
    got = so.run_to_end(s, str(tmp_path), paged=True)
    assert sorted(r.id for r in got.collect()) == sorted(f"i{k}" for k in range(100))


def test_nested_comments(spark):
    rows = feeds.flatten_comments(feeds.stub_thread(spark, "p", 2)).collect()
    by = {r.id: r for r in rows}
    assert len(rows) == 6 and by["p_c0"].depth == 0 and by["p_c0"].parent_id is None
    assert by["p_c1_0"].parent_id == "p_c1" and by["p_c1_0"].depth == 1 and by["p_c1"].author == "a1"


@pytest.mark.parametrize("depth", [17, 700])
def test_nested_comments_of_any_depth(spark, depth):
    doc = "".join(f'{{"id":"c{k}","author":"a","children":[' for k in range(depth)) + "]}" * depth
    rows = feeds.flatten_comments(spark.createDataFrame([("p", f'{{"comments":[{doc}]}}'), ("q", "no json {"), ("r", None)], "post string, json string")).collect()
    assert sorted((r.depth, r.post, r.id, r.parent_id) for r in rows) == [(k, "p", f"c{k}", f"c{k - 1}" if k else None) for k in range(depth)]


def test_nested_comments_with_odd_members(spark):
    doc = '{"comments":[{"id":12345678901234567890,"author":{"name":"n"},"children":[{"id":"b","parent_id":""},{"id":"c","parent_id":"z","author":null},7,null]},{"children":{}}]}'
    rows = [tuple(r)[1:] for r in feeds.flatten_comments(spark.createDataFrame([("p", doc)], "post string, json string")).collect()]
    assert rows == [("12345678901234567890", None, 0, "n"), ("b", "12345678901234567890", 1, None), ("c", "z", 1, None), (None, None, 0, None)]


def test_feed_checks(spark):
    feed = feeds.stub_feed(spark, "new", 5, 0).unionByName(feeds.stub_feed(spark, "odd", 2, 1))
    r = ql.feed_invariants(feed, ["new"], 4).first()
    assert (r.n, r.n_bad_sort, r.n_bad_rank, r.n_null_ids) == (7, 2, 1, 0)


def test_sessions_match_batch(spark, tmp_path):
    import datetime as dt

    t0 = dt.datetime(2024, 1, 1)
    rows = [(1, t0), (1, t0 + dt.timedelta(hours=1)), (1, t0 + dt.timedelta(hours=9)), (2, t0 + dt.timedelta(days=5))]
    spark.createDataFrame(rows, "user_id long, ts timestamp_ntz").write.parquet(f"{tmp_path}/e")
    t = so.sessions(so.event_stream(spark, f"{tmp_path}/e", 10), "ts", "6 hours", ["user_id"])
    got = sorted((r.user_id, r.n) for r in so.run_to_end(t, f"{tmp_path}/c").collect())
    assert got == [(1, 1), (1, 2)]  # the last one stays open: its gap has not passed


def test_first_reply_stream(spark, tmp_path):
    import datetime as dt

    t0 = dt.datetime(2024, 1, 1)
    rows = [(1, None, t0), (2, 1, t0 + dt.timedelta(seconds=30)), (3, 1, t0 + dt.timedelta(seconds=10)), (4, 2, t0 + dt.timedelta(hours=3)), (5, None, t0 + dt.timedelta(days=1))]
    spark.createDataFrame(rows, "comment_id long, parent_id long, ts timestamp_ntz").write.parquet(f"{tmp_path}/c")
    s = so.event_stream(spark, f"{tmp_path}/c", 10).withWatermark("ts", "1 second")
    got = {r.comment_id: r.reply_seconds for r in so.run_to_end(so.first_replies(s, 3600), f"{tmp_path}/k").collect()}
    assert got == {1: 10.0, 2: None, 3: None, 4: None}


def test_every_nth():
    assert [k for k in range(7) if so.every_nth(k, 3)] == [0, 3, 6]


def test_campaign_resumes_and_stops(tmp_path):
    from colloquy.streaming.campaign import run_campaign

    seen = []

    def chunk(day):
        seen.append(day)
        if day == "d3" and seen.count("d3") == 1:
            raise RuntimeError("down")
        return {"warnings": ["slow"]}

    run = lambda **k: run_campaign(str(tmp_path), ["d1", "d2", "d3"], chunk, expected_warnings=frozenset({"slow"}), **k)
    assert run(free_gb=lambda p: 1)["stopped"].startswith("d1") and not seen
    assert run(free_gb=lambda p: 99) == {"done": ["d1", "d2"], "skipped": [], "stopped": "d3: down"}
    assert run(free_gb=lambda p: 99) == {"done": ["d3"], "skipped": ["d1", "d2"], "stopped": None}


def test_modes():
    def unreachable():
        raise OSError

    assert [feeds.resolve_mode("auto", lambda s=s: s) for s in (200, 401, 403)] == ["live", "stub", "stub"]
    assert feeds.resolve_mode("auto", unreachable) == "stub" and feeds.resolve_mode("live", unreachable) == "live"


def test_coverage(spark):
    import datetime as dt

    t = dt.datetime(2024, 1, 1)
    log = spark.createDataFrame([(t,), (t + dt.timedelta(seconds=90),)], "retrieved_at_utc timestamp")
    r = ql.interval_coverage(log, 2, 100).first()
    assert (r.n_calls, r.elapsed_seconds, r.calls_met, r.duration_met) == (2, 90, True, False)


def test_parsed_time_columns(spark):
    from colloquy.functions import scalars as sc

    df = spark.createDataFrame([("2024-01-01T00:00:00Z", "x", "/posts/p1/comments")], "created_at string, other string, endpoint string")
    out = sc.with_parsed_times(df).select("*", sc.endpoint_id(sc.F.col("endpoint")).alias("id"))
    assert out.columns == ["created_at", "other", "endpoint", "created_at_raw", "created_at_utc", "id"]
    assert out.first().id == "p1" and out.first().created_at_utc is not None


def test_latest_state_over_many_batches(spark, tmp_path):
    """A batch rewrites the buckets it touches; repeating one changes nothing."""
    import random

    from pyspark.sql import functions as F

    r = random.Random(4)
    rows = [(r.randrange(30), k, f"v{k}") for k in range(200)]
    for part in range(5):
        spark.createDataFrame(rows[part * 40 : part * 40 + 40], "key long, ts long, v string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    s = spark.readStream.schema("key long, ts long, v string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    so.upserted(s, ["key"], "ts", f"{tmp_path}/out", f"{tmp_path}/state")
    want = {}
    for k, t, v in rows:
        want[k] = max(want.get(k, (t, v)), (t, v))
    assert {x.key: (x.ts, x.v) for x in so.read_latest(spark, f"{tmp_path}/out").collect()} == want
    assert so.read_latest(spark, f"{tmp_path}/out").groupBy("key").agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def test_comments_of_top_posts_in_every_second_round(spark, tmp_path):
    for k in range(4):
        spark.createDataFrame([(f"p{k}{j}", j) for j in range(5)], "post_id string, comment_count long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    s = spark.readStream.schema("post_id string, comment_count long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = so.polled_rounds(s, lambda top: top.select("post_id"), 2, 3, f"{tmp_path}/out")
    q.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out/feed").count() == 20
    rounds = spark.read.parquet(f"{tmp_path}/out/comments").collect()
    assert sorted({x["round"] for x in rounds}) == [0, 2] and len(rounds) == 6


def test_chains_of_edges_over_batches(spark, tmp_path):
    """Six edges back and forth, two a batch, are one chain of six; six in one direction are none. A later edge lets the watermark pass."""
    import datetime as dt

    at = lambda k: dt.datetime(2024, 1, 1, 0, k)
    edges = [(1, at(k), k, *("ab" if k % 2 == 0 else "ba")) for k in range(6)] + [(2, at(k), 10 + k, "c", "d") for k in range(6)] + [(3, at(50), 99, "x", "y")]
    kind = "thread_id long, ts timestamp, comment_id long, src string, dst string"
    for k in range(4):
        own = [e for e in edges if min(3, e[1].minute // 2) == k]
        spark.createDataFrame(own, kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in{k}")
    s = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in*")
    with so.state_in_rocksdb(spark):
        so.upserted(so.running_chains(s), ["thread_id", "first_id"], "length", f"{tmp_path}/out", f"{tmp_path}/state", "update")
    got = [(x.thread_id, x.first_id, x.length) for x in so.read_latest(spark, f"{tmp_path}/out").collect()]
    assert got == [(1, 0, 6)]


def test_exports_with_a_manifest(spark, tmp_path):
    import json

    got = files.export_tables({"a": spark.range(5).toDF("x"), "b": spark.range(7).toDF("y")}, f"{tmp_path}/e", max_rows=6)
    assert {k: v["rows"] for k, v in got["tables"].items()} == {"a": 5, "b": 6}
    assert json.loads(spark.read.text(f"{tmp_path}/e/manifest").first()[0])["tables"] == got["tables"]


def test_raw_files_are_packed_once(tmp_path):
    import gzip

    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.json").write_bytes(b"{}" * 5000)
    (tmp_path / "y.txt").write_text("stays")
    time = (tmp_path / "d" / "x.json").stat().st_mtime_ns
    assert files.gzip_files(str(tmp_path))["files"] == 1 and files.gzip_files(str(tmp_path))["files"] == 0
    packed = tmp_path / "d" / "x.json.gz"
    assert gzip.open(packed).read() == b"{}" * 5000 and packed.stat().st_mtime_ns == time and sorted(p.name for p in tmp_path.rglob("*") if p.is_file()) == ["x.json.gz", "y.txt"]


def test_provenance_tells_commit_and_commands(tmp_path):
    import json
    import subprocess

    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    got = json.loads(files.provenance("r1", repo=str(tmp_path), commands=[["echo", "hi"], ["no-such-command"]], seed=3))
    assert got["seed"] == 3 and got["git"] == {"commit": "HEAD", "changed": False} or got["git"]["changed"] is False
    assert got["commands"][0]["stdout"] == "hi" and got["commands"][1]["returncode"] is None
