"""The jobs: growing input in two runs, reruns, odd rows, settings and the command line's parts."""

import datetime as dt
import json
import logging

import pytest

from jobs import common, conversation_report, daily_activity

SMALL = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture()
def events(spark):
    return spark.read.parquet(f"{SMALL}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value")


def outputs(spark, out):
    return rows(daily_activity.read_daily(spark, out)), rows(common.table_at(spark, f"{out}/activity", daily_activity.ACTIVITY))


def test_a_growing_source_is_taken_once(spark, events, tmp_path, caplog):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    first, second = events.where("event_id % 3 = 0"), events.where("event_id % 3 > 0")
    first.coalesce(2).write.parquet(source)
    caplog.set_level(logging.INFO, "jobs.daily_activity")
    a = daily_activity.run(spark, source, out, state)
    assert a["rows_read"] == first.count() and "new rows" in caplog.text
    before = outputs(spark, out)
    assert daily_activity.run(spark, source, out, state)["rows_read"] == 0
    assert outputs(spark, out) == before
    second.coalesce(3).write.mode("append").parquet(source)
    assert daily_activity.run(spark, source, out, state)["rows_read"] == second.count()
    whole = str(tmp_path / "whole")
    events.coalesce(1).write.parquet(f"{whole}/in")
    daily_activity.run(spark, f"{whole}/in", f"{whole}/out", f"{whole}/state")
    assert outputs(spark, out) == outputs(spark, f"{whole}/out") != before


def test_days_without_new_rows_are_left_alone(spark, events, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    day = events.selectExpr("min(to_date(ts)) d").first().d
    events.where(f"to_date(ts) = '{day}'").write.parquet(source)
    daily_activity.run(spark, source, out, state)
    files = lambda: {p.name for p in (tmp_path / "out" / "daily" / f"day={day}").glob("*.parquet")}
    held = files()
    events.where(f"to_date(ts) > '{day}'").write.mode("append").parquet(source)
    daily_activity.run(spark, source, out, state)
    assert held and files() == held and daily_activity.read_daily(spark, out).count() > 1


def test_a_repeated_batch_changes_nothing(spark, events, tmp_path):
    """The checkpoint is lost after the tables were written: all files are taken again, as the same batch."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    events.coalesce(2).write.parquet(source)
    daily_activity.run(spark, source, out, str(tmp_path / "state1"))
    before = outputs(spark, out)
    daily_activity.run(spark, source, out, str(tmp_path / "state2"))
    assert outputs(spark, out) == before


def test_repeats_and_rows_without_time_or_id(spark, tmp_path):
    t = dt.datetime(2024, 5, 1, 10, 7)
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    make = lambda some: spark.createDataFrame(some, daily_activity.SOURCE).coalesce(1).write.mode("append").parquet(source)
    make([(1, t, 5, "a", 1.0), (1, t, 5, "a", 1.0), (2, t.replace(hour=23), None, None, None), (None, t, 5, "a", 1.0), (3, None, 5, "a", 1.0)])
    daily_activity.run(spark, source, out, state)
    make([(1, t, 5, "a", 1.0), (4, t.replace(day=2), 7, "b", 0.5)])
    daily_activity.run(spark, source, out, state)
    got = {r.day.day: r for r in daily_activity.read_daily(spark, out).collect()}
    assert (got[1].n_rows, got[1].n_events, got[1].n_repeats, got[1].n_users, got[1].active_bins) == (4, 2, 2, 1, 2)
    assert got[1].coverage == 2 / 96 and got[1].first_at == t and (got[2].n_events, got[2].n_repeats) == (1, 0)
    assert daily_activity.read_rejected(spark, out).count() == 2
    assert (got[1].status, got[2].status) == ("FAIL", "PASS")
    total = daily_activity.read_summary(spark, out).first()
    assert (total.n_days, total.n_events, total.n_pass, total.n_fail, total.overall, total.first_at) == (2, 3, 1, 1, "FAIL", t)
    bins = common.table_at(spark, f"{out}/activity", daily_activity.ACTIVITY).where("n > 0").collect()
    assert sorted((b.bin, b.n) for b in bins) == [(t.replace(minute=0), 1), (t.replace(hour=23, minute=0), 1), (t.replace(day=2, minute=0), 1)]


def test_a_source_without_events(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    spark.createDataFrame([], daily_activity.SOURCE).coalesce(1).write.parquet(source)
    assert daily_activity.run(spark, source, out, state)["rows_read"] == 0
    assert daily_activity.read_daily(spark, out).collect() == [] and daily_activity.read_summary(spark, out).first().n_days == 0


TALK = [
    (1, 0, "user", "Which music tools"), (1, 1, "assistant", "one two three"), (1, 2, "user", "four"), (1, 2, "user", "four"), (1, 4, " ", ""), (2, 0, "user", None), (None, 0, "user", "x"), (3, None, "user", "y"),
    (4, 1, "assistant", "no opening"), (5, 0, "user", "airdrop now"), (5, 1, "user", "again"),
]


def test_conversations(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame(TALK, "conv_id long, turn long, role string, text string").write.parquet(source)
    found = conversation_report.run(spark, source, out)
    assert (found["messages"], found["rejected"], found["conversations"]) == (8, 2, 4)
    got = {r.conv_id: r for r in conversation_report.read_threads(spark, out).collect()}
    one = got[1]
    assert (one.n_turns, one.n_roles, one.n_known, one.n_words, one.n_orphans, one.n_answers, one.dyads, one.reciprocal_dyads, one.size_bin) == (4, 2, 3, 7, 1, 2, 1, 1, "3-5")
    assert one.answer_ratio == 4 / 6 and one.reentry_rate == 1 / 3
    assert {k: r.topic for k, r in got.items()} == {1: "Builder/Technical", 2: "Other", 4: "Other", 5: "Spam/Low-Signal"}
    assert (got[4].n_orphans, got[5].dyads, got[5].reciprocity_rate) == (1, 0, None)
    before = rows(conversation_report.read_threads(spark, out))
    conversation_report.run(spark, source, out)
    assert rows(conversation_report.read_threads(spark, out)) == before
    assert {p.name for p in (tmp_path / "out" / "threads").glob("topic=*")} == {"topic=Builder%2FTechnical", "topic=Other", "topic=Spam%2FLow-Signal"}
    lines = spark.read.option("header", True).csv(f"{out}/summary").collect()
    assert [(r.topic, r.n_conversations) for r in lines] == [("Builder/Technical", "1"), ("Other", "2"), ("Spam/Low-Signal", "1")]


def test_an_empty_table_of_messages(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(source)
    assert conversation_report.run(spark, source, out)["conversations"] == 0
    assert conversation_report.read_threads(spark, out).collect() == []


@pytest.mark.parametrize("job", [daily_activity, conversation_report])
def test_settings(job, tmp_path):
    name = job.__name__.rsplit(".", 1)[1]
    assert common.settings(job.Settings, f"jobs/{name}.json") == job.Settings()
    bad = tmp_path / "bad.json"
    bad.write_text(json.dumps({"nothing": 1}))
    with pytest.raises(ValueError, match="nothing"):
        common.settings(job.Settings, str(bad))


def test_command_line(tmp_path):
    import subprocess
    import sys

    out = str(tmp_path / "out")
    done = subprocess.run([sys.executable, "-m", "jobs.conversation_report", "--source", f"{SMALL}/conversations.parquet", "--out", out], capture_output=True, text=True, timeout=300)
    assert done.returncode == 0 and "wrote" in done.stderr
    assert list((tmp_path / "out" / "threads").glob("topic=*"))
