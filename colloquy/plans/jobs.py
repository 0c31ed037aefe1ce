"""The jobs as queries: each runs twice into one new folder and gives its output as it stands then."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.plans.registry import category_sql, query
from colloquy.sources.scratch import shared_path
from jobs import conversation_report, daily_activity

ONE_OF = "row_number() OVER (PARTITION BY {} ORDER BY {}) AS k"


@query(f"""WITH e AS (SELECT ts::DATE AS day, *, {ONE_OF.format("ts::DATE, event_id", "ts, user_id NULLS FIRST, event_type NULLS FIRST, value NULLS FIRST")} FROM events WHERE event_id IS NOT NULL AND ts IS NOT NULL),
o AS (SELECT day, count(*) AS n_events, count(DISTINCT user_id) AS n_users, min(ts) AS first_at, max(ts) AS last_at, count(DISTINCT (hour(ts) * 60 + minute(ts)) // 15) AS active_bins FROM e WHERE k = 1 GROUP BY 1)
SELECT n_rows, n_events, n_rows - n_events AS n_repeats, n_users, first_at, last_at, active_bins, round(active_bins / 96.0::DOUBLE, 6) AS coverage, CASE WHEN n_events::DOUBLE / n_rows >= 0.99 THEN 'PASS' WHEN n_events::DOUBLE / n_rows >= 0.9 THEN 'WARN' ELSE 'FAIL' END AS status, day FROM o JOIN (SELECT day, count(*) AS n_rows FROM e GROUP BY 1) USING (day)""")
def job1_daily_activity(spark, d):
    """Daily activity kept up to date by a checkpointed file stream."""
    root = shared_path(spark, "job1")
    for _ in range(2):
        daily_activity.run(spark, f"{d}/events.parque[t]", f"{root}/out", f"{root}/checkpoint")
    return daily_activity.read_daily(spark, f"{root}/out").withColumn("coverage", F.round("coverage", 6))


@query(f"""WITH w AS (SELECT conv_id, turn, nullif(trim(role), '') AS role, CASE WHEN turn = 0 THEN {category_sql("text", token_only=True)} END AS topic, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t-\\r]+'), lambda x: x <> ''))::BIGINT AS n_words FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
m AS (SELECT * EXCLUDE (k) FROM (SELECT *, {ONE_OF.format("conv_id, turn", "role NULLS FIRST, n_words, topic NULLS FIRST")} FROM w) WHERE k = 1),
e AS (SELECT m.*, p.conv_id IS NOT NULL AS answered, p.role AS parent_role, p.n_words AS parent_words FROM m LEFT JOIN m p ON p.conv_id = m.conv_id AND p.turn = m.turn - 1),
dy AS (SELECT conv_id, count(DISTINCT role < parent_role) = 2 AS reciprocal FROM e WHERE role <> parent_role GROUP BY conv_id, least(role, parent_role), greatest(role, parent_role)),
r AS (SELECT conv_id, count(*) AS dyads, count_if(reciprocal) AS reciprocal_dyads FROM dy GROUP BY 1),
t AS (SELECT conv_id, count(*) AS n_turns, count(DISTINCT role) AS n_roles, count(role) AS n_known, sum(n_words)::BIGINT AS n_words, round(avg(n_words), 6) AS mean_words,
  round((count(role) - count(DISTINCT role))::DOUBLE / nullif(count(role), 0), 6) AS reentry_rate, count_if(turn > 0 AND NOT answered) AS n_orphans, count_if(answered) AS n_answers,
  round(sum(CASE WHEN answered THEN n_words END)::DOUBLE / nullif(sum(parent_words), 0), 6) AS answer_ratio FROM e GROUP BY 1)
SELECT t.*, coalesce(dyads, 0) AS dyads, coalesce(reciprocal_dyads, 0) AS reciprocal_dyads, round(reciprocal_dyads::DOUBLE / dyads, 6) AS reciprocity_rate,
  CASE WHEN n_turns <= 2 THEN '1-2' WHEN n_turns <= 5 THEN '3-5' WHEN n_turns <= 10 THEN '6-10' ELSE '11+' END AS size_bin, coalesce(topic, 'Other') AS topic
FROM t LEFT JOIN r USING (conv_id) LEFT JOIN (SELECT conv_id, topic FROM m WHERE turn = 0) o USING (conv_id)""")
def job2_conversation_report(spark, d):
    """Conversations from message logs, by topic."""
    out = f"{shared_path(spark, 'job2')}/out"
    for _ in range(2):
        conversation_report.run(spark, f"{d}/conversations.parquet", out)
    t = conversation_report.read_threads(spark, out)
    return t.withColumns({c: F.round(c, 6) for c, kind in t.dtypes if kind == "double"})
