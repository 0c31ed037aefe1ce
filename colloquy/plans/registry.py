"""Queries by name, each with the DuckDB statement of the same rows where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from colloquy.functions import scalars as sc
from colloquy.sources import adapters

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def counted(sql: str) -> str:
    """The statement with each count_if(x) as count(CASE WHEN x THEN 1 END), whose type is BIGINT as in Spark."""
    while (at := sql.find("count_if(")) >= 0:
        depth, k = 1, at + len("count_if(")
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            k += 1
        sql = f"{sql[:at]}count(CASE WHEN {sql[at + len('count_if(') : k - 1]} THEN 1 END){sql[k:]}"
    return sql


def query(sql: str | None = None, name: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLES[key] = counted(sql)
        return f

    return add


def category_sql(name: str, variant: str = "baseline", token_only: bool = False) -> str:
    parts = []
    for topic, triggers in sc.KEYWORDS.items():
        triggers = triggers + (sc.EXPANDED.get(topic, []) if variant == "expanded" else [])
        hit = f"list_has_any(string_split_regex(lower(trim({name})), '[^a-z0-9]+'), {triggers})"
        if not token_only:
            hit += f" OR regexp_matches(lower(trim({name})), '{'|'.join(triggers)}')"
        parts.append(f"WHEN {hit} THEN '{topic}'")
    return f"CASE WHEN {name} IS NULL OR trim({name}) = '' THEN 'Other' {' '.join(parts)} ELSE 'Other' END"


def hours_sql(a: str, b: str) -> str:
    return f"(date_diff('microsecond', {a}, {b}) / 3600000000.0::DOUBLE)"


#: Views over the driver tables that statements start from.
VIEWS = f"""WITH RECURSIVE {adapters.SQL},
dep AS (SELECT comment_id, post_id, 1 AS depth FROM comments WHERE parent_id IS NULL
  UNION ALL SELECT c.comment_id, c.post_id, d.depth + 1 FROM comments c JOIN dep d ON c.parent_id = d.comment_id AND c.post_id = d.post_id),
kids AS (SELECT parent_id, count(*) AS n_children FROM comments WHERE parent_id IS NOT NULL GROUP BY 1),
te AS (SELECT c.comment_id, p.thread_id, c.parent_id, c.comment_agent_id, c.created_at_utc, p.post_agent_id, p.submolt, {category_sql("p.submolt")} AS submolt_category,
  p.post_score, p.comment_count, p.post_created_at_utc, CASE WHEN c.parent_id IS NULL THEN 'post' WHEN u.comment_id IS NOT NULL THEN 'comment' ELSE 'unknown' END AS parent_type,
  CASE WHEN c.parent_id IS NULL THEN p.post_created_at_utc ELSE u.created_at_utc END AS parent_created_at_utc,
  CASE WHEN c.parent_id IS NULL THEN p.post_agent_id ELSE u.comment_agent_id END AS parent_agent_id,
  {hours_sql("CASE WHEN c.parent_id IS NULL THEN p.post_created_at_utc ELSE u.created_at_utc END", "c.created_at_utc")} AS lag_since_parent_hours,
  {hours_sql("p.post_created_at_utc", "c.created_at_utc")} AS lag_since_post_hours, dep.depth, coalesce(k.n_children, 0) AS n_children
  FROM comments c JOIN posts p ON c.post_id = p.thread_id LEFT JOIN comments u ON c.parent_id = u.comment_id LEFT JOIN dep ON dep.comment_id = c.comment_id LEFT JOIN kids k ON k.parent_id = c.comment_id),
tm AS (SELECT thread_id, any_value(submolt) AS submolt, any_value(submolt_category) AS submolt_category, any_value(post_created_at_utc) AS post_created_at_utc, count(*) AS n_comments,
  count(DISTINCT comment_agent_id) AS n_unique_agents, max(depth) AS depth_max, avg(depth) AS depth_mean, min(created_at_utc) AS first_comment_at, max(created_at_utc) AS last_comment_at,
  {hours_sql("any_value(post_created_at_utc)", "max(created_at_utc)")} AS thread_duration_hours,
  (count(comment_agent_id) - count(DISTINCT comment_agent_id))::DOUBLE / nullif(count(comment_agent_id), 0) AS reentry_rate, count_if(lag_since_post_hours <= 0.5) AS early_comments
  FROM te GROUP BY thread_id),
edges AS (SELECT thread_id, created_at_utc, comment_id, comment_agent_id AS src, parent_agent_id AS dst FROM te WHERE comment_agent_id <> parent_agent_id),
dy AS (SELECT thread_id, least(src, dst) AS a, greatest(src, dst) AS b, count(DISTINCT src < dst) = 2 AS reciprocal FROM edges GROUP BY ALL),
fr AS (SELECT parent_id, min(created_at_utc) AS first_reply_at FROM comments WHERE parent_id IS NOT NULL GROUP BY 1),
su AS (SELECT * FROM (SELECT te.thread_id, te.comment_id, te.comment_agent_id, te.created_at_utc, te.submolt_category, fr.first_reply_at, (fr.first_reply_at IS NOT NULL)::INT AS event_observed,
  {hours_sql("te.created_at_utc", "coalesce(fr.first_reply_at, e.observation_end)")} AS duration_hours, te.created_at_utc > e.observation_end - INTERVAL 4 HOUR AS excluded_censor_boundary, observation_end
  FROM te LEFT JOIN fr ON fr.parent_id = te.comment_id CROSS JOIN (SELECT max(created_at_utc) AS observation_end FROM comments) e) WHERE duration_hours > 0),
sul AS (SELECT su.*, a.is_claimed, a.follower_count FROM su LEFT JOIN agents a ON a.agent_id = su.comment_agent_id)
"""
TWO_PART = """count(*) AS n_units, count_if(event_observed = 1) AS n_events, round(count_if(event_observed = 1)::DOUBLE / count(*), 6) AS incidence,
  round(quantile_cont(CASE WHEN event_observed = 1 THEN duration_hours * 60 END, 0.5), 6) AS p50_minutes, round(quantile_cont(CASE WHEN event_observed = 1 THEN duration_hours * 60 END, 0.9), 6) AS p90_minutes,
  round(quantile_cont(CASE WHEN event_observed = 1 THEN duration_hours * 60 END, 0.95), 6) AS p95_minutes,
  round(count_if(event_observed = 1 AND duration_hours * 60 <= 0.5)::DOUBLE / count(*), 6) AS within_30s, round(count_if(event_observed = 1 AND duration_hours * 60 <= 5)::DOUBLE / count(*), 6) AS within_5m,
  round(count_if(event_observed = 1 AND duration_hours * 60 <= 0.5)::DOUBLE / nullif(count_if(event_observed = 1), 0), 6) AS within_30s_conditional,
  round(count_if(event_observed = 1 AND duration_hours * 60 <= 5)::DOUBLE / nullif(count_if(event_observed = 1), 0), 6) AS within_5m_conditional,
  round(ln(2) * avg(CASE WHEN event_observed = 1 THEN duration_hours * 60 END), 6) AS half_life_minutes"""
