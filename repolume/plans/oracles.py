"""SQL for another engine that must give the same rows as the registered queries.

Written independently of the operators: plain SQL over the driver's tables.
"""

from __future__ import annotations

from repolume.plans import additive_sql
from repolume.plans.tables import (
    AS_OF,
    AS_OF_CI,
    AS_OF_ISSUES,
    AS_OF_ISSUES_TODAY,
    AS_OF_TODAY,
)

_K = "SELECT *, CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS k FROM events"

ACTIVITY = f"""activity AS (
SELECT CAST(event_id AS VARCHAR) AS id,
 CASE WHEN event_type='click' THEN 'PushEvent' WHEN event_type='purchase' THEN 'PullRequestEvent'
      WHEN event_type='error' THEN 'IssuesEvent' WHEN event_type='view' THEN 'WatchEvent'
      WHEN k<60 THEN 'ForkEvent' WHEN k<90 THEN 'CreateEvent' ELSE 'ReleaseEvent' END AS type,
 'dev'||CAST(user_id AS VARCHAR) AS actor_login,
 'org'||CAST(k%4 AS VARCHAR)||'/repo'||CAST(k%20 AS VARCHAR) AS repo_name,
 ts AS created_at,
 CASE WHEN event_type='purchase' AND k%2=0 THEN
        '{{"action":"closed","merged":true,"number":'||CAST(k AS VARCHAR)||',"pull_request":{{"merged_at":"'
        ||replace(CAST(date_trunc('second', ts + INTERVAL '1' HOUR * k) AS VARCHAR),' ','T')||'Z"}}}}'
      WHEN event_type='purchase' THEN '{{"action":"opened","number":'||CAST(k AS VARCHAR)||'}}'
      WHEN event_type='error' AND k%5=0 THEN '{{"action":"opened","labels":["bug"]}}'
      WHEN event_type='click' THEN '{{"size":'||CAST(k%10+1 AS VARCHAR)||'}}'
      ELSE '{{"action":"created"}}' END AS payload,
 CASE WHEN k%3=0 THEN 'org'||CAST(k%4 AS VARCHAR) END AS org_login
FROM ({_K}) t)"""

ISSUES = f"""issue AS (
SELECT d.doc_id AS id, d.doc_id%500+1 AS number, substr(d.text,1,60) AS title, d.text AS body,
 list_filter([CASE WHEN k%4<>0 THEN d.lang END,
              CASE WHEN l.quality=0 THEN 'low-quality' END,
              CASE WHEN l.toxic=1 THEN 'toxic' END], lambda x: x IS NOT NULL) AS labels,
 CASE WHEN k%2=0 THEN 'closed' ELSE 'open' END AS state, e.ts AS created_at,
 CASE WHEN k%2=0 AND k%10<>0
      THEN e.ts + INTERVAL '1' HOUR * CAST(floor(e.value) AS INT) END AS closed_at,
 'dev'||CAST(e.user_id AS VARCHAR) AS user_login,
 'org'||CAST(k%4 AS VARCHAR)||'/repo'||CAST(k%20 AS VARCHAR) AS repo_name
FROM documents d JOIN ({_K}) e ON e.event_id=d.doc_id
LEFT JOIN labels l ON l.doc_id=d.doc_id)"""

CI_RUNS = """ci_runs AS (
SELECT o_orderkey AS run_id, 'workflow '||o_orderpriority AS workflow_name,
 CASE o_orderstatus WHEN 'P' THEN 'in_progress' ELSE 'completed' END AS status,
 CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'failure' END AS conclusion,
 o_orderdate AS created_at,
 'org'||CAST(o_custkey%4 AS VARCHAR)||'/repo'||CAST(o_custkey%20 AS VARCHAR) AS repo_name
FROM orders)"""

TEST_RESULTS = """test_results AS (
SELECT 'test_'||CAST(l.l_partkey%50 AS VARCHAR) AS test_name,
 'org'||CAST(o.o_custkey%4 AS VARCHAR)||'/repo'||CAST(o.o_custkey%20 AS VARCHAR) AS repo_name,
 o.o_orderkey AS run_id, 'workflow '||o.o_orderpriority AS workflow_name,
 o.o_orderdate AS created_at,
 max(CASE WHEN l.l_returnflag='R' THEN 1 ELSE 0 END) AS failed
FROM lineitem l JOIN orders o ON l.l_orderkey=o.o_orderkey
GROUP BY l.l_partkey%50, o.o_custkey, o.o_orderkey, o.o_orderpriority, o.o_orderdate)"""

FORECASTS = """forecasts AS (
SELECT repo_name AS repository, CAST(created_at AS DATE) + 3 AS forecast_date,
 CAST(count(*) AS DOUBLE) AS predicted_events, CAST(count(*) AS DOUBLE) - 5 AS lower_bound,
 CAST(count(*) AS DOUBLE) + 5 AS upper_bound
FROM activity GROUP BY 1, 2)"""

PREDICTIONS = """predictions AS (
SELECT doc_id AS issue_id, CASE quality WHEN 1 THEN 'keep' ELSE 'drop' END AS predicted_label
FROM labels)"""

NOW = f"TIMESTAMP '{AS_OF}'"
TODAY = f"TIMESTAMP '{AS_OF_TODAY}'"
CI_NOW = f"TIMESTAMP '{AS_OF_CI}'"
ISSUES_NOW = f"TIMESTAMP '{AS_OF_ISSUES}'"
ISSUES_TODAY = f"TIMESTAMP '{AS_OF_ISSUES_TODAY}'"
MERGED = "type = 'PullRequestEvent' AND payload LIKE '%merged%'"
EVENT_ROW = "id, type, actor_login, repo_name, created_at, payload, org_login"


def _with(*parts: str) -> str:
    *ctes, body = parts
    return "WITH " + ",\n".join(ctes) + "\n" + body


def _recursive(*parts: str) -> str:
    return _with(*parts).replace("WITH ", "WITH RECURSIVE ", 1)


def _events(body: str) -> str:
    return _with(ACTIVITY, body)


def _issues(body: str) -> str:
    return _with(ISSUES, body)


def _both(body: str) -> str:
    return _with(ACTIVITY, ISSUES, body)


def _round2(x: str) -> str:
    return f"round_even(({x}) * 100.0, 0) / 100.0"


def _score(x: str) -> str:
    return f"CAST(printf('%.2f', {x}) AS DOUBLE)"


def _recent(days: int, now: str = NOW) -> str:
    return f"created_at >= {now} - INTERVAL {days} DAY"


def _forecast(
    source: str,
    now: str,
    name: str = "forecast",
    table: str = "activity",
    yearly: str = "date_diff('day', any_value(d0), any_value(d1)) >= 730",
    dates: str = "CAST(d1 + CAST(i AS INT) AS DATE)",
) -> str:
    """CTEs ending in one that holds the forecast rows of ``table``; ``source``
    filters its rows, ``yearly`` says where month means are used, and ``dates`` gives
    the i-th day."""
    return f"""{name}_daily AS (
 SELECT repo_name AS repository, CAST(created_at AS DATE) AS ds, CAST(count(*) AS DOUBLE) AS y
 FROM {table} WHERE {source} GROUP BY 1, 2),
{name}_span AS (SELECT repository, min(ds) AS d0, max(ds) AS d1, count(*) AS n
 FROM {name}_daily GROUP BY 1),
{name}_x AS (SELECT repository, ds, y, d0, d1, n, CAST(date_diff('day', d0, ds) AS DOUBLE) AS x
 FROM {name}_daily JOIN {name}_span USING (repository)),
{name}_line AS (SELECT repository, any_value(d0) AS d0, any_value(d1) AS d1,
  CASE WHEN any_value(n) = 1 THEN 0.0 ELSE regr_slope(y, x) END AS sl,
  CASE WHEN any_value(n) = 1 THEN max(y) ELSE regr_intercept(y, x) END AS ic
 FROM {name}_x GROUP BY 1),
{name}_r1 AS (SELECT repository, ds, y - (ic + sl * x) AS r, dayofweek(ds) AS w
 FROM {name}_x JOIN {name}_line USING (repository)),
{name}_week AS (SELECT repository, w, avg(r) AS weekly FROM {name}_r1 GROUP BY 1, 2),
{name}_r2 AS (SELECT repository, ds, r - weekly AS r, month(ds) AS m
 FROM {name}_r1 JOIN {name}_week USING (repository, w)),
{name}_year AS (SELECT repository, m,
  CASE WHEN {yearly} THEN avg(r) ELSE 0.0 END AS yearly
 FROM {name}_r2 JOIN {name}_span USING (repository) GROUP BY 1, 2),
{name}_sigma AS (SELECT repository, stddev_pop(r - yearly) AS sigma
 FROM {name}_r2 JOIN {name}_year USING (repository, m) GROUP BY 1),
{name}_yhat AS (SELECT f.repository, f.forecast_date, sigma,
  ic + sl * date_diff('day', d0, forecast_date) + coalesce(weekly, 0.0) + coalesce(yearly, 0.0) AS yhat
 FROM (SELECT *, {dates} AS forecast_date
       FROM {name}_line, range(1, 31) AS s(i)) f
 JOIN {name}_sigma USING (repository)
 LEFT JOIN {name}_week k ON k.repository = f.repository AND k.w = dayofweek(f.forecast_date)
 LEFT JOIN {name}_year q ON q.repository = f.repository AND q.m = month(f.forecast_date)),
{name} AS (SELECT repository, forecast_date,
  floor(round(greatest(0.0, yhat), 6)) AS predicted_events,
  floor(round(greatest(0.0, yhat - 1.959964 * sigma), 6)) AS lower_bound,
  floor(round(greatest(0.0, yhat + 1.959964 * sigma), 6)) AS upper_bound,
  'trend_weekly' AS model_type, CAST({now} AS DATE) AS training_date
 FROM {name}_yhat)"""


_DAILY = """SELECT repo_name, CAST(created_at AS DATE) AS date, count(*) AS events,
 count(DISTINCT actor_login) AS contributors FROM activity GROUP BY 1, 2"""

_LIMITS = f"""limits AS (SELECT
 (SELECT avg(c) + 3 * stddev_pop(c) FROM (SELECT count(*) AS c FROM activity
   WHERE {{recent}} GROUP BY CAST(created_at AS DATE))) AS e,
 (SELECT avg(c) + 3 * stddev_pop(c) FROM (SELECT count(*) AS c FROM issue
   WHERE {{recent}} GROUP BY CAST(created_at AS DATE))) AS i)"""
LIMITS = _LIMITS.format(recent=_recent(90))
LIMITS_BUSY = _LIMITS.format(recent=_recent(90, ISSUES_TODAY))
LIMITS_TODAY = _LIMITS.format(recent=_recent(90, TODAY))

_THRESHOLDS = _with(
    ACTIVITY,
    ISSUES,
    LIMITS,
    """SELECT round(coalesce(nullif(e, 0), 100.0), 6) AS events_per_day,
     round(coalesce(nullif(i, 0), 10.0), 6) AS issues_per_day,
     CAST(15.0 AS DOUBLE) AS cfr_threshold, CAST(72.0 AS DOUBLE) AS mttr_threshold,
     CAST(72.0 AS DOUBLE) AS lead_time_threshold FROM limits""",
)

_STATUS = "CASE WHEN current > threshold THEN '🔴 UNHEALTHY' ELSE '🟢 HEALTHY' END AS status"


def _health(rows: str) -> str:
    return f"""SELECT metric, round(CAST(current AS DOUBLE), 6) AS current,
 round(CAST(threshold AS DOUBLE), 6) AS threshold, {_STATUS} FROM ({rows})"""


_FLAKY = """ranked AS (SELECT *, row_number() OVER (PARTITION BY test_name, repo_name
  ORDER BY created_at DESC, run_id DESC) AS rn FROM test_results),
islands AS (SELECT *, rn - row_number() OVER (PARTITION BY test_name, repo_name, failed
  ORDER BY rn) AS island FROM ranked WHERE rn <= 10),
streaks AS (SELECT test_name, repo_name, max(n) AS longest FROM (
  SELECT test_name, repo_name, island, count(*) AS n FROM islands WHERE failed = 1
  GROUP BY 1, 2, 3) GROUP BY 1, 2),
flaky AS (SELECT r.test_name, r.repo_name,
  CAST(sum(failed) AS DOUBLE) / count(*) AS failure_rate,
  CAST(sum(CASE WHEN rn <= 10 THEN failed ELSE 0 END) AS BIGINT) AS recent_failures,
  count(*) AS total_runs, max(CASE WHEN failed = 1 THEN created_at END) AS last_detected,
  CASE WHEN max(CASE WHEN workflow_name = 'workflow 1-URGENT' THEN 1 ELSE 0 END) = 1
       THEN 'high' ELSE 'normal' END AS severity,
  CAST(coalesce(max(longest), 0) AS INT) AS longest_streak,
  coalesce(max(longest), 0) >= 3 AS has_trend
  FROM ranked r LEFT JOIN streaks s ON s.test_name = r.test_name AND s.repo_name = r.repo_name
  GROUP BY 1, 2 HAVING CAST(sum(failed) AS DOUBLE) / count(*) BETWEEN 0.1 AND 0.5)"""

_ROLLUP_EXACT = """SELECT CAST(created_at AS DATE) AS date, repo_name, type AS event_type,
 count(*) AS event_count, count(DISTINCT actor_login) AS unique_users
 FROM activity GROUP BY 1, 2, 3"""

_TRAINING = """rows_ AS (SELECT id, labels[1] AS label,
 coalesce(title, '') || ' ' || coalesce(body, '') AS text FROM issue WHERE len(labels) > 0)"""

_CFR = "100.0 * count_if(payload LIKE '%bug%' OR type = 'IssuesEvent') / count(*)"
_LEAD = """date_diff('hour', created_at, CAST(replace(json_extract_string(payload,
 '$.pull_request.merged_at'), 'Z', '') AS TIMESTAMP))"""

ORACLES: dict[str, str] = {
    "trending_repositories": _events(f"""SELECT *,
 CASE WHEN trend_score >= 20 THEN 'high' WHEN trend_score >= 10 THEN 'medium'
      WHEN trend_score >= 5 THEN 'low' ELSE 'stable' END AS trend_level
FROM (SELECT repo_name AS repository, count(*) AS event_count,
   count(DISTINCT actor_login) AS contributor_count,
   count(*) FILTER (WHERE type = 'WatchEvent') AS new_stars, count(*) FILTER (WHERE type = 'ForkEvent') AS new_forks,
   {_round2("count(*) / 7")} AS daily_avg_events,
   {_round2("(count(*) FILTER (WHERE type = 'WatchEvent') * 3 + count(*) FILTER (WHERE type = 'ForkEvent') * 2 + count(DISTINCT actor_login)) / 7")} AS trend_score
  FROM activity WHERE {_recent(7)} GROUP BY 1)
ORDER BY trend_score DESC, repository LIMIT 10"""),
    "repository_stats": _events("""SELECT repo_name, count(*) AS total_events,
 count(DISTINCT actor_login) AS unique_contributors, max(created_at) AS last_activity
FROM activity GROUP BY 1"""),
    "repository_profile": _events("""SELECT repo_name, total_events, unique_contributors,
 last_activity, event_type, event_count
FROM (SELECT repo_name, count(*) AS total_events, count(DISTINCT actor_login) AS unique_contributors,
        max(created_at) AS last_activity FROM activity GROUP BY 1)
JOIN (SELECT repo_name, type AS event_type, count(*) AS event_count FROM activity GROUP BY 1, 2)
USING (repo_name)"""),
    "contributor_stats": _events("""SELECT username, total_contributions, first_contribution,
 last_contribution, event_type, event_count
FROM (SELECT actor_login AS username, count(*) AS total_contributions,
        min(created_at) AS first_contribution, max(created_at) AS last_contribution
      FROM activity GROUP BY 1)
JOIN (SELECT actor_login AS username, type AS event_type, count(*) AS event_count
      FROM activity GROUP BY 1, 2) USING (username)"""),
    "detailed_analytics": _events(f"""SELECT repo_name, CAST(created_at AS DATE) AS date,
 type AS event_type, count(*) AS event_count, count(DISTINCT actor_login) AS unique_users
FROM activity WHERE {_recent(30)} GROUP BY 1, 2, 3"""),
    "detailed_analytics_nested": _events(f"""SELECT repo_name, 30 AS period_days,
 strftime(CAST(created_at AS DATE), '%Y-%m-%d') AS date, type AS event_type,
 count(*) AS event_count, count(DISTINCT actor_login) AS unique_users,
 CAST(sum(count(*)) OVER (PARTITION BY repo_name, type) AS BIGINT) AS type_total
FROM activity WHERE {_recent(30)} GROUP BY 1, 2, 3, 4"""),
    "event_type_summary": _events(f"""SELECT repo_name, type AS event_type,
 count(*) AS event_count FROM activity WHERE {_recent(30)} GROUP BY 1, 2"""),
    "developer_velocity": _events(f"""SELECT *, {_score('''(least(push_events / 100, 1.0::DOUBLE) * 0.3::DOUBLE
  + least(pr_events / 50, 1.0::DOUBLE) * 0.4::DOUBLE
  + least(active_developers / 10, 1.0::DOUBLE) * 0.2::DOUBLE
  + least(events_per_day / 20, 1.0::DOUBLE) * 0.1::DOUBLE) * 100.0::DOUBLE''')} AS velocity_score
FROM (SELECT repo_name, count(*) FILTER (WHERE type = 'PushEvent') AS push_events,
   count(*) FILTER (WHERE type = 'PullRequestEvent') AS pr_events, count(*) FILTER (WHERE type = 'IssuesEvent') AS issue_events,
   count(*) FILTER (WHERE type = 'WatchEvent') AS watch_events, count(DISTINCT actor_login) AS active_developers,
   count(DISTINCT CAST(created_at AS DATE)) AS active_days,
   {_round2("count(*) / count(DISTINCT CAST(created_at AS DATE))")} AS events_per_day
  FROM activity WHERE {_recent(30)} GROUP BY 1)"""),
    "community_health": _events(f"""SELECT *, {_score('''(least(total_contributors / 50, 1.0::DOUBLE) * 0.3::DOUBLE
  + least(contributor_retention_rate / 100, 1.0::DOUBLE) * 0.3::DOUBLE
  + least(total_events / 1000, 1.0::DOUBLE) * 0.2::DOUBLE
  + least((stars + forks) / 100, 1.0::DOUBLE) * 0.2::DOUBLE) * 100.0::DOUBLE''')} AS health_score
FROM (SELECT repo_name, count(*) AS total_events, count(DISTINCT actor_login) AS total_contributors,
   count(DISTINCT CASE WHEN {_recent(90)} THEN actor_login END) AS recent_contributors,
   count(*) FILTER (WHERE type = 'WatchEvent') AS stars, count(*) FILTER (WHERE type = 'ForkEvent') AS forks,
   count(*) FILTER (WHERE type = 'IssuesEvent') AS total_issues, count(*) FILTER (WHERE type = 'PullRequestEvent') AS total_prs,
   CAST(min(created_at) AS DATE) AS first_event_date,
   {_round2(f"count(DISTINCT CASE WHEN {_recent(90)} THEN actor_login END) * 100.0::DOUBLE / count(DISTINCT actor_login)")}
     AS contributor_retention_rate
  FROM activity GROUP BY 1)"""),
    "list_repos": _events("SELECT DISTINCT repo_name FROM activity ORDER BY 1"),
    "list_event_types": _events("SELECT DISTINCT type AS event_type FROM activity ORDER BY 1"),
    "repo_activity_ranking": _events(f"""SELECT repo_name, count(*) AS events,
 count(DISTINCT actor_login) AS contributors FROM activity WHERE {_recent(30)}
GROUP BY 1 ORDER BY events DESC, repo_name LIMIT 10"""),
    "repo_activity_ranking_range": _events(f"""SELECT repo_name, count(*) AS events,
 count(DISTINCT actor_login) AS contributors FROM activity
WHERE created_at BETWEEN TIMESTAMP '2024-01-01 00:00:00' AND {NOW}
GROUP BY 1 ORDER BY events DESC, repo_name LIMIT 10"""),
    "repo_activity_summary": _events("""SELECT repo_name, count(*) AS events,
 count(DISTINCT actor_login) AS contributors FROM activity GROUP BY 1"""),
    "top_contributors": _events(f"""SELECT actor_login AS contributor, count(*) AS events,
 count(DISTINCT repo_name) AS repos FROM activity WHERE {_recent(30)}
GROUP BY 1 ORDER BY events DESC, contributor LIMIT 15"""),
    "top_contributors_range": _events(f"""SELECT actor_login AS contributor, count(*) AS events,
 count(DISTINCT repo_name) AS repos FROM activity
WHERE created_at BETWEEN TIMESTAMP '2024-01-01 00:00:00' AND {NOW}
GROUP BY 1 ORDER BY events DESC, contributor LIMIT 15"""),
    "top_contributors_by_repo": _events("""SELECT repo_name, actor_login, events,
 CAST(rank AS INT) AS rank
FROM (SELECT repo_name, actor_login, count(*) AS events, row_number() OVER (
   PARTITION BY repo_name ORDER BY count(*) DESC, actor_login) AS rank
  FROM activity GROUP BY 1, 2) WHERE rank <= 10"""),
    "daily_activity": _events(f"""SELECT * FROM ({_DAILY})
QUALIFY row_number() OVER (PARTITION BY repo_name ORDER BY date DESC) <= 30"""),
    "event_type_counts": _events("""SELECT type AS event_type, count(*) AS count
FROM activity GROUP BY 1"""),
    "event_type_counts_range": _events(f"""SELECT type AS event_type, count(*) AS count
FROM activity WHERE created_at BETWEEN TIMESTAMP '2024-01-01 00:00:00' AND {NOW} GROUP BY 1"""),
    "event_types_by_repo": _events(
        "SELECT repo_name, type, count(*) AS total FROM activity GROUP BY 1, 2"
    ),
    "event_traffic_daily": _events(f"""SELECT CAST(created_at AS DATE) AS time, count(*) AS events
FROM activity WHERE created_at BETWEEN TIMESTAMP '2024-01-01 00:00:00' AND {NOW} GROUP BY 1"""),
    "event_traffic_epoch_ms": _events("""SELECT repo_name,
 CAST(epoch_ms(date_trunc('day', created_at)::TIMESTAMP) AS BIGINT) AS time, count(*) AS events
FROM activity GROUP BY 1, 2"""),
    "event_traffic_from_rollup": _events("""SELECT CAST(created_at AS DATE) AS time,
 count(*) AS events FROM activity GROUP BY 1"""),
    "hourly_activity": _events(f"""SELECT CAST(date_trunc('hour', created_at) AS TIMESTAMP) AS time,
 count(*) AS events FROM activity
WHERE created_at BETWEEN TIMESTAMP '2024-01-01 00:00:00' AND {NOW} GROUP BY 1"""),
    "release_annotations": _events(f"""SELECT created_at AS time, 'Release: ' || payload AS text,
 'release' AS tags FROM activity WHERE type = 'ReleaseEvent' AND {_recent(90)}"""),
    "deployment_count": _events(f"""SELECT count(*) AS deployments FROM activity
WHERE {MERGED} AND {_recent(7)}"""),
    "deployment_count_by_repo": _events(f"""SELECT repo_name, count(*) AS deployments
FROM activity WHERE {MERGED} AND {_recent(7)} GROUP BY 1"""),
    "deployment_frequency_weekly": _events(f"""SELECT
 CAST(CAST(created_at AS DATE) - CAST(dayofweek(created_at) AS INT) AS DATE) AS week_start,
 CAST(strftime(created_at, '%U') AS INT) AS time, count(*) AS deployments
FROM activity WHERE {MERGED} AND {_recent(90)} GROUP BY 1, 2"""),
    "lead_time_hours": _events(f"""SELECT coalesce(avg({_LEAD}), 0.0::DOUBLE) AS lead_time
FROM activity WHERE {MERGED} AND {_recent(90)}"""),
    "lead_time_hours_by_repo": _events(f"""SELECT repo_name,
 coalesce(avg({_LEAD}), 0.0::DOUBLE) AS lead_time
FROM activity WHERE {MERGED} AND {_recent(90)} GROUP BY 1"""),
    "mttr_hours": _issues(f"""SELECT coalesce(avg(date_diff('hour', created_at, closed_at)),
 0.0::DOUBLE) AS mttr FROM issue
WHERE state = 'closed' AND closed_at IS NOT NULL AND {_recent(90)}"""),
    "mttr_hours_30d": _issues(f"""SELECT avg(date_diff('hour', created_at, closed_at)) AS mttr
FROM issue WHERE state = 'closed' AND closed_at IS NOT NULL AND {_recent(30)}"""),
    "mttr_hours_by_repo": _issues(f"""SELECT repo_name,
 coalesce(avg(date_diff('hour', created_at, closed_at)), 0.0::DOUBLE) AS mttr FROM issue
WHERE state = 'closed' AND closed_at IS NOT NULL AND {_recent(90)} GROUP BY 1"""),
    "mttr_hours_exact": _issues(f"""SELECT repo_name,
 {_round2("avg(date_diff('second', created_at, closed_at)) / 3600.0::DOUBLE")} AS mttr_hours
FROM issue WHERE closed_at IS NOT NULL GROUP BY 1"""),
    "change_failure_rate": _events(f"""SELECT CASE WHEN count(*) > 0 THEN {_CFR}
 ELSE 0.0 END::DOUBLE AS cfr FROM activity WHERE {_recent(7)}"""),
    "change_failure_rate_unguarded": _events(f"""SELECT ({_CFR})::DOUBLE AS cfr
FROM activity WHERE {_recent(7)}"""),
    "change_failure_rate_by_repo": _events(f"""SELECT repo_name, ({_CFR})::DOUBLE AS cfr
FROM activity WHERE {_recent(7)} GROUP BY 1"""),
    "metric_bands": _both(f"""SELECT metric, value, CASE
  WHEN metric = 'deployments' THEN
    CASE WHEN value >= 10 THEN 'green' WHEN value >= 5 THEN 'yellow' ELSE 'red' END
  WHEN value >= high THEN 'red' WHEN value >= high / 2 THEN 'yellow' ELSE 'green' END AS band
FROM (
 SELECT 'lead_time' AS metric, coalesce(avg({_LEAD}), 0.0::DOUBLE) AS value, 72.0 AS high
  FROM activity WHERE {MERGED} AND {_recent(90)}
 UNION ALL SELECT 'mttr', coalesce(avg(date_diff('hour', created_at, closed_at)), 0.0::DOUBLE), 72.0
  FROM issue WHERE state = 'closed' AND closed_at IS NOT NULL AND {_recent(90)}
 UNION ALL SELECT 'cfr', ({_CFR})::DOUBLE, 15.0 FROM activity WHERE {_recent(7)}
 UNION ALL SELECT 'deployments', count(*)::DOUBLE, 0.0 FROM activity
  WHERE {MERGED} AND {_recent(7)}
 UNION ALL SELECT 'open_issues', count(*)::DOUBLE, 100.0 FROM issue WHERE state = 'open')"""),
    "metric_bands_short": _both(f"""SELECT metric, value, CASE
  WHEN metric = 'deployments' THEN
    CASE WHEN value >= 10 THEN 'green' WHEN value >= 5 THEN 'yellow' ELSE 'red' END
  WHEN value >= red THEN 'red' WHEN value >= yellow THEN 'yellow' ELSE 'green' END AS band
FROM (
 SELECT 'mttr' AS metric, coalesce(avg(date_diff('hour', created_at, closed_at)), 0.0::DOUBLE) AS value,
   24.0 AS yellow, 72.0 AS red
  FROM issue WHERE state = 'closed' AND closed_at IS NOT NULL AND {_recent(30)}
 UNION ALL SELECT 'cfr', ({_CFR})::DOUBLE, 15.0, 30.0 FROM activity WHERE {_recent(7)}
 UNION ALL SELECT 'deployments', count(*)::DOUBLE, 0.0, 0.0 FROM activity
  WHERE {MERGED} AND {_recent(7)})"""),
    "event_traffic_bands": _events("""SELECT CAST(created_at AS DATE) AS time,
 count(*) AS events, CASE WHEN count(*) >= 100 THEN 'red' ELSE 'green' END AS band
FROM activity GROUP BY 1"""),
    "issues_by_state": _issues(
        "SELECT repo_name, state, count(*) AS total FROM issue GROUP BY 1, 2"
    ),
    "open_issues": _issues("""SELECT count(*) FILTER (WHERE state = 'open') AS open_issues,
 count(*) FILTER (WHERE state = 'closed') AS closed_issues FROM issue"""),
    "open_issues_by_repo": _issues("""SELECT repo_name, count(*) FILTER (WHERE state = 'open') AS open_issues,
 count(*) FILTER (WHERE state = 'closed') AS closed_issues FROM issue GROUP BY 1"""),
    "top_labels": _issues("""SELECT label, count(*) AS count
FROM (SELECT unnest(labels) AS label FROM issue) GROUP BY 1 ORDER BY count DESC, label LIMIT 10"""),
    "top_labels_recent": _issues(f"""SELECT label, count(*) AS count
FROM (SELECT unnest(labels) AS label FROM issue WHERE {_recent(7, ISSUES_NOW)})
GROUP BY 1 ORDER BY count DESC, label LIMIT 10"""),
    "issues_created_daily": _issues("""SELECT repo_name, CAST(created_at AS DATE) AS time,
 count(*) AS issues FROM issue GROUP BY 1, 2"""),
    "predicted_label_distribution": _with(
        PREDICTIONS, "SELECT predicted_label, count(*) AS count FROM predictions GROUP BY 1"
    ),
    "dynamic_thresholds": _THRESHOLDS,
    "thresholds_roundtrip": _THRESHOLDS,
    "system_health": _with(
        ACTIVITY,
        ISSUES,
        LIMITS_TODAY,
        _health("""SELECT 'Events' AS metric,
   (SELECT count(*) FROM activity WHERE created_at >= TIMESTAMP '2024-01-30 00:00:00')::DOUBLE AS current,
   e AS threshold FROM limits
 UNION ALL SELECT 'Issues',
   (SELECT count(*) FROM issue WHERE created_at >= TIMESTAMP '2024-01-30 00:00:00')::DOUBLE, i FROM limits
 UNION ALL SELECT 'Change Failure Rate', (SELECT CASE WHEN count(*) > 0
     THEN count_if(payload LIKE '%bug%') * 100.0::DOUBLE / count(*) ELSE 0.0 END
   FROM activity WHERE created_at >= TIMESTAMP '2024-01-30 00:00:00'), 15.0::DOUBLE"""),
    ),
    "system_health_static": _both(
        _health(f"""SELECT 'Events (24h)' AS metric,
   (SELECT count(*) FROM activity WHERE {_recent(1)})::DOUBLE AS current, 100.0::DOUBLE AS threshold
 UNION ALL SELECT 'Issues (24h)',
   (SELECT count(*) FROM issue WHERE {_recent(1)})::DOUBLE, 10.0::DOUBLE
 UNION ALL SELECT 'Change Failure Rate',
   (SELECT count_if(payload LIKE '%bug%') * 100.0::DOUBLE / count(*) FROM activity WHERE {_recent(1)}),
   15.0::DOUBLE""")
    ),
    "system_health_busy": _with(
        ACTIVITY,
        ISSUES,
        LIMITS_BUSY,
        _health("""SELECT 'Events' AS metric,
   (SELECT count(*) FROM activity WHERE created_at >= TIMESTAMP '2024-01-02 00:00:00')::DOUBLE AS current,
   e AS threshold FROM limits
 UNION ALL SELECT 'Issues',
   (SELECT count(*) FROM issue WHERE created_at >= TIMESTAMP '2024-01-02 00:00:00')::DOUBLE, i FROM limits
 UNION ALL SELECT 'Change Failure Rate', (SELECT CASE WHEN count(*) > 0
     THEN count_if(payload LIKE '%bug%') * 100.0::DOUBLE / count(*) ELSE 0.0 END
   FROM activity WHERE created_at >= TIMESTAMP '2024-01-02 00:00:00'), 15.0::DOUBLE"""),
    ),
    "system_health_static_busy": _both(
        _health(f"""SELECT 'Events (24h)' AS metric,
   (SELECT count(*) FROM activity WHERE {_recent(1, ISSUES_TODAY)})::DOUBLE AS current, 100.0::DOUBLE AS threshold
 UNION ALL SELECT 'Issues (24h)',
   (SELECT count(*) FROM issue WHERE {_recent(1, ISSUES_TODAY)})::DOUBLE, 10.0::DOUBLE
 UNION ALL SELECT 'Change Failure Rate',
   (SELECT count_if(payload LIKE '%bug%') * 100.0::DOUBLE / count(*) FROM activity
    WHERE {_recent(1, ISSUES_TODAY)}), 15.0::DOUBLE""")
    ),
    "daily_anomalies_flagged": _events("""SELECT time, events, round(e, 6) AS threshold,
 events > e AS is_anomaly FROM (SELECT time, n AS events,
  avg(n) OVER () + 3 * stddev_pop(n) OVER () AS e
  FROM (SELECT CAST(created_at AS DATE) AS time,
    count(*) * CASE WHEN CAST(created_at AS DATE) = DATE '2024-01-15' THEN 6 ELSE 1 END AS n
   FROM activity GROUP BY CAST(created_at AS DATE)))"""),
    "daily_anomalies_of_repos": _with(
        ACTIVITY,
        ISSUES,
        LIMITS,
        """SELECT time, events, round(e, 6) AS threshold, events > e AS is_anomaly
FROM (SELECT CAST(created_at AS DATE) AS time, count(*) AS events FROM activity
 WHERE repo_name IN (SELECT repo_name FROM activity WHERE type = 'ReleaseEvent'
  AND repo_name < 'org2') GROUP BY 1), limits""",
    ),
    "daily_anomalies": _with(
        ACTIVITY,
        ISSUES,
        LIMITS,
        """SELECT time, events, round(e, 6) AS threshold, events > e AS is_anomaly
FROM (SELECT CAST(created_at AS DATE) AS time, count(*) AS events FROM activity GROUP BY 1), limits""",
    ),
    "data_diagnostics": _with(
        ACTIVITY,
        ISSUES,
        FORECASTS,
        f"""SELECT 'Total events' AS metric, count(*) AS value FROM activity
UNION ALL SELECT 'Total issues', count(*) FROM issue
UNION ALL SELECT 'Total forecasts', count(*) FROM forecasts
UNION ALL SELECT 'Events last 7d', count(*) FROM activity WHERE {_recent(7)}
UNION ALL SELECT 'Issues last 7d', count(*) FROM issue WHERE {_recent(7)}
UNION ALL SELECT 'Events last 30d', count(*) FROM activity WHERE {_recent(30)}
UNION ALL SELECT 'Issues last 30d', count(*) FROM issue WHERE {_recent(30)}
UNION ALL SELECT 'Closed issues with closed_at', count(*) FROM issue
  WHERE state = 'closed' AND closed_at IS NOT NULL
UNION ALL SELECT 'Merged PR events', count(*) FROM activity WHERE {MERGED}""",
    ),
    "sample_repos": _events("SELECT DISTINCT repo_name FROM activity ORDER BY 1 LIMIT 5"),
    "workflow_success_rate": _with(CI_RUNS, f"""SELECT workflow_name,
 count_if(conclusion = 'success') / count(*) AS success_rate
FROM ci_runs WHERE created_at > {CI_NOW} - INTERVAL 7 DAY GROUP BY 1"""),
    "workflow_success_rate_by_status": _with(CI_RUNS, f"""SELECT workflow_name,
 count_if(status = 'completed') / count(*) AS success_rate
FROM ci_runs WHERE created_at > {CI_NOW} - INTERVAL 3000 DAY GROUP BY 1"""),
    "flaky_tests": _with(TEST_RESULTS, _FLAKY, "SELECT * FROM flaky"),
    "flaky_tests_of_priorities": _with(
        TEST_RESULTS.replace("test_results AS", "plain_results AS"),
        """test_results AS (SELECT * REPLACE (test_name || '@' || workflow_name AS test_name)
FROM plain_results)""",
        _FLAKY,
        "SELECT * FROM flaky",
    ),
    "flaky_tests_recent": _with(TEST_RESULTS, _FLAKY, f"""SELECT test_name, repo_name,
 failure_rate, severity FROM flaky WHERE last_detected > {CI_NOW} - INTERVAL 30 DAY"""),
    "release_frequency": _events(f"""SELECT CAST(created_at AS DATE) AS date,
 count(*) AS deployments FROM activity
WHERE type = 'ReleaseEvent' AND created_at > {NOW} - INTERVAL 90 DAY GROUP BY 1"""),
    "forecast_training_series": _events("""SELECT repo_name AS repository,
 CAST(created_at AS DATE) AS ds, count(*) AS y FROM activity GROUP BY 1, 2"""),
    "forecast_repos": _with(ACTIVITY, _forecast("true", NOW), "SELECT * FROM forecast"),
    "forecast_repos_from_rollup": _with(
        ACTIVITY, _forecast("true", NOW), "SELECT * FROM forecast"
    ),
    "train_all_forecasts": _with(ACTIVITY, _forecast("true", NOW), "SELECT * FROM forecast"),
    "forecast_repos_seasonal": _with(
        CI_RUNS, _forecast("true", CI_NOW, table="ci_runs"), "SELECT * FROM forecast"
    ),
    "forecast_repos_yearly": _with(
        ACTIVITY, _forecast("true", NOW, yearly="true"), "SELECT * FROM forecast"
    ),
    "forecast_repos_plain": _with(
        CI_RUNS,
        _forecast("true", CI_NOW, table="ci_runs", yearly="false"),
        "SELECT * FROM forecast",
    ),
    "forecast_backtest": _with(
        ACTIVITY,
        _forecast(
            "created_at < TIMESTAMP '2024-01-24 00:00:00'",
            NOW,
            dates="CAST(DATE '2024-01-23' + CAST(i AS INT) AS DATE)",
        ),
        """SELECT f.repository, count(y) AS days, avg(abs(y - predicted_events)) AS mae,
 count_if(y BETWEEN lower_bound AND upper_bound) / nullif(count(y), 0) AS coverage
FROM forecast f LEFT JOIN (SELECT repo_name AS repository, CAST(created_at AS DATE) AS d,
  count(*) AS y FROM activity GROUP BY 1, 2) a
ON a.repository = f.repository AND a.d = f.forecast_date
WHERE f.forecast_date <= DATE '2024-01-31'
GROUP BY 1""",
    ),
    "forecast_additive": _recursive(
        ACTIVITY, additive_sql.fitted("activity"), additive_sql.forecast(NOW), "SELECT * FROM forecast"
    ),
    "forecast_additive_yearly": _recursive(
        CI_RUNS, additive_sql.fitted("ci_runs"), additive_sql.forecast(CI_NOW), "SELECT * FROM forecast"
    ),
    "forecast_additive_changes": _recursive(
        CI_RUNS, additive_sql.fitted("ci_runs"), additive_sql.changes()
    ),
    "forecast_additive_backtest": _recursive(
        ACTIVITY,
        additive_sql.fitted("activity", "ds < DATE '2024-01-24'"),
        additive_sql.forecast(NOW, "CAST(DATE '2024-01-23' + CAST(i AS INT) AS DATE)"),
        """SELECT f.repository, count(y) AS days, avg(abs(y - predicted_events)) AS mae,
 count_if(y BETWEEN lower_bound AND upper_bound) / nullif(count(y), 0) AS coverage
FROM forecast f LEFT JOIN day a ON a.repository = f.repository AND a.ds = f.forecast_date
WHERE f.forecast_date <= DATE '2024-01-31' GROUP BY 1""",
    ),
    "forecast_lookup": _with(ACTIVITY, FORECASTS, """SELECT repository, forecast_date,
 predicted_events AS predicted FROM forecasts"""),
    "forecast_series": _with(ACTIVITY, FORECASTS, """SELECT forecast_date AS time,
 predicted_events FROM forecasts WHERE repository = 'org0/repo0'"""),
    "forecast_vs_actual_long": _with(ACTIVITY, FORECASTS, f"""SELECT CAST(created_at AS DATE) AS time,
 'actual' AS metric, count(*)::DOUBLE AS value FROM activity WHERE {_recent(30)} GROUP BY 1
UNION ALL SELECT forecast_date, 'predicted', predicted_events FROM forecasts
WHERE forecast_date >= {NOW} - INTERVAL 30 DAY"""),
    "forecast_vs_actual_wide": _with(ACTIVITY, FORECASTS, f"""SELECT
 coalesce(a.repository, f.repository) AS repository, coalesce(a.time, f.forecast_date) AS time,
 actual, predicted_events AS predicted, lower_bound, upper_bound
FROM (SELECT repo_name AS repository, CAST(created_at AS DATE) AS time, count(*) AS actual
      FROM activity WHERE {_recent(30)} GROUP BY 1, 2) a
FULL OUTER JOIN (SELECT * FROM forecasts WHERE forecast_date >= {NOW} - INTERVAL 30 DAY) f
ON f.repository = a.repository AND f.forecast_date = a.time"""),
    "classifier_training_rows": _with(
        ISSUES, _TRAINING, "SELECT id, label, length(text) AS text_length FROM rows_"
    ),
    "valid_classes": _with(ISSUES, _TRAINING, """SELECT label, count(*) AS count FROM rows_
GROUP BY 1 HAVING count(*) >= 30"""),
    "train_test_split": _with(ISSUES, _TRAINING, """SELECT id, label,
 CASE WHEN substr(md5(CAST(id AS VARCHAR) || ':42'), 1, 2) < '33' THEN 'test' ELSE 'train' END AS split
FROM rows_ WHERE label IN (SELECT label FROM rows_ GROUP BY 1 HAVING count(*) >= 30)"""),
    "classification_report": """WITH r AS (
 SELECT CASE quality WHEN 1 THEN 'keep' ELSE 'drop' END AS label,
        CASE toxic WHEN 0 THEN 'keep' ELSE 'drop' END AS prediction FROM labels),
c AS (SELECT class, count_if(label = class AND prediction = class)::DOUBLE AS tp,
   count(*) FILTER (WHERE label = class) AS support, count(*) FILTER (WHERE prediction = class) AS predicted
 FROM r, (SELECT label AS class FROM r UNION SELECT prediction FROM r) GROUP BY 1),
p AS (SELECT class, CASE WHEN predicted = 0 THEN 0.0 ELSE tp / predicted END AS precision,
   CASE WHEN support = 0 THEN 0.0 ELSE tp / support END AS recall,
   CASE WHEN support + predicted = 0 THEN 0.0 ELSE 2 * tp / (support + predicted) END AS f1_score,
   support, tp FROM c),
a AS (SELECT class, precision, recall, f1_score, support FROM p
 UNION ALL SELECT 'accuracy', NULL, NULL, sum(tp) / sum(support), sum(support)::BIGINT FROM p
 UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1_score), sum(support)::BIGINT FROM p
 UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support),
   sum(recall * support) / sum(support), sum(f1_score * support) / sum(support),
   sum(support)::BIGINT FROM p)
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall,
 round(f1_score, 6) AS f1_score, support FROM a""",
    "unscored_issues": _with(ISSUES, PREDICTIONS, """SELECT id, title FROM issue i
WHERE NOT EXISTS (SELECT 1 FROM predictions p WHERE p.issue_id = i.id)"""),
    "ingest_events": _events(f"SELECT {EVENT_ROW} FROM activity"),
    "ingest_issues": _issues("""SELECT id, number, title, body,
 array_to_string(labels, ',') AS labels, state, created_at, closed_at, user_login, repo_name
FROM issue WHERE number % 7 <> 0"""),
    "append_events": _events("""SELECT CAST(strftime(created_at, '%Y%m') AS BIGINT) AS event_month,
 count(*) AS events, count(*) AS stamped FROM activity GROUP BY 1"""),
    "export_table": _events(f"SELECT {EVENT_ROW} FROM activity"),
    "backup_restore": _events(f"SELECT {EVENT_ROW} FROM activity"),
    "retention_keep": _events(f"""SELECT {EVENT_ROW} FROM activity
WHERE NOT created_at < TIMESTAMP '2024-04-15 12:00:00' - INTERVAL 90 DAY"""),
    "retention_in_place": _events(f"""SELECT {EVENT_ROW} FROM activity
WHERE NOT created_at < TIMESTAMP '2024-04-15 12:00:00' - INTERVAL 90 DAY"""),
    "compact_events": _events(f"SELECT {EVENT_ROW} FROM activity"),
    "sql_params": _events("""SELECT repo_name, count(*) AS events FROM activity
WHERE type = 'PushEvent' AND created_at >= TIMESTAMP '2024-01-01 00:00:00' GROUP BY 1"""),
    "daily_rollup_reference": _events("""SELECT date, repo_name, event_type,
 CAST(sum(event_count) AS BIGINT) AS event_count, CAST(sum(unique_users) AS BIGINT) AS unique_users
FROM (SELECT CAST(id AS BIGINT) % 4 AS load_id, CAST(created_at AS DATE) AS date, repo_name,
   type AS event_type, count(*) AS event_count, count(DISTINCT actor_login) AS unique_users
  FROM activity GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3"""),
    "daily_rollup": _events(_ROLLUP_EXACT),
    "collapse_rollup": _events(_ROLLUP_EXACT),
    "daily_activity_from_rollup": _events(f"""SELECT * FROM ({_DAILY})
QUALIFY row_number() OVER (PARTITION BY repo_name ORDER BY date DESC) <= 30"""),
    "detailed_analytics_from_rollup": _events(f"""SELECT repo_name,
 CAST(created_at AS DATE) AS date, type AS event_type, count(*) AS event_count,
 count(DISTINCT actor_login) AS unique_users
FROM activity WHERE CAST(created_at AS DATE) >= {NOW} - INTERVAL 30 DAY GROUP BY 1, 2, 3"""),
    "stream_rollup": _events(_ROLLUP_EXACT),
    "stream_ingest": _events(f"SELECT {EVENT_ROW} FROM activity"),
    "stream_daily_counts": _events("""SELECT CAST(created_at AS DATE) AS date, repo_name,
 type AS event_type, count(*) AS event_count FROM activity GROUP BY 1, 2, 3"""),
    "dedup_events": _events(f"SELECT {EVENT_ROW} FROM activity"),
    "stream_dedup": _events(f"SELECT {EVENT_ROW} FROM activity"),
    "stream_dedup_rollup": _events(_ROLLUP_EXACT),
    "rejected_events": _events("""SELECT CASE CAST(id AS BIGINT) % 50 WHEN 0 THEN 'page'
  WHEN 1 THEN 'id' WHEN 2 THEN 'actor' WHEN 3 THEN 'created_at' ELSE 'loaded' END AS outcome,
 count(*) AS events FROM activity GROUP BY 1"""),
    "rejected_issues": _issues("""SELECT CASE WHEN number % 10 = 1 THEN 'json'
  WHEN number % 10 = 2 THEN 'id' WHEN number % 10 = 3 THEN 'created_at' ELSE 'loaded' END AS outcome,
 count(*) AS issues FROM issue WHERE number % 7 <> 0 OR number % 10 = 1 GROUP BY 1"""),
    "store_issues": _issues("""SELECT id, number, title, body,
 array_to_string(labels, ',') AS labels, state, created_at, closed_at, user_login, repo_name
FROM issue WHERE number % 7 <> 0"""),
    "export_issues": _issues("""SELECT repo_name, state, count(*) AS issues,
 count(closed_at) AS with_end FROM issue GROUP BY 1, 2"""),
    "export_forecasts": _with(ACTIVITY, _forecast("true", NOW), """SELECT repository,
 count(*) AS days, sum(predicted_events) AS events FROM forecast GROUP BY 1"""),
    "export_predictions": _with(PREDICTIONS, """SELECT issue_id, predicted_label,
 CAST(1.0 AS DOUBLE) AS confidence, DATE '2024-01-31' AS prediction_date FROM predictions"""),
    "backup_restore_by_load": _events(f"SELECT {EVENT_ROW} FROM activity"),
    "compact_then_replay": _events(f"SELECT {EVENT_ROW} FROM activity"),
    "delete_by_key": _events(f"SELECT {EVENT_ROW} FROM activity WHERE repo_name <> 'org0/repo0'"),
    "score_issues_checked": _with(ISSUES, PREDICTIONS, """SELECT id AS issue_id,
 true AS valid_label, true AS valid_confidence, DATE '2024-01-31' AS prediction_date FROM issue i
WHERE NOT EXISTS (SELECT 1 FROM predictions p WHERE p.issue_id = i.id)"""),
    "classify_texts_checked": _issues("SELECT id, true AS valid FROM issue"),
    "train_classifier": _issues("""SELECT count(*) AS support, true AS good
FROM (SELECT id, labels[1] AS label, count(*) OVER (PARTITION BY labels[1]) AS n
  FROM issue WHERE len(labels) > 0)
WHERE n >= 30 AND substr(md5(CAST(id AS VARCHAR) || ':42'), 1, 2) < '33'"""),
}

# Queries that reach the rows of another by other means: from the rollup, from the state of a
# stream, from tables that were compacted, restored or merged on read.
ORACLES |= {
    name: ORACLES[same]
    for name, same in {
        "developer_velocity_from_rollup": "developer_velocity",
        "community_health_from_rollup": "community_health",
        "trending_from_rollup": "trending_repositories",
        "stream_thresholds": "dynamic_thresholds",
        "stream_health": "system_health",
        "stream_alerts": "daily_anomalies",
        "store_issues_on_read": "store_issues",
        "compact_events_then_replay": "compact_events",
        "compact_restore_replay": "compact_events",
        "delete_by_key_indexed": "delete_by_key",
    }.items()
}

ORACLES |= {
    "events_by_key": _events(
        f"SELECT {EVENT_ROW} FROM activity WHERE repo_name IN ('org0/repo0', 'org1/repo5')"
    ),
    "contributor_flow": _events(f"""SELECT repo_name,
 count(*) FILTER (a) AS before, count(*) FILTER (b) AS during, count(*) FILTER (a AND b) AS retained,
 count(*) FILTER (b AND NOT a) AS joined, count(*) FILTER (a AND NOT b) AS left
FROM (SELECT repo_name, actor_login, bool_or(created_at < {NOW} - INTERVAL 7 DAY) AS a,
  bool_or(created_at >= {NOW} - INTERVAL 7 DAY) AS b
 FROM activity WHERE created_at >= {NOW} - INTERVAL 14 DAY AND created_at < {NOW} GROUP BY 1, 2)
GROUP BY 1"""),
    "repository_stats_approx": _events("""SELECT repo_name, count(*) AS total_events,
 count(DISTINCT actor_login) AS exact_contributors, true AS within FROM activity GROUP BY 1"""),
    "event_panels": _events(f"""SELECT panel, key, count, others, rank FROM (
SELECT 'types' AS panel, type AS key, count(*) AS count, CAST(NULL AS BIGINT) AS others,
  CAST(NULL AS INT) AS rank FROM ranged GROUP BY type
UNION ALL SELECT 'days', strftime(created_at, '%Y-%m-%d'), count(*), NULL, NULL FROM ranged GROUP BY 2
UNION ALL SELECT 'hours', strftime(created_at, '%Y-%m-%d %H:00:00'), count(*), NULL, NULL
 FROM ranged GROUP BY 2
UNION ALL SELECT * FROM (SELECT 'repositories', repo_name, count(*), count(DISTINCT actor_login),
  CAST(row_number() OVER (ORDER BY count(*) DESC, repo_name) AS INT) AS r FROM ranged
  GROUP BY repo_name) WHERE r <= 10
UNION ALL SELECT * FROM (SELECT 'contributors', actor_login, count(*), count(DISTINCT repo_name),
  CAST(row_number() OVER (ORDER BY count(*) DESC, actor_login) AS INT) AS r FROM ranged
  GROUP BY actor_login) WHERE r <= 15)""").replace("FROM ranged", f"""FROM (SELECT * FROM activity
  WHERE created_at BETWEEN TIMESTAMP '2024-01-01 00:00:00' AND {NOW})"""),
    "issue_panels": _issues(f"""SELECT panel, repo_name, key, count, rank FROM (
SELECT 'states' AS panel, repo_name, state AS key, count(*) AS count, CAST(NULL AS INT) AS rank
 FROM ranged GROUP BY repo_name, state
UNION ALL SELECT 'days', repo_name, strftime(created_at, '%Y-%m-%d') AS day, count(*), NULL
 FROM ranged GROUP BY repo_name, day
UNION ALL SELECT * FROM (SELECT 'labels', NULL, label, count(*),
  CAST(row_number() OVER (ORDER BY count(*) DESC, label) AS INT) AS r
  FROM (SELECT unnest(labels) AS label FROM ranged) GROUP BY label) WHERE r <= 10)""").replace(
        "FROM ranged", f"""FROM (SELECT * FROM issue
  WHERE created_at BETWEEN TIMESTAMP '2024-01-01 00:00:00' AND {NOW})"""),
    "repository_lookback": _events("""SELECT repo_name, count(*) FILTER (
  created_at < TIMESTAMP '2024-01-15 00:00:00' AND repo_name <> 'org0/repo0') AS first_load,
 count(*) AS events, max(created_at) AS mark, CAST(count(*) FILTER (
  created_at < TIMESTAMP '2024-01-15 00:00:00' AND repo_name = 'org0/repo0') > 0 AS BIGINT)
  AS held_back
FROM activity GROUP BY 1"""),
    "table_rows": " UNION ALL ".join(
        f"SELECT '{name}' AS table, count(*) AS rows FROM {name}"
        for name in ("events", "documents", "labels", "orders", "lineitem")
    ),
    "created_tables": _with(ACTIVITY, ISSUES, """SELECT 'events' AS table, count(*) AS rows,
 count(DISTINCT id) AS total FROM activity
UNION ALL SELECT 'daily_summary', count(*), CAST(sum(n) AS BIGINT) FROM (SELECT count(*) AS n
 FROM activity GROUP BY CAST(created_at AS DATE), repo_name, type)
UNION ALL SELECT 'forecasts', 30 * count(DISTINCT repo_name), count(DISTINCT repo_name) FROM activity
UNION ALL SELECT 'issues', count(*), count(DISTINCT id) FROM issue WHERE number % 7 <> 0
UNION ALL SELECT 'releases', 0, 0"""),
}

ORACLES |= {
    "lead_time_hours_parsed": ORACLES["lead_time_hours_by_repo"],
    "metric_bands_parsed": ORACLES["metric_bands"],
    "payload_members": _events("""SELECT type, payload ->> '$.action' AS action, count(*) AS events,
 CAST(sum(CAST(payload ->> '$.size' AS BIGINT)) AS BIGINT) AS total_size,
 count(payload ->> '$.pull_request.merged_at') AS merge_times FROM activity GROUP BY 1, 2"""),
    "rejected_payloads": _events("""SELECT CAST(strftime(created_at, '%Y%m') AS BIGINT) AS event_month,
 CASE CAST(id AS BIGINT) % 50 WHEN 0 THEN 'json' WHEN 1 THEN 'object' WHEN 2 THEN 'json' END AS error,
 count(*) AS events, count(*) FILTER (WHERE CAST(id AS BIGINT) % 50 <> 3) AS texts
FROM activity GROUP BY 1, 2"""),
    "unscored_by_bucket": ORACLES["unscored_issues"],
}
