"""SQL of the additive forecast: the same terms, and the normal equations solved by
elimination, one column in each step of a recursion."""

from __future__ import annotations

CHANGES, RANGE, WEEKLY, YEARLY = 25, 0.8, 3, 10
P = 2 + CHANGES + 2 * (WEEKLY + YEARLY)


def _waves(days: str, period: float, order: int, used: str) -> str:
    parts = [
        f"list_transform(range(1, {order + 1}), lambda k: CASE WHEN {used} THEN"
        f" {wave}(2 * pi() * {days} * k / {period}) ELSE 0.0 END)"
        for wave in ("sin", "cos")
    ]
    return " || ".join(parts)


def _terms(date: str) -> str:
    """The terms of a day of a repository, given d0 and d1."""
    t = f"(date_diff('day', d0, {date}) / CAST(greatest(date_diff('day', d0, d1), 1) AS DOUBLE))"
    days = f"CAST(date_diff('day', DATE '1970-01-01', {date}) AS DOUBLE)"
    span = "date_diff('day', d0, d1)"
    bends = (
        f"list_transform(range(1, {CHANGES + 1}),"
        f" lambda j: greatest({t} - {RANGE} * j / {CHANGES}, 0.0))"
    )
    return (
        f"([1.0, {t}] || {bends} || {_waves(days, 7.0, WEEKLY, f'{span} >= 14')} || "
        f"{_waves(days, 365.25, YEARLY, f'{span} >= 730')})"
    )


def fitted(table: str, source: str = "true") -> str:
    """CTEs ending in ``fit`` (repository, d0, d1, top, beta, sigma) and ``day`` (repository,
    ds, y)."""
    penalty = f"CASE WHEN i <= 2 THEN 1e-6 WHEN i <= {2 + CHANGES} THEN 0.1 ELSE 0.01 END"
    return f"""day AS MATERIALIZED (
 SELECT repo_name AS repository, CAST(created_at AS DATE) AS ds, CAST(count(*) AS DOUBLE) AS y
 FROM {table} GROUP BY 1, 2),
used AS (SELECT * FROM day WHERE {source}),
span AS (SELECT repository, min(ds) AS d0, max(ds) AS d1, max(y) AS top FROM used GROUP BY 1),
x AS MATERIALIZED (SELECT repository, ds, y / top AS y, {_terms("ds")} AS f
 FROM used JOIN span USING (repository)),
col AS MATERIALIZED (SELECT repository, i, list(CASE WHEN i <= {P} THEN f[i] ELSE y END ORDER BY ds) AS c
 FROM x, range(1, {P + 2}) AS s(i) GROUP BY 1, 2),
cell AS (SELECT a.repository, a.i, b.i AS j,
  list_inner_product(a.c, b.c) + CASE WHEN a.i = b.i THEN {penalty.replace("i <=", "a.i <=")} ELSE 0 END AS v
 FROM col a JOIN col b ON a.repository = b.repository AND a.i <= {P}),
line AS (SELECT repository, i, list(v ORDER BY j) AS r FROM cell GROUP BY 1, 2),
step(repository, k, m) AS (
 SELECT repository, 1, list(r ORDER BY i) FROM line GROUP BY 1
 UNION ALL
 SELECT repository, k + 1, list_transform(m, lambda r, i: CASE WHEN i = k
   THEN list_transform(r, lambda v: v / m[k][k])
   ELSE list_transform(r, lambda v, c: v - r[k] * m[k][c] / m[k][k]) END)
 FROM step WHERE k <= {P}),
beta AS (SELECT repository, list_transform(m, lambda r: r[{P + 1}]) AS beta FROM step WHERE k = {P + 1}),
fit AS MATERIALIZED (SELECT repository, any_value(d0) AS d0, any_value(d1) AS d1,
  any_value(top) AS top, any_value(beta) AS beta,
  sqrt(avg((y - list_inner_product(f, beta)) * (y - list_inner_product(f, beta)))) AS sigma
 FROM x JOIN beta USING (repository) JOIN span USING (repository) GROUP BY 1)"""


def forecast(now: str, dates: str = "CAST(d1 + CAST(i AS INT) AS DATE)") -> str:
    """CTEs ending in ``forecast``, the rows for the dates d1 + 1 .. 30, or the given ones."""
    ahead = "greatest(date_diff('day', d0, date) / CAST(greatest(date_diff('day', d0, d1), 1) AS DOUBLE) - 1, 0.0)"
    return f"""ahead AS (SELECT *, {dates} AS date FROM fit, range(1, 31) AS s(i)),
said AS (SELECT repository, date AS forecast_date, top * list_inner_product({_terms("date")}, beta) AS yhat,
  top * 1.959964 * sqrt(sigma * sigma + {2 * CHANGES} / 3.0
   * power(list_avg(list_transform(beta[3:{2 + CHANGES}], lambda b: abs(b))), 2) * power({ahead}, 3)) AS half
 FROM ahead),
forecast AS (SELECT repository, forecast_date,
  floor(round(greatest(0.0, yhat), 6)) AS predicted_events,
  floor(round(greatest(0.0, yhat - half), 6)) AS lower_bound,
  floor(round(greatest(0.0, yhat + half), 6)) AS upper_bound,
  'additive' AS model_type, CAST({now} AS DATE) AS training_date FROM said)"""


def changes() -> str:
    """The change points of ``fit`` and by how much the slope changes there."""
    return f"""SELECT repository,
 CAST(d0 + CAST(floor({RANGE} * j / {CHANGES} * greatest(date_diff('day', d0, d1), 1)) AS INT) AS DATE) AS change_date,
 round(beta[CAST(j AS INT) + 2] * top / greatest(date_diff('day', d0, d1), 1), 6) AS slope_change
FROM fit, range(1, {CHANGES + 1}) AS s(j)"""
