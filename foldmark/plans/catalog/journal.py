"""Journal analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldmark.operators import journal as ops
from foldmark.plans import fixtures as fx
from foldmark.plans.catalog.base import query, rounded
from foldmark.plans.catalog.lookups import NORMAL, RATES

_WITH = f"WITH {fx.JOURNAL}"


@query("j_event_counts", f"{_WITH} SELECT event, count(*) AS n FROM journal GROUP BY event")
def j_event_counts(spark, folder):
    return ops.event_counts(fx.journal(spark, folder))


@query("j_filter_noise", f"""{_WITH} SELECT run, event, t, iter FROM journal
WHERE event NOT IN ('TOOL_CALL', 'TOOL_RESULT', 'TOKEN_USAGE')""")
def j_filter_noise(spark, folder):
    return ops.without_noise(fx.journal(spark, folder)).select("run", "event", "t", "iter")


@query("j_strategic_tail", f"""{_WITH}, s AS (SELECT run, event, t, iter,
  row_number() OVER (PARTITION BY run ORDER BY t DESC, iter DESC, event DESC) AS place FROM journal
  WHERE event IN ('BASELINE', 'PROPOSE', 'RESULT', 'ACCEPT', 'EVAL_ERROR', 'AGENT_ERROR', 'REACT_TIMEOUT'))
SELECT run, event, t, iter, CAST(place AS INTEGER) AS place FROM s WHERE place <= 32""")
def j_strategic_tail(spark, folder):
    return ops.strategic_tail(fx.journal(spark, folder), ["t", "iter", "event"]).select(
        "run", "event", "t", "iter", "place")


@query("j_accepts", f"""{_WITH}, base AS (
  SELECT run, arg_min(score, t || lpad(CAST(iter + 1 AS VARCHAR), 9, '0')) AS baseline, min(t) AS started
  FROM journal WHERE event = 'BASELINE' GROUP BY run)
SELECT a.run, a.iter, date_diff('second', CAST(started AS TIMESTAMP), CAST(a.t AS TIMESTAMP)) AS elapsed_sec,
  round(a.score, 6) AS score, round(a.score - baseline, 6) AS gain, r.n_features, p.msg AS hypothesis
FROM journal a LEFT JOIN journal r ON r.event = 'RESULT' AND r.run = a.run AND r.iter = a.iter
LEFT JOIN journal p ON p.event = 'PROPOSE' AND p.run = a.run AND p.iter = a.iter
LEFT JOIN base ON base.run = a.run WHERE a.event = 'ACCEPT'""")
def j_accepts(spark, folder):
    return rounded(ops.accepts(fx.journal(spark, folder)))


# the incumbent walk as a recursive query: each step jumps to the next accepted row
_REPLAY = f"""WITH RECURSIVE {fx.JOURNAL}, v AS (
  SELECT run, iter, score + 0.1 * greatest(std, 1e-9) AS bar, score,
    row_number() OVER (PARTITION BY run ORDER BY t, iter) AS i
  FROM journal WHERE (event = 'RESULT' OR event = 'BASELINE') AND ok),
firsts AS (SELECT * FROM v WHERE i = 1),
walk AS (
  SELECT run, iter, i, bar FROM firsts
  UNION ALL
  SELECT run, iter, i, bar FROM (
    SELECT v.run, v.iter, v.i, v.bar, row_number() OVER (PARTITION BY v.run ORDER BY v.i) AS k
    FROM walk w JOIN v ON v.run = w.run AND v.i > w.i AND v.score > w.bar) WHERE k = 1)
SELECT run, iter, true AS accepted FROM walk WHERE iter >= 0"""


@query("j_replay", _REPLAY)
def j_replay(spark, folder):
    return ops.replay(fx.journal(spark, folder))


@query("j_tool_calls", f"""{_WITH}, c AS (SELECT name, run, iter, count(*) AS n FROM journal
  WHERE event = 'TOOL_CALL' GROUP BY ALL)
SELECT name, CAST(sum(n) AS BIGINT) AS calls, round(avg(n), 6) AS avg_per_iter, max(n) AS max_per_iter
FROM c GROUP BY name""")
def j_tool_calls(spark, folder):
    return rounded(ops.tool_calls(fx.journal(spark, folder)))


def _theme_sql() -> str:
    arms = " ".join(f"WHEN regexp_matches(lower(coalesce(msg, '')), '{p}') THEN '{n}'"
                    for p, n in ops.THEME_RULES)
    return f"""{_WITH} SELECT CASE {arms} ELSE 'other' END AS theme, count(*) AS n
    FROM journal WHERE event = 'PROPOSE' GROUP BY 1"""


@query("j_themes", _theme_sql())
def j_themes(spark, folder):
    return ops.themes(fx.journal(spark, folder))


@query("j_repeats", f"""{_WITH} SELECT run,
  trim(regexp_replace(lower(coalesce(msg, '')), '[^a-z0-9]+', ' ', 'g')) AS hypothesis,
  count(*) AS n, min(iter) AS first_iter FROM journal WHERE event = 'PROPOSE'
GROUP BY 1, 2 HAVING count(*) > 1 OR hypothesis = ''""")
def j_repeats(spark, folder):
    return ops.repeats(fx.journal(spark, folder))


@query("j_error_rate", f"""{_WITH} SELECT CAST(floor(iter / 30.0) AS BIGINT) AS band, count(*) AS n,
  round(avg(CAST(event = 'EVAL_ERROR' AS INTEGER)), 6) AS error_rate
FROM journal WHERE event IN ('RESULT', 'EVAL_ERROR') GROUP BY 1""")
def j_error_rate(spark, folder):
    return rounded(ops.error_rate(fx.journal(spark, folder)))


_USAGE = f"""{_WITH}, {RATES}, usage AS (
  SELECT run, iter, rate_model, input, output,
    round((input * rate_in + output * rate_out) / 1000000.0, 6) AS cost
  FROM (SELECT *, {NORMAL} AS rate_model FROM journal WHERE event = 'TOKEN_USAGE')
  LEFT JOIN rates USING (rate_model))"""


@query("j_cost", f"{_USAGE} SELECT run, iter, input, output, cost FROM usage")
def j_cost(spark, folder):
    return ops.usage_cost(fx.journal(spark, folder)).select("run", "iter", "input", "output", "cost")


@query("j_model_norm", f"""{_WITH} SELECT model, {NORMAL} AS rate_model, count(*) AS n
FROM journal WHERE event = 'TOKEN_USAGE' GROUP BY ALL""")
def j_model_norm(spark, folder):
    usage = fx.journal(spark, folder).filter(F.col("event") == "TOKEN_USAGE")
    return usage.groupBy("model", ops.normal_model(F.col("model")).alias("rate_model")).agg(
        F.count(F.lit(1)).alias("n"))


@query("j_usage_totals", f"""{_USAGE} SELECT run, rate_model, CAST(sum(input) AS BIGINT) AS input,
  CAST(sum(output) AS BIGINT) AS output, CAST(sum(input + output) AS BIGINT) AS total,
  round(sum(cost), 6) AS cost FROM usage GROUP BY ALL""")
def j_usage_totals(spark, folder):
    return rounded(ops.usage_totals(fx.journal(spark, folder)))


@query("j_cost_per_accept", f"""{_USAGE}, a AS (SELECT run, count(*) AS accepts FROM journal
  WHERE event = 'ACCEPT' GROUP BY run), u AS (SELECT run, sum(cost) AS cost FROM usage GROUP BY run)
SELECT run, round(cost, 6) AS cost, coalesce(accepts, 0) AS accepts,
  round(cost / accepts, 8) AS cost_per_accept FROM u LEFT JOIN a USING (run)""")
def j_cost_per_accept(spark, folder):
    return rounded(ops.cost_per_accept(fx.journal(spark, folder)), 6, cost_per_accept=8)
