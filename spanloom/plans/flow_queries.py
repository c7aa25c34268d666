"""Streaming jobs replayed over the events there are, next to their batch twins in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import flows
from .bindings import EVENTS, shared_folder
from .registry import query


def _replay(t, job, mode: str = "append", **more):
    return flows.replay(job(flows.read_events(t.spark, t.sf_dir), **more), shared_folder(t), mode, t.spark)


#: The event that ends a run: a grave error. What comes after it is another life of the run.
ENDS = "kind = 'error' and tokens >= 15000"
LIVES = EVENTS + f""", lives AS (SELECT *, coalesce(sum(CASE WHEN {ENDS} THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS life FROM events_)
"""


@query("str_03_budget_alerts", LIVES + """, s AS (SELECT *, sum(tokens) OVER (PARTITION BY run_id, life ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS running FROM lives)
SELECT run_id, event_id, CAST(running AS BIGINT) AS running FROM s WHERE running >= 50000 AND running - tokens < 50000""")
def _(t):
    return _replay(t, flows.budget_alerts, limit=50_000, ends=F.expr(ENDS))


@query("str_04_live_breaker", LIVES + """, s AS (SELECT *, sum(CASE WHEN kind = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY run_id, life ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM lives),
k AS (SELECT *, row_number() OVER (PARTITION BY run_id, life, island ORDER BY ts, event_id) AS n FROM s WHERE kind = 'error') SELECT run_id, event_id, CAST(n AS BIGINT) AS failures FROM k WHERE n = 3""")
def _(t):
    return _replay(t, flows.breaker_trips, ends=F.expr(ENDS))


@query("str_05_decision_reuse", LIVES + """, x AS (SELECT *, first_value(CASE WHEN kind = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY run_id, life, props ORDER BY ts, event_id
ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reused FROM lives) SELECT run_id, event_id, reused FROM x WHERE kind = 'signup' AND reused IS NOT NULL""")
def _(t):
    return _replay(t, flows.decision_reuse, ends=F.expr(ENDS))


@query("str_06_content_dedup", LIVES + """SELECT run_id, event_id, props FROM (SELECT *, row_number() OVER (PARTITION BY run_id, life, props ORDER BY ts, event_id) AS n FROM lives) WHERE n = 1""")
def _(t):
    return _replay(t, flows.content_dedup, ends=F.expr(ENDS))


@query("str_08_orphans", EVENTS + """, e AS (SELECT run_id, event_id, kind, epoch_ms(ts) AS ms, lead(epoch_ms(ts)) OVER (PARTITION BY run_id ORDER BY epoch_ms(ts), event_id) AS nxt FROM events_)
SELECT run_id, event_id FROM e WHERE kind <> 'purchase' AND coalesce(nxt, (SELECT max(epoch_ms(ts)) FROM events_)) - ms > 3600000""")
def _(t):
    """Runs that went silent for an hour before they ended, by their last event before that."""
    return _replay(t, flows.orphans, seconds=3600, terminal="purchase")
