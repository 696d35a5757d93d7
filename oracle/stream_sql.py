"""Batch twin of the streaming drift monitor (stream = batch)."""

from __future__ import annotations

from oracle.queries import PSI_INNER, r6


def psi_monitor_stream() -> str:
    return f"""WITH s AS (
  SELECT ts, value / 500.0::DOUBLE AS score,
         len(list_filter({PSI_INNER}, lambda e: e < value / 500.0::DOUBLE)) AS bin FROM events),
d0 AS (SELECT min(date_trunc('day', ts)) AS d0 FROM s),
base AS (SELECT bin, count(*) / sum(count(*)) OVER () AS e FROM s, d0 WHERE ts < d0 + INTERVAL 7 DAY GROUP BY bin),
c AS (SELECT date_trunc('day', ts) AS window_start, bin, count(*) AS n FROM s GROUP BY ALL),
sh AS (SELECT *, n / sum(n) OVER (PARTITION BY window_start) AS a FROM c),
w AS (SELECT window_start, sum(n) AS n_events FROM c GROUP BY window_start),
pr AS (SELECT w.window_start, w.n_events, base.bin, base.e, coalesce(sh.a, 0.0) AS a
       FROM w JOIN base ON base.e > 0 LEFT JOIN sh ON sh.window_start = w.window_start AND sh.bin = base.bin),
p AS (SELECT window_start, n_events::BIGINT AS n_events,
             sum(CASE WHEN a = 0 THEN 'inf'::DOUBLE ELSE (a - e) * ln(a / e) END) AS psi FROM pr GROUP BY ALL)
SELECT window_start, n_events, {r6('psi')} AS psi,
       CASE WHEN psi < 0.1 THEN 'stable' WHEN psi < 0.2 THEN 'warning' ELSE 'unstable' END AS psi_stability
FROM p"""


def all_sql() -> dict[str, str]:
    return {"psi_monitor_stream": psi_monitor_stream()}
