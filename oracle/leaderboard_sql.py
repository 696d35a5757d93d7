"""DuckDB oracles for leaderboard queries, built on the evaluate_models oracle."""

from __future__ import annotations

from oracle import queries as q
from oracle.queries import r6

METRICS = ["auc_roc", "auc_pr", "precision", "recall", "f1_score", "gini", "psi", "traffic_light_green",
           "overall_score"]
LONG_METRICS = METRICS + ["accuracy", "ks_statistic"]


def _em() -> str:
    return f"em AS ({q.evaluate_models()})"


def _long() -> str:
    parts = " UNION ALL ".join(f"SELECT model, split AS scope, '{m}' AS metric, {m} AS value FROM em"
                               f" WHERE {m} IS NOT NULL" for m in LONG_METRICS)
    return f"lg AS ({parts})"


def _with(*ctes: str) -> str:
    return "WITH " + ", ".join(ctes) + "\n"


def metrics_table() -> str:
    cols = ", ".join(f"max(value) FILTER (WHERE metric = '{m}') AS {m}" for m in METRICS)
    return _with(_em(), _long()) + f"SELECT model, scope, {cols} FROM lg GROUP BY model, scope"


def rank_models() -> str:
    return _with(_em(), _long()) + """SELECT *, (row_number() OVER (PARTITION BY scope, metric
                                                        ORDER BY value DESC, model))::INTEGER AS rank FROM lg"""


def best_model() -> str:
    return _with(_em(), _long()) + """SELECT scope, metric, best_model, best_value FROM (
  SELECT scope, metric, model AS best_model, max(value) OVER (PARTITION BY scope, metric) AS best_value,
         row_number() OVER (PARTITION BY scope, metric ORDER BY value DESC, model) AS rk FROM lg) WHERE rk = 1"""


def top_k_models() -> str:
    return _with(_em()) + """SELECT model, split, overall_score, rank::INTEGER AS rank FROM (
  SELECT model, split, overall_score,
         row_number() OVER (PARTITION BY split ORDER BY overall_score DESC, model) AS rank FROM em) WHERE rank <= 3"""


def family_summary() -> str:
    # best model: highest score, ties to the smallest name
    return _with(_em()) + f"""SELECT split, family, {r6('avg(overall_score)')} AS mean_score,
       first(model ORDER BY overall_score DESC, model) AS best_model, max(overall_score) AS best_score,
       count(*) AS n_models
FROM em JOIN (VALUES ('model_a', 'Linear'), ('model_b', 'Noise'), ('model_c', 'Linear'), ('model_d', 'Calibrated'))
     f(model, family) USING (model)
GROUP BY split, family"""


def threshold_status() -> str:
    return _with(_em()) + """SELECT model, split, auc_roc, psi, traffic_light_green,
  CASE WHEN auc_roc >= 0.75 THEN 'excellent' WHEN auc_roc >= 0.65 THEN 'acceptable' ELSE 'insufficient' END AS auc_status,
  CASE WHEN psi IS NULL THEN NULL WHEN psi <= 0.05 THEN 'stable' WHEN psi <= 0.10 THEN 'warning' ELSE 'unstable' END
    AS psi_status,
  CASE WHEN traffic_light_green >= 0.8 THEN 'good' ELSE 'insufficient' END AS green_status
FROM em"""


def threshold_compliance() -> str:
    return _with(_em()) + f"""SELECT split, count(*) AS n_models,
  count(*) FILTER (WHERE auc_roc >= 0.65) AS auc_ok, count(*) FILTER (WHERE psi <= 0.10) AS psi_ok,
  count(*) FILTER (WHERE auc_roc >= 0.65 AND psi <= 0.10) AS both_ok,
  {r6('count(*) FILTER (WHERE auc_roc >= 0.65) / count(*) * 100.0')} AS auc_ok_pct,
  {r6('count(*) FILTER (WHERE psi <= 0.10) / count(*) * 100.0')} AS psi_ok_pct,
  {r6('count(*) FILTER (WHERE auc_roc >= 0.65 AND psi <= 0.10) / count(*) * 100.0')} AS both_ok_pct
FROM em GROUP BY split"""


def score_summary() -> str:
    return _with(_em()) + f"""SELECT split, count(*) AS n_models, {r6('max(overall_score)')} AS max_score,
  {r6('min(overall_score)')} AS min_score, {r6('avg(overall_score)')} AS mean_score,
  {r6('stddev_samp(overall_score)')} AS std_score
FROM em GROUP BY split"""


def metric_correlations() -> str:
    pairs = [(a, b) for i, a in enumerate(METRICS) for b in METRICS[i + 1:]]
    rows = " UNION ALL ".join(
        f"SELECT split, '{a}' AS metric1, '{b}' AS metric2, corr({a}, {b}) AS r FROM em GROUP BY split"
        for a, b in pairs)
    return _with(_em(), f"pc AS ({rows})") + f"""SELECT split, metric1, metric2, {r6('r')} AS correlation,
       rank::INTEGER AS rank FROM (
  SELECT split, metric1, metric2, CASE WHEN isnan(r) THEN NULL ELSE r END AS r,
         row_number() OVER (PARTITION BY split ORDER BY abs({r6('CASE WHEN isnan(r) THEN NULL ELSE r END')}) DESC NULLS LAST,
                            metric1, metric2) AS rank
  FROM pc) WHERE rank <= 10"""


def ensemble_top_k() -> str:
    inner = q.evaluate_models()
    fixtures, _, _ = inner.partition("\nSELECT *, ")
    return fixtures + f""",
em2 AS ({inner.replace('WITH ', 'SELECT * FROM (WITH ', 1)})),
top AS (SELECT model FROM (SELECT model, row_number() OVER (ORDER BY overall_score DESC, model) AS rk
                           FROM em2 WHERE split = 'test') WHERE rk <= 3)
SELECT split, loan_id, {r6('avg(p)')} AS p, max(y) AS y, count(*) AS n_models
FROM scored_split WHERE model IN (SELECT model FROM top) GROUP BY split, loan_id"""


def overall_score() -> str:
    return _with(_em()) + """SELECT model, split, auc_roc, f1_score, gini, traffic_light_green, psi_stability,
       overall_score FROM em"""


def all_sql() -> dict[str, str]:
    return {
        "overall_score": overall_score(),
        "metrics_table": metrics_table(), "rank_models": rank_models(), "best_model": best_model(),
        "top_k_models": top_k_models(), "family_summary": family_summary(),
        "threshold_status": threshold_status(), "threshold_compliance": threshold_compliance(),
        "score_summary": score_summary(), "metric_correlations": metric_correlations(),
        "ensemble_top_k": ensemble_top_k(),
    }
