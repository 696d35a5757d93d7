"""Brute-force oracle for the exact kNN kernel (all minority pairs; fine at oracle scale)."""

from __future__ import annotations

from oracle.fixtures_sql import with_fixtures
from oracle.queries import evaluate_models, r6


def knn_minority() -> str:
    d = ("sqrt((a.n_orders - b.n_orders) * (a.n_orders - b.n_orders)"
         " + (a.sum_amount - b.sum_amount) * (a.sum_amount - b.sum_amount)"
         " + (a.avg_amount - b.avg_amount) * (a.avg_amount - b.avg_amount)"
         " + (a.c_nationkey - b.c_nationkey) * (a.c_nationkey - b.c_nationkey))")
    return with_fixtures("imbalanced") + f""",
m AS (SELECT * FROM imbalanced WHERE target = 1),
p AS (SELECT a.customer_id AS id, b.customer_id AS nbr_id, {d} AS dist
      FROM m a JOIN m b ON a.customer_id <> b.customer_id)
SELECT id, nbr_rank::INTEGER AS nbr_rank, {r6('dist')} AS dist FROM (
  SELECT id, dist, row_number() OVER (PARTITION BY id ORDER BY dist, nbr_id) AS nbr_rank FROM p)
WHERE nbr_rank <= 5"""


def mix_quotas() -> str:
    """Quotas by rounding; the training share of each class is rounded first."""
    return with_fixtures("imbalanced") + """,
t AS (SELECT sum(n)::BIGINT AS n FROM (SELECT floor(count(*) * 0.7::DOUBLE + 0.5::DOUBLE) AS n FROM imbalanced GROUP BY target)),
m AS (SELECT * FROM (VALUES ('real70_synth30', 0.7::DOUBLE, 0.3::DOUBLE), ('real50_synth50', 0.5, 0.5),
                            ('real30_synth70', 0.3, 0.7), ('real0_synth100', 0.0, 1.0)) AS x(strategy, a, b))
SELECT * FROM (SELECT strategy, 'real' AS origin, round_even(a * n, 0)::BIGINT AS n FROM m, t
               UNION ALL SELECT strategy, 'synthetic', round_even(b * n, 0)::BIGINT FROM m, t) WHERE n > 0"""


def smote_totals() -> str:
    return with_fixtures("imbalanced") + """,
c AS (SELECT target, count(*)::BIGINT AS n FROM imbalanced GROUP BY target)
SELECT target, 'real' AS origin, n FROM c
UNION ALL SELECT target, 'new', (SELECT max(n) FROM c) - n FROM c WHERE n < (SELECT max(n) FROM c) AND n > 1"""


def strategy_rank() -> str:
    return f"""WITH w AS ({evaluate_models()}), s AS (
  SELECT t.model AS generator, t.model, q.overall_score AS quality_score, t.auc_roc, t.psi,
         CASE WHEN t.psi IS NULL THEN 0.0 ELSE 1.0 - least(1.0, t.psi / 0.10::DOUBLE) END AS stability,
         coalesce(t.auc_roc >= 0.65 AND t.psi <= 0.10 AND t.ks_statistic >= 0.05, false) AS passes_gates
  FROM w t JOIN w q ON q.model = t.model AND q.split = 'train' WHERE t.split = 'test'),
r AS (SELECT generator, model, quality_score, auc_roc, psi, {r6('stability')} AS stability,
             {r6('0.4::DOUBLE * quality_score + 0.4::DOUBLE * auc_roc + 0.2::DOUBLE * stability')} AS strategy_score, passes_gates FROM s)
SELECT *, row_number() OVER (ORDER BY strategy_score DESC, generator, model)::INTEGER AS rank FROM r"""


def all_sql() -> dict[str, str]:
    return {"knn_minority": knn_minority(), "mix_quotas": mix_quotas(), "smote_totals": smote_totals(), "strategy_rank": strategy_rank()}
