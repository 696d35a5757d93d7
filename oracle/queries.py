"""DuckDB oracle SQL, one entry per registered query.

The oracle deliberately uses different algorithms from the Spark side:
``quantile_cont`` for quantiles, plain ``row_number``/running-sum windows for
ranks and curves, and binomial tails as sums of ``lgamma`` pmf terms.
"""

from __future__ import annotations

from oracle.fixtures_sql import with_fixtures

def rnd(x: str, d: int) -> str:
    """Half-up rounding with the same 1e-9 nudge as the Spark side."""
    return f"round(({x}) + {1e-6 * 10.0 ** (-d)!r}, {d})"


def r6(x: str) -> str:
    return rnd(x, 6)


QCUT10 = ("[0.0::DOUBLE, 0.1::DOUBLE, 0.2::DOUBLE, 0.30000000000000004::DOUBLE, 0.4::DOUBLE, 0.5::DOUBLE,"
          " 0.6000000000000001::DOUBLE, 0.7000000000000001::DOUBLE, 0.8::DOUBLE, 0.9::DOUBLE, 1.0::DOUBLE]")


def _pmf(i: str, n: str, p: str) -> str:
    return (f"exp(lgamma({n} + 1) - lgamma({i} + 1) - lgamma({n} - {i} + 1)"
            f" + {i} * ln({p}) + ({n} - {i}) * ln(1 - {p}))")


def _cdf_le(k: str, n: str, p: str) -> str:
    """P(X <= k) as a sum of pmf terms (0 < p < 1)."""
    return (f"(CASE WHEN {k} < 0 THEN 0.0::DOUBLE WHEN {k} >= {n} THEN 1.0::DOUBLE"
            f" ELSE list_sum(list_transform(range(0, {k} + 1), lambda i: {_pmf('i', n, p)})) END)")


def _sf_ge(k: str, n: str, p: str) -> str:
    """P(X >= k) as a sum of pmf terms (0 < p < 1)."""
    return (f"(CASE WHEN {k} <= 0 THEN 1.0::DOUBLE WHEN {k} > {n} THEN 0.0::DOUBLE"
            f" ELSE list_sum(list_transform(range({k}, {n} + 1), lambda i: {_pmf('i', n, p)})) END)")


def _deciles(src: str, keys: str) -> str:
    """CTEs ``edges``, ``dec`` and ``agg`` for qcut deciles of ``src`` grouped by ``keys``."""
    return f"""
edges AS (
  SELECT {keys}, list_sort(list_distinct(quantile_cont(p, {QCUT10}))) AS e
  FROM {src} WHERE p IS NOT NULL AND NOT isnan(p) GROUP BY {keys}
),
dec AS (
  SELECT s.*, greatest(1, len(list_filter(edges.e, lambda x: x < s.p)))::INTEGER AS decile
  FROM {src} s JOIN edges USING ({keys})
  WHERE s.p IS NOT NULL AND NOT isnan(s.p)
),
agg AS (
  SELECT {keys}, decile, count(*) AS n, sum(y)::BIGINT AS k, avg(y::DOUBLE) AS rate,
         avg(p) AS pd, min(p) AS mn, max(p) AS mx
  FROM dec GROUP BY {keys}, decile
)"""


def _interval(keys: str, src: str = "agg") -> str:
    """CTE ``ci``: equal-tail 95 % bounds of Bin(n, rate) by a running pmf sum."""
    return f"""
ci_terms AS (
  SELECT {keys}, decile, n, rate, unnest(range(0, n + 1)) AS j FROM {src}
  WHERE rate > 0 AND rate < 1
),
ci_cum AS (
  SELECT {keys}, decile, j,
         sum({_pmf('j', 'n', 'rate')}) OVER (PARTITION BY {keys}, decile ORDER BY j) AS c
  FROM ci_terms
),
ci AS (
  SELECT {keys}, decile, min(j) FILTER (WHERE c >= 0.025) AS lo, min(j) FILTER (WHERE c >= 0.975) AS hi
  FROM ci_cum GROUP BY {keys}, decile
  UNION ALL
  SELECT {keys}, decile, CASE WHEN rate <= 0 THEN 0 ELSE n END, CASE WHEN rate <= 0 THEN 0 ELSE n END
  FROM {src} WHERE rate <= 0 OR rate >= 1
)"""


def tl_basel() -> str:
    keys = "model, split"
    return with_fixtures("scored_split") + "," + _deciles("scored_split", keys) + "," + _interval(keys) + f""",
pv AS (
  SELECT agg.*, 2 * least({_cdf_le('k', 'n', 'pd')}, {_sf_ge('k', 'n', 'pd')}) AS p_value,
         ci.lo, ci.hi
  FROM agg JOIN ci USING ({keys}, decile)
),
rows AS (
  SELECT {keys}, decile::VARCHAR AS Decil, printf('%.3f-%.3f', mn, mx) AS Rango_Probabilidad,
         n AS Total_Registros, k AS Cantidad_1, n - k AS Cantidad_0,
         {rnd('(n - k) / n * 100.0', 2)} AS Porcentaje_0, {rnd('k / n * 100.0', 2)} AS Porcentaje_1,
         {rnd('rate', 4)} AS Tasa_Real, {rnd('pd', 4)} AS PD_Predicha,
         {rnd('abs(rate - pd)', 4)} AS Diferencia, {rnd('p_value', 4)} AS P_Value,
         CASE WHEN p_value > 0.05 THEN 'Verde'
              WHEN rate > pd AND p_value > 0.01 THEN 'Amarillo'
              WHEN rate > pd THEN 'Rojo'
              WHEN p_value > 0.01 THEN 'Azul Claro' ELSE 'Azul Marino' END AS Color,
         CASE WHEN p_value > 0.05 THEN 'Preciso'
              WHEN rate > pd AND p_value > 0.01 THEN 'Subestimacion leve'
              WHEN rate > pd THEN 'Subestimacion fuerte'
              WHEN p_value > 0.01 THEN 'Sobrestimacion leve' ELSE 'Sobrestimacion fuerte' END AS Interpretacion,
         {rnd('lo / n', 4)} AS CI_Lower, {rnd('hi / n', 4)} AS CI_Upper
  FROM pv
)
SELECT * FROM rows
UNION ALL
SELECT {keys}, 'TOTAL', NULL, sum(Total_Registros)::BIGINT, sum(Cantidad_1)::BIGINT, sum(Cantidad_0)::BIGINT,
       {rnd('sum(Cantidad_0) / sum(Total_Registros) * 100.0', 2)},
       {rnd('sum(Cantidad_1) / sum(Total_Registros) * 100.0', 2)},
       {rnd('sum(Cantidad_1) / sum(Total_Registros)', 4)}, NULL, NULL, NULL,
       printf('V:%d A:%d R:%d AC:%d AM:%d', count(*) FILTER (WHERE Color = 'Verde'),
              count(*) FILTER (WHERE Color = 'Amarillo'), count(*) FILTER (WHERE Color = 'Rojo'),
              count(*) FILTER (WHERE Color = 'Azul Claro'), count(*) FILTER (WHERE Color = 'Azul Marino')),
       'Resumen', NULL, NULL
FROM rows GROUP BY {keys}
"""


VALID = "p IS NOT NULL AND NOT isnan(p)"
PSI_INNER = ("[0.1::DOUBLE, 0.2::DOUBLE, 0.30000000000000004::DOUBLE, 0.4::DOUBLE, 0.5::DOUBLE,"
             " 0.6000000000000001::DOUBLE, 0.7000000000000001::DOUBLE, 0.8::DOUBLE, 0.9::DOUBLE]")
LIN10 = ("[0.0::DOUBLE, 0.1::DOUBLE, 0.2::DOUBLE, 0.30000000000000004::DOUBLE, 0.4::DOUBLE, 0.5::DOUBLE,"
         " 0.6000000000000001::DOUBLE, 0.7000000000000001::DOUBLE, 0.8::DOUBLE, 0.9::DOUBLE, 1.0::DOUBLE]")


def _cls_cte(src: str, keys: str, name: str = "cls") -> str:
    return f"""
{name}_c AS (
  SELECT {keys}, count(*) AS n,
         count(*) FILTER (WHERE y = 1 AND p > 0.5) AS tp, count(*) FILTER (WHERE y = 0 AND p > 0.5) AS fp,
         count(*) FILTER (WHERE y = 1 AND p <= 0.5) AS fn, count(*) FILTER (WHERE y = 0 AND p <= 0.5) AS tn
  FROM {src} WHERE {VALID} GROUP BY {keys}
),
{name}_m AS (
  SELECT *, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS pr1,
            CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS rc1,
            CASE WHEN tn + fn = 0 THEN 0.0 ELSE tn / (tn + fn) END AS pr0,
            CASE WHEN tn + fp = 0 THEN 0.0 ELSE tn / (tn + fp) END AS rc0
  FROM {name}_c
),
{name} AS (
  SELECT {keys}, n, {r6('(tp + tn) / n')} AS accuracy,
         {r6('(pr1 * (tp + fn) + pr0 * (tn + fp)) / n')} AS precision,
         {r6('(rc1 * (tp + fn) + rc0 * (tn + fp)) / n')} AS recall,
         {r6('((CASE WHEN pr1 + rc1 = 0 THEN 0 ELSE 2 * pr1 * rc1 / (pr1 + rc1) END) * (tp + fn)'
             ' + (CASE WHEN pr0 + rc0 = 0 THEN 0 ELSE 2 * pr0 * rc0 / (pr0 + rc0) END) * (tn + fp)) / n')} AS f1_score
  FROM {name}_m
)"""


def _curve_cte(src: str, keys: str, name: str = "crv") -> str:
    """AUC by the rank-sum formula, AUC-PR by an explicit lag() trapezoid, KS."""
    return f"""
{name}_v AS (
  SELECT {keys}, p, sum(y)::BIGINT AS pos, sum(1 - y)::BIGINT AS neg FROM {src} WHERE {VALID} GROUP BY {keys}, p
),
{name}_r AS (
  SELECT *, sum(pos + neg) OVER (PARTITION BY {keys} ORDER BY p ROWS UNBOUNDED PRECEDING) - (pos + neg) AS before_n,
         sum(pos) OVER (PARTITION BY {keys} ORDER BY p ROWS UNBOUNDED PRECEDING) AS cpos,
         sum(neg) OVER (PARTITION BY {keys} ORDER BY p ROWS UNBOUNDED PRECEDING) AS cneg,
         sum(pos) OVER (PARTITION BY {keys}) AS np_, sum(neg) OVER (PARTITION BY {keys}) AS nn_,
         sum(pos) OVER (PARTITION BY {keys} ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS tp_d,
         sum(neg) OVER (PARTITION BY {keys} ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS fp_d
  FROM {name}_v
),
{name}_pr AS (
  SELECT *, tp_d / np_ AS rec, tp_d / (tp_d + fp_d) AS prec,
         coalesce(lag(tp_d / np_) OVER (PARTITION BY {keys} ORDER BY p DESC), 0.0) AS rec_prev,
         coalesce(lag(tp_d / (tp_d + fp_d)) OVER (PARTITION BY {keys} ORDER BY p DESC), 1.0) AS prec_prev
  FROM {name}_r
),
{name} AS (
  SELECT {keys}, max(np_)::BIGINT AS n_pos, max(nn_)::BIGINT AS n_neg,
         CASE WHEN max(np_) > 0 AND max(nn_) > 0 THEN
           (sum(pos * (before_n + (pos + neg + 1) / 2.0)) - max(np_) * (max(np_) + 1) / 2.0) / (max(np_) * max(nn_)) END AS auc,
         CASE WHEN max(np_) > 0 AND max(nn_) > 0 THEN sum((rec - rec_prev) * (prec + prec_prev) / 2.0) END AS aupr,
         CASE WHEN max(np_) > 0 AND max(nn_) > 0 THEN max(abs(cpos / np_ - cneg / nn_)) END AS ks
  FROM {name}_pr GROUP BY {keys}
)"""


def _curve_select(keys: str, cols: str) -> str:
    m = {"auc_roc": f"{r6('auc')} AS auc_roc", "auc_pr": f"{r6('aupr')} AS auc_pr",
         "gini": f"{r6('2 * auc - 1')} AS gini", "ks_statistic": f"{r6('ks')} AS ks_statistic"}
    return ", ".join([keys, "n_pos", "n_neg"] + [m[c] for c in cols.split(",")])


def classification_metrics() -> str:
    return with_fixtures("scored_split") + "," + _cls_cte("scored_split", "model, split") + \
        "\nSELECT * FROM cls"


def curve_query(cols: str) -> str:
    return with_fixtures("scored_split") + "," + _curve_cte("scored_split", "model, split") + \
        f"\nSELECT {_curve_select('model, split', cols)} FROM crv"


def confusion_matrix() -> str:
    return with_fixtures("scored_split") + f"""
SELECT model, split, y AS actual, (p > 0.5)::INTEGER AS predicted, count(*) AS n
FROM scored_split WHERE {VALID} GROUP BY ALL"""


def _psi_pooled_cte(name: str = "psa") -> str:
    return f"""
{name}_pairs AS (
  SELECT model, c.compared, split, p FROM scored_split,
         (SELECT DISTINCT split AS compared FROM scored_split WHERE split <> 'train') c
  WHERE {VALID} AND (split = 'train' OR split = c.compared)
),
{name}_rng AS (SELECT model, compared, min(p) AS lo, max(p) AS hi FROM {name}_pairs GROUP BY ALL),
{name}_e AS (
  SELECT model, compared, list_transform(range(0, 11),
         lambda i: CASE WHEN i = 10 THEN hi ELSE i::DOUBLE * ((hi - lo) / 10.0::DOUBLE) + lo END) AS e
  FROM {name}_rng
),
{name}_b AS (
  SELECT model, compared, split, least(len(list_filter(e, lambda x: x <= p)) - 1, 9) AS bin
  FROM {name}_pairs JOIN {name}_e USING (model, compared)
),
{name}_g AS (SELECT model, compared, unnest(range(0, 10)) AS bin FROM {name}_rng),
{name}_cnt AS (
  SELECT g.model, g.compared, g.bin,
         count(b.split) FILTER (WHERE b.split = 'train') AS e, count(b.split) FILTER (WHERE b.split <> 'train') AS a
  FROM {name}_g g LEFT JOIN {name}_b b USING (model, compared, bin) GROUP BY ALL
),
{name}_sh AS (
  SELECT model, compared, e / sum(e) OVER (PARTITION BY model, compared) AS es,
         a / sum(a) OVER (PARTITION BY model, compared) AS as_
  FROM {name}_cnt
),
{name} AS (
  SELECT model, compared AS split,
         {r6("sum((CASE WHEN as_ = 0 THEN 1e-6 ELSE as_ END - CASE WHEN es = 0 THEN 1e-6 ELSE es END)"
             " * ln(CASE WHEN as_ = 0 THEN 1e-6 ELSE as_ END / CASE WHEN es = 0 THEN 1e-6 ELSE es END))")} AS psi
  FROM {name}_sh GROUP BY ALL
)"""


def psi_pooled() -> str:
    return with_fixtures("scored_split") + "," + _psi_pooled_cte() + "\nSELECT * FROM psa"


def psi_with_status() -> str:
    return with_fixtures("scored_split") + "," + _psi_pooled_cte() + """
SELECT *, CASE WHEN psi < 0.1 THEN 'stable' WHEN psi < 0.2 THEN 'warning' ELSE 'unstable' END AS psi_stability
FROM psa"""


def psi_fixed() -> str:
    return with_fixtures("scored_split") + f""",
b AS (SELECT model, split, len(list_filter({PSI_INNER}, lambda e: e < p)) AS bin FROM scored_split WHERE {VALID}),
cnt AS (SELECT model, split, bin, count(*) AS c FROM b GROUP BY ALL),
sh AS (SELECT *, c / sum(c) OVER (PARTITION BY model, split) AS s FROM cnt),
ex AS (SELECT model, bin, s AS e FROM sh WHERE split = 'train'),
sides AS (SELECT DISTINCT model, split FROM sh WHERE split <> 'train'),
pr AS (
  SELECT sides.model, sides.split, ex.bin, ex.e, coalesce(sh.s, 0.0) AS a
  FROM sides JOIN ex ON sides.model = ex.model
  LEFT JOIN sh ON sh.model = sides.model AND sh.split = sides.split AND sh.bin = ex.bin
)
SELECT model, split, {r6("sum(CASE WHEN a = 0 THEN 'inf'::DOUBLE ELSE (a - e) * ln(a / e) END)")} AS psi
FROM pr GROUP BY ALL"""


def _ks_cte(src: str, keys: str, side: str, a: str, b: str, value: str = "p", name: str = "ks") -> str:
    return f"""
{name}_v AS (
  SELECT {keys}, {value} AS v, count(*) FILTER (WHERE {side} = '{a}') AS na,
         count(*) FILTER (WHERE {side} = '{b}') AS nb
  FROM {src} WHERE {value} IS NOT NULL AND NOT isnan({value}) AND {side} IN ('{a}', '{b}') GROUP BY ALL
),
{name} AS (
  SELECT {keys}, max(ta)::BIGINT AS n_a, max(tb)::BIGINT AS n_b, max(abs(ca / ta - cb / tb)) AS ks
  FROM (SELECT *, sum(na) OVER w AS ca, sum(nb) OVER w AS cb,
               sum(na) OVER (PARTITION BY {keys}) AS ta, sum(nb) OVER (PARTITION BY {keys}) AS tb
        FROM {name}_v WINDOW w AS (PARTITION BY {keys} ORDER BY v ROWS UNBOUNDED PRECEDING))
  GROUP BY {keys}
)"""


def ks_scores() -> str:
    return with_fixtures("populations") + "," + _ks_cte("populations", "model", "side", "expected", "actual") + \
        f"\nSELECT model, n_a, n_b, {r6('ks')} AS ks_statistic FROM ks"


def population_stability() -> str:
    stats = ", ".join(
        f"max({c}) FILTER (WHERE side = {s!r}) AS {s}_{c}"
        for s in ("expected", "actual") for c in ("mean", "std", "min", "max", "median"))
    rounded = ", ".join(f"{r6(f'{s}_{c}')} AS {s}_{c}"
                        for s in ("expected", "actual") for c in ("mean", "std", "min", "max", "median"))
    return with_fixtures("populations") + "," + _ks_cte("populations", "model", "side", "expected", "actual") + f""",
st AS (
  SELECT model, side, avg(p) AS mean, stddev_pop(p) AS std, min(p) AS min, max(p) AS max,
         quantile_cont(p, 0.5) AS median
  FROM populations WHERE {VALID} GROUP BY ALL
),
w AS (SELECT model, {stats} FROM st GROUP BY model)
SELECT w.model, {rounded},
       {r6('abs(actual_mean - expected_mean)')} AS mean_difference,
       {r6('abs(actual_std - expected_std)')} AS std_difference,
       {r6('abs(actual_median - expected_median)')} AS median_difference,
       {r6('ks')} AS ks_statistic, {r6('1 - least(1.0, ks)')} AS stability_score,
       CASE WHEN 1 - least(1.0, ks) > 0.8 THEN 'stable' WHEN 1 - least(1.0, ks) > 0.6 THEN 'warning'
            ELSE 'unstable' END AS status
FROM w JOIN ks USING (model)"""


def _v1_cte(src: str, keys: str, name: str = "v1") -> str:
    return f"""
{name}_b AS (
  SELECT {keys}, y, p, greatest(len(list_filter({LIN10}, lambda e: e < p)), 1) - 1 AS grp
  FROM {src} WHERE {VALID} AND p >= 0 AND p <= 1
),
{name} AS (
  SELECT {keys}, grp AS "group", avg(y::DOUBLE) AS observed_rate, avg(p) AS predicted_rate, count(*) AS size,
         CASE WHEN avg(p) > 0 THEN 1 - abs(avg(y::DOUBLE) - avg(p)) / avg(p) ELSE 0.0 END AS precision
  FROM {name}_b GROUP BY {keys}, grp
),
{name}_s AS (
  SELECT {keys}, count(*) AS total_groups, count(*) FILTER (WHERE precision > 0.8) AS green_groups,
         count(*) FILTER (WHERE precision > 0.8) / count(*) AS green_percentage
  FROM {name} GROUP BY {keys}
)"""


def tl_probability_bins() -> str:
    return with_fixtures("scored_split") + "," + _v1_cte("scored_split", "model, split") + f"""
SELECT model, split, "group"::INTEGER AS "group", {r6('observed_rate')} AS observed_rate, {r6('predicted_rate')} AS predicted_rate,
       size, {r6('precision')} AS precision,
       CASE WHEN precision > 0.8 THEN 'green' WHEN precision > 0.6 THEN 'yellow' ELSE 'red' END AS status
FROM v1"""


def tl_probability_summary() -> str:
    return with_fixtures("scored_split") + "," + _v1_cte("scored_split", "model, split") + f"""
SELECT model, split, total_groups, green_groups, {r6('green_percentage')} AS green_percentage,
       CASE WHEN green_percentage >= 0.8 THEN 'green' WHEN green_percentage >= 0.6 THEN 'yellow' ELSE 'red' END AS status
FROM v1_s"""


def tl_decile_tolerance() -> str:
    keys = "model, split"
    return with_fixtures("scored_split") + "," + _deciles("scored_split", keys) + f"""
SELECT {keys}, decile, {r6('rate')} AS actual_rate, {r6('pd')} AS predicted_rate, {r6('abs(rate - pd)')} AS difference,
       CASE WHEN abs(rate - pd) <= 0.05 THEN 'green' WHEN abs(rate - pd) <= 0.10 THEN 'yellow' ELSE 'red' END AS color,
       n AS size, {r6('mn')} AS min_prob, {r6('mx')} AS max_prob, {r6('pd')} AS avg_prob
FROM agg"""


def tl_decile_statistical() -> str:
    keys = "model, split"
    return with_fixtures("scored_split") + "," + _deciles("scored_split", keys) + "," + _interval(keys) + f""",
pv AS (
  SELECT agg.*, 2 * least({_cdf_le('k', 'n', 'pd')}, {_sf_ge('k', 'n', 'pd')}) AS p_value, ci.lo, ci.hi
  FROM agg JOIN ci USING ({keys}, decile)
)
SELECT {keys}, decile, {r6('rate')} AS actual_rate, {r6('pd')} AS predicted_rate, {r6('abs(rate - pd)')} AS difference,
       {r6('p_value')} AS p_value,
       CASE WHEN p_value > 0.05 THEN 'green' WHEN p_value > 0.025 THEN 'yellow' ELSE 'red' END AS color,
       n AS size, {r6('mn')} AS min_prob, {r6('mx')} AS max_prob, {r6('pd')} AS avg_prob,
       {r6('lo / n')} AS ci_lower, {r6('hi / n')} AS ci_upper, p_value < 0.05 AS significant
FROM pv"""


def tl_decile_colour_shares() -> str:
    keys = "model, split"
    return with_fixtures("scored_split") + "," + _deciles("scored_split", keys) + f""",
c AS (SELECT {keys}, CASE WHEN abs(rate - pd) <= 0.05 THEN 'green' WHEN abs(rate - pd) <= 0.10 THEN 'yellow'
                     ELSE 'red' END AS color FROM agg)
SELECT {keys}, count(*) AS total_groups,
       {r6("count(*) FILTER (WHERE color = 'green') / count(*) * 100.0")} AS green_percentage,
       {r6("count(*) FILTER (WHERE color = 'yellow') / count(*) * 100.0")} AS yellow_percentage,
       {r6("count(*) FILTER (WHERE color = 'red') / count(*) * 100.0")} AS red_percentage
FROM c GROUP BY {keys}"""


RANGE_EDGES_SQL = ("[0.0::DOUBLE, 0.1::DOUBLE, 0.2::DOUBLE, 0.3::DOUBLE, 0.4::DOUBLE, 0.5::DOUBLE, 0.6::DOUBLE,"
                   " 0.7::DOUBLE, 0.8::DOUBLE, 0.9::DOUBLE, 1.0::DOUBLE]")
RANGE_LABELS_SQL = ("['0.00-0.10', '0.11-0.20', '0.21-0.30', '0.31-0.40', '0.41-0.50', '0.51-0.60',"
                    " '0.61-0.70', '0.71-0.80', '0.81-0.90', '0.91-1.00']")
RANGE_MIDS_SQL = ("[(0.00::DOUBLE + 0.10::DOUBLE) / 2, (0.11::DOUBLE + 0.20::DOUBLE) / 2, (0.21::DOUBLE + 0.30::DOUBLE) / 2,"
                  " (0.31::DOUBLE + 0.40::DOUBLE) / 2, (0.41::DOUBLE + 0.50::DOUBLE) / 2, (0.51::DOUBLE + 0.60::DOUBLE) / 2,"
                  " (0.61::DOUBLE + 0.70::DOUBLE) / 2, (0.71::DOUBLE + 0.80::DOUBLE) / 2, (0.81::DOUBLE + 0.90::DOUBLE) / 2,"
                  " (0.91::DOUBLE + 1.00::DOUBLE) / 2]")


def tl_range_midpoint() -> str:
    keys = "model, split"
    return with_fixtures("scored_split") + f""",
b AS (
  SELECT {keys}, y, greatest(len(list_filter({RANGE_EDGES_SQL}, lambda e: e < p)), 1) AS bin
  FROM scored_split WHERE {VALID} AND p >= 0 AND p <= 1
),
agg AS (
  SELECT {keys}, bin, count(*) AS n, sum(y)::BIGINT AS k, {RANGE_MIDS_SQL}[bin] AS mid,
         {RANGE_LABELS_SQL}[bin] AS label
  FROM b GROUP BY {keys}, bin
),
pv AS (SELECT *, k / n AS rate, 2 * least({_cdf_le('k', 'n', 'mid')}, {_sf_ge('k', 'n', 'mid')}) AS p_value FROM agg),
rows AS (
  SELECT {keys}, label AS Rango_Probabilidad, n AS Total_Registros, k AS Cantidad_1, n - k AS Cantidad_0,
         {rnd('(n - k) / n * 100.0', 2)} AS Porcentaje_0, {rnd('k / n * 100.0', 2)} AS Porcentaje_1,
         {rnd('rate', 4)} AS Tasa_Real, {rnd('mid', 2)} AS Punto_Medio_Rango,
         {rnd('abs(rate - mid)', 4)} AS Diferencia, {rnd('p_value', 4)} AS P_Value,
         CASE WHEN p_value > 0.05 THEN 'Verde' WHEN p_value > 0.025 THEN 'Amarillo' ELSE 'Rojo' END AS Color
  FROM pv
)
SELECT * FROM rows
UNION ALL
SELECT {keys}, 'TOTAL', sum(Total_Registros)::BIGINT, sum(Cantidad_1)::BIGINT, sum(Cantidad_0)::BIGINT,
       {rnd('sum(Cantidad_0) / sum(Total_Registros) * 100.0', 2)}, {rnd('sum(Cantidad_1) / sum(Total_Registros) * 100.0', 2)},
       {rnd('sum(Cantidad_1) / sum(Total_Registros)', 4)}, NULL, NULL, NULL, NULL
FROM rows GROUP BY {keys}"""


def _basel_colour(rate: str = "rate", pd_: str = "pd", pv: str = "p_value") -> str:
    return (f"CASE WHEN {pv} > 0.05 THEN 'Verde' WHEN {rate} > {pd_} AND {pv} > 0.01 THEN 'Amarillo'"
            f" WHEN {rate} > {pd_} THEN 'Rojo' WHEN {pv} > 0.01 THEN 'Azul Claro' ELSE 'Azul Marino' END")


def basel_verdict() -> str:
    keys = "model, split"
    return with_fixtures("scored_split") + "," + _deciles("scored_split", keys) + f""",
pv AS (SELECT agg.*, 2 * least({_cdf_le('k', 'n', 'pd')}, {_sf_ge('k', 'n', 'pd')}) AS p_value FROM agg),
c AS (SELECT {keys}, {_basel_colour()} AS color FROM pv),
t AS (
  SELECT {keys}, count(*) AS total_ranges,
         count(*) FILTER (WHERE color = 'Verde') AS green_count, count(*) FILTER (WHERE color = 'Amarillo') AS yellow_count,
         count(*) FILTER (WHERE color = 'Rojo') AS red_count, count(*) FILTER (WHERE color = 'Azul Claro') AS light_blue_count,
         count(*) FILTER (WHERE color = 'Azul Marino') AS dark_blue_count
  FROM c GROUP BY {keys}
)
SELECT *, {r6('green_count / total_ranges')} AS green_share, {r6('yellow_count / total_ranges')} AS yellow_share,
       {r6('red_count / total_ranges')} AS red_share, {r6('light_blue_count / total_ranges')} AS light_blue_share,
       {r6('dark_blue_count / total_ranges')} AS dark_blue_share,
       CASE WHEN green_count >= 7 THEN 'APROBADO' WHEN green_count >= 5 THEN 'ACEPTABLE' ELSE 'RECHAZADO' END AS verdict
FROM t"""


def binomial_table() -> str:
    keys = "model"
    pm = _pmf('i', 'n', 'pd')
    return with_fixtures("scored") + "," + _deciles("scored", keys) + "," + _interval(keys) + f""",
pv AS (
  SELECT agg.*, {_cdf_le('k', 'n', 'pd')} AS le, {_sf_ge('k', 'n', 'pd')} AS ge,
         least(1.0, list_sum(list_filter(list_transform(range(0, n + 1), lambda i: {pm}),
                                         lambda x: x <= {_pmf('k', 'n', 'pd')} * (1 + 1e-7)))) AS ml,
         ci.lo, ci.hi
  FROM agg JOIN ci USING ({keys}, decile)
)
SELECT {keys}, decile, n AS size, k AS n_success, {r6('pd')} AS predicted_rate,
       {r6('2 * least(le, ge)')} AS p_double_tail, {r6('ge')} AS p_greater, {r6('le')} AS p_less,
       {r6('ml')} AS p_minlike, lo::BIGINT AS ci_lo_count, hi::BIGINT AS ci_hi_count
FROM pv"""


def tl_all_models() -> str:
    keys = "model, split"
    return with_fixtures("scored_split") + "," + _deciles("scored_split", keys) + f""",
pv AS (SELECT agg.*, 2 * least({_cdf_le('k', 'n', 'pd')}, {_sf_ge('k', 'n', 'pd')}) AS p_value FROM agg),
rb AS (
  SELECT {keys}, y, greatest(len(list_filter({RANGE_EDGES_SQL}, lambda e: e < p)), 1) AS bin
  FROM scored_split WHERE {VALID} AND p >= 0 AND p <= 1
),
ra AS (SELECT {keys}, bin, count(*) AS n, sum(y)::BIGINT AS k, {RANGE_MIDS_SQL}[bin] AS mid,
              {RANGE_LABELS_SQL}[bin] AS label FROM rb GROUP BY {keys}, bin),
rp AS (SELECT *, 2 * least({_cdf_le('k', 'n', 'mid')}, {_sf_ge('k', 'n', 'mid')}) AS p_value FROM ra)
SELECT 'statistical' AS method, {keys}, decile::VARCHAR AS bin, n, {r6('p_value')} AS p_value,
       CASE WHEN p_value > 0.05 THEN 'green' WHEN p_value > 0.025 THEN 'yellow' ELSE 'red' END AS color FROM pv
UNION ALL
SELECT 'range_midpoint', {keys}, label, n, {r6('p_value')},
       CASE WHEN p_value > 0.05 THEN 'Verde' WHEN p_value > 0.025 THEN 'Amarillo' ELSE 'Rojo' END FROM rp
UNION ALL
SELECT 'basel', {keys}, decile::VARCHAR, n, {r6('p_value')}, {_basel_colour()} FROM pv"""


def evaluate_models() -> str:
    keys = "model, split"
    return with_fixtures("scored_split") + "," + _cls_cte("scored_split", keys) + "," + \
        _curve_cte("scored_split", keys) + "," + _v1_cte("scored_split", keys) + "," + _psi_pooled_cte() + f""",
w AS (
  SELECT cls.*, {_curve_select_cols()}, {r6('v1_s.green_percentage')} AS traffic_light_green,
         CASE WHEN v1_s.green_percentage >= 0.8 THEN 'green' WHEN v1_s.green_percentage >= 0.6 THEN 'yellow'
              ELSE 'red' END AS traffic_light_status,
         psa.psi,
         CASE WHEN psa.psi IS NULL THEN NULL WHEN psa.psi < 0.1 THEN 'stable' WHEN psa.psi < 0.2 THEN 'warning'
              ELSE 'unstable' END AS psi_stability
  FROM cls JOIN crv USING ({keys}) JOIN v1_s USING ({keys}) LEFT JOIN psa USING ({keys})
)
SELECT *, {r6("greatest(0.0, least(1.0, (auc_roc + f1_score + (gini + 1) / 2 + traffic_light_green"
              " + coalesce(CASE psi_stability WHEN 'stable' THEN 1.0 WHEN 'warning' THEN 0.5 ELSE 0.0 END, 0.0))"
              " / (CASE WHEN psi_stability IS NULL THEN 4 ELSE 5 END)))")} AS overall_score
FROM w"""


def _curve_select_cols() -> str:
    return (f"{r6('crv.auc')} AS auc_roc, {r6('crv.aupr')} AS auc_pr, {r6('2 * crv.auc - 1')} AS gini,"
            f" {r6('crv.ks')} AS ks_statistic")


def out_of_time_eval() -> str:
    keys = "model, period"
    src = "(SELECT *, CASE WHEN as_of < TIMESTAMP '1999-01-01' THEN 'in_time' ELSE 'out_of_time' END AS period FROM scored)"
    return with_fixtures("scored") + ", sp AS " + src + "," + _cls_cte("sp", keys) + "," + _curve_cte("sp", keys) + f"""
SELECT cls.*, crv.n_pos, crv.n_neg, {_curve_select_cols()} FROM cls JOIN crv USING ({keys})"""


def all_sql() -> dict[str, str]:
    return {
        "tl_basel": tl_basel(),
        "tl_probability_bins": tl_probability_bins(),
        "tl_probability_summary": tl_probability_summary(),
        "tl_decile_tolerance": tl_decile_tolerance(),
        "tl_decile_colour_shares": tl_decile_colour_shares(),
        "tl_decile_statistical": tl_decile_statistical(),
        "tl_range_midpoint": tl_range_midpoint(),
        "basel_verdict": basel_verdict(),
        "binomial_test_table": binomial_table(),
        "binomial_test": "SELECT model, decile, size, n_success, predicted_rate, p_double_tail, p_greater, p_less,"
                         " p_minlike FROM (" + binomial_table() + ")",
        "binomial_interval": "SELECT model, decile, size, n_success, ci_lo_count, ci_hi_count FROM ("
                             + binomial_table() + ")",
        "total_row": "SELECT * FROM (" + tl_basel() + ") WHERE Decil = 'TOTAL'",
        "tl_all_models": tl_all_models(),
        "classification_metrics": classification_metrics(),
        "confusion_matrix": confusion_matrix(),
        "auc_roc": curve_query("auc_roc"),
        "auc_pr": curve_query("auc_pr"),
        "gini": curve_query("gini"),
        "ks_good_bad": curve_query("ks_statistic"),
        "psi_pooled": psi_pooled(),
        "psi_fixed": psi_fixed(),
        "stability_status": psi_with_status(),
        "population_stability": population_stability(),
        "ks_scores": ks_scores(),
        "evaluate_models": evaluate_models(),
        "out_of_time_eval": out_of_time_eval(),
    }
