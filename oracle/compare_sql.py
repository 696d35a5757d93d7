"""DuckDB oracles for real-vs-synthetic comparison and quality queries (fixture F5)."""

from __future__ import annotations

from oracle.fixtures_sql import with_fixtures
from oracle.queries import r6

COLS = ["quantity", "extendedprice", "discount", "tax"]


def _lbl(x: str) -> str:
    return f"CASE WHEN {x} < 0.1 THEN 'high' WHEN {x} < 0.2 THEN 'medium' ELSE 'low' END"


LONG = "long AS (" + " UNION ALL ".join(
    f"SELECT side, '{c}' AS \"column\", {c}::DOUBLE AS value FROM real_vs_synth WHERE {c} IS NOT NULL"
    for c in COLS) + ")"


def _base() -> str:
    return with_fixtures("real_vs_synth") + ", " + LONG


def shape_compare() -> str:
    return with_fixtures("real_vs_synth") + f"""
SELECT count(*) FILTER (WHERE side = 'real') AS real_rows, 5 AS real_cols,
       count(*) FILTER (WHERE side = 'synthetic') AS synthetic_rows, 5 AS synthetic_cols,
       true AS shape_match, true AS column_match,
       {r6("CASE WHEN count(*) FILTER (WHERE side = 'real') > 0 THEN count(*) FILTER (WHERE side = 'synthetic')"
           " / count(*) FILTER (WHERE side = 'real') ELSE 0.0 END")} AS size_ratio
FROM real_vs_synth"""


def stats_compare() -> str:
    return _base() + f""", st AS (
  SELECT "column", avg(value) FILTER (WHERE side = 'real') AS rm, avg(value) FILTER (WHERE side = 'synthetic') AS sm,
         stddev_samp(value) FILTER (WHERE side = 'real') AS rs, stddev_samp(value) FILTER (WHERE side = 'synthetic') AS ss
  FROM long GROUP BY "column")
SELECT "column", {r6('rm')} AS real_mean, {r6('sm')} AS synthetic_mean, {r6('rs')} AS real_std,
       {r6('ss')} AS synthetic_std, {r6('abs(rm - sm)')} AS mean_difference, {r6('abs(rs - ss)')} AS std_difference
FROM st"""


def _ks_cte() -> str:
    return """
kv AS (SELECT "column", value, count(*) FILTER (WHERE side = 'real') AS na,
              count(*) FILTER (WHERE side = 'synthetic') AS nb FROM long GROUP BY ALL),
kc AS (SELECT *, sum(na) OVER w AS ca, sum(nb) OVER w AS cb, sum(na) OVER (PARTITION BY "column") AS ta,
              sum(nb) OVER (PARTITION BY "column") AS tb
       FROM kv WINDOW w AS (PARTITION BY "column" ORDER BY value ROWS UNBOUNDED PRECEDING)),
ks AS (SELECT "column", max(ta)::BIGINT AS n_a, max(tb)::BIGINT AS n_b, max(abs(ca / ta - cb / tb)) AS d
       FROM kc GROUP BY "column"),
ksp AS (SELECT *, (sqrt(n_a * n_b / (n_a + n_b)) + 0.12 + 0.11 / sqrt(n_a * n_b / (n_a + n_b))) * d AS lam FROM ks)"""


def ks_compare() -> str:
    series = ("list_sum(list_transform(range(1, 101), lambda j: 2.0 * (CASE WHEN j % 2 = 1 THEN 1.0 ELSE -1.0 END)"
              " * exp(-2.0 * (j * j)::DOUBLE * lam * lam)))")
    return _base() + "," + _ks_cte() + f"""
SELECT "column", n_a, n_b, {r6('d')} AS ks_statistic,
       {r6(f'CASE WHEN lam < 0.2 THEN 1.0 ELSE greatest(0.0, least(1.0, {series})) END')} AS p_value,
       {r6('1.0 - d')} AS ks_complement, {_lbl('d')} AS similarity
FROM ksp"""


def ks_complement() -> str:
    return _base() + "," + _ks_cte() + f"\nSELECT \"column\", {r6('1.0 - d')} AS ks_complement FROM ksp"


def _pairs_cte() -> str:
    pairs = [(i, j) for i in range(len(COLS)) for j in range(i + 1, len(COLS))]
    rows = " UNION ALL ".join(
        f"SELECT {i} AS i, {j} AS j, corr({COLS[i]}::DOUBLE, {COLS[j]}::DOUBLE) FILTER (WHERE side = 'real') AS rr,"
        f" corr({COLS[i]}::DOUBLE, {COLS[j]}::DOUBLE) FILTER (WHERE side = 'synthetic') AS sr FROM real_vs_synth"
        for i, j in pairs)
    return f"pr AS ({rows})"


def corr_matrix_diff() -> str:
    v = f"2.0 * sum(abs(rr - sr)) / {float(len(COLS) ** 2)}"
    return with_fixtures("real_vs_synth") + ", " + _pairs_cte() + f"""
SELECT {r6(v)} AS average_correlation_difference, {_lbl(v)} AS correlation_similarity FROM pr"""


def corr_structure() -> str:
    v = f"2.0 * sum(abs(rr - sr)) / {float(len(COLS) ** 2)}"
    return with_fixtures("real_vs_synth") + ", " + _pairs_cte() + f"""
SELECT {r6(v)} AS average_correlation_difference, {r6('corr(rr, sr)')} AS correlation_correlation,
       {_lbl(v)} AS correlation_similarity FROM pr"""


def _shares_cte() -> str:
    return """
sh AS (SELECT side, target AS class, count(*) / sum(count(*)) OVER (PARTITION BY side) AS share
       FROM real_vs_synth GROUP BY side, target),
rs AS (SELECT class, share AS real FROM sh WHERE side = 'real'),
ss AS (SELECT class, share AS synthetic FROM sh WHERE side = 'synthetic')"""


def target_compare_inner() -> str:
    return with_fixtures("real_vs_synth") + "," + _shares_cte() + f"""
SELECT {r6('coalesce(sum(abs(real - synthetic)), 0.0)')} AS distribution_difference FROM rs JOIN ss USING (class)"""


def target_compare_outer() -> str:
    v = "sum(abs(coalesce(real, 0.0) - coalesce(synthetic, 0.0)))"
    return with_fixtures("real_vs_synth") + "," + _shares_cte() + f"""
SELECT {r6(v)} AS distribution_difference, {_lbl(v)} AS distribution_similarity
FROM rs FULL OUTER JOIN ss USING (class)"""


def _hist_cte(k: int, name: str) -> str:
    e = f"list_transform(range(0, {k}), lambda i: CASE WHEN i = {k - 1} THEN hi ELSE i::DOUBLE * ((hi - lo) / {float(k - 1)}::DOUBLE) + lo END)"
    return f"""
{name}_rng AS (SELECT "column", min(value) AS lo, max(value) AS hi FROM long GROUP BY "column"),
{name}_e AS (SELECT "column", {e} AS e FROM {name}_rng),
{name}_b AS (SELECT l."column", l.side, least(len(list_filter(e.e, lambda x: x <= l.value)) - 1, {k - 2}) AS bin
             FROM long l JOIN {name}_e e USING ("column")),
{name}_g AS (SELECT "column", e, unnest(range(0, {k - 1})) AS bin FROM {name}_e),
{name} AS (
  SELECT g."column", g.bin, g.e[g.bin + 2] - g.e[g.bin + 1] AS w,
         count(b.side) FILTER (WHERE b.side = 'real') AS r, count(b.side) FILTER (WHERE b.side = 'synthetic') AS s
  FROM {name}_g g LEFT JOIN {name}_b b USING ("column", bin) GROUP BY ALL
),
{name}_t AS (SELECT *, sum(r) OVER (PARTITION BY "column") AS nr, sum(s) OVER (PARTITION BY "column") AS ns FROM {name})"""


def _chi_cte() -> str:
    return _hist_cte(10, "h10") + """,
chi AS (
  SELECT "column",
         sum(CASE WHEN s * nr / ns = 0 AND r = 0 THEN NULL WHEN s * nr / ns = 0 THEN 'inf'::DOUBLE
                  ELSE (r - s * nr / ns) * (r - s * nr / ns) / (s * nr / ns) END) AS chi2, max(nr) AS nr
  FROM h10_t GROUP BY "column")"""


def chi_squared_score() -> str:
    return _base() + "," + _chi_cte() + f"""
SELECT "column", {r6('chi2')} AS chi_squared, {r6('1.0 / (1.0 + chi2 / nr)')} AS chi_squared_score FROM chi"""


def _div_cte() -> str:
    return _hist_cte(20, "h20") + """,
dn AS (SELECT "column", bin, r / (nr * w) AS dr, s / (ns * w) AS ds FROM h20_t),
dp AS (SELECT *, (dr + 1e-10) / sum(dr + 1e-10) OVER (PARTITION BY "column") AS p,
              (ds + 1e-10) / sum(ds + 1e-10) OVER (PARTITION BY "column") AS q FROM dn),
dv AS (
  SELECT "column", sum(p / q - ln(p / q) - 1.0) AS is_div, sum(p * ln(p / q)) AS kl,
         sum(dr * ds) / sqrt(sum(dr * dr) * sum(ds * ds)) AS cos,
         sum(-((p + q) / 2.0) * ln((p + q) / 2.0)) AS hm, sum(-p * ln(p)) AS hp, sum(-q * ln(q)) AS hq
  FROM dp GROUP BY "column")"""


def is_divergence_score() -> str:
    return _base() + "," + _div_cte() + f"""
SELECT "column", {r6('1.0 / (1.0 + is_div)')} AS kl_divergence_inverse, {r6('kl')} AS kl_divergence FROM dv"""


def cosine_similarity() -> str:
    return _base() + "," + _div_cte() + f"\nSELECT \"column\", {r6('greatest(0.0, cos)')} AS cosine_similarity FROM dv"


def js_similarity() -> str:
    return _base() + "," + _div_cte() + \
        f"\nSELECT \"column\", {r6('1.0 - (hm - 0.5 * (hp + hq))')} AS jensen_shannon_entropy FROM dv"


def _metrics_cte() -> str:
    return _ks_cte() + "," + _chi_cte() + "," + _div_cte() + f""",
dm AS (
  SELECT ksp."column", {r6('1.0 - ksp.d')} AS m1, {r6('1.0 / (1.0 + chi.chi2 / chi.nr)')} AS m2,
         {r6('1.0 / (1.0 + dv.is_div)')} AS m3, {r6('greatest(0.0, dv.cos)')} AS m4,
         {r6('1.0 - (dv.hm - 0.5 * (dv.hp + dv.hq))')} AS m5
  FROM ksp JOIN chi USING ("column") JOIN dv USING ("column")),
{_pairs_cte()},
cs AS (SELECT {r6(f'2.0 * sum(abs(rr - sr)) / {float(len(COLS) ** 2)}')} AS acd, {r6('corr(rr, sr)')} AS cc FROM pr),
{_shares_cte()},
tg AS (SELECT {r6('sum(abs(coalesce(real, 0.0) - coalesce(synthetic, 0.0)))')} AS dd
       FROM rs FULL OUTER JOIN ss USING (class)),
terms AS (
  SELECT avg(cm) AS v FROM (
    SELECT list_avg(list_filter([m1, m2, m3, m4, m5], lambda x: x IS NOT NULL AND NOT isnan(x))) AS cm FROM dm)
  UNION ALL SELECT cc FROM cs UNION ALL SELECT 1.0 - dd FROM tg),
qs AS (SELECT {r6('CASE WHEN count(*) > 0 THEN greatest(0.0, least(1.0, avg(v))) ELSE 0.0 END')} AS overall_score,
              count(*) AS n_terms
       FROM terms WHERE v IS NOT NULL AND NOT isnan(v))"""


def quality_score() -> str:
    return _base() + "," + _metrics_cte() + "\nSELECT * FROM qs"


def evaluate_quality() -> str:
    names = ["KS_complement", "chi_squared", "kl_divergence_inverse", "cosine_similarity", "jensen_shannon_entropy"]
    dist = " UNION ALL ".join(f"SELECT 'distribution' AS section, \"column\", '{n}' AS metric, m{i + 1} AS value FROM dm"
                              for i, n in enumerate(names))
    ratio = r6("count(*) FILTER (WHERE side = 'synthetic') / count(*) FILTER (WHERE side = 'real')")
    return _base() + "," + _metrics_cte() + f"""
{dist}
UNION ALL SELECT 'correlation', NULL, 'average_correlation_difference', acd FROM cs
UNION ALL SELECT 'correlation', NULL, 'correlation_correlation', cc FROM cs
UNION ALL SELECT 'target', NULL, 'distribution_difference', dd FROM tg
UNION ALL SELECT 'basic', NULL, 'size_ratio', {ratio} FROM real_vs_synth
UNION ALL SELECT 'overall', NULL, 'overall_score', overall_score FROM qs"""


def synthetic_validation() -> str:
    ratio = r6("count(*) FILTER (WHERE side = 'synthetic') / count(*) FILTER (WHERE side = 'real')")
    stats = " UNION ALL ".join(
        f"SELECT 'statistics', \"column\", '{m}', {e} FROM st" for m, e in [
            ("real_mean", r6("rm")), ("synthetic_mean", r6("sm")), ("real_std", r6("rs")),
            ("synthetic_std", r6("ss")), ("mean_difference", r6("abs(rm - sm)")),
            ("std_difference", r6("abs(rs - ss)"))])
    series = ("list_sum(list_transform(range(1, 101), lambda j: 2.0 * (CASE WHEN j % 2 = 1 THEN 1.0 ELSE -1.0 END)"
              " * exp(-2.0 * (j * j)::DOUBLE * lam * lam)))")
    pval = r6(f"CASE WHEN lam < 0.2 THEN 1.0 ELSE greatest(0.0, least(1.0, {series})) END")
    return _base() + "," + _ks_cte() + "," + _pairs_cte() + "," + _shares_cte() + f""",
st AS (
  SELECT "column", avg(value) FILTER (WHERE side = 'real') AS rm, avg(value) FILTER (WHERE side = 'synthetic') AS sm,
         stddev_samp(value) FILTER (WHERE side = 'real') AS rs, stddev_samp(value) FILTER (WHERE side = 'synthetic') AS ss
  FROM long GROUP BY "column")
SELECT 'shape' AS "check", NULL AS "column", 'real_rows' AS metric,
       count(*) FILTER (WHERE side = 'real')::DOUBLE AS value FROM real_vs_synth
UNION ALL SELECT 'shape', NULL, 'synthetic_rows', count(*) FILTER (WHERE side = 'synthetic')::DOUBLE FROM real_vs_synth
UNION ALL SELECT 'shape', NULL, 'size_ratio', {ratio} FROM real_vs_synth
UNION ALL {stats}
UNION ALL SELECT 'distribution', "column", 'ks_statistic', {r6('d')} FROM ksp
UNION ALL SELECT 'distribution', "column", 'p_value', {pval} FROM ksp
UNION ALL SELECT 'distribution', "column", 'ks_complement', {r6('1.0 - d')} FROM ksp
UNION ALL SELECT 'correlation', NULL, 'average_correlation_difference',
                 {r6(f'2.0 * sum(abs(rr - sr)) / {float(len(COLS) ** 2)}')} FROM pr
UNION ALL SELECT 'target', NULL, 'distribution_difference', {r6('coalesce(sum(abs(real - synthetic)), 0.0)')}
          FROM rs JOIN ss USING (class)"""


def all_sql() -> dict[str, str]:
    return {
        "shape_compare": shape_compare(), "basic_comparison": shape_compare(),
        "stats_compare": stats_compare(), "ks_compare": ks_compare(), "ks_complement": ks_complement(),
        "corr_matrix_diff": corr_matrix_diff(), "corr_structure": corr_structure(),
        "target_compare_inner": target_compare_inner(), "target_compare_outer": target_compare_outer(),
        "chi_squared_score": chi_squared_score(), "is_divergence_score": is_divergence_score(),
        "cosine_similarity": cosine_similarity(), "js_similarity": js_similarity(),
        "quality_score": quality_score(), "evaluate_quality": evaluate_quality(),
        "synthetic_validation": synthetic_validation(),
    }
