"""DuckDB oracles for profiling (P) and transform (T) queries on the loan fixtures."""

from __future__ import annotations

from oracle.fixtures_sql import with_fixtures
from oracle.queries import r6

# schema of the loans / loans_dirty fixtures: (name, Spark type name)
LOAN_COLS = [("loan_id", "bigint"), ("customer_id", "bigint"), ("as_of", "timestamp_ntz"),
             ("segment", "string"), ("priority", "string"), ("amount", "double"), ("balance", "double"),
             ("n_lines", "bigint"), ("qty_sum", "double"), ("avg_discount", "double"), ("p_true", "double"),
             ("target", "int")]
NUMERIC = [c for c, t in LOAN_COLS if t in ("bigint", "int", "double")]
FLOAT = [c for c, t in LOAN_COLS if t == "double"]
STRING = [c for c, t in LOAN_COLS if t == "string"]
KEYS = ["loan_id", "customer_id"]


def _clean(c: str) -> str:
    return f"CASE WHEN isnan({c}) THEN NULL ELSE {c} END" if c in FLOAT else c


def _missing(c: str) -> str:
    return f"({c} IS NULL OR isnan({c}))" if c in FLOAT else f"{c} IS NULL"


def _status(x: str, a: float, b: float) -> str:
    return f"CASE WHEN {x} < {a} THEN 'ok' WHEN {x} < {b} THEN 'warning' ELSE 'critical' END"


def basic_info() -> str:
    vals = ", ".join(f"({i}, '{c}', '{t}')" for i, (c, t) in enumerate(LOAN_COLS))
    return with_fixtures("loans_dirty") + f"""
SELECT m.position, m."column", m.dtype, n.n_rows, {len(LOAN_COLS)} AS n_cols
FROM (VALUES {vals}) m(position, "column", dtype), (SELECT count(*) AS n_rows FROM loans_dirty) n"""


def frame_gate() -> str:
    return with_fixtures("loans_dirty") + f"""
SELECT {len(LOAN_COLS)} AS n_cols, count(*) AS rows_seen, CASE WHEN count(*) >= 10 THEN 'ok' ELSE 'warning' END AS status
FROM loans_dirty"""


def missing_profile() -> str:
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {i} AS position, count(*) FILTER (WHERE {_missing(c)}) AS missing_count,"
        f" count(*) AS n FROM loans_dirty" for i, (c, _) in enumerate(LOAN_COLS))
    pct = "missing_count / n * 100.0"
    tpct = f"sum(missing_count) / (max(n) * {float(len(LOAN_COLS))}) * 100.0"
    return with_fixtures("loans_dirty") + f""", m AS ({parts})
SELECT "column", position, missing_count, {r6(pct)} AS missing_percentage, {_status(pct, 5, 20)} AS status FROM m
UNION ALL
SELECT 'summary', -1, sum(missing_count)::BIGINT, {r6(tpct)}, {_status(tpct, 5, 20)} FROM m"""


def duplicate_profile() -> str:
    cols = ", ".join(c for c, _ in LOAN_COLS)
    pct = "duplicate_count / n_rows * 100.0"
    return with_fixtures("loans_dirty") + f""", g AS (SELECT count(*) AS c FROM loans_dirty GROUP BY {cols}),
t AS (SELECT sum(c)::BIGINT AS n_rows, sum(c - 1)::BIGINT AS duplicate_count FROM g)
SELECT n_rows, duplicate_count, {r6(pct)} AS duplicate_percentage, {_status(pct, 1, 5)} AS status FROM t"""


def cardinality_profile() -> str:
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {i} AS position, '{t}' AS dtype,"
        f" count(DISTINCT {_clean(c)}) AS unique_count, count(*) AS n FROM loans_dirty"
        for i, (c, t) in enumerate(LOAN_COLS))
    pct = "unique_count / n * 100.0"
    return with_fixtures("loans_dirty") + f""", m AS ({parts})
SELECT "column", position, dtype, unique_count, {r6(pct)} AS unique_percentage,
       CASE WHEN {pct} > 1 THEN 'ok' ELSE 'warning' END AS status FROM m"""


def iqr_outliers() -> str:
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {i} AS position, quantile_cont({_clean(c)}::DOUBLE, 0.25) AS q1,"
        f" quantile_cont({_clean(c)}::DOUBLE, 0.75) AS q3 FROM loans_dirty" for i, c in enumerate(NUMERIC))
    counts = " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {_clean(c)} < b.lb OR {_clean(c)} > b.ub) AS oc,"
        f" count(*) AS n FROM loans_dirty, (SELECT lb, ub FROM bnd WHERE \"column\" = '{c}') b" for c in NUMERIC)
    pct = "oc / n * 100.0"
    return with_fixtures("loans_dirty") + f""", q AS ({parts}),
bnd AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lb, q3 + 1.5 * (q3 - q1) AS ub FROM q),
c AS ({counts})
SELECT bnd."column", position, oc AS outlier_count, {r6(pct)} AS outlier_percentage,
       {r6('lb')} AS lower_bound, {r6('ub')} AS upper_bound, {_status(pct, 5, 15)} AS status
FROM bnd JOIN c USING ("column")"""


def _corr_pairs() -> str:
    pairs = [(a, b) for i, a in enumerate(NUMERIC) for b in NUMERIC[i + 1:]]
    return " UNION ALL ".join(
        f"SELECT '{a}' AS feature1, '{b}' AS feature2, corr({_clean(a)}::DOUBLE, {_clean(b)}::DOUBLE) AS correlation"
        f" FROM loans_dirty" for a, b in pairs)


def correlation_pairs() -> str:
    return with_fixtures("loans_dirty") + f""", m AS ({_corr_pairs()})
SELECT feature1, feature2, {r6('correlation')} AS correlation FROM m WHERE abs(correlation) > 0.8"""


def correlation_summary() -> str:
    return with_fixtures("loans_dirty") + f""", m AS ({_corr_pairs()})
SELECT {r6('greatest(1.0, max(abs(correlation)))')} AS max_correlation,
       {r6('max(abs(correlation))')} AS max_offdiagonal_correlation FROM m"""


def target_correlation() -> str:
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {r6(f'corr({_clean(c)}::DOUBLE, target::DOUBLE)')} AS correlation"
        f" FROM loans_dirty" for c in NUMERIC if c != "target")
    return with_fixtures("loans_dirty") + "\n" + parts


def class_distribution() -> str:
    return with_fixtures("scored_split") + f""", c AS (
  SELECT model, split, y, count(*) AS count FROM scored_split GROUP BY model, split, y)
SELECT model, split, y, count, sum(count) OVER (PARTITION BY model, split)::BIGINT AS n_rows, 3 AS n_features,
       {r6('count / sum(count) OVER (PARTITION BY model, split)')} AS proportion FROM c"""


def column_metadata() -> str:
    num = " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", 'numerical' AS kind, min({_clean(c)})::DOUBLE AS min,"
        f" max({_clean(c)})::DOUBLE AS max, NULL::VARCHAR AS value FROM loans_dirty" for c in NUMERIC)
    other = " UNION ALL ".join(
        f"SELECT DISTINCT '{c}' AS \"column\", 'categorical' AS kind, NULL::DOUBLE AS min, NULL::DOUBLE AS max,"
        f" CAST({c} AS VARCHAR) AS value FROM loans_dirty" for c, t in LOAN_COLS if c not in NUMERIC)
    return with_fixtures("loans_dirty") + "\n" + num + " UNION ALL " + other


def detect_types() -> str:
    num_rows = " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", CASE WHEN count(DISTINCT {_clean(c)}) = 2 THEN 'binary' ELSE 'numeric' END AS kind,"
        f" {i} AS o FROM loans_dirty" for i, c in enumerate(NUMERIC))
    rest = " UNION ALL ".join(
        [f"SELECT '{c}', 'categorical', {100 + i} FROM (SELECT 1)" for i, c in enumerate(STRING)]
        + ["SELECT 'as_of', 'datetime', 200 FROM (SELECT 1)"])
    return with_fixtures("loans_dirty") + f"""
SELECT "column", kind FROM ({num_rows} UNION ALL {rest})"""


# imputation: these fixture columns hold missing values (FIXTURES F6)
MISSING = ["priority", "amount", "qty_sum", "avg_discount"]


def _mode_sql(c: str) -> str:
    return (f"(SELECT {c} FROM loans_dirty WHERE {c} IS NOT NULL GROUP BY {c}"
            f" ORDER BY count(*) DESC, {c} LIMIT 1)")


def _impute_select(kind: str) -> str:
    out = []
    for c, _ in LOAN_COLS:
        if c not in MISSING:
            out.append(c)
        elif c in STRING:
            out.append(f"coalesce({c}, {_mode_sql(c)}) AS {c}")
        else:
            agg = "quantile_cont" if kind == "median" else "avg"
            stat = f"(SELECT {agg}({_clean(c)}::DOUBLE{', 0.5' if kind == 'median' else ''}) FROM loans_dirty)"
            out.append(f"coalesce({_clean(c)}::DOUBLE, {stat}) AS {c}")
    return ", ".join(out)


def impute() -> str:
    return with_fixtures("loans_dirty") + f"\nSELECT {_impute_select('median')} FROM loans_dirty"


def impute_mean() -> str:
    return with_fixtures("loans_dirty") + f"\nSELECT {_impute_select('mean')} FROM loans_dirty"


def impute_drop() -> str:
    cond = " AND ".join(f"NOT ({_missing(c)})" for c in MISSING)
    return with_fixtures("loans_dirty") + f"\nSELECT * FROM loans_dirty WHERE {cond}"


def _codes_cte(src: str, cols: list[str], null_text: str | None = "nan") -> str:
    parts = []
    for c in cols:
        v = f"coalesce({c}, '{null_text}')" if null_text else c
        parts.append(f"code_{c} AS (SELECT v, (dense_rank() OVER (ORDER BY v) - 1)::INTEGER AS code"
                     f" FROM (SELECT DISTINCT {v} AS v FROM {src} WHERE {v} IS NOT NULL))")
    return ", ".join(parts)


def label_encode() -> str:
    sel = ", ".join(f"(SELECT code FROM code_{c} WHERE v = coalesce(t.{c}, 'nan')) AS {c}" if c in STRING else f"t.{c}"
                    for c, _ in LOAN_COLS)
    return with_fixtures("loans_dirty") + ", " + _codes_cte("loans_dirty", STRING) + \
        f"\nSELECT {sel} FROM loans_dirty t"


SCALED_LOANS = ["amount", "balance", "n_lines", "qty_sum", "avg_discount", "p_true"]


def standard_scale() -> str:
    sel = ", ".join(
        f"({c}::DOUBLE - (SELECT avg({c}) FROM loans)) / (SELECT CASE WHEN stddev_pop({c}) = 0 THEN 1.0"
        f" ELSE stddev_pop({c}) END FROM loans) AS {c}" if c in SCALED_LOANS else c for c, _ in LOAN_COLS)
    return with_fixtures("loans") + f"\nSELECT {sel} FROM loans"


def interaction_feature() -> str:
    return with_fixtures("loans") + "\nSELECT loan_id, amount * balance AS amount_x_balance FROM loans"


def squared_feature() -> str:
    return with_fixtures("loans") + "\nSELECT loan_id, amount * amount AS amount_squared FROM loans"


def preprocess() -> str:
    scaled = ["segment", "priority", "amount", "balance", "n_lines", "qty_sum", "avg_discount", "p_true"]
    imp = _impute_select("median")
    coded = ", ".join(f"(SELECT code FROM code_{c} WHERE v = coalesce(i.{c}, 'nan')) AS {c}" if c in STRING
                      else f"i.{c}" for c, _ in LOAN_COLS)
    sc = ", ".join(
        f"({c}::DOUBLE - (SELECT avg({c}) FROM enc)) / (SELECT CASE WHEN stddev_pop({c}) = 0 THEN 1.0"
        f" ELSE stddev_pop({c}) END FROM enc) AS {c}" if c in scaled else c for c, _ in LOAN_COLS)
    return with_fixtures("loans_dirty") + f""", imp AS (SELECT {imp} FROM loans_dirty),
{_codes_cte('imp', STRING)},
enc AS (SELECT {coded} FROM imp i),
sc AS (SELECT {sc} FROM enc)
SELECT *, segment * priority AS segment_x_priority, segment * segment AS segment_squared FROM sc"""


def binarize_target() -> str:
    return with_fixtures("loans") + """
SELECT loan_id, class, (class = 2)::INTEGER AS "default"
FROM (SELECT loan_id, CASE WHEN target = 1 THEN 2 ELSE 1 END AS class FROM loans)"""


def select_features() -> str:
    return with_fixtures("loans") + "\nSELECT loan_id, amount, balance, target AS label FROM loans"


def generator_prepare() -> str:
    med = []
    for c, _ in LOAN_COLS:
        if c in ("amount", "qty_sum", "avg_discount"):
            med.append(f"coalesce({_clean(c)}::DOUBLE, (SELECT quantile_cont({_clean(c)}::DOUBLE, 0.5)"
                       f" FROM loans_dirty)) AS {c}")
        elif c in STRING:
            med.append(f"coalesce((SELECT code FROM code_{c} WHERE v = t.{c}), -1)::INTEGER AS {c}")
        else:
            med.append(f"t.{c}")
    return with_fixtures("loans_dirty") + ", " + _codes_cte("loans_dirty", STRING, null_text=None) + \
        f"\nSELECT {', '.join(med)} FROM loans_dirty t"


def quality_report() -> str:
    """Union of the profile oracles in the (check, column, metric, value, status) shape."""
    rows = []
    specs = [
        ("missing", missing_profile(), ["missing_count", "missing_percentage"], "status", '"column"'),
        ("cardinality", cardinality_profile(), ["unique_count", "unique_percentage"], "status", '"column"'),
        ("outliers", iqr_outliers(), ["outlier_count", "outlier_percentage", "lower_bound", "upper_bound"],
         "status", '"column"'),
        ("duplicates", duplicate_profile(), ["duplicate_count", "duplicate_percentage"], "status", "NULL"),
        ("shape", basic_info() + " WHERE m.position = 0", ["n_rows", "n_cols"], None, "NULL"),
        ("target_correlation", target_correlation(), ["correlation"], None, '"column"'),
    ]
    for check, sql, metrics, status, col in specs:
        for m in metrics:
            st = status if status else "NULL::VARCHAR"
            rows.append(f"SELECT '{check}' AS \"check\", {col}::VARCHAR AS \"column\", '{m}' AS metric,"
                        f" {m}::DOUBLE AS value, {st} AS status FROM ({sql})")
    return " UNION ALL ".join(rows)


def _round_doubles(sql: str, cols: list[str]) -> str:
    """Wrap the final SELECT so the listed DOUBLE columns are rounded to 6 dp."""
    head, sep, tail = sql.rpartition("\nSELECT ")
    rep = ", ".join(f"{r6(c)} AS {c}" for c in cols)
    return f"{head}, _res AS (SELECT {tail})\nSELECT * REPLACE ({rep}) FROM _res"


DOUBLES_DIRTY = ["amount", "balance", "qty_sum", "avg_discount", "p_true"]


def all_sql() -> dict[str, str]:
    return {name: fn() for name, fn in [
        ("basic_info", basic_info), ("frame_gate", frame_gate), ("missing_profile", missing_profile),
        ("duplicate_profile", duplicate_profile), ("cardinality_profile", cardinality_profile),
        ("iqr_outliers", iqr_outliers), ("correlation_pairs", correlation_pairs),
        ("correlation_summary", correlation_summary), ("target_correlation", target_correlation),
        ("class_distribution", class_distribution), ("column_metadata", column_metadata),
        ("detect_types", detect_types), ("impute", impute), ("impute_mean", impute_mean),
        ("impute_drop", impute_drop), ("label_encode", label_encode),
        ("interaction_feature", interaction_feature), ("squared_feature", squared_feature),
        ("binarize_target", binarize_target),
        ("select_features", select_features), ("generator_prepare", generator_prepare),
    ]} | {
        "quality_report": quality_report(),
        "save_pipeline": _round_doubles(preprocess(), ["segment", "priority", "amount", "balance", "n_lines",
                                                       "qty_sum", "avg_discount", "p_true", "segment_x_priority",
                                                       "segment_squared"]),
        "impute_mean": _round_doubles(impute_mean(), DOUBLES_DIRTY),
        "standard_scale": _round_doubles(standard_scale(), SCALED_LOANS),
        "preprocess": _round_doubles(preprocess(), ["segment", "priority", "amount", "balance", "n_lines", "qty_sum",
                                                    "avg_discount", "p_true", "segment_x_priority",
                                                    "segment_squared"]),
    }
