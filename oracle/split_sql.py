"""DuckDB oracles for split queries (plain row_number windows)."""

from __future__ import annotations

from oracle.fixtures_sql import with_fixtures


def _ranked(names: list[str], cum: list[float]) -> str:
    cases = " ".join(f"WHEN rk <= floor(n::DOUBLE * {c!r}::DOUBLE + 0.5::DOUBLE) THEN '{nm}'"
                     for nm, c in zip(names[:-1], cum))
    return with_fixtures("loans") + f"""
SELECT loan_id, as_of, target, CASE {cases} ELSE '{names[-1]}' END AS split
FROM (SELECT loan_id, as_of, target,
             row_number() OVER (PARTITION BY target ORDER BY md5('42:' || CAST(loan_id AS VARCHAR)), loan_id) AS rk,
             count(*) OVER (PARTITION BY target) AS n
      FROM loans)"""


def _cum(ratios: list[float]) -> list[float]:
    out, c = [], 0.0
    for r in ratios[:-1]:
        c += r
        out.append(c)
    return out


def time_series_splits() -> str:
    return with_fixtures("loans") + """,
r AS (SELECT loan_id, as_of, target, row_number() OVER (ORDER BY as_of, loan_id) AS rk,
             count(*) OVER () AS n FROM loans),
f AS (SELECT unnest(range(0, 5)) AS fold)
SELECT loan_id, as_of, target, fold::INTEGER AS fold,
       CASE WHEN rk <= (fold + 1) * (n // 5) THEN 'train' ELSE 'validation' END AS role
FROM r, f
WHERE (fold + 1) * (n // 5) < n
  AND (rk <= (fold + 1) * (n // 5) OR (rk > (fold + 1) * (n // 5) AND rk <= least((fold + 2) * (n // 5), n)))"""


def all_sql() -> dict[str, str]:
    return {
        "stratified_split": _ranked(["train", "validation", "test"], _cum([0.6, 0.2, 0.2])),
        "holdout_split": _ranked(["train", "test", "holdout"], _cum([0.6, 0.2, 0.2])),
        "synthetic_validation_split": _ranked(["train", "validation"], _cum([0.85, 0.15])),
        "stratified_folds": with_fixtures("loans") + """
SELECT loan_id, as_of, target, ((rk - 1) % 5)::INTEGER AS fold
FROM (SELECT loan_id, as_of, target,
             row_number() OVER (PARTITION BY target ORDER BY md5('42:' || CAST(loan_id AS VARCHAR)), loan_id) AS rk
      FROM loans)""",
        "time_series_splits": time_series_splits(),
    }
