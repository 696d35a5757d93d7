"""DuckDB oracles for source / sink round trips."""

from __future__ import annotations

from oracle.fixtures_sql import with_fixtures
from oracle.queries import classification_metrics
from oracle.split_sql import all_sql as split_sql


def all_sql() -> dict[str, str]:
    holdout = split_sql()["holdout_split"]
    return {
        "scan_table": "SELECT * FROM orders",
        "scan_segment": with_fixtures("loans") + """
SELECT loan_id, customer_id, amount, balance, target, segment FROM loans WHERE segment = 'BUILDING'""",
        "scan_catalog": " UNION ALL BY NAME ".join(f"SELECT *, '{t}' AS dataset FROM {t}" for t in ("customer", "orders", "part", "supplier")),
        "read_splits": holdout,
        "write_table": "SELECT * FROM customer",
        "write_metrics": classification_metrics(),
        "write_splits": holdout,
    }
