"""DuckDB twins of the fixture views (FIXTURES.md §3), as CTE fragments.

Written independently of the Spark code: plain joins, window ``row_number``
for ranks and ``UNION ALL`` for the four scoring rules.
"""

from __future__ import annotations

LOANS = """
loans AS (
  SELECT o.o_orderkey AS loan_id, o.o_custkey AS customer_id, o.o_orderdate AS as_of,
         c.c_mktsegment AS segment, o.o_orderpriority AS priority, o.o_totalprice AS amount,
         c.c_acctbal AS balance, coalesce(li.n_lines, 0)::BIGINT AS n_lines,
         li.qty_sum, li.avg_discount,
         0.05::DOUBLE + 0.50::DOUBLE * o.o_totalprice / 500000.0::DOUBLE AS p_true,
         ((((o.o_orderkey * 15485863 + 101) % 100003)::DOUBLE / 100003.0::DOUBLE)
            < (0.05::DOUBLE + 0.50::DOUBLE * o.o_totalprice / 500000.0::DOUBLE))::INTEGER AS target
  FROM orders o
  JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN (SELECT l_orderkey, count(*) AS n_lines, sum(l_quantity) AS qty_sum,
                    avg(l_discount) AS avg_discount
             FROM lineitem GROUP BY l_orderkey) li ON li.l_orderkey = o.o_orderkey
)"""

SCORED = """
scored AS (
  SELECT 'model_a' AS model, loan_id, as_of, segment, target AS y,
         0.20::DOUBLE + 0.30::DOUBLE * amount / 500000.0::DOUBLE AS p FROM loans
  UNION ALL
  SELECT 'model_b', loan_id, as_of, segment, target,
         (1 + (loan_id * 7919) % 997)::DOUBLE / 1000.0::DOUBLE FROM loans
  UNION ALL
  SELECT 'model_c', loan_id, as_of, segment, target,
         0.25::DOUBLE + 0.15::DOUBLE * (balance + 1000.0::DOUBLE) / 11000.0::DOUBLE FROM loans
  UNION ALL
  SELECT 'model_d', loan_id, as_of, segment, target, p_true FROM loans
)"""

LOAN_SPLIT = """
loan_split AS (
  SELECT loan_id,
         CASE WHEN rk <= floor(n::DOUBLE * 0.6::DOUBLE + 0.5::DOUBLE) THEN 'train'
              WHEN rk <= floor(n::DOUBLE * 0.8::DOUBLE + 0.5::DOUBLE) THEN 'test'
              ELSE 'holdout' END AS split
  FROM (SELECT loan_id,
               row_number() OVER (PARTITION BY target
                                  ORDER BY md5('42:' || CAST(loan_id AS VARCHAR)), loan_id) AS rk,
               count(*) OVER (PARTITION BY target) AS n
        FROM loans) r
)"""

SCORED_SPLIT = """
scored_split AS (
  SELECT s.*, ls.split FROM scored s JOIN loan_split ls USING (loan_id)
)"""

POPULATIONS = """
populations AS (
  SELECT *, CASE WHEN as_of < TIMESTAMP '1998-04-01' THEN 'expected' ELSE 'actual' END AS side
  FROM scored
)"""

REAL_VS_SYNTH = """
real_vs_synth AS (
  SELECT CASE WHEN l_linestatus = 'O' THEN 'real' ELSE 'synthetic' END AS side,
         l_quantity AS quantity, l_extendedprice AS extendedprice, l_discount AS discount,
         l_tax AS tax, l_returnflag AS target
  FROM lineitem
)"""

LOANS_DIRTY = """
loans_dirty0 AS (
  SELECT loan_id, customer_id, as_of, segment,
         CASE WHEN loan_id % 11 = 0 THEN NULL ELSE priority END AS priority,
         CASE WHEN loan_id % 7 = 0 THEN NULL ELSE amount END AS amount,
         balance, n_lines, qty_sum, avg_discount, p_true, target
  FROM loans
),
loans_dirty AS (
  SELECT * FROM loans_dirty0 UNION ALL SELECT * FROM loans_dirty0 WHERE loan_id % 50 = 0
)"""

IMBALANCED = """
imbalanced AS (
  SELECT c.c_custkey AS customer_id,
         coalesce(o.n_orders, 0)::DOUBLE AS n_orders,
         coalesce(o.sum_amount, 0.0::DOUBLE) AS sum_amount,
         coalesce(o.avg_amount, 0.0::DOUBLE) AS avg_amount,
         c.c_nationkey::DOUBLE AS c_nationkey,
         (c.c_acctbal < 0)::INTEGER AS target
  FROM customer c
  LEFT JOIN (SELECT o_custkey, count(*) AS n_orders, sum(o_totalprice) AS sum_amount,
                    avg(o_totalprice) AS avg_amount FROM orders GROUP BY o_custkey) o
    ON c.c_custkey = o.o_custkey
)"""

DOC_QUALITY = """
doc_quality AS (
  SELECT d.doc_id, d.n_chars, d.lang, d.source, l.quality
  FROM documents d JOIN labels l USING (doc_id)
)"""

SCORE_STREAM = """
score_stream AS (
  SELECT event_id, ts, value / 500.0::DOUBLE AS score FROM events
)"""

_DEPS = {
    "loans": [LOANS],
    "scored": [LOANS, SCORED],
    "scored_split": [LOANS, SCORED, LOAN_SPLIT, SCORED_SPLIT],
    "populations": [LOANS, SCORED, POPULATIONS],
    "real_vs_synth": [REAL_VS_SYNTH],
    "loans_dirty": [LOANS, LOANS_DIRTY],
    "imbalanced": [IMBALANCED],
    "doc_quality": [DOC_QUALITY],
    "score_stream": [SCORE_STREAM],
}


def with_fixtures(*names: str) -> str:
    """``WITH`` clause defining the named fixture views (and what they need)."""
    parts: list[str] = []
    for n in names:
        for frag in _DEPS[n]:
            if frag not in parts:
                parts.append(frag)
    return "WITH " + ",".join(parts)
