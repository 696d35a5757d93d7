"""Bin assignment against explicit edges (kernel K2) and edge builders.

Edges are always built the way NumPy builds them (``lo + i*step`` with the last
edge set to ``hi``), never from decimal literals, so ``3*0.1`` stays
``0.30000000000000004`` exactly as in the reference computations.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def linspace(lo: float, hi: float, num: int) -> list[float]:
    """Python twin of ``numpy.linspace`` for literal edges."""
    if num == 1:
        return [float(lo)]
    step = (hi - lo) / (num - 1)
    out = [i * step + lo for i in range(num)]
    out[-1] = float(hi)
    return out


def linspace_col(lo: Column, hi: Column, num: int) -> Column:
    """``numpy.linspace(lo, hi, num)`` as an array column (per-row lo/hi)."""
    step = (hi - lo) / F.lit(float(num - 1))
    return F.transform(
        F.sequence(F.lit(0), F.lit(num - 1)),
        lambda i: F.when(i == num - 1, hi).otherwise(i.cast("double") * step + lo),
    )


def edges_literal(edges: list[float]) -> Column:
    return F.array(*[F.lit(float(e)) for e in edges])


def count_edges(x: Column, edges: Column | Sequence[float], n_max: int | None = None,
                strict: bool = True) -> Column:
    """Number of edges ``< x`` (``strict``) or ``<= x``, as unrolled comparisons.

    ``edges`` is a literal list or an array column of at most ``n_max``
    elements. Plain comparisons stay inside whole-stage codegen, unlike an
    array ``filter`` lambda.
    """
    if isinstance(edges, (list, tuple)):
        vals = [F.lit(float(e)) for e in edges]
    else:
        if n_max is None:
            raise ValueError("n_max is required for array-column edges")
        vals = [F.try_element_at(edges, F.lit(i)) for i in range(1, n_max + 1)]
    terms = [F.when((v < x) if strict else (v <= x), F.lit(1)).otherwise(F.lit(0)) for v in vals]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def count_below_sorted(df, x: Column, sorted_arr: str, n_max: int, out_col: str, strict: bool = True):
    """Add ``out_col`` = number of elements of the ascending array column
    ``sorted_arr`` (length <= n_max) that are ``< x`` (``<= x`` if not strict).

    Binary descent in ceil(log2(n_max + 1)) projection steps, each a plain
    comparison with ``try_element_at`` (NULL past the end, or for a NULL array,
    counts as "not below"), so it stays in codegen for thousands of cut points.
    """
    import math
    k = max(1, math.ceil(math.log2(n_max + 1)))
    pos = f"_bs_{out_col}"
    out = df.withColumn(pos, F.lit(0))
    for j in range(k - 1, -1, -1):
        cand = F.col(pos) + F.lit(2 ** j)
        v = F.try_element_at(F.col(sorted_arr), cand)
        cond = (v < x) if strict else (v <= x)
        out = out.withColumn(pos, F.when(cond, cand).otherwise(F.col(pos)))
    return out.withColumnRenamed(pos, out_col)


def _first_last(edges, n_max):
    if isinstance(edges, (list, tuple)):
        return F.lit(float(edges[0])), F.lit(float(edges[-1])), len(edges)
    return F.element_at(edges, 1), F.element_at(edges, -1), None


def bin_left(x: Column, edges, n_max: int | None = None) -> Column:
    """0-based bin of ``x`` in [e_i, e_{i+1}), last bin closed (``numpy.histogram``).

    NULL when ``x`` is outside [e_0, e_last] or NULL/NaN.
    """
    lo, hi, n_lit = _first_last(edges, n_max)
    nb = (F.lit(n_lit) if n_lit is not None else F.size(edges)) - 1
    idx = count_edges(x, edges, n_max, strict=False) - 1
    inside = (x >= lo) & (x <= hi) & ~F.isnan(x)
    return F.when(inside, F.least(idx, nb - 1))


def bin_right(x: Column, edges, include_lowest: bool = True, n_max: int | None = None) -> Column:
    """1-based bin of ``x`` in (e_{i-1}, e_i] (``pandas.cut`` with right=True).

    With ``include_lowest`` a value equal to e_0 goes to bin 1. NULL outside
    the edges or for NULL/NaN.
    """
    lo, hi, _ = _first_last(edges, n_max)
    idx = count_edges(x, edges, n_max, strict=True)
    inside = (x <= hi) & ~F.isnan(x)
    inside = inside & ((x >= lo) if include_lowest else (x > lo))
    return F.when(inside, F.greatest(idx, F.lit(1)))


def status3(value: Column, good_cut: float, warn_cut: float, labels=("ok", "warning", "critical"),
            strict: bool = True, higher_is_better: bool = False) -> Column:
    """Three-level status: ``value < good_cut`` -> labels[0], ``< warn_cut`` -> labels[1]."""
    if higher_is_better:
        c1 = value > good_cut if strict else value >= good_cut
        c2 = value > warn_cut if strict else value >= warn_cut
    else:
        c1 = value < good_cut if strict else value <= good_cut
        c2 = value < warn_cut if strict else value <= warn_cut
    return F.when(c1, labels[0]).when(c2, labels[1]).otherwise(labels[2])


def round_half_up(x: Column, digits: int) -> Column:
    """Round half up at ``digits`` decimals, robust to last-bit noise of float sums.

    A mean that is exactly ``…5`` in decimal can come out one ulp either side
    depending on summation order, and engines disagree on how to round such a
    value; adding 1e-6 of the last unit first makes every engine round it the
    same way (up). Infinity and NULL pass through.
    """
    return F.round(x + F.lit(1e-6 * 10.0 ** (-digits)), digits)


def r6(x: Column) -> Column:
    """Output rounding used by every metric table (6 decimals)."""
    return round_half_up(x, 6)
