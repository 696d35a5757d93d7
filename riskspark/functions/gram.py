"""Pairwise-complete correlations of many columns in one pass: a blocked Gram matrix.

A task multiplies the matrices of its rows - values with missing ones masked, and the masks -
and so has, for all pairs of columns at once, the rows on which both are present, their means,
and their sums of squares and products about the means. It gives out one row for each pair of
column blocks; these rows are merged (in tasks' buckets, then over the buckets) by the exact
formulas for joining centred moments. The plan has no expression for a pair of columns: only
one column of the scan for each of them.

A task holds four d x d matrices of doubles for each value of ``by`` (8 MB for 500 columns),
so ``by`` should have few values (sides, splits).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 128          # columns of a block; a row of the shuffle holds 6 x BLOCK x BLOCK doubles
BUCKETS = 64         # of tasks, merged first
NO_SPREAD = 1e-12    # standard deviation over mean below which a column counts as constant


def _moments(x: np.ndarray, held: dict, key) -> None:
    """Adds a batch (rows x columns, NaN missing) to the sums of ``key`` about fixed shifts."""
    present = ~np.isnan(x)
    if key not in held:
        order = np.sort(x, axis=0)                       # NaN last: the middle present value of each column
        middle = np.maximum(present.sum(0) - 1, 0) // 2
        shift = np.nan_to_num(order[middle, np.arange(x.shape[1])])
        held[key] = [shift, *(np.zeros((x.shape[1], x.shape[1])) for _ in range(4))]
    shift, n, s, q, p = held[key]
    v, m = np.where(present, x - shift, 0.0), present.astype(float)
    n += m.T @ m
    s += v.T @ m                                         # sum of the row's column where the other is present
    q += (v * v).T @ m
    p += v.T @ v


def _centred(shift, n, s, q, p) -> list[np.ndarray]:
    """n, both means, and squares and products about them, for every pair of columns."""
    with np.errstate(invalid="ignore", divide="ignore"):
        mean = np.where(n > 0, s / n, 0.0)
    square = q - mean * s
    square = np.where(square <= 1e-13 * q, 0.0, square)
    return [n, shift[:, None] + mean, (shift[:, None] + mean).T, square, square.T, p - mean * s.T]


def _joined(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    """Moments of two sets of rows together."""
    n = a[0] + b[0]
    with np.errstate(invalid="ignore", divide="ignore"):
        share = np.where(n > 0, b[0] / n, 0.0)
    dx, dy = np.where(a[0] * b[0] > 0, b[1] - a[1], 0.0), np.where(a[0] * b[0] > 0, b[2] - a[2], 0.0)
    weight = a[0] * share
    return [n, np.where(a[0] > 0, a[1] + dx * share, b[1]), np.where(a[0] > 0, a[2] + dy * share, b[2]),
            a[3] + b[3] + dx * dx * weight, a[4] + b[4] + dy * dy * weight, a[5] + b[5] + dx * dy * weight]


def pair_correlations(df: DataFrame, columns: Sequence[Column], by: Column | None = None) -> DataFrame:
    """(by, i, j, n, r) for all pairs i <= j of ``columns`` (numbered from 0): Pearson's r over
    the rows on which both are present, NULL where either does not vary on these. ``by`` is cast
    to string and groups the rows; NULL is a group of its own."""
    import pyarrow as pa

    d = len(columns)
    edges = [(a, min(a + BLOCK, d)) for a in range(0, d, BLOCK)]
    frame = df.select((by.cast("string") if by is not None else F.lit(None).cast("string")).alias("by"),
                      *[F.nanvl(c.cast("double"), F.lit(None).cast("double")).alias(f"c{k}") for k, c in enumerate(columns)])

    def partial(batches):
        from pyspark import TaskContext
        held: dict = {}
        for rb in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in rb.columns[1:]]).astype(float) if d else np.zeros((rb.num_rows, 0))
            groups = rb.column(0).dictionary_encode()
            codes = groups.indices.to_numpy(zero_copy_only=False) if groups.null_count == 0 else \
                groups.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            for code in np.unique(codes).tolist():
                _moments(x[codes == code], held, None if code < 0 else groups.dictionary[int(code)].as_py())
        rows = []
        for key, sums in held.items():
            all_pairs = _centred(*sums)
            rows += [(key, a, b, np.stack([m[slice(*edges[a]), slice(*edges[b])] for m in all_pairs]).tobytes())
                     for a in range(len(edges)) for b in range(a, len(edges))]
        task = TaskContext.get().partitionId() % BUCKETS
        yield _batch(rows, task)

    def _batch(rows, task):
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int32()),
                                           pa.array([task] * len(rows), pa.int32()), pa.array([r[3] for r in rows], pa.binary())], ["by", "a", "b", "bucket", "m"])

    def shaped(raw: bytes, a: int, b: int) -> list[np.ndarray]:
        return list(np.frombuffer(raw).reshape(6, edges[a][1] - edges[a][0], edges[b][1] - edges[b][0]))

    def merged(batches):
        """Sorted rows of one key follow one another; one sum is held at a time."""
        key, total = None, None
        for rb in batches:
            for row in zip(*(rb.column(c).to_pylist() for c in ("by", "a", "b", "bucket", "m"))):
                part = shaped(row[4], row[1], row[2])
                if key == row[:4]:
                    total = _joined(total, part)
                    continue
                if key is not None:
                    yield key, total
                key, total = row[:4], part
        if key is not None:
            yield key, total

    def first_merge(batches):
        for key, total in merged(batches):
            yield _batch([(*key[:3], np.stack(total).tobytes())], 0)

    def last_merge(batches):
        for (group, a, b, _), (n, mx, my, xx, yy, xy) in merged(batches):
            flat = (xx <= n * (NO_SPREAD * mx) ** 2) | (yy <= n * (NO_SPREAD * my) ** 2) | (n < 1)
            with np.errstate(invalid="ignore", divide="ignore"):
                r = xy / np.sqrt(xx * yy)
            i, j = np.meshgrid(np.arange(*edges[a]), np.arange(*edges[b]), indexing="ij")
            keep = (i <= j).ravel()
            yield pa.RecordBatch.from_arrays([
                pa.array([group] * int(keep.sum()), pa.string()), pa.array(i.ravel()[keep].astype(np.int32)), pa.array(j.ravel()[keep].astype(np.int32)),
                pa.array(n.ravel()[keep].astype(np.int64)), pa.array(r.ravel()[keep], mask=flat.ravel()[keep])], ["by", "i", "j", "n", "r"])

    key = "by string, a int, b int, bucket int, m binary"
    parts = frame.mapInArrow(partial, key)
    near = ["by", "a", "b", "bucket"]
    parts = parts.repartition(*near).sortWithinPartitions(*near).mapInArrow(first_merge, key)
    parts = parts.repartition(*near[:3]).sortWithinPartitions(*near[:3])
    return parts.mapInArrow(last_merge, "by string, i int, j int, n long, r double")
