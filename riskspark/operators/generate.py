"""Synthetic row generators (G1–G6) and generator persistence.

* Gaussian copula: per-column marginals (exact quantile grid, or a table of the
  cumulative shares of a text column's values), normal scores from exact ranks,
  their correlation matrix (d×d) and quantile grids (the only things that reach
  the driver), Cholesky, then ``spark.range(n)`` rows whose normals come from
  seeded hashes, so the output does not depend on partitioning. Uniforms meet
  the values of a text column by a join on ranges of their shares.
* SMOTE / ADASYN / borderline SMOTE: new minority rows interpolated towards
  one of the k nearest neighbours. Neighbours come from ``knn``, an exact
  distributed k-nearest-neighbour search that never builds all pairs. Class
  sizes are a joined table, so any number of classes will do.

A fitted generator is a model that is sampled, saved and loaded: the copula, or
a table of seeds and one of their neighbours.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskspark.functions.normal import hash_uniform, norm_cdf, norm_ppf
from riskspark.functions.gram import pair_correlations
from riskspark.operators.kernels import exact_quantiles, hash_rank, store_table, value_cumsums
from riskspark.operators.profile import numeric_columns

GRID = 1001   # quantile grid points per numeric marginal


# ====================================================================== G1
@dataclass
class CopulaModel:
    columns: list[str]
    kinds: list[str]                    # "numeric" | "categorical"
    grids: dict[str, list[float]]       # numeric: quantile grid on [0, 1]
    n_values: dict[str, int]            # categorical: number of distinct values
    bounds: dict[str, tuple[float, float]]
    decimals: dict[str, int | None]
    dtypes: dict[str, str]
    chol: list[list[float]]
    n_rows: int
    categories: DataFrame | None = None   # (column, value, lo, hi): each value's range of cumulative shares

    def to_json(self) -> str:
        return json.dumps({k: v for k, v in self.__dict__.items() if k != "categories"})

    @staticmethod
    def from_json(text: str, categories: DataFrame | None = None) -> "CopulaModel":
        d = json.loads(text)
        d["bounds"] = {k: tuple(v) for k, v in d["bounds"].items()}
        return CopulaModel(**d, categories=categories)


def _decimals(df: DataFrame, cols: Sequence[str], max_digits: int = 4) -> dict[str, int | None]:
    """Smallest number of decimals (<= max_digits) that every value already has."""
    if not cols:
        return {}
    row = df.agg(*[F.count_if(F.col(c).isNotNull() & (F.round(F.col(c), k) != F.col(c))).alias(f"{i}_{k}")
                   for i, c in enumerate(cols) for k in range(max_digits + 1)]).first()
    out = {}
    for i, c in enumerate(cols):
        out[c] = next((k for k in range(max_digits + 1) if row[f"{i}_{k}"] == 0), None)
    return out


def fit_copula(df: DataFrame, columns: Sequence[str] | None = None, key: str | None = None) -> CopulaModel:
    """Fit marginals and the normal-score correlation of ``columns``."""
    cols = list(columns or [c for c in df.columns if c != key])
    num = [c for c in cols if c in numeric_columns(df)]
    kinds = ["numeric" if c in num else "categorical" for c in cols]
    rid = F.monotonically_increasing_id()
    base = df.select(*[F.col(c) for c in cols]).withColumn("_rid", rid).checkpoint(eager=True)
    n = base.count()
    # marginals
    long_num = base.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in num])).alias("r")
    ).select("r.*") if num else None
    grids, bounds = {}, {}
    if num:
        probs = [i / (GRID - 1) for i in range(GRID)]
        for r in exact_quantiles(long_num, ["column"], "v", probs, out_col="q").collect():
            grids[r["column"]] = [float(x) for x in r["q"]]
            bounds[r["column"]] = (float(r["q"][0]), float(r["q"][-1]))
    text = [c for c in cols if c not in num]
    long_text = base.select("_rid", F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in text])).alias("r")
    ).select("_rid", "r.*") if text else None
    categories, n_values = None, {}
    if text:
        shares = value_cumsums(long_text.groupBy("column", "value").agg(F.count(F.lit(1)).alias("c")), ["column"], "value", ["c"])
        categories = store_table(shares.select("column", "value", ((F.col("cum_c") - F.col("c")) / F.col("tot_c")).alias("lo"),
                                               (F.col("cum_c") / F.col("tot_c")).alias("hi")))
        n_values = {r["column"]: r["count"] for r in categories.groupBy("column").count().collect()}
    # normal scores: u = (average rank − 0.5) / n for numeric values; the middle
    # of the category's cumulative interval for categories
    parts = []
    if num:
        long_num = base.select("_rid", F.explode(F.array(*[
            F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in num])).alias("r")).select("_rid", "r.*")
        counts = long_num.where(F.col("v").isNotNull()).groupBy("column", "v").agg(F.count(F.lit(1)).alias("c"))
        cum = value_cumsums(counts, ["column"], "v", ["c"])
        ranks = cum.select("column", "v", ((F.col("cum_c") - (F.col("c") - 1) / 2.0 - 0.5) / F.col("tot_c"))
                           .alias("u"))
        parts.append(long_num.join(ranks, ["column", "v"]).select("_rid", "column", "u"))
    if text:
        mids = categories.select(F.col("column").alias("_c"), F.col("value").alias("_v"), ((F.col("lo") + F.col("hi")) / 2.0).alias("u"))
        parts.append(long_text.join(mids, (F.col("column") == F.col("_c")) & F.col("value").eqNullSafe(F.col("_v"))).select("_rid", "column", "u"))
    u_long = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    z_wide = u_long.withColumn("z", norm_ppf(F.col("u"))).groupBy("_rid").pivot("column", cols).agg(F.first("z"))
    corr = np.eye(len(cols))
    for r in pair_correlations(z_wide, [F.col(f"`{c}`") for c in cols]).where("i < j").collect():        # d x d numbers
        corr[r["i"], r["j"]] = corr[r["j"], r["i"]] = 0.0 if r["r"] is None or np.isnan(r["r"]) else r["r"]
    # nearest positive-definite matrix by diagonal loading, then Cholesky (d×d on the driver)
    for jitter in (0.0, 1e-10, 1e-8, 1e-6, 1e-4, 1e-2):
        try:
            chol = np.linalg.cholesky(corr + jitter * np.eye(len(cols)))
            break
        except np.linalg.LinAlgError:
            continue
    dtypes = {c: df.schema[c].dataType.simpleString() for c in cols}
    decimals = _decimals(base, [c for c in num if dtypes[c] in ("double", "float")])
    decimals.update({c: 0 for c in num if dtypes[c] not in ("double", "float")})
    return CopulaModel(cols, kinds, grids, n_values, bounds, decimals, dtypes, chol.tolist(), int(n), categories)


def _interp(grid: list[float], u: Column) -> Column:
    arr = F.array(*[F.lit(float(x)) for x in grid])
    pos = u * float(len(grid) - 1)
    lo = F.least(F.floor(pos).cast("int"), F.lit(len(grid) - 2))
    t = pos - lo.cast("double")
    a = F.element_at(arr, lo + 1)
    b = F.element_at(arr, lo + 2)
    return a + (b - a) * t


def sample_copula(spark: SparkSession, model: CopulaModel, n: int, seed: int = 42,
                  enforce_min_max: bool = True, enforce_rounding: bool = True,
                  partitions: int | None = None) -> DataFrame:
    """n synthetic rows; row i depends only on (seed, i)."""
    d = len(model.columns)
    rows = spark.range(0, n, numPartitions=partitions or max(1, spark.sparkContext.defaultParallelism))
    e = [norm_ppf(hash_uniform(seed, F.col("id"), F.lit(j))) for j in range(d)]
    rows = rows.select("id", *[x.alias(f"_e{j}") for j, x in enumerate(e)])
    L = model.chol
    z = [sum((F.lit(L[i][j]) * F.col(f"_e{j}") for j in range(i + 1)), F.lit(0.0)) for i in range(d)]
    rows = rows.select("id", *[F.least(F.greatest(norm_cdf(zi), F.lit(0.0)), F.lit(1.0)).alias(f"_u{i}") for i, zi in enumerate(z)])
    out = [F.col("id").alias("synthetic_id")]
    for i, c in enumerate(model.columns):
        u = F.col(f"_u{i}")
        if model.kinds[i] == "numeric":
            v = _interp(model.grids[c], u)
            if enforce_min_max:
                lo, hi = model.bounds[c]
                v = F.least(F.greatest(v, F.lit(lo)), F.lit(hi))
            dec = model.decimals.get(c)
            if enforce_rounding and dec is not None:
                v = F.round(v, dec)
        else:
            rows = _with_value(rows, f"_u{i}", model.categories.where(F.col("column") == c), model.n_values[c], f"_v{i}")
            v = F.col(f"_v{i}")
        out.append(v.cast(model.dtypes[c]).alias(c))
    return rows.select(*out)


def _with_value(rows: DataFrame, u: str, categories: DataFrame, n_values: int, name: str) -> DataFrame:
    """``rows`` with the value whose range of shares (lo, hi] holds ``u``. Ranges are dealt to
    as many equal cells of [0, 1] as there are values; a uniform meets the ranges of its own
    cell, two on average however the shares are spread."""
    cells = max(1, n_values)
    cell = lambda x: F.least(F.floor(x * float(cells)), F.lit(cells - 1)).cast("long")      # noqa: E731
    ranges = categories.select(F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi")))).alias("_cell"), F.col("value").alias(name),
                               F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
    inside = (F.col(u) <= F.col("_hi")) & ((F.col(u) > F.col("_lo")) | (F.col("_lo") == 0.0))
    placed = rows.withColumn("_at", cell(F.col(u)))
    return placed.join(ranges, (F.col("_at") == F.col("_cell")) & inside).drop("_at", "_cell", "_lo", "_hi")


def gaussian_copula(df: DataFrame, n: int | None = None, columns: Sequence[str] | None = None,
                    key: str | None = None, seed: int = 42) -> DataFrame:
    model = fit_copula(df, columns, key)
    return sample_copula(df.sparkSession, model, n if n is not None else model.n_rows, seed)


# ====================================================================== exact kNN
CELLS_HELD = 1 << 20      # distances (points x pivots) that a task holds at a time


def _distances(f: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (f * f).sum(1)[:, None] - 2.0 * (f @ pivots.T) + (pivots * pivots).sum(1)[None, :]
    return np.sqrt(np.maximum(square, 0.0))


def _rows_of(col) -> np.ndarray:
    return np.array(col.to_pylist(), float).reshape(len(col), -1)


ROWS_A_SALT = 1 << 14     # rows that meet one copy of a cell's members
TASKS_A_CORE = 3          # tasks in which rows meet members of cells


def _meet(pivots: DataFrame, rows: DataFrame, key: list[str], kernel, extra: dict[str, str], share: int | None = None,
          without: Sequence[str] = ()) -> DataFrame:
    """Every row meets the pivots (pid, pf, pr) of its ``key``. Both are dealt out by the key and
    a salt and sorted, so a task reads a key's pivots and then streams the rows past them; it
    holds one key's pivots and one batch. ``kernel(pid, pf, pr, batch)`` gives the numbers of
    the batch's rows that stay (repeats allowed) and the ``extra`` columns of the result, which
    leaves out the columns ``without``. Pivots are copied to every task, or with ``share`` (many
    keys of few rows) once for that many rows of their key. Then the number of tasks is given,
    since the bytes that meet, by which tasks would be merged, say little of the pairs they make."""
    import pyarrow as pa

    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kinds, payload = dict(rows.dtypes), [c for c in rows.columns if c not in key]
    kept = [c for c in [*key, *payload] if c not in without]
    salts = F.lit(parts)
    if share:
        copies = rows.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / share).cast("int").alias("_salts"))
        pivots, rows, salts = pivots.join(copies, key), rows.join(copies, key), F.col("_salts")
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)      # noqa: E731
    held = pivots.select(*key, F.explode(F.sequence(F.lit(0), salts - 1)).alias("_salt"), F.lit(0).alias("_kind"), "pid", "pf",
                         F.col("pr").cast("double").alias("pr"), *[none(kinds[c], c) for c in payload])
    asked = rows.select(*key, F.pmod(F.xxhash64("vid"), salts).cast("int").alias("_salt"), F.lit(1).alias("_kind"),
                        none("bigint", "pid"), none("array<double>", "pf"), none("double", "pr"), *payload)
    order = [*key, "_salt", "_kind"]

    def run(batches):
        now, found = None, []
        for rb in batches:
            marks = list(zip(*(rb.column(c).to_pylist() for c in order)))
            cuts = [0, *(i for i in range(1, len(marks)) if marks[i] != marks[i - 1]), len(marks)]
            for at, to in zip(cuts, cuts[1:]):
                if at == to:
                    continue
                part = rb.slice(at, to - at)
                if marks[at][:-1] != now:
                    now, found = marks[at][:-1], []
                if marks[at][-1] == 0:
                    found.append((part.column("pid").to_numpy(), _rows_of(part.column("pf")), part.column("pr").to_numpy(zero_copy_only=False)))
                    continue
                if len(found) > 1:
                    found = [tuple(np.concatenate(x) for x in zip(*found))]
                if not found:
                    continue
                step = max(1, CELLS_HELD // len(found[0][0]))
                for k in range(0, part.num_rows, step):
                    piece = part.slice(k, step)
                    stay, more = kernel(*found[0], piece)
                    take = pa.array(stay, pa.int64())
                    yield pa.RecordBatch.from_arrays([*(piece.column(c).take(take) for c in kept), *(pa.array(x) for x in more)], [*kept, *extra])

    tasks = [min(parts, TASKS_A_CORE * spark.sparkContext.defaultParallelism)] if share else []
    both = held.unionByName(asked).repartition(*tasks, *key, "_salt").sortWithinPartitions(*order)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in kept), *(f"`{c}` {kind}" for c, kind in extra.items())])
    return both.mapInArrow(run, schema)


def _nearest_pivot(pid, pf, pr, piece):
    d = _distances(_rows_of(piece.column("f")), pf)
    best = d.argmin(1)
    return np.arange(len(d)), [pid[best], d[np.arange(len(d)), best]]


def _near_tops(pid, pf, pr, piece):
    """The tops that may hold a point within each row's bound. A top is left out where the
    triangle inequality, or the hyperplane between it and the row's own top, puts all its
    points beyond the bound."""
    f, ub = _rows_of(piece.column("f")), piece.column("ub").to_numpy()
    own = np.searchsorted(pid[np.argsort(pid)], piece.column("top").to_numpy())
    own = np.argsort(pid)[own]
    return _within(_distances(f, pf), _distances(pf[own], pf), own, pr, ub, pid)


def _near_cells(pid, pf, pr, piece):
    """The cells of one top that may hold a point within each row's bound, but for its own. The
    hyperplanes are those between a cell's pivot and the row's nearest pivot in the top."""
    d = _distances(_rows_of(piece.column("f")), pf)
    best = d.argmin(1)
    rows, (found,) = _within(d, _distances(pf[best], pf), best, pr, piece.column("ub").to_numpy(), pid)
    other = found != piece.column("cell").to_numpy()[rows]
    return rows[other], [found[other]]


def _within(d, between, own, radius, ub, pid):
    mine = d[np.arange(len(d)), own][:, None]
    plane = np.where(between > 0, (d * d - mine * mine) / (2.0 * np.maximum(between, 1e-300)), 0.0)
    least = np.maximum(d - radius[None, :], plane)
    rows, at = np.nonzero(least <= ub[:, None] * (1 + 1e-9) + 1e-9 * (1.0 + mine))
    return rows, [pid[at]]


def _nearest_members(held: int):
    """The ``held`` members of its cell that are nearest to each row, and no farther than the
    row's bound ``ub``; of equal distances the smaller ids. Distances are sums in the order of the coordinates."""
    def kernel(pid, pf, pr, piece):
        f = _rows_of(piece.column("f"))
        square = np.zeros((len(f), len(pid)))
        for j in range(f.shape[1]):
            apart = f[:, j, None] - pf[None, :, j]
            square += apart * apart
        dist = np.sqrt(square)
        most = piece.column("ub").to_numpy()
        if len(pid) > held:
            last = np.partition(dist, held - 1, axis=1)[:, held - 1]
            most = np.where(last < most, last, most)
        rows, at = np.nonzero(~(dist > most[:, None]))
        order = np.lexsort((pid[at], dist[rows, at], rows))
        rows, at = rows[order], at[order]
        begun = np.searchsorted(rows, np.arange(len(f)))
        near = np.arange(len(rows)) - begun[rows] < held
        return rows[near], [pid[at[near]], dist[rows[near], at[near]]]
    return kernel


def _pivots(vectors: DataFrame, g: str, wanted: int | None) -> tuple[DataFrame, DataFrame]:
    """Cell pivots, about the root of a group's points (drawn by hash, so dense regions get more
    of them), and tops, about the root of these: (g, vid, f) each, one at least for a group."""
    sizes = vectors.groupBy(g).agg(F.count(F.lit(1)).alias("_n"), F.min("vid").alias("_least"))
    cells = F.lit(float(wanted)) if wanted else F.ceil(F.sqrt(F.col("_n").cast("double")))

    def drawn(rows, salt, share):
        return rows.where((F.pmod(F.xxhash64(F.col("vid"), F.lit(salt)), F.lit(1 << 30)) < share * (1 << 30)) | (F.col("vid") == F.col("_least")))

    picked = store_table(drawn(vectors.join(sizes, g), 5, cells / F.col("_n")))
    return picked.select(g, "vid", "f"), store_table(drawn(picked, 6, 1.0 / F.sqrt(cells)).select(g, "vid", "f"))


def _as_pivots(rows: DataFrame, key: list[str], radius: Column) -> DataFrame:
    return rows.select(*key, F.col("vid").alias("pid"), F.col("f").alias("pf"), radius.alias("pr"))


def _placed(vectors: DataFrame, g: str, wanted: int | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """vectors (g, vid, f) with top, cell, and their distances; tops and cells as pivots with
    their radii."""
    cells, tops = _pivots(vectors, g, wanted)
    zero = F.lit(0.0)
    by_top = {"top": "bigint", "top_dist": "double"}
    cells = store_table(_meet(_as_pivots(tops, [g], zero), cells, [g], _nearest_pivot, by_top))
    rows = _meet(_as_pivots(tops, [g], zero), vectors, [g], _nearest_pivot, by_top)
    placed = store_table(_meet(_as_pivots(cells, [g, "top"], zero), rows, [g, "top"], _nearest_pivot, {"cell": "bigint", "own": "double"}))
    wide = placed.groupBy(g, F.col("top").alias("vid")).agg(F.max("top_dist").alias("r"))
    round_ = placed.groupBy(g, F.col("cell").alias("vid")).agg(F.max("own").alias("r"))
    return (placed, store_table(_as_pivots(tops.join(wide, [g, "vid"]), [g], F.col("r"))),
            store_table(_as_pivots(cells.join(round_, [g, "vid"]), [g, "top"], F.col("r"))))


def _probes(bounded: DataFrame, g: str, tops: DataFrame, cells: DataFrame) -> DataFrame:
    """(g, vid, f, ub, cell): the other cells that may hold a point within each vector's bound ``ub``."""
    near = _meet(tops, bounded.select(g, "vid", "f", "top", "cell", "ub"), [g], _near_tops, {"near": "bigint"})
    near = near.select(g, F.col("near").alias("top"), "vid", "f", "cell", "ub")
    return _meet(cells, near, [g, "top"], _near_cells, {"other": "bigint"}).select(g, "vid", "f", "ub", F.col("other").alias("cell"))


def knn(points: DataFrame, k: int, query: Column | None = None, group: str | None = None,
        pivots: int | None = None) -> DataFrame:
    """Exact k nearest neighbours (Euclidean) of the query points.

    ``points``: (id long, f array<double>[, group]); neighbours are searched
    among points of the same group, excluding the point itself. Output:
    (id, nbr_rank 1..k, nbr_id, dist) — the k smallest distances are exact;
    among equal distances the smaller id comes first. Points with a missing
    coordinate have no neighbours and are none.

    Equal points are searched once, and only the k + 1 smallest ids of them can
    be anyone's neighbours. The distinct points are dealt to cells by a tree of
    pivots: about √n cell pivots (drawn by hash, so dense regions get more) lie
    below about √√n tops; a point goes to its nearest top and to the nearest cell
    below that. Pivots and points of a key stream past each other in salted tasks,
    so no task and no driver holds all pivots, and any number of groups will do.
    A point meets the members of its own cell first, which bounds its k-th distance
    (a task holds one cell's members and gives out k + 1 pairs a point, not all
    pairs); then the tops, and in those the cells, that the triangle inequality and the hyperplane
    bounds cannot exclude. In few dimensions or on clustered points these are
    few; on uniform points the share of cells met grows with the dimension, up to
    all of them (tests hold it).
    """
    g = group or "_kg"
    pts = points if group else points.withColumn("_kg", F.lit(0))
    ok = F.col("f").isNotNull() & F.forall("f", lambda x: x.isNotNull() & ~F.isnan(x)) & F.col(g).isNotNull()
    pts = pts.where(ok)
    first = Window.partitionBy(g, "f").orderBy("id")
    cand = pts.select(g, "f", "id").withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= k + 1)
    cand = cand.withColumn("vid", F.min("id").over(Window.partitionBy(g, "f"))).drop("_n").checkpoint(eager=True)
    vectors = cand.where(F.col("id") == F.col("vid")).select(g, "vid", "f")
    placed, tops, cells = _placed(vectors, g, pivots)
    members = cand.select(g, F.col("vid").alias("_cv"), F.col("id").alias("pid"), F.col("f").alias("pf"), F.lit(None).cast("double").alias("pr")) \
        .join(placed.select(g, F.col("vid").alias("_cv"), "cell"), [g, "_cv"]).drop("_cv")
    asked = placed if query is None else store_table(_asked(placed, pts, query, g))

    def nearest(rows: DataFrame) -> DataFrame:
        found = _meet(members, rows.select(g, "cell", "vid", "f", "ub"), [g, "cell"], _nearest_members(k + 1),
                      {"nbr_id": "bigint", "dist": "double"}, ROWS_A_SALT, ("cell", "f", "ub"))
        return found.select(g, "vid", "nbr_id", "dist")

    at_home = nearest(asked.withColumn("ub", F.lit(float("inf")))).checkpoint(eager=True)
    bound = at_home.groupBy(g, "vid").agg(F.when(F.count(F.lit(1)) > k, F.max("dist")).otherwise(F.lit(float("inf"))).alias("ub"))
    away = nearest(store_table(_probes(asked.join(bound, [g, "vid"]), g, tops, cells)))
    both = at_home.unionByName(away)
    rank = F.row_number().over(Window.partitionBy(g, "vid").orderBy("dist", "nbr_id"))
    best = both.withColumn("_r", rank).where(F.col("_r") <= k + 1).drop("_r")
    askers = pts if query is None else pts.where(query)
    vid_of = cand.where(F.col("id") == F.col("vid")).select(g, "f", "vid")
    mine = askers.select(g, "f", "id").join(vid_of, [g, "f"]).select(g, "id", "vid").join(best, [g, "vid"]).where(F.col("nbr_id") != F.col("id"))
    rank = F.row_number().over(Window.partitionBy(g, "id").orderBy("dist", "nbr_id"))
    out = mine.withColumn("nbr_rank", rank).where(F.col("nbr_rank") <= k).select(g, "id", "nbr_rank", "nbr_id", "dist").checkpoint(eager=True)
    return out if group else out.drop("_kg")


def _asked(placed: DataFrame, pts: DataFrame, query: Column, g: str) -> DataFrame:
    """The placed vectors that some query point has."""
    return placed.join(pts.where(query).select(g, "f").distinct(), [g, "f"], "left_semi").select(*placed.columns)


# ====================================================================== G2–G4
def _features(df: DataFrame, features: Sequence[str]) -> Column:
    return F.array(*[F.col(c).cast("double") for c in features])


def _class_sizes(df: DataFrame, target: str, k: int) -> DataFrame:
    """(cls, n, short, k_eff) of the classes with fewer rows than the largest, and two at least:
    rows that they lack, and neighbours that a row can have."""
    sizes = df.groupBy(F.col(target).alias("cls")).agg(F.count(F.lit(1)).alias("n"))
    major = sizes.agg(F.max("n").alias("major"))                                     # one row
    return store_table(sizes.crossJoin(F.broadcast(major)).where((F.col("n") < F.col("major")) & (F.col("n") > 1) & F.col("cls").isNotNull()).select(
        "cls", "n", (F.col("major") - F.col("n")).alias("short"), F.least(F.lit(k), F.col("n") - 1).alias("k_eff")))


@dataclass
class NeighbourModel:
    """A fitted SMOTE, ADASYN or borderline SMOTE: ``seeds`` (id, cls, f, n_gen, k_eff) and
    ``neighbours`` (id, nbr_rank, nf), both stored tables."""

    kind: str
    features: list[str]
    target: str
    seed: int
    seeds: DataFrame
    neighbours: DataFrame

    def sample(self) -> DataFrame:
        return _interpolate(self.seeds, self.neighbours, self.features, self.target, self.seed).drop("seed_id", "j")


SEED_BLOCK = 100_000      # synthetic rows of one seed made in one task


def _interpolate(seeds: DataFrame, nbrs: DataFrame, features: Sequence[str], target: str,
                 seed: int, k_col: str = "k_eff") -> DataFrame:
    """seeds: (id, cls, f, n_gen, k_eff); nbrs: (id, nbr_rank, nf). One new row per
    (id, j < n_gen): x + λ·(neighbour − x), neighbour rank and λ from seeded hashes."""
    n = F.col("n_gen").cast("long")
    # a seed's rows go out in blocks, so a few seeds of many rows spread over tasks
    blocks = seeds.where(n > 0).select(
        "id", "cls", "f", n.alias("n_gen"), k_col,
        F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / SEED_BLOCK).cast("long"))).alias("block"))
    blocks = blocks.repartition("id", "block")
    gen = blocks.select("id", "cls", "f", k_col, F.explode(F.sequence(
        F.col("block") * SEED_BLOCK, F.least(F.col("n_gen"), (F.col("block") + 1) * SEED_BLOCK) - 1)).alias("j"))
    gen = gen.withColumn("nbr_rank", (F.floor(hash_uniform(seed, F.col("id"), F.col("j"), F.lit(1))
                                              * F.col(k_col)) + 1).cast("int")) \
             .withColumn("lam", hash_uniform(seed, F.col("id"), F.col("j"), F.lit(2)))
    j = gen.join(nbrs, ["id", "nbr_rank"])
    new = F.zip_with("f", "nf", lambda a, b: a + F.col("lam") * (b - a))
    return j.select(*[F.element_at(new, i + 1).alias(c) for i, c in enumerate(features)],
                    F.col("cls").alias(target), F.col("id").alias("seed_id"), "j")


def _minority_neighbours(pts: DataFrame, k: int) -> DataFrame:
    nb = knn(pts.select("id", "f", "cls"), k, group="cls")
    return nb.join(pts.select(F.col("id").alias("nbr_id"), F.col("f").alias("nf")), "nbr_id") \
        .select("id", "nbr_rank", "nf")


def _points(df: DataFrame, features: Sequence[str], target: str, key: str | None) -> DataFrame:
    rid = F.col(key).cast("long") if key else F.monotonically_increasing_id()
    return df.select(rid.alias("id"), _features(df, features).alias("f"), F.col(target).alias("cls")) \
        .checkpoint(eager=True)


def _quotas(ranked: DataFrame, parts: Column) -> DataFrame:
    """Seeds whose numbers of new rows differ by one at most and sum to what the class lacks;
    ``parts`` is the number of seeds of the class."""
    extra = (F.col("hr") <= F.col("short") % parts).cast("long")
    return ranked.select("id", "cls", "f", (F.floor(F.col("short") / parts).cast("long") + extra).alias("n_gen"), "k_eff")


def fit_smote(df: DataFrame, features: Sequence[str], target: str, k: int = 5, seed: int = 42,
              key: str | None = None) -> NeighbourModel:
    """Every non-majority class grows to the majority count."""
    pts = _points(df, features, target, key)
    mins = pts.join(_class_sizes(df, target, k), "cls")
    seeds = _quotas(hash_rank(mins, ["cls"], "id", seed, out_col="hr"), F.col("n"))
    return NeighbourModel("smote", list(features), target, seed, store_table(seeds), store_table(_minority_neighbours(mins, k)))


def _majority_share(pts: DataFrame, sizes: DataFrame, k: int) -> DataFrame:
    """Per point of the classes of ``sizes``: share of its k nearest neighbours (whole set) of
    another class."""
    asked = sizes.select("cls", F.lit(True).alias("_asked"))
    allp = pts.select("id", "f", "cls").join(asked, "cls", "left").withColumn("_q", F.coalesce("_asked", F.lit(False)))
    nb = knn(allp, k, query=F.col("_q"))
    lab = pts.select(F.col("id").alias("nbr_id"), F.col("cls").alias("ncls"))
    me = pts.select("id", "cls")
    return nb.join(lab, "nbr_id").join(me, "id").groupBy("id", "cls").agg(
        (F.count_if(F.col("ncls") != F.col("cls")) / F.lit(float(k))).alias("ratio"),
        F.count_if(F.col("ncls") != F.col("cls")).alias("n_other"))


def fit_adasyn(df: DataFrame, features: Sequence[str], target: str, k: int = 5, seed: int = 42,
               key: str | None = None) -> NeighbourModel:
    """Quota per minority point proportional to its share of other-class
    neighbours, g_i = rint(r_i / Σr · G)."""
    sizes, pts = _class_sizes(df, target, k), _points(df, features, target, key)
    ratio = store_table(_majority_share(pts, sizes, k))
    tot = ratio.groupBy("cls").agg(F.sum("ratio").alias("rs"))
    seeds = ratio.join(tot.where(F.col("rs") > 0), "cls").join(sizes, "cls").join(pts.select("id", "f"), "id").select(
        "id", "cls", "f", F.bround(F.col("ratio") / F.col("rs") * F.col("short"), 0).cast("long").alias("n_gen"), "k_eff")
    return NeighbourModel("adasyn", list(features), target, seed, store_table(seeds), store_table(_minority_neighbours(pts.join(sizes.select("cls"), "cls"), k)))


def fit_borderline_smote(df: DataFrame, features: Sequence[str], target: str, k: int = 5, m: int = 10,
                         seed: int = 42, key: str | None = None) -> NeighbourModel:
    """SMOTE seeded only from 'danger' points (m/2 <= other-class neighbours < m)."""
    sizes, pts = _class_sizes(df, target, k), _points(df, features, target, key)
    share = _majority_share(pts, sizes, m)
    danger = store_table(share.where((F.col("n_other") >= m / 2.0) & (F.col("n_other") < m)).select("id", "cls"))
    per_class = danger.groupBy("cls").agg(F.count(F.lit(1)).alias("dangers"))
    ranked = hash_rank(danger, ["cls"], "id", seed, out_col="hr").join(sizes, "cls").join(per_class, "cls").join(pts.select("id", "f"), "id")
    seeds = _quotas(ranked, F.col("dangers"))
    return NeighbourModel("borderline_smote", list(features), target, seed, store_table(seeds),
                          store_table(_minority_neighbours(pts.join(per_class.select("cls"), "cls"), k)))


def smote(df: DataFrame, features: Sequence[str], target: str, k: int = 5, seed: int = 42, key: str | None = None) -> DataFrame:
    return fit_smote(df, features, target, k, seed, key).sample()


def adasyn(df: DataFrame, features: Sequence[str], target: str, k: int = 5, seed: int = 42, key: str | None = None) -> DataFrame:
    return fit_adasyn(df, features, target, k, seed, key).sample()


def borderline_smote(df: DataFrame, features: Sequence[str], target: str, k: int = 5, m: int = 10, seed: int = 42,
                     key: str | None = None) -> DataFrame:
    return fit_borderline_smote(df, features, target, k, m, seed, key).sample()


# ====================================================================== S10
def save_generator(model: CopulaModel | NeighbourModel | None, path: str) -> None:
    """Writes a fitted generator under ``path``: its settings, and its tables as Parquet. One
    that isn't fitted is refused."""
    if model is None:
        raise ValueError("the generator is not fitted")
    spark, path = SparkSession.getActiveSession(), path.rstrip("/")
    if isinstance(model, CopulaModel):
        state = {"kind": "gaussian_copula", "model": model.to_json(), "text": model.categories is not None}
        tables = {"categories": model.categories} if model.categories is not None else {}
    else:
        state = {"kind": model.kind, "features": model.features, "target": model.target, "seed": model.seed}
        tables = {"seeds": model.seeds, "neighbours": model.neighbours}
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")
    # written last: a folder without it is not a saved generator
    spark.createDataFrame([(json.dumps(state),)], "state string").coalesce(1).write.mode("overwrite").text(f"{path}/state")


def load_generator(path: str) -> CopulaModel | NeighbourModel:
    spark, path = SparkSession.getActiveSession(), path.rstrip("/")
    state = json.loads(spark.read.text(f"{path}/state").first()[0])
    if state["kind"] == "gaussian_copula":
        return CopulaModel.from_json(state["model"], spark.read.parquet(f"{path}/categories") if state["text"] else None)
    return NeighbourModel(state["kind"], state["features"], state["target"], state["seed"],
                          spark.read.parquet(f"{path}/seeds"), spark.read.parquet(f"{path}/neighbours"))


def save_generators(models: dict[str, CopulaModel | NeighbourModel], folder: str) -> None:
    for name, model in models.items():
        save_generator(model, f"{folder.rstrip('/')}/{name}")


def load_generators(folder: str, names: Sequence[str] | None = None, failed: dict[str, str] | None = None) -> dict:
    """The named generators of a folder (all of them by default). One that cannot be read ends
    the call, unless ``failed`` is given: then it is skipped and its error recorded there."""
    if names is None:
        spark = SparkSession.getActiveSession()
        root = spark._jvm.org.apache.hadoop.fs.Path(folder)
        names = sorted(x.getPath().getName() for x in root.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(root) if x.isDirectory())
    out = {}
    for name in names:
        try:
            out[name] = load_generator(f"{folder.rstrip('/')}/{name}")
        except Exception as exc:  # noqa: BLE001 - recorded for the caller
            if failed is None:
                raise
            failed[name] = f"{type(exc).__name__}: {exc}"
    return out


def sample_generator(model: CopulaModel | NeighbourModel, n: int | None = None, seed: int = 42) -> DataFrame:
    """Synthetic rows of a fitted generator. A neighbour model makes what its classes lack."""
    if isinstance(model, CopulaModel):
        return sample_copula(SparkSession.getActiveSession(), model, model.n_rows if n is None else n, seed).drop("synthetic_id")
    return model.sample()


# ====================================================================== G5 / G6
GENERATORS = ("gaussian_copula", "smote", "adasyn", "borderline_smote")


def generate_all(df: DataFrame, features: Sequence[str], target: str, key: str | None = None,
                 n: int | None = None, seed: int = 42,
                 generators: Sequence[str] = GENERATORS, failed: dict[str, str] | None = None) -> DataFrame:
    """One long table of synthetic rows with a ``generator`` column. A generator that
    fails ends the call, unless ``failed`` is given: then it is skipped and its error
    recorded there under its name."""
    out = None
    cols = list(features) + [target]
    for name in generators:
        try:
            if name == "gaussian_copula":
                g = gaussian_copula(df.select(*cols), n, cols, seed=seed).drop("synthetic_id")
            elif name == "smote":
                g = smote(df, features, target, seed=seed, key=key)
            elif name == "adasyn":
                g = adasyn(df, features, target, seed=seed, key=key)
            else:
                g = borderline_smote(df, features, target, seed=seed, key=key)
            g = g.select(*[F.col(c).cast(df.schema[c].dataType).alias(c) for c in cols]) \
                .withColumn("generator", F.lit(name))
        except Exception as exc:  # noqa: BLE001 - recorded for the caller
            if failed is None:
                raise
            failed[name] = f"{type(exc).__name__}: {exc}"
            continue
        out = g if out is None else out.unionByName(g)
    return out


# The real / synthetic mixes the reference plans to compare.
MIXES = (("real70_synth30", 0.7, 0.3), ("real50_synth50", 0.5, 0.5),
         ("real30_synth70", 0.3, 0.7), ("real0_synth100", 0.0, 1.0))


def mix_real_synthetic(real: DataFrame, synthetic: DataFrame, real_key: str, synth_key: str,
                       total: int | None = None, seed: int = 42, mixes=MIXES) -> DataFrame:
    """For each mix, exact quotas of hash-ranked real and synthetic rows. A side with
    fewer rows than its largest quota is an error, not a short mix."""
    n_real, n_synthetic = real.count(), synthetic.count()
    n = total if total is not None else n_real
    for name, a, b in mixes:
        if int(round(a * n)) > n_real or int(round(b * n)) > n_synthetic:
            raise ValueError(f"{name} needs {int(round(a * n))} real and {int(round(b * n))} synthetic rows; "
                             f"there are {n_real} and {n_synthetic}")
    rr = hash_rank(real, [], real_key, seed, out_col="_hr")
    sr = hash_rank(synthetic, [], synth_key, seed + 1, out_col="_hr")
    out = None
    for name, a, b in mixes:
        qa, qb = int(round(a * n)), int(round(b * n))
        part = rr.where(F.col("_hr") <= qa).select(F.lit(name).alias("strategy"), F.lit("real").alias("origin"),
                                                   *[F.col(c) for c in real.columns]) \
            .unionByName(sr.where(F.col("_hr") <= qb).select(
                F.lit(name).alias("strategy"), F.lit("synthetic").alias("origin"),
                *[F.col(c) for c in synthetic.columns]), allowMissingColumns=True)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out

