"""The cumulative score table against plain numpy, and what its plans read."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskspark.operators import evaluate as ev
from riskspark.operators import score_table as st
from riskspark.operators import traffic_light as tl


def rows(seed, n=900, sides=4):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        g = rng.choice(["a", "b", None])
        p = rng.choice([rng.random(), round(rng.random(), 2), 0.5])
        out.append((i, g, rng.choice([f"s{k}" for k in range(sides)]), int(rng.random() < p), p))
    return out + [(n, "a", "s1", 1, float("nan")), (n + 1, "a", "s1", 0, None), (n + 2, "c", "s0", 1, 0.3), (n + 3, "c", "s2", 0, 0.3),
                  (n + 4, "d", "s2", 0, 0.3)]


def frame(spark, data):
    return spark.createDataFrame(data, "k long, g string, s string, y int, p double").repartition(5)


def psi(e, a, bins=10):
    edges = np.linspace(min(e.min(), a.min()), max(e.max(), a.max()), bins + 1)
    he, ha = (np.histogram(x, edges)[0] / len(x) if edges[0] < edges[-1] else np.eye(1, bins, bins - 1)[0] for x in (e, a))
    he, ha = np.where(he == 0, 1e-6, he), np.where(ha == 0, 1e-6, ha)
    return float(((ha - he) * np.log(ha / he)).sum())


@pytest.mark.parametrize("seed", [1, 2])
def test_psi_by_edges_equals_histograms(spark, seed):
    data = rows(seed)
    got = {(r.g, r.s): r.psi for r in ev.psi_pooled(frame(spark, data), ["g"], "s", "s0").collect()}
    scores = {}
    for _, g, s, _, p in data:
        if p is not None and p == p:
            scores.setdefault((g, s), []).append(p)
    want = {(g, s): (psi(np.array(scores[g, "s0"]), np.array(v)) if (g, "s0") in scores else None) for (g, s), v in scores.items() if s != "s0"}
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] is None if v is None else got[k] == pytest.approx(v, abs=2e-6)


def test_psi_joins_edges_only(spark):
    """Continuous scores: what the joins give out are sides x edges, not sides x scores."""
    rng = random.Random(3)
    df = spark.createDataFrame([(f"s{i % 6}", rng.random()) for i in range(6000)], "s string, p double")
    table = st.score_table(df, [], None, "p", "s", "s0")
    assert table.edges.count() == 5 * 9
    sides = F.explode(F.array(F.col("compared"), F.lit("s0"))).alias("s")
    asked = table.edges.select(sides, F.col("e").alias("p")).distinct()
    other, on = st.same(table.rows, asked, ["s", "p"])
    assert table.rows.join(other, on).count() == asked.count() <= 2 * 5 * 9
    assert ev.psi_pooled(table, [], "s", "s0").count() == 5


def test_one_table_serves_all_metrics(spark, tmp_path):
    path = str(tmp_path / "scores")
    frame(spark, [r for r in rows(5) if r[1] is not None]).write.parquet(path)
    df = spark.read.parquet(path)
    table = st.score_table(df, ["g"], "y", "p", "s", "s0")
    by = ["g", "s"]
    alike = [(ev.curve_metrics(table, by), ev.curve_metrics(df, by)), (tl.tl_probability_bins(table, by), tl.tl_probability_bins(df, by)),
             (tl.tl_basel(table, by), tl.tl_basel(df, by)), (tl.tl_all_models(table, by), tl.tl_all_models(df, by)),
             (tl.tl_range_midpoint(table, by), tl.tl_range_midpoint(df, by)), (ev.psi_pooled(table, ["g"], "s"), ev.psi_pooled(df, ["g"], "s", "s0"))]
    for a, b in alike:
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    with pytest.raises(ValueError):
        ev.curve_metrics(table, ["g"])
    for out in (ev.evaluate_models(df, ["g"], "s", "s0"), tl.tl_all_models(df, by)):
        assert path not in out._jdf.queryExecution().executedPlan().toString()      # read before, once, into the stored table


@pytest.mark.parametrize("seed", [1, 4])
def test_population_stability_equals_numpy(spark, seed):
    data = [(k, g, "expected" if s < "s2" else "actual", y, p) for k, g, s, y, p in rows(seed)]
    got = {r.g: r for r in ev.population_stability(frame(spark, data), ["g"], "s").collect()}
    scores = {}
    for _, g, s, _, p in data:
        if p is not None and p == p:
            scores.setdefault(g, {}).setdefault(s, []).append(p)
    assert got.keys() == {g for g, v in scores.items() if len(v) == 2}
    for g, r in got.items():
        e, a = (np.array(scores[g][s]) for s in ("expected", "actual"))
        for x, name in ((e, "expected"), (a, "actual")):
            for f, stat in ((np.mean, "mean"), (np.std, "std"), (np.min, "min"), (np.max, "max"), (np.median, "median")):
                assert r[f"{name}_{stat}"] == pytest.approx(f(x), abs=2e-6)
        pool = np.unique(np.concatenate([e, a]))
        ks = max(abs((e <= v).mean() - (a <= v).mean()) for v in pool)
        assert r.ks_statistic == pytest.approx(ks, abs=2e-6)


def test_empty_scores(spark):
    df = frame(spark, rows(1)).limit(0)
    assert ev.evaluate_models(df, ["g"], "s", "s0").count() == 0
    assert ev.population_stability(df, ["g"], "s").count() == 0
    assert tl.tl_all_models(df, ["g", "s"]).count() == 0


def test_edges_that_are_scores_of_both_sides(spark):
    """Marks at the very scores: PSI equals histograms, and the other metrics do not see the marks."""
    rng = random.Random(9)
    data = [(i, "a", f"s{i % 3}", int(rng.random() < 0.4), rng.randrange(11) / 10 if i > 40 else [0.0, 1.0][i % 2]) for i in range(900)]
    df = frame(spark, data)
    table = st.score_table(df, ["g"], "y", "p", "s", "s0")
    scores = {s: np.array([r[4] for r in data if r[2] == s]) for s in ("s0", "s1", "s2")}
    for r in ev.psi_pooled(table, ["g"], "s", "s0").collect():
        assert r.psi == pytest.approx(psi(scores["s0"], scores[r.s]), abs=2e-6)
    by = ["g", "s"]
    for metric in (ev.curve_metrics, tl.tl_probability_bins, tl.tl_basel):
        assert sorted(map(str, metric(table, by).collect())) == sorted(map(str, metric(df, by).collect()))
