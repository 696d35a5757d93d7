import numpy as np
import pandas as pd
import pytest

from riskspark.operators import traffic_light as tl


def _frame(spark, n=1000, seed=3, ties=True):
    rng = np.random.default_rng(seed)
    p = rng.uniform(0.01, 0.9, n)
    if ties:
        p = np.round(p, 2)
    y = (rng.uniform(size=n) < p).astype("int64")
    pdf = pd.DataFrame({"model": "m", "split": "test", "y": y, "p": p})
    return spark.createDataFrame(pdf), pdf


@pytest.mark.parametrize("ties", [True, False])
def test_deciles_match_pandas_qcut(spark, ties):
    df, pdf = _frame(spark, ties=ties)
    got = tl.assign_deciles(df, ["model", "split"]).toPandas().sort_values("p")
    want = pd.qcut(pdf["p"], q=10, labels=False, duplicates="drop") + 1
    merged = pd.DataFrame({"p": pdf["p"], "want": want}).sort_values("p")
    assert list(got["decile"].to_numpy()) == list(merged["want"].astype(int).to_numpy())


def test_deciles_monotone_in_score(spark):
    df, _ = _frame(spark)
    s = tl.decile_summary(df, ["model", "split"]).orderBy("decile").toPandas()
    assert (s["min_prob"].diff().dropna() > 0).all()
    assert s["size"].sum() == 1000


def test_probability_bins_edges(spark):
    # scores on bin edges: 0 goes to bin 0, 0.1 to bin 0 (right-closed), 1.0 to bin 9
    pdf = pd.DataFrame({"model": "m", "split": "s", "y": [0, 1, 1, 0, 1], "p": [0.0, 0.1, 0.10001, 1.0, 1.2]})
    got = tl.tl_probability_bins(spark.createDataFrame(pdf), ["model", "split"]).toPandas()
    sizes = dict(zip(got["group"], got["size"]))
    assert sizes == {0: 2, 1: 1, 9: 1}          # 1.2 is outside [0, 1] and drops out


def test_basel_colours_and_total(spark):
    df, pdf = _frame(spark, n=2000)
    t = tl.tl_basel(df, ["model", "split"]).toPandas()
    body, total = t[t["Decil"] != "TOTAL"], t[t["Decil"] == "TOTAL"]
    assert len(total) == 1 and int(total["Total_Registros"].iloc[0]) == 2000
    assert set(body["Color"]) <= {"Verde", "Amarillo", "Rojo", "Azul Claro", "Azul Marino"}
    counts = total["Color"].iloc[0]
    assert counts.startswith("V:") and "AM:" in counts
    # one decile recomputed by hand
    d = body.iloc[0]
    assert d["Cantidad_1"] + d["Cantidad_0"] == d["Total_Registros"]


def test_one_class_decile_interval_degenerate(spark):
    pdf = pd.DataFrame({"model": "m", "split": "s", "y": [0] * 20, "p": np.linspace(0.1, 0.3, 20)})
    t = tl.basel_deciles(spark.createDataFrame(pdf), ["model", "split"]).toPandas()
    assert (t["ci_lower"] == 0).all() and (t["ci_upper"] == 0).all()


def test_verdict_thresholds(spark):
    rows = [("m", "s", c) for c in ["Verde"] * 7 + ["Rojo"] * 3] + \
           [("n", "s", c) for c in ["Verde"] * 5 + ["Rojo"] * 5] + [("o", "s", "Verde")] * 4
    df = spark.createDataFrame(rows, "model string, split string, color string")
    v = {r.model: r.verdict for r in tl.basel_verdict(df).collect()}
    assert v == {"m": "APROBADO", "n": "ACEPTABLE", "o": "RECHAZADO"}
