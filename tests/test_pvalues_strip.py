"""p values of the screens, the paired Wilcoxon test, the ROC area and the time-ordered strip, against brute force."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hazardflow.operators import aggregate, screen
from hazardflow.sources.tables import write_table


def student_p(t, dof):
    u = np.linspace(0, abs(t), 200_001)
    f = np.exp(math.lgamma((dof + 1) / 2) - math.lgamma(dof / 2)) / math.sqrt(math.pi * dof) * (1 + u * u / dof) ** (-(dof + 1) / 2)
    return 1 - 2 * np.trapezoid(f, u)


def ranks(x):
    x = np.asarray(x)
    return np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    n = 120
    a, b = rng.integers(0, 9, n).astype(float), rng.integers(0, 9, n).astype(float)
    b[::11] = np.nan
    pdf = pd.DataFrame({"id": np.arange(n), "a": a, "b": b, "flat": 1.0, "time": rng.integers(1, 12, n).astype(float) + a / 4,
                        "event": (rng.random(n) < 0.4).astype(int)})
    return spark.createDataFrame(pdf).repartition(5), pdf


def test_screen_pvalues(rows):
    df, pdf = rows
    got = {(r["method"], r["feature"]): r for r in screen.screen_pvalues(df, ["a", "b", "flat"], "time").collect()}
    for c in ("a", "b"):
        ok = pdf[c].notna()
        x, y, n = pdf[c][ok].to_numpy(), pdf.time[ok].to_numpy(), int(ok.sum())
        for method, u, v in (("PEAS", x, y), ("SPM", ranks(x), ranks(y))):
            r = np.corrcoef(u, v)[0, 1]
            assert got[method, c]["n"] == n
            assert got[method, c]["p"] == pytest.approx(student_p(r * math.sqrt((n - 2) / (1 - r * r)), n - 2), abs=1e-7)
        assert got["ANVF", c]["p"] == pytest.approx(got["PEAS", c]["p"], abs=1e-9)
        assert got["LR", c]["p"] == got["PEAS", c]["p"]
    assert got["PEAS", "flat"]["p"] is None


def test_two_sample_pvalues(rows):
    df, pdf = rows
    got = screen.two_sample_pvalues(df, ["a"]).first()
    x, y = pdf.a[pdf.event > 0].to_numpy(), pdf.a[pdf.event <= 0].to_numpy()
    s, t = x.var(ddof=1) / len(x), y.var(ddof=1) / len(y)
    dof = (s + t) ** 2 / (s * s / (len(x) - 1) + t * t / (len(y) - 1))
    assert got["welch_dof"] == pytest.approx(dof)
    assert got["welch_p"] == pytest.approx(student_p((x.mean() - y.mean()) / math.sqrt(s + t), dof), abs=1e-7)
    assert got["ranksum_p"] == pytest.approx(math.erfc(abs(got["ranksum_z"]) / math.sqrt(2)))


def test_signed_rank(spark, rows):
    df, pdf = rows
    got = {(r["a"], r["b"]): r for r in screen.signed_rank(df, [("a", "b"), ("b", "time"), ("a", "a")]).collect()}
    for a, b in (("a", "b"), ("b", "time")):
        d = (pdf[a] - pdf[b]).dropna()
        d = d[d != 0].to_numpy()
        r, n = ranks(np.abs(d)), len(d)
        ties = sum(c ** 3 - c for c in np.unique(np.abs(d), return_counts=True)[1].tolist())
        z = (r[d > 0].sum() - n * (n + 1) / 4) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)
        assert (got[a, b]["n"], got[a, b]["w_plus"], got[a, b]["w_minus"]) == (n, r[d > 0].sum(), r[d < 0].sum())
        assert got[a, b]["z"] == pytest.approx(z)
        assert got[a, b]["p"] == pytest.approx(math.erfc(abs(z) / math.sqrt(2)))
    assert got["a", "a"]["n"] == 0 and got["a", "a"]["p"] is None  # every difference is zero
    assert screen.signed_rank(df.limit(0), [("a", "b")]).first()["n"] == 0


def test_roc_auc(rows):
    df, pdf = rows
    got = aggregate.roc_auc(df.select("a", "event"), "a", "event").first()
    x, y = pdf.a[pdf.event > 0].to_numpy(), pdf.a[pdf.event <= 0].to_numpy()
    won = (x[:, None] > y).sum() + (x[:, None] == y).sum() / 2
    assert got["auc"] == pytest.approx(won / len(x) / len(y))
    assert aggregate.roc_auc(df.where("event = 1"), "a", "event").first()["auc"] is None


def test_risk_strip_in_files(spark, rows, tmp_path):
    df, pdf = rows
    strip = aggregate.risk_strip(df.select("id", "time", "event", F.col("a").alias("risk_score")), "id")
    write_table(strip, str(tmp_path / "strip"), order_by=["position"])
    files = sorted((tmp_path / "strip").glob("part-*.parquet"))
    held = pd.concat([pd.read_parquet(f) for f in files], ignore_index=True)
    assert held.position.tolist() == list(range(len(pdf)))
    assert held.id.tolist() == pdf.sort_values(["time", "event", "id"]).id.tolist()
