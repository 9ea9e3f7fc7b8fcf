"""Descriptive and collinearity operators.

Everything that needs a p x p matrix gets it from one aggregation (S3
Gram); decompositions/solves on that matrix run on the driver, which only
ever sees p x p numbers.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import gram, outer_sum
from .prep import clean, quantiles


def pearson_long(df: DataFrame, cols: list[str]) -> DataFrame:
    """Row 28: Pearson matrix as a long table (feature_a, feature_b, r).

    Each pair takes the rows where both are present.  Columns are centred at
    their means first; counts, sums, squares and products of all pairs come
    from one pass of per-task blocks."""
    p = len(cols)
    means = df.agg(*[F.avg(clean(c)).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    x = [clean(c) - F.lit(float(means[f"m{i}"] or 0.0)) for i, c in enumerate(cols)]
    sides = df.select(*[F.coalesce(v, F.lit(0.0)).alias(f"x{i}") for i, v in enumerate(x)],
                      *[F.coalesce(v * v, F.lit(0.0)).alias(f"q{i}") for i, v in enumerate(x)],
                      *[v.isNotNull().cast("double").alias(f"m{i}") for i, v in enumerate(x)])
    xs, qs, ms = ([f"{k}{i}" for i in range(p)] for k in "xqm")
    out = outer_sum(sides, xs + qs + ms, ms + xs)
    sums, squares, n, products = out[:p, :p], out[p:2 * p, :p], out[2 * p:, :p], out[:p, p:]
    with np.errstate(divide="ignore", invalid="ignore"):
        cov = products - sums * sums.T / n
        var = squares - sums * sums / n
        r = cov / np.sqrt(var * var.T)
    np.fill_diagonal(r, np.where(np.diag(var) > 0, 1.0, np.nan))
    rows = [(a, b, float(r[i, j]) if np.isfinite(r[i, j]) else None)
            for i, a in enumerate(cols) for j, b in enumerate(cols)]
    return df.sparkSession.createDataFrame(rows, "feature_a string, feature_b string, r double")


def covariance(df: DataFrame, cols: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """(covariance with divisor n, means, n) over rows without missing values.

    The means go out in a first pass, so no digits are lost where they are
    large against the spread; the products come from per-task blocks."""
    p = len(cols)
    sub = df.select(*[clean(c).alias(f"x{i}") for i, c in enumerate(cols)]).dropna()
    row = sub.agg(F.count(F.lit(1)).alias("n"), *[F.avg(f"x{i}").alias(f"m{i}") for i in range(p)]).first()
    n, mean = int(row["n"]), np.array([row[f"m{i}"] or 0.0 for i in range(p)])
    centred = sub.select(*[(F.col(f"x{i}") - F.lit(float(mean[i]))).alias(f"x{i}") for i in range(p)])
    names = [f"x{i}" for i in range(p)]
    return outer_sum(centred, names, names) / max(n, 1), mean, n


def correlation_matrix(df: DataFrame, cols: list[str]) -> np.ndarray:
    """Correlation matrix from one Gram pass over centred-by-moment sums."""
    cov, _, _ = covariance(df, cols)
    sd = np.sqrt(np.clip(np.diag(cov), 0, None))
    with np.errstate(divide="ignore", invalid="ignore"):
        return cov / np.outer(sd, sd)


def vif_values(corr: np.ndarray, cond_limit: float = 1e13) -> np.ndarray:
    """Row 29: VIF = diagonal of the inverse correlation matrix; infinite
    when the matrix is numerically singular."""
    if np.linalg.cond(corr) > cond_limit:
        inv = np.linalg.pinv(corr)
        out = np.diag(inv).copy()
        out[np.abs(out) > cond_limit] = np.inf
        return out
    return np.diag(np.linalg.inv(corr))


def vif_band(v: Column) -> Column:
    """Row 30: <= 5 low, 5-10 moderate, >= 10 high."""
    return F.when(v <= 5, "low").when(v < 10, "moderate").otherwise("high")


def vif(df: DataFrame, cols: list[str]) -> DataFrame:
    spark = df.sparkSession
    v = vif_values(correlation_matrix(df, cols))
    out = spark.createDataFrame(pd.DataFrame({"feature": cols, "vif": v.astype(float)}))
    return out.withColumn("band", vif_band(F.col("vif")))


def histogram(df: DataFrame, cols: list[str], bins: int = 100) -> DataFrame:
    """Row 31: equal-width bins per feature between its min and max."""
    row = df.agg(*[F.min(clean(c)).alias(f"lo{i}") for i, c in enumerate(cols)],
                 *[F.max(clean(c)).alias(f"hi{i}") for i, c in enumerate(cols)]).first()
    long = df.select(*[clean(c).alias(c) for c in cols]).unpivot([], cols, "feature", "x") \
        .filter(F.col("x").isNotNull())
    lo = F.create_map(*[e for i, c in enumerate(cols) for e in (F.lit(c), F.lit(row[f"lo{i}"]))])
    hi = F.create_map(*[e for i, c in enumerate(cols) for e in (F.lit(c), F.lit(row[f"hi{i}"]))])
    l, h = lo[F.col("feature")], hi[F.col("feature")]
    b = F.least(F.floor(F.try_divide(F.col("x") - l, h - l) * bins), F.lit(bins - 1)).cast("int")
    return long.groupBy("feature", b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def describe(df: DataFrame, cols: list[str]) -> DataFrame:
    """Row 32: count, mean, sample sd, min, quartiles, max per feature."""
    spark = df.sparkSession
    row = df.agg(*[F.count(clean(c)).alias(f"n{i}") for i, c in enumerate(cols)],
                 *[F.avg(clean(c)).alias(f"m{i}") for i, c in enumerate(cols)],
                 *[F.stddev_samp(clean(c)).alias(f"s{i}") for i, c in enumerate(cols)],
                 *[F.min(clean(c)).alias(f"a{i}") for i, c in enumerate(cols)],
                 *[F.max(clean(c)).alias(f"b{i}") for i, c in enumerate(cols)]).first()
    qs = quantiles(df, cols, [0.25, 0.5, 0.75])
    rows = [(c, int(row[f"n{i}"]), row[f"m{i}"], row[f"s{i}"], row[f"a{i}"], *qs[c], row[f"b{i}"])
            for i, c in enumerate(cols)]
    return spark.createDataFrame(rows, "feature string, count long, mean double, std double, min double, "
                                       "q25 double, q50 double, q75 double, max double")


def status_counts(df: DataFrame, status: str) -> DataFrame:
    """Row 33: value counts of the status column."""
    return df.groupBy(status).agg(F.count(F.lit(1)).alias("n"))


def alpha_grid(lo: float = -4, hi: float = 6, num: int = 100) -> np.ndarray:
    return np.logspace(lo, hi, num)


def ridge_path(df: DataFrame, cols: list[str], y: str, alphas=None) -> pd.DataFrame:
    """Row 34: ``min ||y - Xw||^2 + alpha ||w||^2`` (no intercept) for each
    alpha: one Gram pass, then p x p solves."""
    alphas = alpha_grid() if alphas is None else alphas
    sub = df.select(*[clean(c).alias(f"x{i}") for i, c in enumerate(cols)], F.col(y).cast("double").alias("y")).dropna()
    g, h, _ = gram(sub, [f"x{i}" for i in range(len(cols))], y="y")
    rows = []
    for i, a in enumerate(alphas):
        w = np.linalg.solve(g + a * np.eye(len(cols)), h)
        rows += [(i, float(np.log10(a)), c, float(w[j])) for j, c in enumerate(cols)]
    return pd.DataFrame(rows, columns=["i", "log10_alpha", "feature", "coef"])


def lasso_cd(g: np.ndarray, h: np.ndarray, n: float, alpha: float, w0=None, l1_ratio: float = 1.0,
             max_iter: int = 10000, tol: float = 1e-10) -> np.ndarray:
    """Covariance-form coordinate descent for
    ``1/(2n)||y - Xw||^2 + alpha*l1*||w||_1 + alpha*(1-l1)/2*||w||^2``."""
    p = len(h)
    w = np.zeros(p) if w0 is None else w0.copy()
    for _ in range(max_iter):
        mx = 0.0
        for j in range(p):
            if g[j, j] == 0:
                continue
            rho = (h[j] - g[j] @ w + g[j, j] * w[j]) / n
            z = g[j, j] / n + alpha * (1 - l1_ratio)
            new = np.sign(rho) * max(abs(rho) - alpha * l1_ratio, 0.0) / z
            mx = max(mx, abs(new - w[j]))
            w[j] = new
        if mx < tol:
            break
    return w


def lasso_path(df: DataFrame, cols: list[str], y: str, alphas=None) -> pd.DataFrame:
    """Row 35: Lasso path on the same grid, warm-started from large alpha."""
    alphas = alpha_grid() if alphas is None else alphas
    sub = df.select(*[clean(c).alias(f"x{i}") for i, c in enumerate(cols)], F.col(y).cast("double").alias("y")).dropna()
    g, h, n = gram(sub, [f"x{i}" for i in range(len(cols))], y="y")
    rows, w = [], None
    order = np.argsort(-np.asarray(alphas))
    for i in order:
        w = lasso_cd(g, h, n, float(alphas[i]), w)
        rows += [(int(i), float(np.log10(alphas[i])), c, float(w[j])) for j, c in enumerate(cols)]
    return pd.DataFrame(rows, columns=["i", "log10_alpha", "feature", "coef"])


def _minka_ll(spectrum: np.ndarray, rank: int, n: int) -> float:
    """Minka (2000) Laplace approximation of the PCA evidence for ``rank``."""
    p = len(spectrum)
    if spectrum[rank - 1] < 1e-15:
        return -np.inf
    pu = -rank * math.log(2.0)
    for i in range(1, rank + 1):
        pu += math.lgamma((p - i + 1) / 2.0) - math.log(math.pi) * (p - i + 1) / 2.0
    pl = -np.sum(np.log(spectrum[:rank])) * n / 2.0
    v = max(1e-15, np.sum(spectrum[rank:]) / (p - rank))
    pv = -math.log(v) * n * (p - rank) / 2.0
    m = p * rank - rank * (rank + 1.0) / 2.0
    pp = math.log(2.0 * math.pi) * (m + rank) / 2.0
    lam = spectrum.copy()
    lam[rank:] = v
    pa = 0.0
    for i in range(rank):
        for j in range(i + 1, p):
            pa += math.log((spectrum[i] - spectrum[j]) * (1.0 / lam[j] - 1.0 / lam[i])) + math.log(n)
    return pu + pl + pv + pp - pa / 2.0 - rank * math.log(n) / 2.0


class PCA:
    """Rows 36-37: covariance eigen-decomposition from one Gram pass;
    rank by Minka's MLE when n >= p, then truncated at the first k whose
    cumulative explained ratio (each rounded to 8 decimals) reaches
    ``threshold`` (all components when that k <= 5 or the total stays
    below).  Scores are centred, component signs fixed so the largest
    absolute loading is positive."""

    def __init__(self, threshold: float = 0.95):
        self.threshold = threshold

    def fit(self, df: DataFrame, cols: list[str]) -> "PCA":
        self.cols = list(cols)
        p = len(cols)
        cov, self.mean, n = covariance(df, cols)
        cov = cov * n / (n - 1)
        vals, vecs = np.linalg.eigh(cov)
        o = np.argsort(vals)[::-1]
        vals, vecs = np.clip(vals[o], 0, None), vecs[:, o]
        for j in range(p):
            if vecs[np.argmax(np.abs(vecs[:, j])), j] < 0:
                vecs[:, j] *= -1
        if n >= p and p > 1:
            ll = [_minka_ll(vals, r, int(n)) for r in range(1, p)]
            rank = int(np.argmax(ll)) + 1
        else:
            rank = p
        ratio = vals / vals.sum()
        vals, vecs, ratio = vals[:rank], vecs[:, :rank], ratio[:rank]
        cum = np.cumsum(np.round(ratio, 8))
        hit = np.flatnonzero(cum >= self.threshold)
        k = rank if (ratio.sum() <= self.threshold or len(hit) == 0) else int(hit[0]) + 1
        if k <= 5:
            k = rank
        self.explained_variance = vals[:k]
        self.explained_ratio = ratio[:k]
        self.components = vecs[:, :k]
        self.n = n
        return self

    def columns(self) -> dict[str, Column]:
        out = {}
        for j in range(self.components.shape[1]):
            e = None
            for i, c in enumerate(self.cols):
                t = (clean(c) - F.lit(float(self.mean[i]))) * F.lit(float(self.components[i, j]))
                e = t if e is None else e + t
            out[f"feature_{j}"] = e
        return out
