"""Elastic-net Cox.

Objective (maximised): logPL(beta)/n - alpha * (l1 * ||beta||_1 + (1 - l1)/2 * ||beta||^2),
Breslow ties, path of ``n_alphas`` geometric alphas from
alpha_max = max|U(0)| / (n * l1) down to alpha_max * alpha_min_ratio; the
model uses the last (smallest) alpha.

Proximal Newton on resident time ranges: one pass linearises the likelihood at
the current vectors of all alphas, each alpha's penalised quadratic model is
solved by coordinate descent on the driver (p x p), and the next pass takes
the alphas that still move.  A step that lowers an alpha's objective is
halved.  ``converged`` tells alphas that still moved by more than ``tol``
after ``max_passes`` passes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .resident import Models, ResidentRows


def _enet_cd(H: np.ndarray, lin: np.ndarray, a1: float, a2: float, b0: np.ndarray,
             iters: int = 10000, tol: float = 1e-13) -> np.ndarray:
    """min_b 1/2 b'Hb - lin'b + a1 ||b||_1 + a2/2 ||b||^2 by coordinate descent."""
    b = b0.copy()
    p = len(b)
    for _ in range(iters):
        mx = 0.0
        for j in range(p):
            rho = lin[j] - (H[j] @ b - H[j, j] * b[j])
            den = H[j, j] + a2
            new = np.sign(rho) * max(abs(rho) - a1, 0.0) / den if den > 0 else 0.0
            mx = max(mx, abs(new - b[j]))
            b[j] = new
        if mx < tol:
            break
    return b


@dataclass
class CoxnetPath:
    features: list
    alphas: np.ndarray
    coefs: np.ndarray            # n_alphas x p
    loglik: np.ndarray           # n_alphas
    null_loglik: float
    passes: int
    converged: np.ndarray        # n_alphas
    gradient: np.ndarray         # n_alphas x p, of the log partial likelihood over n at the solutions
    l1_ratio: float
    cindex: np.ndarray | None = None  # n_alphas, Harrell's C on the training rows

    def kkt_residual(self) -> np.ndarray:
        """For each alpha, how far the solution is from the optimality conditions."""
        a1, a2 = self.alphas[:, None] * self.l1_ratio, self.alphas[:, None] * (1 - self.l1_ratio)
        g = self.gradient - a2 * self.coefs
        at_zero = np.maximum(np.abs(g) - a1, 0.0)
        return np.where(self.coefs == 0, at_zero, np.abs(g - a1 * np.sign(self.coefs))).max(axis=1, initial=0.0)

    @property
    def deviance_ratio(self) -> np.ndarray:
        # deviance = -2 loglik; ratio = 1 - deviance / null deviance
        if self.null_loglik == 0:
            return np.zeros_like(self.loglik)
        return 1.0 - self.loglik / self.null_loglik

    def table(self) -> pd.DataFrame:
        rows = []
        dr = self.deviance_ratio
        for i, a in enumerate(self.alphas):
            for j, f in enumerate(self.features):
                rows.append((i, float(a), float(dr[i]), f, float(self.coefs[i, j]), bool(self.converged[i])))
        return pd.DataFrame(rows, columns=["i", "alpha", "deviance_ratio", "feature", "coef", "converged"])


def fit_path(df: DataFrame, features: list[str], l1_ratio: float = 0.2, n_alphas: int = 100,
             alpha_min_ratio: float = 1e-4, tol: float = 1e-7, max_passes: int = 60,
             time: str = "time", event: str = "event", with_cindex: bool = False) -> CoxnetPath:
    """The whole path, every alpha in every pass until it moves by at most ``tol``.

    ``with_cindex`` adds Harrell's C of each alpha's model on the training rows."""
    rows, p = ResidentRows(df, features, time=time, event=event), len(features)
    n = max(rows.n, 1)

    def models(k):
        return Models(np.zeros(k, int), np.zeros(k), np.zeros(k, bool), np.ones((k, p), bool))

    ll, g, h = rows.evaluate(models(1), np.zeros((1, p)))
    null, g0, h0, passes = float(ll[0]), g[0] / n, h[0] / n, 1
    amax = float(np.max(np.abs(g0), initial=0.0)) / l1_ratio if l1_ratio > 0 else float(np.max(np.abs(g0), initial=0.0)) * 1e3
    alphas = np.geomspace(amax, amax * alpha_min_ratio, n_alphas) if amax > 0 else np.zeros(n_alphas)

    def solve(i, at, grad, hess, start):
        return _enet_cd(hess, hess @ at + grad, alphas[i] * l1_ratio, alphas[i] * (1 - l1_ratio), start)

    def penalty(i, b):
        return alphas[i] * (l1_ratio * np.abs(b).sum() + 0.5 * (1 - l1_ratio) * b @ b)

    coefs, b = np.zeros((n_alphas, p)), np.zeros(p)
    for i in range(n_alphas):  # the first step of every alpha, warm down the path
        coefs[i] = b = solve(i, np.zeros(p), g0, h0, b)
    last, best = np.zeros((n_alphas, p)), np.full(n_alphas, null / n)
    lls, grads = np.full(n_alphas, null), np.tile(g0, (n_alphas, 1))
    converged, left = np.abs(coefs - last).max(axis=1, initial=0.0) <= tol, np.arange(n_alphas)
    left = left[~converged]
    while len(left) and passes < max_passes:
        ll, g, h = rows.evaluate(models(len(left)), coefs[left])
        passes += 1
        for row, i in enumerate(left.tolist()):
            value = ll[row] / n - penalty(i, coefs[i])
            if value < best[i] - 1e-12 * max(1.0, abs(best[i])) and np.abs(coefs[i] - last[i]).max() > tol:
                coefs[i] = 0.5 * (coefs[i] + last[i])
                continue
            best[i], lls[i], grads[i] = value, ll[row], g[row] / n
            new = solve(i, coefs[i], grads[i], h[row] / n, coefs[i])
            converged[i] = np.abs(new - coefs[i]).max() <= tol
            if not converged[i]:  # a converged alpha stays where its likelihood and gradient were taken
                last[i], coefs[i] = coefs[i].copy(), new
        left = left[~converged[left]]
    c = rows.concordance(np.zeros(n_alphas, int), coefs, on="train")["cindex"].to_numpy(float) if with_cindex and rows.n else None
    rows.close()
    return CoxnetPath(features=list(features), alphas=alphas, coefs=coefs, loglik=lls, null_loglik=null, passes=passes,
                      converged=converged, gradient=grads, l1_ratio=l1_ratio, cindex=c)


def pick(path: CoxnetPath, how: str = "last") -> int:
    """Row 62: index of the alpha used: ``last`` (the reference default),
    ``deviance`` (max deviance ratio) or ``concordance`` (every alpha's fit
    scored, max C; the path must have been fitted ``with_cindex``)."""
    if how == "last":
        return len(path.alphas) - 1
    if how == "deviance":
        return int(np.argmax(path.deviance_ratio))
    if how == "concordance":
        return int(np.nanargmax(path.cindex))
    raise ValueError(how)
