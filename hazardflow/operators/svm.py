"""Survival SVMs.

Risk score s = w.x, trained so that s_i > s_j for comparable pairs (i an
event, j later; or j censored at the same time), i.e. higher score =
higher risk, the same orientation as Cox and the C-index.

Objective: 1/2 ||w||^2 + alpha/2 * (r * sum_pairs max(0, 1 - s_i + s_j)^2
+ (1 - r) * sum_rows residual^2), r = ``rank_ratio``.  A residual is log
time against b - s, one-sided for censored rows.  The pairs' loss may be the
hinge instead (smoothed, with continuation), the penalty the L1 norm
(proximal Newton with a line search).

Every pass takes its sums over the active pairs from ``pairs.PairRows``
(exact, no pair list, O(p) columns a row) and tries several steps at once.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pairs import PairRows


class PairStats:
    """Loss, gradient and Hessian of sum_active (1 - s_i + s_j)^2 over the
    comparable pairs with s_j > s_i - 1 + shift."""

    def __init__(self, data: DataFrame, p: int, cap=None, share: int = 1):
        """``share``: ``data`` is about one row in that many, and the sums are scaled to those of all rows."""
        self.p, self.share = p, share
        self.rows = PairRows(data, p, cap)

    def __call__(self, w: np.ndarray, shift: float = 0.0):
        r = self.at([(w, shift, 0.0)])[0]
        return r.square, r.square_grad, r.square_hess, r.count

    def at(self, points, residuals: bool = False):
        """The sums at several (w, shift, intercept), from one pass over the rows."""
        got = self.rows.evaluate([[*w, shift, b] for w, shift, b in points], residuals)
        return [r.scaled(self.share) for r in got] if self.share > 1 else got

    def close(self):
        self.rows.close()


@dataclass
class SVMResult:
    coef: np.ndarray
    objective: float
    iterations: int
    active_pairs: float
    converged: bool
    intercept: float = 0.0


def _prepare(df: DataFrame, features: list[str], time: str, event: str) -> DataFrame:
    return df.select(F.col(time).cast("double").alias("time"), F.col(event).cast("int").alias("_e"),
                     *[F.col(f"`{c}`").cast("double").alias(f"_x{k}") for k, c in enumerate(features)]).dropna()


#: Newton steps of one smoothing level of the hinge, after which the fit counts as unsolved.
HINGE_STEPS = 200
#: Step lengths tried by one pass; the next pass goes on from the last by the same factors.
TRIES = (1.0, 0.5, 0.25, 0.125)
LEAST_TRY = 1e-10
FAR = 16.0


#: Distinct rows of the smallest share (one block) whose minimum starts the fit of a large input, and how much
#: larger each next share is.  Shares decide how many passes the whole input takes, not the minimum.
START_ROWS = 12_288
SHARE_GROWTH = 16


def _descend(evaluate, direction, start, limit: int, tol: float, by_value: bool = False, near: bool = False,
             length=None):
    """Minimise by damped Newton steps: ``evaluate`` gives (objective, ...) at several points,
    ``direction`` the step and its slope at one.

    Returns (point, values there, steps, converged).  Of the step lengths tried in one pass the one
    of least objective among those of sufficient decrease is taken.  Decreases below the rounding of
    the objective are not told apart; ``by_value`` stops there.  ``near``: the start is near the minimum, full steps
    are tried first.  ``length`` tells how far a step moves the margins: step lengths that move them by more than
    FAR are passed over, as a Hessian without an active pair in its band gives steps as long as the pairs are many."""
    at, cur = start, evaluate([start])[0]
    for taken in range(limit + 1):
        step, slope = direction(at, cur)
        noise = 1e-12 * max(1.0, abs(cur[0]))
        if np.max(np.abs(step)) < tol or (by_value and -0.5 * slope < noise):
            return at, cur, taken, True
        if taken == limit:
            break
        scale, best = 1.0, None
        while length and np.isfinite(far := length(cur, scale * step)) and far > FAR:
            scale *= TRIES[-1] / 2
        least = scale * LEAST_TRY
        while best is None and scale >= least:
            tries = [scale * t for t in (TRIES if (by_value and not near) or scale < 1 else TRIES[:1])]
            found = evaluate([at + t * step for t in tries])
            good = [i for i, t in enumerate(tries) if found[i][0] <= cur[0] + 1e-4 * t * slope + noise]
            if good:
                best = min(good, key=lambda i: (found[i][0], i))
                at, cur = at + tries[best] * step, found[best]
            scale = tries[-1] / 2
        if best is None:  # no decrease along a descent direction
            return at, cur, taken, bool(-0.5 * slope < noise)
    return at, cur, limit, False


def _newton(at, cur):
    grad, hess = cur[1:3]
    step = -np.linalg.solve(hess + 1e-9 * np.eye(len(grad)), grad)
    return step, grad @ step


def fit_rank_svm(df: DataFrame, features: list[str], alpha: float = 1.0, loss: str = "squared_hinge",
                 penalty: str = "l2", max_iter: int = 20, tol: float = 1e-8, time: str = "time",
                 event: str = "event", cap=None, rank_ratio: float = 1.0, fit_intercept: bool = False) -> SVMResult:
    """Rows 63/64/65/72: survival SVM on the comparable pairs, mixed with a regression of log time.

    ``rank_ratio`` below 1 needs the squared hinge, the L2 penalty and positive times; only it has an
    intercept, which is not penalised.  ``converged`` is False where a limit on the steps was reached
    first.  The hinge is solved to tolerance at every smoothing level, with up to
    ``max(max_iter, HINGE_STEPS)`` steps a level; the last level is 0.01."""
    if not 0 <= rank_ratio <= 1:
        raise ValueError("rank_ratio must be in [0, 1]")
    if (penalty, loss) not in {("l2", "squared_hinge"), ("l2", "hinge"), ("l1", "squared_hinge")}:
        raise ValueError(f"unsupported penalty/loss: {penalty}/{loss}")
    if rank_ratio < 1 and (penalty, loss) != ("l2", "squared_hinge"):
        raise ValueError("rank_ratio below 1 goes with the squared hinge and the l2 penalty")
    if fit_intercept and rank_ratio == 1:
        raise ValueError("pairs of scores don't determine an intercept")
    d = _prepare(df, features, time, event)
    if rank_ratio < 1 and d.where("time <= 0").limit(1).count():
        raise ValueError("rank_ratio below 1 takes the log of the times, which must be positive")
    p, m = len(features), len(features) + int(fit_intercept)
    stats = PairStats(d, p, cap)

    def solve(stats, start):
        """(point, values there, steps, converged) on the rows of ``stats``; without a start from zero."""
        at, near = np.zeros(m) if start is None else start, start is not None
        if loss == "hinge":
            steps, converged = 0, True
            for delta in (0.01,) if near else (1.0, 0.1, 0.01):
                def hinge(ws, delta=delta):
                    return [(0.5 * w @ w + alpha * f, w + alpha * g, np.eye(p) + alpha * h, n, spread)
                            for w, (f, g, h, n, spread) in zip(ws, _smoothed(stats, ws, delta), strict=True)]

                at, cur, more, solved = _descend(hinge, _newton, at, max(max_iter, HINGE_STEPS), tol, by_value=True,
                                                 near=near, length=lambda cur, step: math.sqrt(step @ cur[4] @ step))
                steps, converged = steps + more, converged and solved
            return at, cur, steps, converged
        if penalty == "l1":
            def lasso(ws):
                return [(np.abs(w).sum() + 0.5 * alpha * r.square, 0.5 * alpha * r.square_grad,
                         0.5 * alpha * r.square_hess + 1e-9 * np.eye(p), r.count)
                        for w, r in zip(ws, stats.at([(w, 0.0, 0.0) for w in ws]), strict=True)]

            def proximal(w, cur):
                new = _l1_quadratic_cd(cur[2], cur[1], w, 1.0)
                return new - w, cur[1] @ (new - w) + np.abs(new).sum() - np.abs(w).sum()

            return _descend(lasso, proximal, at, max_iter, tol)

        def mixed(points):
            w, b = [v[:p] for v in points], [v[p] if fit_intercept else 0.0 for v in points]
            got = stats.at([(w[i], 0.0, b[i]) for i in range(len(w))], residuals=rank_ratio < 1)
            out = []
            for v, r in zip(w, got, strict=True):
                grad, hess = (1 - rank_ratio) * r.residual_grad, (1 - rank_ratio) * r.residual_hess
                grad[:p] += rank_ratio * r.square_grad
                hess[:p, :p] += rank_ratio * r.square_hess
                f = rank_ratio * r.square + (1 - rank_ratio) * r.residual
                grad, hess = 0.5 * alpha * grad, 0.5 * alpha * hess
                grad[:p] += v
                hess[:p, :p] += np.eye(p)
                out.append((0.5 * v @ v + 0.5 * alpha * f, grad[:m], hess[:m, :m], r.count))
            return out

        return _descend(mixed, _newton, at, max_iter, tol)

    try:
        start, share, before = None, stats.rows.n // START_ROWS, 0
        while loss == "hinge" and share >= 4:
            part = PairStats(d.where(F.pmod(F.xxhash64(F.lit(share), *d.columns), F.lit(share)) == 0), p, cap, share)
            try:
                start, _, more, _ = solve(part, start)
                before += more
            finally:
                part.close()
            share //= SHARE_GROWTH
        at, cur, steps, converged = solve(stats, start)
        return SVMResult(at[:p], float(cur[0]), before + steps, cur[3], converged, float(at[p]) if fit_intercept else 0.0)
    finally:
        stats.close()


def predicted_time(result: SVMResult, features: list[str]) -> Column:
    """exp(b - s): the time that a fit with ``rank_ratio`` below 1 predicts."""
    s = F.lit(float(result.intercept))
    for c, w in zip(features, result.coef, strict=True):
        s = s - F.col(f"`{c}`").cast("double") * F.lit(float(w))
    return F.exp(s)


def _smoothed(stats: PairStats, ws, delta):
    """Huber-smoothed hinge over the comparable pairs, z = s_i - s_j:
    0 for z >= 1, (1-z)^2/(2 delta) for 1-delta < z < 1, 1 - z - delta/2
    for z <= 1-delta: squares over z < 1 less those over z < 1 - delta, whose
    plain margins make the linear part.  (value, gradient, Hessian, pairs, mean outer product of the pairs' differences) each."""
    got = stats.at([(w, shift, 0.0) for w in ws for shift in (0.0, delta)])
    return [((a.square - b.square) / (2 * delta) + b.linear - b.count * delta / 2,
             (a.square_grad - b.square_grad) / (2 * delta) + b.linear_grad,
             (a.square_hess - b.square_hess) / (2 * delta), a.count, a.square_hess / (2 * max(a.count, 1.0))) for a, b in zip(got[::2], got[1::2], strict=True)]


def _smoothed_hinge(stats: PairStats, w, delta):
    return _smoothed(stats, [w], delta)[0][:4]


def _l1_quadratic_cd(H, g, w0, lam, iters=1000, tol=1e-12):
    """min_w g'(w - w0) + 1/2 (w - w0)' H (w - w0) + lam ||w||_1."""
    w = w0.copy()
    p = len(w)
    b = H @ w0 - g
    for _ in range(iters):
        mx = 0.0
        for j in range(p):
            rho = b[j] - (H[j] @ w - H[j, j] * w[j])
            new = np.sign(rho) * max(abs(rho) - lam, 0.0) / H[j, j]
            mx = max(mx, abs(new - w[j]))
            w[j] = new
        if mx < tol:
            break
    return w


# -- kernels as explicit feature maps (row 66) -----------------------------------


def feature_map(df: DataFrame, features: list[str], kernel: str = "rbf", degree: int = 2,
                gamma: float | None = None, n_components: int = 32, seed: int = 0) -> tuple[DataFrame, list[str]]:
    """Explicit features for the kernel SVM: linear, cosine (row-normalised),
    poly (all monomials up to ``degree``), rbf (random Fourier features,
    Rahimi & Recht 2007).  The sigmoid and precomputed kernels have no
    finite explicit map and are rejected."""
    x = [F.col(f"`{c}`").cast("double") for c in features]
    if kernel == "linear":
        return df.select("*", *[v.alias(f"phi{k}") for k, v in enumerate(x)]), [f"phi{k}" for k in range(len(x))]
    if kernel == "cosine":
        norm = F.sqrt(sum(v * v for v in x))
        cols = [F.when(norm > 0, v / norm).otherwise(0.0) for v in x]
        return df.select("*", *[v.alias(f"phi{k}") for k, v in enumerate(cols)]), [f"phi{k}" for k in range(len(x))]
    if kernel == "poly":
        import itertools
        cols = []
        for dgr in range(1, degree + 1):
            for combo in itertools.combinations_with_replacement(range(len(x)), dgr):
                t = None
                for i in combo:
                    t = x[i] if t is None else t * x[i]
                cols.append(t)
        return df.select("*", *[v.alias(f"phi{k}") for k, v in enumerate(cols)]), [f"phi{k}" for k in range(len(cols))]
    if kernel == "rbf":
        p = len(x)
        g = 1.0 / p if gamma is None else gamma
        rng = np.random.default_rng(seed)
        W = rng.normal(scale=math.sqrt(2 * g), size=(n_components, p))
        b = rng.uniform(0, 2 * math.pi, size=n_components)
        cols = []
        for r in range(n_components):
            t = F.lit(float(b[r]))
            for k in range(p):
                t = t + x[k] * F.lit(float(W[r, k]))
            cols.append(F.lit(math.sqrt(2.0 / n_components)) * F.cos(t))
        return df.select("*", *[v.alias(f"phi{k}") for k, v in enumerate(cols)]), [f"phi{k}" for k in range(n_components)]
    raise ValueError(f"kernel {kernel!r} has no explicit feature map here")
