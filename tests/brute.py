"""Brute-force numpy references used by the tests (O(n^2), tiny inputs only)."""

import numpy as np


def harrell(t, e, s, w=None):
    n = len(t)
    w = np.ones(n) if w is None else w
    num = den = 0.0
    for i in range(n):
        if not e[i]:
            continue
        for j in range(n):
            if j == i:
                continue
            if t[j] > t[i] or (t[j] == t[i] and not e[j]):
                den += w[i]
                if s[j] < s[i]:
                    num += w[i]
                elif s[j] == s[i]:
                    num += 0.5 * w[i]
    return num / den


def km(t, e, reverse=False):
    ut = np.unique(t)
    out = []
    s = 1.0
    for u in ut:
        n = np.sum(t >= u)
        d = np.sum((t == u) & e)
        c = np.sum((t == u) & ~e)
        if reverse:
            n, d = n - d, c
        s *= (1 - d / n) if d > 0 else 1.0
        out.append((u, s))
    return out


def step(table, x, default=1.0):
    v = default
    for u, s in table:
        if u <= x:
            v = s
    return v


def uno(t, e, s, tau=None):
    g = km(t, e, reverse=True)
    w = np.array([1.0 / step(g, ti) ** 2 if ei else 0.0 for ti, ei in zip(t, e)])
    if tau is not None:
        w = np.where(t < tau, w, 0.0)
    return harrell(t, e, s, w)


def dyn_auc(t, e, s, times):
    g = km(t, e, reverse=True)
    res = []
    for tau in times:
        case = (t <= tau) & e
        ctrl = t > tau
        num = den = 0.0
        for i in np.flatnonzero(case):
            wi = 1.0 / step(g, t[i])
            for j in np.flatnonzero(ctrl):
                den += wi
                num += wi * (1.0 if s[i] > s[j] else 0.5 if s[i] == s[j] else 0.0)
        res.append(num / den)
    sv = [step(km(t, e), x) for x in times]
    prev = [1.0] + sv[:-1]
    mean = sum(a * (p - c) for a, p, c in zip(res, prev, sv)) / (1 - sv[-1])
    return np.array(res), mean
