"""Univariate screens and selection votes.

Rows are unpivoted to (feature, x, y) once; every statistic is an
aggregation grouped by feature, so all features are screened in the same
pass.  Ranks (Spearman, rank-sum) come from per-(feature, value) counts and
ordered sums (``kernels.cumulative``), never from a global window.
p values are computed on the driver from the per-feature statistics.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dist import chi2_sf, f_sf, norm_two_sided, t_two_sided
from .kernels import cumulative, dominance
from .prep import clean, quantiles


def long_xy(df: DataFrame, features: list[str], y: str, extra: list[str] | None = None) -> DataFrame:
    extra = extra or []
    base = df.select(*[F.col(e) for e in extra], F.col(y).cast("double").alias("y"),
                     *[clean(c).alias(c) for c in features])
    return base.unpivot(["y", *extra], features, "feature", "x").filter(
        F.col("x").isNotNull() & F.col("y").isNotNull())


def variance_select(df: DataFrame, features: list[str], threshold: float = 0.8 * (1 - 0.8)) -> DataFrame:
    """Row 39: population variance > threshold (0.16)."""
    row = df.agg(*[F.var_pop(clean(c)).alias(f"v{i}") for i, c in enumerate(features)])
    st = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"v{i}").alias("variance"))
                             for i, c in enumerate(features)]))
    return row.select(st.alias("s")).select("s.*").withColumn("selected", F.col("variance") > threshold)


def _corr(x: str, y: str) -> Column:
    """Pearson correlation; null where a side is constant (``corr`` raises there under ANSI rules)."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def correlation_stats(df: DataFrame, features: list[str], y: str) -> DataFrame:
    """Rows 40-42: Pearson r, F-regression F = r^2 (n-2)/(1-r^2), simple
    regression slope; one grouped aggregation over all features.  A constant
    feature has null statistics."""
    long = long_xy(df, features, y)
    agg = long.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), _corr("x", "y").alias("r"),
                                      F.try_divide(F.covar_pop("x", "y"), F.var_pop("x")).alias("slope"))
    r2 = F.col("r") * F.col("r")
    return agg.withColumn("r2", r2).withColumn("f", F.try_divide(r2 * (F.col("n") - 2), F.lit(1.0) - r2))


def with_pvalues(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.copy()
    pdf["p_f"] = [f_sf(f, 1, n - 2) for f, n in zip(pdf["f"], pdf["n"])]
    pdf["p_r"] = [t_two_sided(r * math.sqrt((n - 2) / max(1e-300, 1 - r * r)), n - 2)
                  for r, n in zip(pdf["r"], pdf["n"])]
    return pdf


def average_ranks(long: DataFrame, key: list[str], value: str) -> DataFrame:
    """Average (mid) ranks of ``value`` within each ``key`` group, returned
    per distinct (key, value): rank = #smaller + (#equal + 1) / 2."""
    cnt = long.groupBy(*key, F.col(value).alias("_v")).agg(F.count(F.lit(1)).cast("double").alias("_c"))
    cum = cumulative(cnt, ["_v"], {"_before": "_c"}, segment=key, exclusive=True)
    return cum.select(*key, F.col("_v").alias(value),
                      (F.col("_before") + (F.col("_c") + 1.0) / 2.0).alias(f"rank_{value}"))


def spearman(df: DataFrame, features: list[str], y: str) -> DataFrame:
    """Row 43: Spearman rho = Pearson correlation of average ranks; null for a constant feature.

    ``y`` is ranked once for all features (a count per value and feature, as
    each feature leaves out its own nulls) and its centred ranks join the rows;
    then rows collapse to one a (feature, value) before ``x`` is ranked."""
    cols = [f"x{i}" for i in range(len(features))]
    wide = df.select(F.col(y).cast("double").alias("y"), *[clean(c).alias(x) for x, c in zip(cols, features, strict=True)]
                     ).where("y IS NOT NULL")
    per = wide.groupBy("y").agg(*[F.count(x).cast("double").alias(f"c{i}") for i, x in enumerate(cols)]).persist()
    totals = per.agg(*[F.sum(f"c{i}").alias(f"c{i}") for i in range(len(cols))]).first()
    n = [totals[i] or 0.0 for i in range(len(cols))]
    ranked = cumulative(per, ["y"], {f"b{i}": f"c{i}" for i in range(len(cols))}, exclusive=True)
    ranked = ranked.select("y", *[(F.col(f"b{i}") + (F.col(f"c{i}") - n[i]) / 2).alias(f"r{i}") for i in range(len(cols))])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(x).alias("x"), F.col(f"r{i}").alias("ry"),
                                         F.lit(n[i]).alias("n")) for i, (x, c) in enumerate(zip(cols, features, strict=True))]))
    cnt = wide.join(ranked, "y").select(pairs.alias("s")).select("s.*").where("x IS NOT NULL").groupBy("feature", "n", "x").agg(
        F.count(F.lit(1)).cast("double").alias("c"), F.sum("ry").alias("ry"), F.sum(F.col("ry") * F.col("ry")).alias("yy"))
    cum = cumulative(cnt, ["x"], {"before": "c"}, segment=["feature"], exclusive=True)
    rx = F.col("before") + (F.col("c") - F.col("n")) / 2
    agg = cum.withColumn("rx", rx).groupBy("feature").agg(
        F.sum("c").cast("long").alias("n"), F.sum(F.col("rx") * F.col("ry")).alias("xy"),
        F.sum(F.col("c") * F.col("rx") * F.col("rx")).alias("xx"), F.sum("yy").alias("yy"))
    return agg.select("feature", "n", F.try_divide(F.col("xy"), F.sqrt("xx") * F.sqrt("yy")).alias("rho"))


def kendall_tau_b(df: DataFrame, x: str, y: str, *, cap: int | None = None, **kw) -> dict:
    """Row 44: Kendall tau-b with tie correction via the S2 dominance kernel.

    Rows collapse to distinct (x, y) with a count; discordant pairs are those of
    a larger x and a smaller y, tie pairs come from the counts."""
    per = df.select(clean(x).alias("x"), F.col(y).cast("double").alias("y")).dropna().groupBy("x", "y").agg(
        F.count(F.lit(1)).cast("double").alias("c")).persist()
    pairs = F.sum(F.col("c") * (F.col("c") - 1) / 2)
    of_x, of_y = (per.groupBy(k).agg(F.sum("c").alias("c")).agg(pairs.alias("t")).first()["t"] for k in ("x", "y"))
    row = per.agg(F.sum("c").alias("n"), pairs.alias("joint"), F.count(F.lit(1)).alias("rows")).first()
    n = int(row["n"] or 0)
    disc, _ = dominance(per, "x", "y", "c", "c", n_rows=row["rows"], cap=cap, dense=False)
    per.unpersist()
    tot = n * (n - 1) / 2.0
    n1, n2, n3 = float(of_x or 0), float(of_y or 0), float(row["joint"] or 0)
    conc = tot - disc - n2 - n1 + n3
    denom = math.sqrt((tot - n1) * (tot - n2))
    tau = (conc - disc) / denom if denom > 0 else float("nan")
    return {"n": n, "concordant": conc, "discordant": disc, "x_ties": n1, "y_ties": n2, "tau": tau}


def kendall(df: DataFrame, features: list[str], y: str, **kw) -> pd.DataFrame:
    rows = []
    for c in features:
        r = kendall_tau_b(df, c, y, **kw)
        rows.append({"feature": c, **r})
    return pd.DataFrame(rows)


def mi_binned(df: DataFrame, features: list[str], y: str, bins: int = 10) -> DataFrame:
    """Row 45 (re-aimed): mutual information of quantile-binned x and y,
    ``sum p_xy ln(p_xy / (p_x p_y))``.  Bin = number of cut points <= value,
    cut points = exact quantiles at 1/bins .. (bins-1)/bins."""
    probs = [i / bins for i in range(1, bins)]
    cuts = quantiles(df, features + [y], probs)
    long = long_xy(df, features, y)
    ycuts = F.array(*[F.lit(v) for v in cuts[y]])
    fmap = {c: F.array(*[F.lit(v) for v in cuts[c]]) for c in features}
    xc = F.coalesce(*[F.when(F.col("feature") == c, a) for c, a in fmap.items()])
    bx = F.size(F.filter(xc, lambda c: c <= F.col("x")))
    by = F.size(F.filter(ycuts, lambda c: c <= F.col("y")))
    joint = long.groupBy("feature", bx.alias("bx"), by.alias("by")).agg(F.count(F.lit(1)).cast("double").alias("nxy"))
    wf = Window.partitionBy("feature")  # bounded: at most bins^2 rows per feature
    j = joint.withColumn("n", F.sum("nxy").over(wf)) \
        .withColumn("nx", F.sum("nxy").over(Window.partitionBy("feature", "bx"))) \
        .withColumn("ny", F.sum("nxy").over(Window.partitionBy("feature", "by")))
    term = F.col("nxy") / F.col("n") * F.log(F.col("nxy") * F.col("n") / (F.col("nx") * F.col("ny")))
    return j.groupBy("feature").agg(F.sum(term).alias("mi"))


def top_k_vote(scores: DataFrame, k: int, ratio: float = 0.15) -> DataFrame:
    """Rows 49-50: per method keep the k largest scores (``selected`` given
    for threshold methods), then True_ratio = share of methods selecting
    the feature; keep >= ratio.  ``scores``: (method, feature, score[, selected]).
    One row per (method, feature): the window is bounded by the feature count."""
    w = Window.partitionBy("method").orderBy(F.col("score").desc_nulls_last(), F.col("feature"))
    if "selected" not in scores.columns:
        scores = scores.withColumn("selected", F.lit(None).cast("boolean"))
    ranked = scores.withColumn("rank", F.row_number().over(w))
    sel = ranked.withColumn("selected", F.coalesce(F.col("selected"), F.col("rank") <= k))
    vote = sel.groupBy("feature").agg(F.avg(F.col("selected").cast("double")).alias("true_ratio"))
    return vote.withColumn("kept", F.col("true_ratio") >= ratio)


def two_sample(df: DataFrame, features: list[str], event: str = "event") -> DataFrame:
    """Row 51: event vs censored per feature: rank-sum z, Mann-Whitney U
    (for the event group) and Welch t."""
    long = long_xy(df, features, event).withColumnRenamed("y", "g").persist()
    rk = average_ranks(long, ["feature"], "x")
    j = long.join(rk, ["feature", "x"])
    g1 = F.col("g") > 0
    agg = j.groupBy("feature").agg(
        F.sum(g1.cast("double")).alias("n1"), F.sum((~g1).cast("double")).alias("n2"),
        F.sum(F.when(g1, F.col("rank_x")).otherwise(0.0)).alias("r1"),
        F.avg(F.when(g1, F.col("x"))).alias("m1"), F.avg(F.when(~g1, F.col("x"))).alias("m2"),
        F.var_samp(F.when(g1, F.col("x"))).alias("v1"), F.var_samp(F.when(~g1, F.col("x"))).alias("v2"))
    n1, n2, r1 = F.col("n1"), F.col("n2"), F.col("r1")
    u = r1 - n1 * (n1 + 1) / 2
    z = (r1 - n1 * (n1 + n2 + 1) / 2) / F.sqrt(n1 * n2 * (n1 + n2 + 1) / 12)
    t = (F.col("m1") - F.col("m2")) / F.sqrt(F.col("v1") / n1 + F.col("v2") / n2)
    return agg.select("feature", "n1", "n2", r1.alias("rank_sum"), u.alias("mwu"), z.alias("ranksum_z"),
                      t.alias("welch_t"))


def chi2_scores(df: DataFrame, features: list[str], event: str = "event") -> DataFrame:
    """Row 52: chi^2 of non-negative features against the class: observed
    = per-class feature sums, expected = class share x feature total."""
    ev = F.col(event) > 0
    aggs = [F.count(F.lit(1)).cast("double").alias("n"), F.sum(ev.cast("double")).alias("n1")]
    for i, c in enumerate(features):
        aggs += [F.sum(clean(c)).alias(f"t{i}"), F.sum(F.when(ev, clean(c)).otherwise(0.0)).alias(f"o{i}")]
    row = df.agg(*aggs)
    structs = []
    for i, c in enumerate(features):
        p1 = F.col("n1") / F.col("n")
        e1 = p1 * F.col(f"t{i}")
        e0 = (1 - p1) * F.col(f"t{i}")
        o1 = F.col(f"o{i}")
        o0 = F.col(f"t{i}") - o1
        chi = (o1 - e1) * (o1 - e1) / e1 + (o0 - e0) * (o0 - e0) / e0
        structs.append(F.struct(F.lit(c).alias("feature"), chi.alias("chi2")))
    return row.select(F.explode(F.array(*structs)).alias("s")).select("s.*")


@dataclass
class Statistic:
    """A pluggable statistic of (x, y) as a mergeable accumulator.

    ``update`` maps arrays of x and y to a state (a list of doubles),
    ``merge`` joins two states, ``finish`` gives (score, p)."""

    update: Callable[[np.ndarray, np.ndarray], list]
    merge: Callable[[list, list], list]
    finish: Callable[[list], tuple]


def custom_stat(df: DataFrame, features: list[str], y: str, stat: Statistic) -> DataFrame:
    """Row 53: ``stat`` per feature.  Every task folds its own rows into one
    state a feature; only the states (one per task and feature) are merged,
    so no feature column is gathered, at any size."""
    def fold(frames):
        states: dict = {}
        for pdf in frames:
            for name, part in pdf.groupby("feature"):
                new = stat.update(part["x"].to_numpy(), part["y"].to_numpy())
                states[name] = stat.merge(states[name], new) if name in states else new
        if states:
            yield pd.DataFrame({"feature": list(states), "state": [[float(v) for v in s] for s in states.values()]})

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        s, p = stat.finish(reduce(stat.merge, [list(v) for v in pdf["state"]]))
        return pd.DataFrame({"feature": [pdf["feature"].iloc[0]], "score": [float(s)], "p": [float(p)]})

    folded = long_xy(df, features, y).mapInPandas(fold, "feature string, state array<double>")
    return folded.groupBy("feature").applyInPandas(finish, "feature string, score double, p double")


def _p(fn, *args):
    """A p value, None where the statistic isn't a finite number."""
    return float(fn(*args)) if all(a is not None and math.isfinite(a) for a in args) else None


def screen_pvalues(df: DataFrame, features: list[str], y: str) -> DataFrame:
    """Rows 40-43: (method, feature, n, statistic, p) of ANVF, PEAS, LR and SPM.

    F has (1, n - 2) degrees of freedom; r, slope and rho are tested by
    Student's t with n - 2.  A constant feature, or fewer than three rows,
    has a null p.  One row per method and feature reaches the driver."""
    def t_of(r, n):
        return None if r is None or n < 3 else r * math.sqrt((n - 2) / max(1e-300, 1 - r * r))

    out = []
    for s in correlation_stats(df, features, y).collect():
        t, n = t_of(s["r"], s["n"]), s["n"]
        p = _p(t_two_sided, t, n - 2)
        out.append(("ANVF", s["feature"], n, s["f"], _p(f_sf, s["f"], 1, n - 2) if n > 2 else None))
        out += [("PEAS", s["feature"], n, s["r"], p), ("LR", s["feature"], n, s["slope"], p)]
    for s in spearman(df, features, y).collect():
        out.append(("SPM", s["feature"], s["n"], s["rho"], _p(t_two_sided, t_of(s["rho"], s["n"]), s["n"] - 2)))
    return df.sparkSession.createDataFrame(out, "method string, feature string, n long, statistic double, p double")


def signed_rank(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Row 51, WC: the paired Wilcoxon test of two columns, for every pair of columns.

    Differences that are null or zero are left out.  Rows collapse to
    distinct absolute differences, whose average ranks come from one ordered
    sum over all pairs, so a frequent difference is one row.  ``z`` has the
    variance corrected for ties and no continuity correction; p is two-sided
    from the normal distribution, null where no difference is left."""
    named = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), (clean(a) - clean(b)).alias("d"))
                                for a, b in pairs]))
    long = df.select(named.alias("s")).select("s.*").where("d IS NOT NULL AND d <> 0")
    per = long.groupBy("a", "b", F.abs("d").alias("size")).agg(
        F.count(F.lit(1)).cast("double").alias("c"), F.sum((F.col("d") > 0).cast("double")).alias("up"))
    ran = cumulative(per, ["size"], {"before": "c"}, segment=["a", "b"], exclusive=True)
    c, rank = F.col("c"), F.col("before") + (F.col("c") + 1) / 2
    got = ran.groupBy("a", "b").agg(F.sum("c").alias("n"), F.sum(rank * F.col("up")).alias("w_plus"),
                                    F.sum(rank * (c - F.col("up"))).alias("w_minus"),
                                    F.sum(c * c * c - c).alias("ties")).collect()  # one row a pair
    found = {(r["a"], r["b"]): r for r in got}
    out = []
    for a, b in pairs:
        r = found.get((a, b))
        if r is None:
            out.append((a, b, 0, 0.0, 0.0, None, None))
            continue
        n = r["n"]
        z = (r["w_plus"] - n * (n + 1) / 4) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - r["ties"] / 48)
        out.append((a, b, int(n), r["w_plus"], r["w_minus"], z, norm_two_sided(z)))
    return df.sparkSession.createDataFrame(
        out, "a string, b string, n long, w_plus double, w_minus double, z double, p double")


def two_sample_pvalues(df: DataFrame, features: list[str], event: str = "event") -> DataFrame:
    """Row 51, RS and TTI with p: the rank-sum z by the normal distribution, Welch's t with Satterthwaite's degrees of freedom."""
    long = long_xy(df, features, event)
    g1 = F.col("y") > 0
    spread = {r["feature"]: (r["v1"], r["v2"]) for r in long.groupBy("feature").agg(
        F.var_samp(F.when(g1, F.col("x"))).alias("v1"), F.var_samp(F.when(~g1, F.col("x"))).alias("v2")).collect()}
    out = []
    for r in two_sample(df, features, event).collect():
        v1, v2 = spread[r["feature"]]
        dof = None
        if v1 is not None and v2 is not None and v1 + v2 > 0:
            a, b = v1 / r["n1"], v2 / r["n2"]
            dof = (a + b) ** 2 / (a * a / (r["n1"] - 1) + b * b / (r["n2"] - 1))
        out.append((r["feature"], r["ranksum_z"], _p(norm_two_sided, r["ranksum_z"]), r["welch_t"], dof,
                    None if dof is None else _p(t_two_sided, r["welch_t"], dof)))
    return df.sparkSession.createDataFrame(out, "feature string, ranksum_z double, ranksum_p double, welch_t double, "
                                                "welch_dof double, welch_p double")
