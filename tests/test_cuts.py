import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hazardflow.operators import kernels, search, splits
from hazardflow.operators.cuts import HashFolds, copies_by, kfolds, share_folds
from hazardflow.operators.resident import Models, ResidentRows, next_step
from tests.test_resident import brute_terms, sample


def by_row(folds):
    """{fold: (training ids, test ids)} as the blocks see them."""
    rows = folds.ids.where("id IS NOT NULL").toPandas()
    train, test = folds.members()(rows["id"].to_numpy(), np.stack(rows["copies"]))
    return {f: tuple(set(rows["id"][on[:, i] > 0]) for on in (train, test)) for i, f in enumerate(folds.names)}


def by_table(table):
    pdf = table.toPandas().dropna()
    pick = lambda own, on: set(own["id"][own["is_test"] == on])
    return {f: (pick(own, False), pick(own, True)) for f, own in pdf.groupby("fold")}


@pytest.fixture(scope="module")
def frames(spark):
    rng = np.random.default_rng(5)
    n = 700
    whole = pd.DataFrame({"id": rng.permutation(n), "event": (rng.random(n) < 0.3).astype(int)})
    texts = whole.assign(id=["é" * (i % 3) + str(i) for i in whole["id"]])
    frames = {"whole": spark.createDataFrame(whole), "texts": spark.createDataFrame(texts)}
    frames["nulls"] = frames["whole"].select(F.expr("if(id % 10 = 0, null, id)").alias("id"),
                                             F.expr("if(id % 17 = 3, null, event)").alias("event"))
    frames["copies"] = frames["whole"].unionByName(frames["whole"])
    return frames


@pytest.mark.parametrize("name", ["whole", "texts", "nulls", "copies"])
def test_shares_cut_as_the_ranked_rows(frames, name):
    shares, plan = search.share_plan([0.15, 0.28, 0.29], 2)  # 0.28 and 0.29 have equal seeds
    got = share_folds(frames[name], "id", "event", plan, everywhere=-1)
    found = by_row(got)
    assert found.pop(-1)[0] == set(got.ids.where("id IS NOT NULL").toPandas()["id"])
    assert found == by_table(search.share_splits(frames[name], "id", "event", shares, 2)[0])


@pytest.mark.parametrize("name", ["whole", "texts", "nulls"])
def test_inner_folds_cut_as_the_ranked_rows(frames, name):
    outer = splits.stratified_shuffle(frames[name], "id", "event", 2, 0.25, 0).persist()
    assert by_row(search.inner_cuts(outer, "id")) == by_table(search.inner_folds(outer, "id"))


def test_copies_of_an_id_on_both_sides_train_and_test(spark):
    df = spark.createDataFrame([(7,)] * 5, "id long")
    found = by_row(kfolds(copies_by(df, "id")[0], [0], 4, 1, 1))
    assert found == {0: ({7}, {7}), 1: ({7}, {7}), 2: ({7}, {7}), 3: ({7}, {7})}
    assert by_row(HashFolds(copies_by(df, "id")[0], [(0, 1)], lambda u, n: [0, n], {0: [(0, 0, 1)], 1: [(0, 1, None)]})) == {
        0: (set(), {7}), 1: ({7}, set())}


def test_models_that_differ_by_the_penalty_reach_their_own_minimum(spark):
    pdf = sample(400)
    feats, alphas = ["f0", "f1", "f2"], [0.5, 0.0, 1e-5, 3.0]
    rows = ResidentRows(spark.createDataFrame(pdf), feats, parts=3)
    passes, evaluate = [], rows.evaluate
    rows.evaluate = lambda models, *a, **k: passes.append(len(models)) or evaluate(models, *a, **k)
    models = Models(np.zeros(8, int), np.array(alphas * 2), np.arange(8) >= 4, np.ones((8, 3), bool))
    beta, converged = rows.fit_penalties(models)
    assert converged.all() and passes[0] == 2  # one model a kind of ties; the penalties start from it
    for k, b in enumerate(beta):
        _, u, h = brute_terms(pdf["time"].to_numpy(), pdf["event"].to_numpy(), pdf[feats].to_numpy(), b, k >= 4)
        assert np.abs(np.linalg.solve(h + alphas[k % 4] * np.eye(3), u - alphas[k % 4] * b)).max() < 1e-9
    rows.close()


def test_the_bound_of_the_next_step_holds():
    pdf, rng = sample(150, hot=False), np.random.default_rng(2)
    t, e, x = pdf["time"].to_numpy(), pdf["event"].to_numpy(), pdf[["f0", "f1", "f2"]].to_numpy()
    for efron in (False, True):
        for size in (0.05, 0.01, 1e-3):
            best = np.zeros(3)
            for _ in range(20):
                _, u, h = brute_terms(t, e, x, best, efron)
                best = best + np.linalg.solve(h, u)
            _, u, h = brute_terms(t, e, x, best + size * rng.normal(size=3), efron)
            at = best + size * rng.normal(size=3)
            _, u, h = brute_terms(t, e, x, at, efron)
            step = np.linalg.solve(h, u)
            _, u, after = brute_terms(t, e, x, at + step, efron)
            bound = next_step(h, step, np.ones(3, bool), np.ptp(x, axis=0))
            assert np.abs(np.linalg.solve(after, u)).max() <= bound


def test_pairs_before_in_tiles_of_every_width(monkeypatch):
    rng = np.random.default_rng(0)
    for tile in (4, 256, 512):
        monkeypatch.setattr(kernels, "TILE", tile)
        for m, hi in ((2, 3), (255, 3), (257, 9999), (900, 9999)):
            a, s, asks = rng.integers(-hi, hi, m), rng.integers(0, hi, m) / 7, rng.random(m) < 0.6
            before = a[None] < a[asks][:, None]
            want = [float((before & on).sum()) for on in (s[None] < s[asks][:, None], s[None] == s[asks][:, None])]
            assert list(kernels.pairs_before(a, s, asks)) == want
