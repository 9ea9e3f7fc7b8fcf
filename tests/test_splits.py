import numpy as np
import pandas as pd
import pytest

from hazardflow.operators import splits


@pytest.fixture(scope="module")
def df(spark):
    rng = np.random.default_rng(4)
    n = 203
    pdf = pd.DataFrame({"id": np.arange(n), "event": (rng.random(n) < 0.35).astype(int),
                        "time": rng.integers(1, 30, n).astype(float)})
    return spark.createDataFrame(pdf), pdf


def test_stratified_shuffle_sizes(df):
    sdf, pdf = df
    a = splits.stratified_shuffle(sdf, "id", "event", 5, 0.25, 0).toPandas().merge(pdf, on="id")
    for s, g in a.groupby("split"):
        for ev, gg in g.groupby("event"):
            assert gg.is_test.sum() == int(np.floor(len(gg) * 0.25 + 0.5))
    # different splits draw different test sets
    sets = [frozenset(g[g.is_test].id) for _, g in a.groupby("split")]
    assert len(set(sets)) == 5


def test_kfold_partitions_each_stratum(df):
    sdf, pdf = df
    f = splits.stratified_kfold(sdf, "id", "event", 4).toPandas().merge(pdf, on="id")
    assert len(f) == len(pdf) and set(f.fold) == {0, 1, 2, 3}
    for _, g in f.groupby("event"):
        sizes = g.fold.value_counts()
        assert sizes.max() - sizes.min() <= 1
    r = splits.repeated_kfold(sdf, "id", None, 4, 3, 1).toPandas()
    assert len(r) == 3 * len(pdf)
    assert (r.groupby("repeat").fold.value_counts().unstack().max(axis=1)
            - r.groupby("repeat").fold.value_counts().unstack().min(axis=1)).max() <= 1


def test_ssa_tests_every_row_and_holdouts(df):
    sdf, pdf = df
    a = splits.ssa(sdf, "id", "event", 3, 0.25, 0).toPandas()
    assert set(a[a.is_test].id) == set(pdf.id)
    h = splits.systematic_holdout(sdf, "id", "time", "event", 0.3).toPandas().merge(pdf, on="id")
    for _, g in h.groupby("event"):
        assert g.is_test.sum() == len(set(np.linspace(1, len(g) - 2, int(len(g) * 0.3)).astype(int)))
    r = splits.random_holdout(sdf, "id", 0.3, 10).toPandas()
    assert r.is_test.sum() == int(np.ceil(len(pdf) * 0.3))


def test_text_ids_split_like_any_other(spark):
    from hazardflow.operators import splits

    df = spark.createDataFrame([(f"T12-{i:03d}", i % 3 == 0) for i in range(90)], "sample string, event boolean")
    a = splits.stratified_shuffle(df, "sample", "event", 4, 0.25, 0)
    counts = {(r.split, r.is_test): r["count"] for r in a.groupBy("split", "is_test").count().collect()}
    assert all(counts[s, True] in (22, 23) for s in range(4))
    tests = [{r.sample for r in a.filter(f"split = {s} AND is_test").collect()} for s in range(4)]
    assert len({frozenset(t) for t in tests}) == 4
    assert splits.random_holdout(df, "sample", 0.3).filter("is_test").count() == 27
    assert splits.repeated_kfold(df, "sample", "event", 3, 2).groupBy("repeat", "fold").count().count() == 6
