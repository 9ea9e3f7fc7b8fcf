import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hazardflow.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, label int, dim int, block long, ids binary"


def data(seed=1, n=400, dim=12):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)).astype(np.float32)
    x[50:60] = x[40]  # ties
    x[100] *= 1000
    x[101] *= 1e-20
    found = [(i, v.tolist(), 0, 1, 2, None) for i, v in enumerate(x)]
    odd = [None, [], [0.0] * dim, [None] * dim, [math.nan] * dim, [math.inf] * dim, [1.0, None, *[1.0] * (dim - 2)], [1.0, 2.0], [3.0, 1.0]]
    found += [(1000 + 20 * k, v, None, None, None, None) for k, v in enumerate(odd)]
    return found + [found[0], found[20], (None, [1.0] * dim, 0, 0, 0, None)]


def brute(rows, k, step=20):
    ok = {}
    for i, v, *_ in rows:
        if i is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v):
            ok[i] = np.array(v, np.float32).astype(float)
    out = {}
    for q, x in ok.items():
        if q % step == 0:
            scores = sorted((-float((x * y).sum()), i) for i, y in ok.items() if i != q and len(y) == len(x))
            out[q] = [(i, -s) for s, i in scores[:k]]
    return {q: v for q, v in out.items() if v}


@pytest.mark.parametrize("blocks", [(2048, 1024), (37, 5)])
def test_against_brute_force(spark, blocks):
    df = spark.createDataFrame(data(), SCHEMA).repartition(4)
    got = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 20 == 0, 20, *blocks).orderBy("query_id", "rank").collect():
        assert r.rank == len(got.setdefault(r.query_id, [])) + 1
        got[r.query_id].append((r.vec_id, r.score))
    want = brute(data(), 20)
    assert got.keys() == want.keys()
    for q, v in want.items():
        assert [i for i, _ in got[q]] == [i for i, _ in v]
        assert np.allclose([s for _, s in got[q]], [s for _, s in v], rtol=1e-12, atol=0)


def test_bounds_hold():
    rng = np.random.default_rng(3)
    import pyarrow as pa

    x = rng.normal(size=(50, 8)) * rng.choice([1e-3, 1, 1e3], size=(50, 1))
    table = pa.table({"vec_id": pa.array(range(50), pa.int64()), "vector": pa.array(list(x), pa.list_(pa.float64())),
                      "dim": pa.array([8] * 50, pa.int32()), "block": pa.array([0] * 50, pa.int64())})
    row = neighbours._pack(table).to_pylist()[0]
    side = neighbours._Side(row, "", 8)
    about = (side.codes @ side.codes.T).astype(float) * side.scales[:, None] * side.scales[None, :]
    bound = side.rests[:, None] * side.norms[None, :] + (side.norms + side.rests)[:, None] * side.rests[None, :]
    assert (np.abs(x @ x.T - about) <= bound * (1 + 1e-9) + 1e-12 * np.abs(about)).all()


def test_fewer_candidates_than_k_and_none(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0], 0, 0, 0, None), (1, [0.5, 1.0], 0, 0, 0, None)], SCHEMA)
    assert [tuple(r) for r in neighbours.nearest(few, F.col("vec_id") % 20 == 0).collect()] == [(0, 1, 1, 0.5)]
    assert neighbours.nearest(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 20 == 0).collect() == []
