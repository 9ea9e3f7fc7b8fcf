import hashlib
import math
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest

from hazardflow.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<double>, label int, dim int, codes string, v int, rows int"


def frame(spark, data):
    return spark.createDataFrame([(i, v, y, 1, "x", 2, 3) for i, v, y in data], SCHEMA).repartition(3)


def brute(data, parts=8, entries=16, rounds=6):
    kept = [(i, [math.floor(Fraction(x) * 4096) for x in v], y, v) for i, v, y in data
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[3]))
    width = len(kept[0][1]) // parts
    cut = [[r[1][p * width:(p + 1) * width] for p in range(parts)] for r in kept]
    book = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book[p]))

    for _ in range(rounds):
        moved = [list(b) for b in book]
        for p in range(parts):
            groups = defaultdict(list)
            for c in cut:
                groups[nearest(p, c[p])[1]].append(c[p])
            for k, members in groups.items():
                moved[p][k] = [sum(col) // len(members) for col in zip(*members, strict=True)]
        book = moved
    coded = [(r[0], r[2], [nearest(p, c[p]) for p in range(parts)]) for r, c in zip(kept, cut, strict=True)]
    by_label = defaultdict(int)
    for _, y, n in coded:
        by_label[y] += sum(d for d, _ in n)
    text = ",".join(str(x) for b in book for e in b for x in e)
    return sorted(str((i, [k for _, k in n], sum(d for d, _ in n), by_label[y])) for i, y, n in coded), text


def got(spark, data, **how):
    out, book = vc.compress(frame(spark, data), **how)
    return sorted(str((r.vec_id, r.codes, r.error, r.label_error)) for r in out.collect()), vc.book_text(book)


def made(n, dim, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(7, dim))
    return [(int(rng.integers(0, n)), (centres[k % 7] + rng.normal(scale=0.2, size=dim)).tolist(),
             [None, 1, 2, 3][k % 4]) for k in range(n)]


@pytest.mark.parametrize(("n", "dim"), [(90, 16), (40, 8), (9, 24)])
def test_against_brute_force(spark, n, dim):
    data = made(n, dim, n)
    assert got(spark, data) == brute(data)


def test_dropped_rows_ties_and_repeats(spark):
    data = made(30, 8, 2)
    data += [data[3], data[3], (None, [0.0] * 8, None), (None, [0.0] * 8, 5), (5, None, 1), (6, [None] + [1.0] * 7, 1),
             (7, [float("nan")] * 8, 1), (8, [float("inf")] + [0.0] * 7, None), (-1, [-0.0] * 8, 2), (-2, [0.0] * 8, 2)]
    assert got(spark, data) == brute(data)


def test_large_components_stay_exact(spark):
    data = made(25, 8, 4)
    data += [(1, [3e5, -3e5, 1e9, 0.0, 0.0, 0.5, 1.0, 2.0], 1), (40, [1e6] * 8, 9)]
    assert got(spark, data) == brute(data)


def test_errors_beyond_a_long_are_null(spark):
    data = [(k, [float(k)] * 8, 1) for k in range(16)] + [(20, [1e300] * 8, 1), (21, [-1e308] * 8, 2), (22, [0.1] * 8, 3)]
    out, book = vc.compress(frame(spark, data))
    rows = {r.vec_id: r for r in out.collect()}
    want, text = brute(data)
    assert vc.book_text(book) == text and len(rows) == 19
    assert rows[22].label_error == rows[22].error
    for r in rows.values():
        assert r.error is None or any(w.startswith(f"({r.vec_id}, {r.codes}, {r.error}, ") for w in want)


def test_empty_table_and_uneven_lengths(spark):
    assert got(spark, []) == ([], "")
    assert got(spark, [(1, None, 1)]) == ([], "")
    with pytest.raises(ValueError, match="can't be cut"):
        got(spark, [(1, [1.0] * 8, 1), (2, [1.0] * 16, 1)])
    with pytest.raises(ValueError, match="can't be cut"):
        got(spark, [(1, [1.0] * 9, 1)])
    codes, text = got(spark, [(1, [], 1), (2, [], None)])
    assert text == "" and len(codes) == 2


@pytest.mark.parametrize("n", [1100, 70_000])
def test_blocks_give_the_integers_back(spark, n, monkeypatch):
    """More than 2^16 dictionary values in all, and more than 2^16 in one dimension."""
    monkeypatch.setattr(vc, "BLOCK_COMPONENTS", 1 << 20)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100000")
    x = np.random.default_rng(n).normal(size=(n, 64 if n < 2000 else 1)) * 100
    df = spark.createDataFrame([(k, v, 0, 0, "", 0, 0) for k, v in enumerate(x.tolist())], SCHEMA).coalesce(1)
    rows = vc.blocks(vc.kept_rows(df)).collect()
    seen = {}
    for r in rows:
        values, codes = vc._unpack(len(r.rows), r.dim, bytes(r.sizes), bytes(r.dictionary), bytes(r.codes))
        for k, owner in enumerate(r.rows):
            seen[owner.vec_id] = [int(values[j][codes[j, k]]) for j in range(r.dim)]
    assert seen == {k: [math.floor(v * 4096) for v in row] for k, row in enumerate(x.tolist())}


def test_digest_of_the_codebooks():
    assert vc.digest([[[1, -2]], [[3, 4]]]) == hashlib.sha256(b"1,-2,3,4").hexdigest()


def test_small_blocks_give_the_same(spark, monkeypatch):
    data = made(50, 16, 6)
    whole = got(spark, data)
    monkeypatch.setattr(vc, "BLOCK_COMPONENTS", 40)
    assert got(spark, data) == whole
