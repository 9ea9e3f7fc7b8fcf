import numpy as np
import pytest
import xxhash

from hazardflow.llm import simhash
from tests.llm.helpers import SCHEMA, frame, rows


def fingerprint(text, width=3):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[k:k + width]) for k in range(max(1, len(words) - width + 1))] if words else []
    counts = [sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def classes(prints):
    """Least id reachable, by comparing all pairs."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (_, a) in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j][1]).bit_count() <= 2:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    out = []
    for i in range(len(prints)):
        ids = [prints[j][0] for j in range(len(prints)) if find(j) == find(i) and prints[j][0] is not None]
        out.append((prints[i][0], prints[i][1], min(ids) if ids else None))
    return out


def test_whole_texts_against_brute_force(spark):
    got = [(r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(frame(spark)).collect()]
    key = lambda r: (r[0] is None, r)
    want = classes([(r[0], fingerprint(r[1])) for r in rows()])
    assert sorted(map(str, got)) == sorted(map(str, want)), key


@pytest.mark.parametrize("hot", [0, 2, 64])
def test_links_lose_nothing(spark, hot):
    rng = np.random.default_rng(hot)
    centres = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    fps = {0, 1, 3, 7, (1 << 64) - 1}
    for c in centres.tolist():
        for _ in range(25):
            v = c
            for b in rng.integers(0, 64, rng.integers(0, 5)).tolist():
                v ^= 1 << b
            fps.add(v)
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in fps]
    df = spark.createDataFrame(signed, "fp long")
    edges = {(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.links(df, hot).collect()}
    assert all((a ^ b).bit_count() <= 2 for a, b in edges)
    label = {v: v for v in fps}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        label[max(x, y)] = min(x, y)
    for a in fps:
        for b in fps:
            if (a ^ b).bit_count() <= 2:
                assert find(a) == find(b)


def test_keep_first_keeps_columns(spark):
    docs = frame(spark)
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    got = [r.doc_id for r in kept.collect()]
    first = {c for i, _, c in classes([(r[0], fingerprint(r[1])) for r in rows()]) if i is not None and i == c}
    assert sorted(x for x in got if x is not None) == sorted(first)
    assert got.count(None) == 1


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(empty).collect() == []
    assert simhash.keep_first(empty).collect() == []
