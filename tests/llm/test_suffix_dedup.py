import random

import pytest
from pyspark.sql import functions as F

from hazardflow.llm import suffix_dedup as S
from hazardflow.llm.suffix_sort import common_prefix, deep_shallow
from tests.llm.helpers import SCHEMA, frame, rows


def brute(data):
    """Maximal runs covered by 100-byte strings that start earlier too."""
    first = {}
    texts = [(S.NO_ID if i is None else i, (t or "").encode()) for i, t in data]
    for i, d in texts:
        for p in range(len(d) - 99):
            first[d[p:p + 100]] = min(first.get(d[p:p + 100], (i, p)), (i, p))
    out = []
    for i, d in texts:
        covered = bytearray(len(d))
        for p in range(len(d) - 99):
            if first[d[p:p + 100]] < (i, p):
                covered[p:p + 100] = b"\1" * 100
        marks = [0, *covered, 0]
        starts = [k for k in range(len(d) + 1) if marks[k + 1] and not marks[k]]
        stops = [k for k in range(len(d) + 1) if marks[k] and not marks[k + 1]]
        out.append((i, list(zip(starts, stops, strict=True))))
    return sorted(out)


def found(df, **options):
    got = S.remove_repeats(df, [F.col("doc_id")], lambda data, runs: (str(runs),), "runs string", **options).collect()
    return sorted((S.NO_ID if r.row.doc_id is None else r.row.doc_id, eval(r.runs)) for r in got)


def passages(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice(rng.choice(["ab", "abcdefgh é"])) for _ in range(rng.choice([90, 150, 400]))) for _ in range(4)]
    data = []
    for i in range(40):
        t = "".join(rng.choice(base)[rng.choice([0, 0, 3, 20]):] for _ in range(rng.randint(0, 4)))
        if t and rng.random() < 0.6:
            k = rng.randrange(len(t))
            t = t[:k] + rng.choice("xyzé") + t[k + 1:]
        data.append((i, t))
    return data + [(50, None), (51, ""), (52, "a" * 700), (53, "a" * 650 + "b"), (54, "ab" * 300), (55, "\0" * 300),
                   (56, "\0" * 250 + "a"), (57, "q" * 99), (58, "q" * 100), (None, data[0][1])]


@pytest.mark.parametrize("hot", [S.HOT, 3, 0])
def test_against_brute_force(spark, hot, monkeypatch):
    monkeypatch.setattr(S, "UNIT_BYTES", 3000)
    data = passages(hot % 7)
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    want = brute(data)
    assert sum(len(r) for _, r in want) > 20
    assert found(df, hot=hot) == want


def test_blocks_of_a_long_text(monkeypatch):
    rng = random.Random(2)
    data = bytes(rng.choice(b"abcd") for _ in range(5000))
    whole = [(int(g), int(a), int(x), int(y)) for g, a, x, y in zip(*S.anchors(data), strict=True)]
    assert {p for _, a, x, y in whole for p in range(a - x, a + y - 99)} == set(range(len(data) - 99))
    monkeypatch.setattr(S, "BLOCK", 700)
    cut = list(zip(*S.anchors(data), strict=True))
    assert {(int(a), p) for _, a, x, y in cut for p in range(a - x, a + y - 99)} == {
        (a, p) for _, a, x, y in whole for p in range(a - x, a + y - 99)}
    assert S.anchors(b"short") is None


@pytest.mark.parametrize("seed", range(40))
def test_deep_shallow_order(seed):
    rng = random.Random(seed)
    letters = rng.choice([b"ab", bytes(range(1, 256)), b"abcdefgh"])
    prefix = bytes(rng.choice(letters) for _ in range(rng.choice([0, 10, 24, 40])))
    strings = list({(prefix if rng.random() < 0.7 else b"") + bytes(rng.choice(letters) for _ in range(rng.randint(0, rng.choice([3, 30, 60]))))
                    for _ in range(rng.randint(0, 200))})
    rng.shuffle(strings)
    order, shared = deep_shallow(strings)
    got = [strings[k] for k in order.tolist()]
    assert got == sorted(strings)
    assert shared.tolist() == [0, *map(common_prefix, got, got[1:])][:len(got)]


def test_kept_characters():
    data = "aéb".encode()
    assert S.whole_characters(data, [(0, 2)]) == "éb"
    assert S.whole_characters(data, [(2, 4)]) == "aé"
    assert S.whole_characters(data, [(1, 3)]) == "ab"
    assert S.whole_characters(data, []) == "aéb"


def test_all_columns_stay(spark):
    docs = frame(spark)
    out = S.clean_texts(docs)
    assert out.columns == docs.columns
    got = out.collect()
    assert len(got) == len(rows())
    assert all(r.n_chars == len(r.text or "") for r in got)
    assert sum(r.text is None for r in got) == sum(r[1] is None for r in rows())
    assert all(r.fp == "clash" and r.key == -1 for r in got if r.doc_id is not None)


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert found(empty) == []
    assert S.clean_texts(empty).collect() == []
