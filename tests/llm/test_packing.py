import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from hazardflow.llm import packing
from tests.llm.helpers import SCHEMA, frame, rows

PATH = public_tokenizers.path("word_bpe_49k.json")


def fewest(items, capacity):
    """Fewest sequences, by trying all placements."""
    items, best = sorted(items, reverse=True), [len(items)]

    def put(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for k in {b: j for j, b in enumerate(bins)}.values():
            if bins[k] + items[i] <= capacity:
                bins[k] += items[i]
                put(i + 1, bins)
                bins[k] -= items[i]
        put(i + 1, [*bins, items[i]])

    put(0, [])
    return best[0]


def used(plan, capacity):
    total = Counter()
    for pattern, n in plan:
        assert n > 0 and sum(pattern) <= capacity
        for length in pattern:
            total[length] += n
    return total


@pytest.mark.parametrize("seed", range(60))
def test_plan_is_optimal_on_small_tables(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 20, 50])
    items = [rng.randint(2, capacity) for _ in range(rng.randint(0, 10))]
    plan = packing.plan(Counter(items), capacity)
    assert used(plan, capacity) == Counter(items)
    assert sum(n for _, n in plan) == (fewest(items, capacity) if items else 0)


def test_plan_beats_best_fit():
    counts = Counter({9: 3, 7: 3, 6: 3, 5: 3, 4: 3, 3: 3, 2: 6})
    plan = packing.plan(counts, 20)
    assert used(plan, 20) == counts
    assert sum(n for _, n in plan) <= sum(n for _, n in packing.best_fit(counts, 20))


@pytest.mark.parametrize("counts", [{700: 1000, 1300: 10, 2048: 5}, {1100: 50, 1: 3}, {1: 5000}, {}, {2048: 7, 2047: 7, 1: 7}])
def test_ties_and_large_counts(counts):
    plan = packing.plan(counts, 2048)
    assert used(plan, 2048) == Counter(counts)
    if counts:
        lone = sum(n for k, n in counts.items() if 2 * k > 2048)
        assert sum(n for _, n in plan) >= max(lone, -(-sum(k * n for k, n in counts.items()) // 2048))


def test_bad_lengths():
    with pytest.raises(ValueError):
        packing.plan({0: 1}, 10)
    with pytest.raises(ValueError):
        packing.plan({11: 1}, 10)


def test_documents_round_trip(spark):
    whole = Tokenizer.from_file(PATH)
    want = Counter()
    for i, t, *_ in rows():
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for k in range(0, len(ids), 2048):
            c = ids[k:k + 2048]
            want[(i, k // 2048, k, len(c), zlib.crc32(c.tobytes()))] += 1
    got = packing.pack(frame(spark), PATH).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(k[3] * n for k, n in want.items())
    assert len(sequences) <= -(-total // 2048) + 1


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA), PATH).collect() == []
