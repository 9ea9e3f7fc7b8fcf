from collections import Counter, defaultdict

import pytest

from hazardflow.llm.sharding import cut_edges, packed, propagate, quotas, shard
from tests.llm.helpers import rows

SCHEMA = "id long, link long, size long, slot long, place long"


def laws(got, shards):
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    counts = [len(slots[s]) for s in range(shards)]
    assert sum(counts) == len(got) and max(counts) - min(counts) <= 1
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))


@pytest.mark.parametrize("giant", [0, 150, 300])
def test_counts_slots_and_groups(spark, giant):
    data = [(i, i // 3 if i < 90 else i, 7, None, None) for i in range(300)]
    data = [(i, -5 if i < giant else link, s, None, None) for i, link, s, *_ in data]
    df = spark.createDataFrame([d[:3] for d in data], "id long, link long, size long").repartition(4)
    got = shard(df, 10).collect()
    laws(got, 10)
    assert Counter((r.id, r.link, r.size) for r in got) == Counter(d[:3] for d in data)
    places = defaultdict(set)
    for r in got:
        places[r.link].add(r.shard)
    whole = [link for link, n in Counter(d[1] for d in data).items() if 1 < n <= 30 and link != -5]
    assert sum(len(places[k]) > 1 for k in whole) <= len(whole) // 10
    if giant == 150:  # dealt by a hash, each shard would have a tenth
        counts = Counter(r.shard for r in got if r.link == -5)
        assert sum((n / giant) ** 2 for n in counts.values()) > 0.12


def test_odd_rows(spark):
    data = [(r[0], None if r[1] is None else len(r[1]), 1) for r in rows()]
    data += [(None, None, None), (5, 5, 5), (5, 5, 5), (5, 5, 6)]
    got = shard(spark.createDataFrame(data, "id long, link long, size long"), 40).collect()
    laws(got, 40)
    assert Counter((r.id, r.link, r.size) for r in got) == Counter(data)


def test_fewer_rows_than_shards_and_none(spark):
    got = shard(spark.createDataFrame([(1, 1, 1), (2, 1, 1), (3, 3, 1)], "id long, link long, size long"), 40).collect()
    laws(got, 40)
    assert shard(spark.createDataFrame([], "id long, link long, size long"), 40).collect() == []
    assert sum(quotas(1001, 40)) == 1001


def cut_groups(got, shards):
    """Links whose group would fit a shard but lies in several."""
    places, sizes = defaultdict(set), Counter(r.link for r in got)
    for r in got:
        places[r.link].add(r.shard)
    return [k for k, n in sizes.items() if n <= max(quotas(len(got), shards)) and len(places[k]) > 1]


@pytest.mark.parametrize("paired", [1000, 970])
def test_copies_stay_whole_where_little_is_unlinked(spark, paired):
    data = [(i, i // 2 if i < paired else -i, 1) for i in range(1000)]
    got = shard(spark.createDataFrame(data, "id long, link long, size long").repartition(4), 10).collect()
    laws(got, 10)
    assert Counter((r.id, r.link, r.size) for r in got) == Counter(data)
    assert cut_groups(got, 10) == []


@pytest.mark.parametrize("sizes, shards, cuts", [
    ({2: 50_000, 3: 20_000, 7: 900, 30: 11}, 40, 39),
    ({60: 4, 50: 4, 40: 4, 250: 1}, 10, 9),
    ({3: 5, 2: 1}, 8, 7),
    ({6: 2, 4: 3, 2: 4}, 4, 0),
])
def test_packed_places_every_row_once(sizes, shards, cuts):
    quota = quotas(sum(m * n for m, n in sizes.items()), shards)
    places, room, cut = packed(sizes, quota)
    loads, seen = [0] * shards, defaultdict(list)
    for members, first, last, into, stops in places:
        assert stops[-1] == members and (last - first == 1 or len(into) == 1)
        for s, a, b in zip(into, [0, *stops], stops):
            loads[s] += (last - first) * (b - a)
        seen[members] += range(first, last)
    assert {m: sorted(x) for m, x in seen.items()} == {m: list(range(n)) for m, n in sizes.items()}
    assert room == [0] * shards and loads == quota
    assert cut <= cuts


def test_propagation_moves_linked_rows_together(spark):
    """Cliques dealt at random over the shards: cut edges fall round by round, counts stay, copies meet."""
    import random

    rng = random.Random(4)
    edges = [(c * 6 + i, c * 6 + j) for c in range(20) for i in range(6) for j in range(i)]
    nodes = list(range(200))  # 120 in cliques, 80 without links
    rng.shuffle(nodes)
    labels = spark.createDataFrame([(n, k % 5) for k, n in enumerate(nodes)], "node long, shard int")
    graph = spark.createDataFrame(edges, "a long, b long")
    before = {r.node: r.shard for r in labels.collect()}
    moved, history = propagate(labels, graph, 5)
    after = {r.node: r.shard for r in moved.collect()}
    cut = lambda of: sum(of[a] != of[b] for a, b in edges)
    assert history[0] == cut(before) and history[-1] == cut(after) == cut_edges(graph, moved)
    assert all(x > y for x, y in zip(history, history[1:])) and history[-1] < history[0] / 2
    assert Counter(after.values()) == Counter(before.values()) and set(after) == set(before)


def test_propagation_reaches_what_brute_force_finds(spark):
    """Two triangles crossed over two full shards: exchanges alone end at the least cut of all balanced labels."""
    from itertools import combinations

    edges = [(0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5)]
    labels = {0: 0, 1: 0, 2: 1, 3: 1, 4: 1, 5: 0}
    moved, history = propagate(spark.createDataFrame(list(labels.items()), "node long, shard int"),
                               spark.createDataFrame(edges, "a long, b long"), 2)
    least = min(sum((a in s) != (b in s) for a, b in edges) for s in map(set, combinations(range(6), 3)))
    assert history == [4, least]
    assert Counter(r.shard for r in moved.collect()) == Counter(labels.values())
