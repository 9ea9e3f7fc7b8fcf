import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from hazardflow.llm import minhash
from tests.llm.helpers import WORDS, frame, rows

WORD = re.compile("[^\x20\x09-\x0d]+")


def shingles(text, width=4):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[k:k + width]) for k in range(max(1, len(w) - width + 1)))


def brute(data):
    """(doc_id, n_shingles, component_id, kept) by comparing all pairs."""
    sets = [shingles(r[1]) for r in data]
    root = list(range(len(data)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    out = []
    for i, r in enumerate(data):
        ids = [data[j][0] for j in range(len(data)) if find(j) == find(i) and data[j][0] is not None]
        least = min(ids) if ids else None
        if not sets[i]:
            least = r[0]
        out.append((r[0], len(sets[i]), least, r[0] == least))
    return sorted(map(str, out))


def near(seed, n, copies=12):
    """Chains of texts, each an edit of the one before, so that links differ from components."""
    rng, out = random.Random(seed), []
    for k in range(n):
        w = [rng.choice(WORDS) for _ in range(rng.randint(40, 120))]
        for _ in range(copies):
            w = list(w)
            w[rng.randrange(len(w))] = rng.choice(WORDS)
            out.append((len(out) * 7 + k % 3, " ".join(w), "en", None, None, None, None, None))
    rng.shuffle(out)
    return out


def answer(spark, data):
    got = minhash.near_duplicates(frame(spark, data)).collect()
    return sorted(str((r.doc_id, r.n_shingles, r.component_id, r.kept)) for r in got)


def test_block_links_join_what_all_pairs_join():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 10**9, 100)
    sets = []
    for _ in range(60):
        s = base.copy()
        k = rng.integers(2, 25)
        s[rng.choice(100, k, replace=False)] = rng.integers(0, 10**9, k)
        sets.append(np.unique(minhash.mixed(s.astype(np.uint64))))
    sig, at = minhash.signatures(sets), np.arange(60)
    bands = sig.reshape(60, minhash.BANDS, minhash.ROWS)
    found = []
    for band in range(minhash.BANDS):
        values, group = np.unique(bands[:, band].copy().view("V12").reshape(-1), return_inverse=True)
        for g in range(len(values)):
            m = at[group == g]
            if len(m) > 1:
                found += minhash.block_links(band, np.arange(len(m)), np.arange(len(m)), m, m, sig[m], [sets[k] for k in m])

    def joined(edges):
        label = at.copy()
        for a, b in edges:
            label[label == label[b]] = label[a]
        return sorted(sorted(at[label == x].tolist()) for x in set(label.tolist()))

    true = [(i, j) for i in at for j in range(i) if 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j]))]
    assert joined(found) == joined(true) and 1 < len(joined(true)) < 60


def test_odd_rows_against_brute_force(spark):
    assert answer(spark, rows()) == brute(rows())


@pytest.mark.parametrize("block", [5, 1024])
def test_chains_against_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", block)
    data = near(3, 8)
    assert answer(spark, data) == brute(data)


def test_groups_of_components_are_compared(spark, monkeypatch):
    """Texts with a common half share bands but are no copies; some of them are."""
    monkeypatch.setattr(minhash, "BLOCK", 7)
    rng = random.Random(5)
    common = [rng.choice(WORDS) for _ in range(60)]
    data = []
    for k in range(40):
        own = [f"w{rng.randrange(10**6)}" for _ in range(22)]
        data.append((k, " ".join(common + own), "en", None, None, None, None, None))
        if k % 5 == 0:
            data.append((1000 - k, " ".join(common + own[:-1] + ["z"]), "en", None, None, None, None, None))
    assert answer(spark, data) == brute(data)


def test_one_id_with_two_texts_and_empty_table(spark):
    data = [(1, "alpha beta gamma delta epsilon", None, None, None, None, None, None),
            (1, "one two three four five six", None, None, None, None, None, None),
            (0, "One  two three\tfour five six", None, None, None, None, None, None)]
    assert answer(spark, data) == brute(data)
    assert answer(spark, []) == []


def test_shingle_hashes_follow_the_words():
    a = minhash.shingle_set(b"The quick\tBROWN  fox jumps")
    assert np.array_equal(a, minhash.shingle_set(b" the quick brown fox\x0bjumps\n")) and len(a) == 2
    assert len(minhash.shingle_set(b"a b c")) == 1 and not np.array_equal(minhash.shingle_set(b"a b c"), minhash.shingle_set(b"a b"))
    assert not len(minhash.shingle_set(b" \t")) and not len(minhash.shingle_set(None))
    rng = random.Random(2)
    words = [f"{rng.randrange(300)}" for _ in range(5000)]
    assert len(minhash.shingle_set(" ".join(words).encode())) == len(shingles(" ".join(words)))


def test_signatures_estimate_similarity_in_any_chunks(monkeypatch):
    rng = np.random.default_rng(1)
    sets = [np.unique(minhash.mixed(rng.integers(1, 900, 700).astype(np.uint64))) for _ in range(6)]
    sig = minhash.signatures([*sets, sets[0][:0]])
    monkeypatch.setattr(minhash, "CHUNK", 100)
    assert np.array_equal(sig, minhash.signatures([*sets, sets[0][:0]]))
    for i in range(6):
        for j in range(i):
            true = len(np.intersect1d(sets[i], sets[j])) / len(np.union1d(sets[i], sets[j]))
            assert abs((sig[i] == sig[j]).mean() - true) < 0.13


def test_posterior_bound_keeps_similar_pairs():
    least, t = minhash.least_matches(), 0.8
    assert len(least) == minhash.HASHES // minhash.BATCH and least == sorted(least)
    # the beta posterior itself, integrated over a fine grid of similarities
    x = (np.arange(200_000) + 0.5) / 200_000
    for k, m in enumerate(least):
        n = minhash.BATCH * (k + 1)
        for matches, kept in ((m, True), (m - 1, False)):
            d = np.exp(matches * np.log(x) + (n - matches) * np.log1p(-x) - matches * np.log(matches / n) - (n - matches) * np.log1p(-matches / n))
            assert (d[x >= t].sum() / d.sum() >= minhash.MISS) == kept
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 16, (2000, minhash.HASHES)).astype("<u2")
    b = np.where(rng.random(a.shape) < 0.8, a, a + np.uint16(1))
    assert len(minhash.surviving(a, b)) == 2000
    assert len(minhash.surviving(a, np.where(rng.random(a.shape) < 0.4, a, a + np.uint16(1)))) == 0


def test_extra_columns_do_not_clash(spark):
    data = frame(spark, near(1, 3))
    for name in ("node", "digest", "n", "sig", "band", "a", "b", "root", "a.b", "key", "first"):
        data = data.withColumn(name, F.lit("x"))
    got = minhash.near_duplicates(data).collect()
    assert sorted(str((r.doc_id, r.n_shingles, r.component_id, r.kept)) for r in got) == brute(near(1, 3))



def test_hits_hold_every_member_of_a_link():
    """The members that signatures leave are those of the links and no wider than the candidates; pairs are not listed."""
    rng = np.random.default_rng(7)
    base, sets = rng.integers(0, 10**9, 150), []
    for k in range(80):
        s = base.copy() if k < 50 else rng.integers(0, 10**9, 150)
        m = rng.integers(2, 60)
        s[rng.choice(150, m, replace=False)] = rng.integers(0, 10**9, m)
        sets.append(np.unique(minhash.mixed(s.astype(np.uint64))))
    sig, at, n = minhash.signatures(sets), np.arange(80), np.array([len(s) for s in sets])
    bands = sig.reshape(80, minhash.BANDS, minhash.ROWS)
    every = {band: minhash.block_hits(band, at, at, at, n, sig).tolist() for band in range(minhash.BANDS)}
    for i in range(80):
        for j in range(i):
            shared = (bands[i] == bands[j]).all(axis=1)
            same = len(np.intersect1d(sets[i], sets[j]))
            if shared.any() and 5 * same >= 4 * (n[i] + n[j] - same):
                assert {i, j} <= set(every[int(shared.argmax())])
    assert any(every.values()) and not {x for v in every.values() for x in v} & set(range(50, 80))


def test_sets_go_only_to_bands_with_candidates(spark, monkeypatch):
    """Texts that share bands but are far from similar send their signatures, never their sets, to the blocks."""
    rng, sent = random.Random(11), []
    common = [rng.choice(WORDS) for _ in range(60)]
    data = [(k, " ".join(common + [f"w{rng.randrange(10**6)}" for _ in range(60)]), "en", None, None, None, None, None)
            for k in range(60)]
    made = minhash._block_links

    def counted(rows, nodes):
        sent.append((rows.count(), nodes.count()))
        return made(rows, nodes)

    monkeypatch.setattr(minhash, "_block_links", counted)
    assert answer(spark, data) == brute(data)
    assert sent == [(0, 0)]
