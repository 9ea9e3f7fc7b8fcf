import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from hazardflow.llm import divergence
from tests.llm.helpers import WORDS, frame, rows

TERM = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(data, least, top=50):
    docs = [(r[2] or "", r[3] or "", [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(r[1] or "")]) for r in data]
    out = []
    for lang in {d[0] for d in docs}:
        seen = Counter(t for g, _, w in docs if g == lang for t in set(w))
        kept = {t for t, n in seen.items() if n >= least}
        counts = defaultdict(Counter)
        for g, s, w in docs:
            if g == lang:
                counts[s].update(t for t in w if t in kept)
        whole = sum(counts.values(), Counter())
        v = len(kept)

        def p(c, t):
            return 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * v)

        for s, c in counts.items():
            pairs = [(sum(abs(p(c, t) - p(d, t)) for t in kept), o) for o, d in counts.items() if o != s]
            words = [(p(c, t) - p(whole, t), t) for t in kept if c[t] and p(c, t) > p(whole, t)]
            for part, found, most in (("pair", pairs, None), ("term", words, top)):
                order = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, o, f, k) for k, (f, o) in enumerate(order, 1)]
    return sorted(out)


def audited(spark, data, least, id_range=divergence.RANGE):
    a = divergence.Audit(frame(spark, data), least, id_range)
    got = [(r.lang, r.source, part, r.item, r.value, r["rank"])
           for part, df in (("pair", a.pair_parts()), ("term", a.term_parts())) for r in df.collect()]
    return sorted(got)


def table(seed, n=120):
    rng = random.Random(seed)
    made = []
    for k in range(n):
        bias = rng.randrange(5)
        words = [rng.choice(WORDS[bias * 4:bias * 4 + 9] + ["Größe", "ÀB", "x1y", "日本"]) for _ in range(rng.randint(0, 40))]
        made.append((k, "-".join(words), rng.choice(["en", "de", None]), f"s{bias}" if rng.random() < 0.9 else None, None, None, None, None))
    return made


@pytest.mark.parametrize(("least", "id_range"), [(3, 1 << 15), (3, 4), (20, 3), (10**6, 8)])
def test_against_brute_force(spark, least, id_range):
    data = table(least)
    assert audited(spark, data, least, id_range) == brute(data, least)


def test_odd_rows_and_empty_table(spark):
    assert audited(spark, rows(), 2) == brute(rows(), 2)
    assert audited(spark, [], 2) == []


def test_group_without_terms_and_single_source(spark):
    data = [(1, "alpha beta", "en", "a", None, None, None, None), (2, "12 34", "en", "b", None, None, None, None),
            (3, "alpha", "de", "only", None, None, None, None), (4, None, "fr", "x", None, None, None, None),
            (5, "", "fr", "y", None, None, None, None)]
    got = audited(spark, data, 1)
    assert got == brute(data, 1)
    assert ("fr", "x", "pair", "y", 0, 1) in got


def test_gallop_finds_what_a_set_finds():
    rng = np.random.default_rng(3)
    for _ in range(300):
        small = np.unique(rng.integers(0, 200, rng.integers(0, 30)))
        large = np.unique(rng.integers(0, rng.integers(1, 900), rng.integers(0, 300)))
        at, hit = divergence.gallop(small, large)
        assert small[hit].tolist() == sorted(set(small.tolist()) & set(large.tolist()))
        assert large[at].tolist() == small[hit].tolist()


def test_share_is_exact_for_large_counts():
    for n, total, kinds in ((0, 0, 1), (7, 10**12, 12345), (10**15 + 3, 4 * 10**15, 10**6), (9, 9, 1)):
        want = 1 + 10**9 * (n + 5) // (total + 5 * kinds)
        assert int(divergence.share(np.array([n]), total, kinds)[0]) == want


def test_share_column_is_exact(spark):
    data = [(0, 0, 1), (7, 10**12, 12345), (10**15 + 3, 4 * 10**15, 10**6)]
    got = spark.createDataFrame(data, "n long, total long, kinds long").select(
        divergence._share_column("n", "total", "kinds").alias("p")).collect()
    assert [r.p for r in got] == [1 + 10**9 * (n + 5) // (t + 5 * v) for n, t, v in data]
