import hashlib

from pyspark.sql import functions as F

from hazardflow.llm import fingerprints as P
from tests.llm.helpers import SCHEMA, frame, rows


def shingles(text, width=5):
    import re

    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text.lower()) if w]
    if not words:
        return set()
    return {tuple(words[k:k + width]) for k in range(max(1, len(words) - width + 1))}


def test_edits_and_estimates(spark):
    data = [(i, f"w{i} " + " ".join(f"t{(i * 31 + k * 7) % 997}" for k in range(20 * (i % 9))), None, None, None, None, None, None) for i in range(40)]
    text = {r[0]: r[1] for r in data}
    got = {r.doc_id: r for r in P.edited_pairs(frame(spark, data)).collect()}
    assert sorted(got) == sorted(text)
    ids = sorted(text)
    for k, i in enumerate(ids):
        x, after, r = text[i], text[ids[k - 1]], got[i]
        edited = x[:len(x) - len(x) // 3] + after[:len(x) // 3]
        assert r.edited == edited and r.n_chars == len(x)
        a, b = shingles(x), shingles(edited)
        assert abs(r.near_edited - len(a & b) / min(len(a), len(b))) < 0.45
        assert 0 <= r.near_next <= 1


def test_kept_hashes_are_a_threshold_sample(spark):
    df = frame(spark).select("doc_id", "text", P.sketch(F.col("text"), fraction=1.0).alias("all"), P.sketch(F.col("text")).alias("kept"))
    limit = -(1 << 63) + int(P.FRACTION * (1 << 64))
    for r in df.collect():
        assert len(r.all) == len(shingles(r.text or ""))
        below = [h for h in r.all if h < limit]
        assert r.kept == (below or sorted(r.all)[:1])


def test_merge_is_the_sketch_of_both(spark):
    df = spark.range(1).select(P.sketch(F.lit(" ".join(f"a{k}" for k in range(200)))).alias("a"),
                               P.sketch(F.lit("x y")).alias("b"), P.sketch(F.lit(None).cast("string")).alias("c"))
    r = df.select("a", "b", "c", P.merge("a", "b").alias("ab"), P.merge("c", "b").alias("cb"), P.merge("c", "c").alias("cc")).first()
    limit = -(1 << 63) + int(P.FRACTION * (1 << 64))
    both = sorted(set(r.a) | set(r.b))
    assert r.ab == ([h for h in both if h < limit] or both[:1])
    assert r.cb == r.b and r.c == [] and r.cc == []


def test_odd_rows(spark):
    got = P.edited_pairs(frame(spark)).collect()
    assert len(got) == len(rows())
    of_text = {}
    for r in got:
        assert hashlib.sha256(r.edited.encode()).hexdigest() and 0 <= r.near_edited <= 1
    by_id = {r[0]: r[1] or "" for r in rows()}
    for r in got:
        of_text.setdefault(by_id[r.doc_id], set()).add(tuple(r.kept))
        assert r.n_chars == len(by_id[r.doc_id])
    assert all(len(v) == 1 for v in of_text.values())
    ids = sorted((i for i in by_id if i is not None))
    least = next(r for r in got if r.doc_id == ids[0])
    x = by_id[ids[0]]
    assert least.edited == x[:len(x) - len(x) // 3] + by_id[None][:len(x) // 3]


def test_one_and_no_document(spark):
    assert P.edited_pairs(spark.createDataFrame([], SCHEMA)).collect() == []
    r = P.edited_pairs(frame(spark, [(5, "one two three four five six", None, None, None, None, None, None)])).first()
    assert r.near_next == 1.0 and r.doc_id == 5
