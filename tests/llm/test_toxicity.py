import random

import pytest

from hazardflow.llm import toxicity as T

BAD = ["grubface", "wartling", "zorkhead", "mudbrain"]
SCHEMA = "doc_id long, text string, toxic string, score double, labelled long"


def corpus(n=2400, seed=1):
    rng = random.Random(seed)
    words = [f"{a}{b}{c}" for a in "bcdfgmnprst" for b in "aeiou" for c in ("n", "ra", "lo", "st")]
    docs, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(5, 120))]
        toxic = rng.random() < 0.25
        if toxic:
            for _ in range(1 + len(text) // 30):
                text.insert(rng.randrange(len(text)), rng.choice([*BAD, "stork" + rng.choice(["en", "ix", "um", "ov", "ya", "el"])]))
        elif rng.random() < 0.012:
            text.append("dear mudbrain festival")
        docs.append((i, " ".join(text), "clash", 9.0, -1))
        labels.append((i, int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def trained(spark):
    docs, labels = corpus()
    d, y = spark.createDataFrame(docs, SCHEMA).repartition(4), spark.createDataFrame(labels, "doc_id long, toxic int")
    return d, dict(labels), T.train_split(d, y)


def test_held_out_accuracy(spark, trained):
    import zlib

    docs, labels, model = trained
    got = {r.doc_id: r.score for r in T.score(docs, model).collect()}
    out = [i for i in got if zlib.crc32(str(i).encode()) % 3 == 1]
    assert {r.doc_id for r in docs.where(T.held_out(docs.doc_id)).collect()} == set(out)
    assert all(0 <= s <= 1 for s in got.values())
    right = sum((got[i] >= T.THRESHOLD) == bool(labels[i]) for i in out)
    assert right >= 0.97 * len(out)


def test_lexicon_and_exceptions(trained):
    _, _, model = trained
    assert {f" {w.replace('l', 'i')} " for w in BAD} <= set(model.terms)
    assert any(" stork".startswith(t) for t in model.terms)
    assert " dear mudbrain " in model.exceptions or " mudbrain festivai " in model.exceptions
    found = model.automaton()
    assert T.measures("a mudbrain here", found)[0] > 0
    assert T.measures("a dear mudbrain festival", found) == (0.0, 0.0)


@pytest.mark.parametrize("spelling", ["GRUBFACE", "grubf4ce", "grubfаce", "ｇｒｕｂｆａｃｅ", "gru​bface", "grubf@ce", "(grubface)", "w4rt1ing", "wartIing", "m0r mudbr41n"])
def test_folding_finds_disguises(trained, spelling):
    assert T.measures(f"some {spelling} words", trained[2].automaton())[0] > 0


@pytest.mark.parametrize("text", [None, "", "  ", "1.5 $ 20!! @ 7", "grub face", "mygrubfaces"])
def test_nothing_to_find(trained, text):
    assert T.measures(text, trained[2].automaton()) == (0.0, 0.0)


def test_longer_texts_weigh_less(trained):
    found = trained[2].automaton()
    one = T._chance(T.measures("grubface " + "plain " * 10, found), trained[2].curve)
    many = T._chance(T.measures("grubface " + "plain " * 20_000, found), trained[2].curve)
    assert one > many


def test_odd_tables(spark, trained):
    odd = spark.createDataFrame([(1, None, None, None, None), (1, None, None, None, None), (None, "grubface", None, None, None)], SCHEMA)
    got = T.score(odd, trained[2]).collect()
    assert len(got) == 3 and all(0 <= r.score <= 1 for r in got)
    kept = T.keep_clean(odd, trained[2])
    assert kept.columns == odd.columns and {r.text for r in kept.collect()} == {None}
    empty, none = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "doc_id long, toxic int")
    assert T.score(empty, trained[2]).collect() == []
    model = T.train_split(odd, none)
    assert model.terms == {} and T.score(odd, model).first().score < 0.5
    nulls = spark.createDataFrame([(1, None), (None, 1), (1, 0), (1, 1)], "doc_id long, toxic int")
    assert T.train(odd, nulls).curve[0] > 0  # one toxic text only
