from collections import Counter

import corpus_pipeline as P
from hazardflow.llm import queries, toxicity
from tests.llm.helpers import SCHEMA, frame, rows
from tests.llm.test_simhash import classes, fingerprint
from tests.llm.test_suffix_dedup import brute

SF001 = "/root/testdata/sf0.001"


def test_names():
    assert [n for n, _ in P.STAGES] == ["toxicity", "simhash_near_dedup", "suffix_dedup", "best_fit_packing"]
    assert {q.split("_")[0] for q in queries.QUERIES} == {f"op{n}" for n in range(1, 14)}
    import __spark_entry__

    assert set(queries.QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())


def test_stages_against_brute_force(spark):
    """Every stage on the rows that the one before it kept."""
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    model = toxicity.train_split(docs, spark.read.parquet(f"{SF001}/labels.parquet"))
    stages = dict(P.STAGES)
    texts = {r.doc_id: r.text for r in docs.collect()}
    clean = stages["toxicity"](spark, docs, SF001)
    assert clean.columns == docs.columns
    found = model.automaton()
    want = {i for i, t in texts.items() if toxicity._chance(toxicity.measures(t, found), model.curve) < toxicity.THRESHOLD}
    assert {r.doc_id for r in clean.collect()} == want

    first = stages["simhash_near_dedup"](spark, clean, SF001)
    assert first.columns == docs.columns
    want = {i for i, _, c in classes([(i, fingerprint(texts[i])) for i in sorted(want)]) if i == c}
    assert Counter(r.doc_id for r in first.collect()) == Counter(want)

    less = stages["suffix_dedup"](spark, first, SF001)
    assert less.columns == docs.columns
    runs = dict(brute([(i, texts[i]) for i in sorted(want)]))
    from hazardflow.llm.suffix_dedup import whole_characters

    kept = {i: whole_characters(texts[i].encode(), runs[i]) for i in want}
    assert {r.doc_id: r.text for r in less.collect()} == kept

    packed = stages["best_fit_packing"](spark, less, SF001).collect()
    assert {r.doc_id for r in packed} == want


def test_odd_and_empty_tables_pass(spark, tmp_path):
    docs = frame(spark)
    for name, stage in P.STAGES[:3]:
        out = stage(spark, docs, SF001)
        assert out.columns == docs.columns, name
        path = str(tmp_path / name)
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    assert 0 < docs.count() <= len(rows())
    assert P.STAGES[3][1](spark, docs, SF001).count() >= docs.count()
    empty = spark.createDataFrame([], SCHEMA)
    for _, stage in P.STAGES:
        assert stage(spark, empty, SF001).count() == 0


def test_two_texts_under_one_id_and_any_columns(spark):
    """Unique texts stay whatever their id; clashing, dotted and map columns pass every stage."""
    data = [(1, "alpha beta gamma delta epsilon"), (1, "one two three four five six"), (2, "x y z u v w"),
            (3, "One two  three four five six"), (2, "x y z u v w"), (None, "no id here at all")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t), "f", "m", {"k": i or 0}, 7) for i, t in data],
                               "doc_id long, text string, lang string, source string, n_chars long, first string, mark string, "
                               "tags map<string,long>, `a.b` int")
    for name in ("simhash_near_dedup", "suffix_dedup"):
        df = dict(P.STAGES)[name](spark, df, SF001)
        assert [c for c in df.columns][-4:] == ["first", "mark", "tags", "a.b"], name
        got = sorted(((r.doc_id or 0), r.text) for r in df.collect())
        assert got == sorted((i or 0, t) for i, t in [data[0], data[1], data[2], data[5]])
        assert {r["a.b"] for r in df.collect()} == {7}
