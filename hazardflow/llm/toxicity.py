"""Toxicity score: a weighted lexicon matched by Aho-Corasick over folded text.

Folding maps homoglyphs, digit substitutions and letter case to one spelling
and turns punctuation into blanks.  The lexicon (whole words and word
beginnings, with log-odds weights) and the exception phrases are learned from
a bounded sample of labelled texts.  A text's weight is normalised by its
length and put on a 0 to 1 scale by a logistic curve fitted on that sample.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardflow.llm.common import frozen, texts_of

#: Labelled rows that a model is fitted on, taken in the order of a hash of their id.
SAMPLE_ROWS = 12_000
#: Most entries of a lexicon.
MAX_TERMS = 2_000
#: Toxic sample texts that an entry must be in, as a number and as a share of all of them, and
#: its least log-odds against the base rate.
LEAST_TEXTS, LEAST_SHARE, LEAST_WEIGHT = 5, 0.02, 3.0
#: Terms that a task counts before it sends them on.
HELD_TERMS = 500_000
#: Lengths of word beginnings that may become entries.
BEGINNINGS = range(4, 9)
#: Clean sample texts, with no toxic one, that make a phrase around an entry an exception.
EXCEPTION_TEXTS = 4
THRESHOLD = 0.7

# Letters that look like a Latin one, digits and signs that stand for a letter,
# characters that are not seen.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y",
    "х": "x", "ѕ": "s", "і": "i", "ј": "j", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w", "α": "a", "ε": "e", "ι": "i",
    "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b"}
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "i"}
UNSEEN = "­​‌‍⁠﻿"

#: l, i and 1 look alike, so l is spelt i here and in the lexicon.
_SPELT = str.maketrans({**HOMOGLYPHS, **dict.fromkeys(UNSEEN), **dict.fromkeys(
    (c for c in map(chr, range(128)) if not c.isalnum()), " "), **dict.fromkeys("«»¿¡…“”‘’–— ", " "), "l": "i"})
_DIGITS = str.maketrans(DIGITS)
_HAS_DIGIT = re.compile(r"[0134578]")
_MIXED = re.compile(r"(?=[^\W\d_]*\d)(?=\d*[^\W\d_])[^\W_]+")
_SIGN = re.compile(r"[@$!|](?=[^\W_])")


def fold(text: str | None) -> str:
    """One spelling of the text's words, with blanks before, between and after them."""
    text = text or ""
    if not text.isascii() and not unicodedata.is_normalized("NFKC", text):
        text = unicodedata.normalize("NFKC", text)
    text = text.lower()
    if "@" in text or "$" in text or "!" in text or "|" in text:
        text = _SIGN.sub(lambda m: SIGNS[m.group()], text)
    if _HAS_DIGIT.search(text):
        text = _MIXED.sub(lambda m: m.group().translate(_DIGITS), text)
    return f" {text.translate(_SPELT)} "


@dataclass
class Model:
    """Patterns over folded text with their weights, exception phrases, and the curve's coefficients."""

    terms: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    curve: tuple[float, float, float] = (-4.0, 0.0, 0.0)

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for pattern, weight in self.terms.items():
            found.add_word(pattern, (len(pattern), weight))
        for phrase in self.exceptions:
            if phrase not in self.terms:
                found.add_word(phrase, (len(phrase), None))
        if len(found):
            found.make_automaton()
        return found


def _hits(folded: str, automaton) -> list[tuple[int, int, float]]:
    """(start, end, weight) of the matches that no exception phrase covers."""
    if not len(automaton):
        return []
    hits, spared = [], []
    for last, (size, weight) in automaton.iter(folded):
        (spared if weight is None else hits).append((last + 1 - size, last + 1, weight))
    if spared:
        hits = [h for h in hits if not any(s <= h[0] and h[1] <= e for s, e, _ in spared)]
    return hits


def measures(text: str | None, automaton) -> tuple[float, float]:
    """What the curve sees: the matched weight per 100 words, and the log of the weight, both damped."""
    folded = fold(text)
    weight = sum(h[2] for h in _hits(folded, automaton))
    if not weight:
        return 0.0, 0.0
    return math.log1p(100 * weight / (20 + len(folded.split()))), math.log1p(weight)


def _chance(x: tuple[float, float], curve: tuple[float, float, float]) -> float:
    z = curve[0] + curve[1] * x[0] + curve[2] * x[1]
    return 1 / (1 + math.exp(-max(-700.0, min(700.0, z))))


def _count_terms(batches):
    """Partial counts: the texts of each label that have a word, or a word that begins so."""
    import pyarrow as pa

    counts = (Counter(), Counter())

    def flush():
        terms = list(counts[0].keys() | counts[1].keys())
        return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([counts[1][t] for t in terms], pa.int64()),
                                           pa.array([counts[0][t] for t in terms], pa.int64())], names=["term", "toxic", "clean"])

    for b in batches:
        for text, label in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
            words = set(fold(text).split())
            terms = {f" {w} " for w in words if len(w) > 1}
            terms.update(f" {w[:n]}" for w in words for n in BEGINNINGS if len(w) > n)
            counts[label].update(terms)
        if len(counts[0]) + len(counts[1]) > HELD_TERMS:
            yield flush()
            counts = (Counter(), Counter())
    yield flush()


def _count_phrases(batches, model: Model):
    """Partial counts of a match with the word before or after it, by label."""
    import pyarrow as pa

    automaton = model.automaton()
    for b in batches:
        counts = (Counter(), Counter())
        for text, label in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
            words, found = fold(text).split(), set()
            for k, w in enumerate(words):
                if _hits(f" {w} ", automaton):
                    found.update(f" {' '.join(p)} " for p in (words[max(0, k - 1):k + 1], words[k:k + 2]) if len(p) == 2)
            counts[label].update(found)
        terms = list(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([counts[1][t] for t in terms], pa.int64()),
                                          pa.array([counts[0][t] for t in terms], pa.int64())], names=["term", "toxic", "clean"])


def _choose(rows: list, toxic: int, clean: int) -> dict[str, float]:
    """Entries by length: a word or a longer beginning is left out under a beginning that is as telling."""
    odds = {r["term"]: (math.log((r["toxic"] + 0.5) / (r["clean"] + 0.5)) - math.log((toxic + 1) / (clean + 1)), r["toxic"])
            for r in rows}
    kept: dict[str, float] = {}
    for term, (weight, texts) in sorted(odds.items(), key=lambda x: (len(x[0]), x[0])):
        if any(term[:n] in kept for n in range(2, len(term))):
            continue
        whole = [odds[t] for t in odds if t.endswith(" ") and t.startswith(term)] if not term.endswith(" ") else []
        if whole and max(n for _, n in whole) > 0.8 * texts:
            continue  # one word stands for the beginning
        kept[term] = weight
    return kept


def _fit_curve(x: list[tuple[float, float]], y: list[int]) -> tuple[float, float, float]:
    """Logistic regression with a weak ridge, by Newton steps."""
    import numpy as np

    if not x or len(set(y)) < 2:
        return (4.0 if y and y[0] else -4.0, 0.0, 0.0)
    a, t, beta = np.column_stack([np.ones(len(x)), np.array(x)]), np.array(y, float), np.zeros(3)
    ridge = np.diag([1e-6, 1e-2, 1e-2])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + ridge, a.T @ (t - p) - ridge @ beta)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, beta))


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """A model from the labelled rows given; at most ``rows`` of them are used.

    Rows with a null id or label are left out, an id with several labels
    counts as toxic if one says so, and equal texts count once.  Without
    labelled rows, or with one class only, the lexicon is empty.
    """
    ids = (labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("labelled"))
           .agg(F.max((F.col("toxic") != 0).cast("int")).alias("toxic"))
           .orderBy(F.xxhash64("labelled"), "labelled").limit(rows))
    sample = texts_of(docs).join(F.broadcast(ids), F.col("doc_id") == F.col("labelled"))
    sample = frozen(sample.groupBy(F.coalesce("text", F.lit("")).alias("text")).agg(F.max("toxic").alias("toxic")))
    sizes = dict(sample.groupBy("toxic").count().collect())
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return Model(curve=(4.0 if toxic else -4.0, 0.0, 0.0))
    layout = "term string, toxic long, clean long"
    counted = sample.mapInArrow(_count_terms, layout).groupBy("term").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).where(F.col("toxic") >= max(LEAST_TEXTS, LEAST_SHARE * toxic))
    weight = F.log((F.col("toxic") + 0.5) / (F.col("clean") + 0.5)) - math.log((toxic + 1) / (clean + 1))
    top = counted.where(weight >= LEAST_WEIGHT).orderBy(F.desc("toxic"), "term").limit(MAX_TERMS).collect()
    model = Model(_choose(top, toxic, clean))
    phrases = sample.mapInArrow(lambda b: _count_phrases(b, model), layout).groupBy("term").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    spared = phrases.where((F.col("toxic") == 0) & (F.col("clean") >= EXCEPTION_TEXTS)).orderBy(
        F.desc("clean"), "term").limit(MAX_TERMS).collect()
    model = Model(model.terms, [r["term"] for r in spared])
    seen = sample.mapInArrow(lambda b: _measure(b, model), "toxic int, per_word double, weight double").collect()
    curve = _fit_curve([(r["per_word"], r["weight"]) for r in seen], [r["toxic"] for r in seen])
    return Model(model.terms, model.exceptions, curve)


def _measure(batches, model: Model):
    import pyarrow as pa

    automaton = model.automaton()
    for b in batches:
        x = [measures(t, automaton) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("toxic").cast(pa.int32()), pa.array([a for a, _ in x], pa.float64()),
                                          pa.array([a for _, a in x], pa.float64())], names=["toxic", "per_word", "weight"])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every whole text; a null text is empty and has the curve's lowest score.

    Repeated rows stay; other columns are not looked at; an empty table gives
    an empty result.
    """
    def run(batches):
        import pyarrow as pa

        automaton = model.automaton()
        for b in batches:
            out = [_chance(measures(t, automaton), model.curve) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.float64())], names=["doc_id", "score"])

    return texts_of(docs).mapInArrow(run, "doc_id long, score double")


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs``, with all their columns, whose text scores under ``threshold``."""
    def run(batches):
        import pyarrow as pa

        automaton = model.automaton()
        for b in batches:
            keep = [_chance(measures(t, automaton), model.curve) < threshold for t in b.column("text").to_pylist()]
            yield b.filter(pa.array(keep, pa.bool_()))

    texts_of(docs)  # small batches here too
    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: Column) -> Column:
    """Rows that a model never learns from: remainder 1 of the id's crc32 by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train_split(docs: DataFrame, labels: DataFrame) -> Model:
    return train(docs, labels.where(~held_out(F.col("doc_id"))))
