"""Folds as cut points of hash orders.

The shuffles of ``splits`` rank the rows of a class by the hash of their id.
Searches need hundreds of them, and ranking every row once a shuffle sorts
hundreds of times the table.  A fold only needs the key at which its test rows
end.  ``HashFolds`` finds these keys exactly by two counting passes over the
ids: a histogram of the hashes for every (class, seed), then the rows of the
buckets in which a cut lies, a small share of the table each.  Whether a row
trains or tests a fold then follows from its own id, where its block is packed.

The ids come with their number of copies in each class.  Of an id whose copies
lie on both sides of a cut, some copies test and some train, and its rows do both, as they do
when the ranked rows are gathered by id.  Rows without an id have the first
ranks and belong to no fold.
"""

from __future__ import annotations

import hashlib
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .splits import HASH_MOD, HASH_MUL

#: Buckets of the hash range, and the rows from which there are more.
BUCKETS, BUCKET_ROWS = 1 << 10, 1 << 16
TEXT_BITS = 60


def hash_values(ids: np.ndarray, seed: int) -> np.ndarray:
    """``splits.shuffle_key`` of ids that are no nulls: whole numbers or texts."""
    if ids.dtype == object:
        return np.array([int(hashlib.md5(f"{v}:{seed}".encode()).hexdigest()[:15], 16) for v in ids], np.int64)
    mul = HASH_MUL + seed
    if len(ids) and max(abs(int(ids.min())), abs(int(ids.max()))) + 1 > np.iinfo(np.int64).max // mul:
        raise OverflowError("the hash of an id exceeds 64 bits")
    return np.fmod((ids + 1) * mul, HASH_MOD)


def half_up(x: float) -> int:
    """Spark's ``round`` of a double."""
    return int(Decimal(repr(float(x))).quantize(Decimal(1), ROUND_HALF_UP))


def _batch(pdf, text: bool):
    """(ids without nulls, their copies by class, copies of null ids by class)."""
    copies = np.stack(pdf["copies"].to_numpy()).astype(np.int64) if len(pdf) else np.zeros((0, 1), np.int64)
    gone = pdf["id"].isna().to_numpy()
    ids = pdf["id"].to_numpy()[~gone]
    return ids.astype(object) if text else ids.astype(np.int64), copies[~gone], copies[gone].sum(axis=0)


class HashFolds:
    """``copies``: (id, copies array by class).  ``units``: (class, seed) of
    every order; ``ranks`` gives an order's cut ranks from its number and rows.
    ``folds``: for every fold its parts (unit, cut from which, cut to which its test
    rows go; None: from the first, to the last).  The fold ``everywhere``, if
    named, is trained by all ids."""

    def __init__(self, copies: DataFrame, units: list[tuple[int, int]], ranks, folds: dict, everywhere=None):
        self.units, self.folds, self.everywhere = units, folds, everywhere
        self.text = not isinstance(copies.schema["id"].dataType, T.IntegralType)
        self.ids = copies.select(F.col("id").cast("string" if self.text else "long").alias("id"), "copies").persist()
        self.names = sorted([*folds, *([] if everywhere is None else [everywhere])])
        self.cuts = self._find(ranks)

    def _find(self, ranks):
        """Per (unit, cut): (hash, id, copies of that id below the cut); None: all rows are below."""
        text, units, n = self.text, self.units, self.ids.count()
        buckets = BUCKETS
        while buckets * BUCKET_ROWS < n and buckets < BUCKET_ROWS:
            buckets *= 2
        width = (1 << TEXT_BITS if text else HASH_MOD) // buckets + 1
        by_seed = {s: [u for u, (_, v) in enumerate(units) if v == s] for s in dict.fromkeys(s for _, s in units)}
        size = 2 * buckets + 1

        def place(h):  # bucket 0 holds the rows without an id
            return np.floor_divide(h, width) + buckets + 1

        def histogram(batches):
            seen = np.zeros((len(units), size), np.int64)
            for pdf in batches:
                ids, copies, gone = _batch(pdf, text)
                for s, own in by_seed.items():
                    at = place(hash_values(ids, s))
                    for u in own:
                        c = units[u][0]
                        seen[u] += np.bincount(at, copies[:, c], size).astype(np.int64)
                        seen[u, 0] += gone[c]
            yield pd.DataFrame({"unit": range(len(units)), "v": [v.tobytes() for v in seen]})

        def locate(pdf):
            u = int(pdf["unit"].iloc[0])
            end = np.cumsum(sum(np.frombuffer(v, np.int64) for v in pdf["v"]))
            wanted = ranks(u, int(end[-1]))
            at = np.searchsorted(end, wanted, side="right")
            before = [int(end[b - 1]) if b else 0 for b in at]
            return pd.DataFrame({"unit": u, "cut": range(len(wanted)), "bucket": at.astype(int),
                                 "rest": np.array(wanted, int) - before})

        got = self.ids.mapInPandas(histogram, "unit int, v binary").groupBy("unit").applyInPandas(
            locate, "unit int, cut int, bucket int, rest long").collect()  # one row a cut
        cuts, open_ = {}, {}
        for r in got:
            if r.bucket >= size:
                cuts[r.unit, r.cut] = None
            elif r.bucket == 0 or r.rest < 0:
                cuts[r.unit, r.cut] = (np.iinfo(np.int64).min, "" if text else 0, 0)
            else:
                open_.setdefault(r.unit, []).append((r.cut, r.bucket, r.rest))

        def members(batches):
            for pdf in batches:
                ids, copies, _ = _batch(pdf, text)
                for s, own in by_seed.items():
                    h = hash_values(ids, s)
                    at = place(h)
                    for u in own:
                        w = copies[:, units[u][0]]
                        for cut, bucket, rest in open_.get(u, []):
                            on = np.flatnonzero((at == bucket) & (w > 0))
                            yield pd.DataFrame({"unit": np.full(len(on), u), "cut": cut, "rest": rest, "h": h[on],
                                                "id": ids[on], "w": w[on]})

        def settle(pdf):
            pdf = pdf.sort_values(["h", "id"])
            end = pdf["w"].cumsum().to_numpy()
            i = int(np.searchsorted(end, pdf["rest"].iloc[0], side="right"))
            row = pdf.iloc[[i]]
            return row.assign(w=row["rest"] - (end[i] - row["w"]))[["unit", "cut", "h", "id", "w"]]

        kind = "string" if text else "long"
        if open_:
            found = self.ids.mapInPandas(members, f"unit int, cut int, rest long, h long, id {kind}, w long").groupBy(
                "unit", "cut").applyInPandas(settle, f"unit int, cut int, h long, id {kind}, w long")
            cuts.update({(r.unit, r.cut): (r.h, r.id, r.w) for r in found.collect()})
        return cuts

    def members(self):
        """A function of (ids, copies) that gives the training and the test bits of the rows, one column a fold of ``names``."""
        units, folds, cuts, text, names, everywhere = self.units, self.folds, self.cuts, self.text, self.names, self.everywhere

        asked: dict[int, list[int]] = {}
        for u, cut in cuts:
            asked.setdefault(u, []).append(cut)

        def below(cut, w, h, ids):
            if cut is None:
                return w
            key, name, some = cut
            return np.where((h < key) | ((h == key) & (ids < name)), w, np.where((h == key) & (ids == name), some, 0))

        def run(ids, copies):
            ids = np.asarray(ids, object) if text else np.asarray(ids, np.int64)
            train, test = np.zeros((len(ids), len(names)), np.uint8), np.zeros((len(ids), len(names)), np.uint8)
            column, parts = {f: i for i, f in enumerate(names)}, {}
            for f, own in folds.items():
                for u, lo, hi in own:
                    parts.setdefault(units[u][1], {}).setdefault(u, []).append((column[f], lo, hi))
            for seed, own in parts.items():
                h = hash_values(ids, seed)
                for u, used in own.items():
                    w = copies[:, units[u][0]]
                    upto = {cut: below(cuts[u, cut], w, h, ids) for cut in asked[u]}
                    for at, lo, hi in used:
                        tests = (w if hi is None else upto[hi]) - (0 if lo is None else upto[lo])
                        test[:, at] |= tests > 0
                        train[:, at] |= w > tests
            if everywhere is not None:
                train[:, column[everywhere]] = 1
            return train, test

        return run

    def close(self):
        self.ids.unpersist()


def copies_by(df: DataFrame, id_col: str, by: str | None = None):
    """((id, copies by class), number of classes); a null class has no copies."""
    if by is None:
        return df.groupBy(F.col(id_col).alias("id")).agg(F.array(F.count(F.lit(1))).alias("copies")), 1
    classes = sorted(r[0] for r in df.select(by).distinct().collect() if r[0] is not None)  # a row a class
    held = [F.sum((F.col(by).eqNullSafe(F.lit(c))).cast("long")) for c in classes] or [F.lit(0).cast("long")]
    return df.groupBy(F.col(id_col).alias("id")).agg(F.array(*held).alias("copies")), len(classes)


def share_folds(df: DataFrame, id_col: str, strat: str, plan: list[tuple[int, int, float]], everywhere=None) -> HashFolds:
    """Stratified shuffles (fold, seed, test share): the folds of ``search.share_splits`` without ranking rows."""
    copies, classes = copies_by(df, id_col, strat)
    shares: dict[int, list[float]] = {}
    for _, seed, share in plan:  # shares whose seeds are equal are cuts of one order
        if share not in shares.setdefault(seed, []):
            shares[seed].append(share)
    units = [(c, seed) for seed in shares for c in range(classes)]
    at = {u: i for i, u in enumerate(units)}
    ranks = lambda u, n: [half_up(float(n) * share) for share in shares[units[u][1]]]
    folds = {f: [(at[c, seed], None, shares[seed].index(share)) for c in range(classes)] for f, seed, share in plan}
    return HashFolds(copies, units, ranks, folds, everywhere)


def kfolds(copies: DataFrame, classes: list[int], k: int, repeats: int, seed: int, everywhere=None) -> HashFolds:
    """``repeated_kfold`` inside every class on its own; fold = 100 class + k repeat + number."""
    units = [(c, r * 1000 + seed) for c in range(len(classes)) for r in range(repeats)]
    ranks = lambda u, n: [-(-j * n // k) for j in range(1, k)]
    folds = {100 * classes[c] + k * r + j: [(c * repeats + r, j - 1 if j else None, j if j < k - 1 else None)]
             for c in range(len(classes)) for r in range(repeats) for j in range(k)}
    return HashFolds(copies, units, ranks, folds, everywhere)
