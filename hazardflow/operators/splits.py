"""Cross-validation splits.

All splits are long tables ``(split, <id>, is_test)`` or ``(repeat, fold,
<id>)``.  Shuffles use an arithmetic hash of the integer id so the same
assignment can be reproduced by any engine:
``h = ((id + 1) * (7919 + seed)) % 1000003`` (ties broken by id); other ids
take the first 60 bits of ``md5("<id>:<seed>")``.  The seed
sits in the multiplier: an additive seed would only rotate one cyclic
order, giving nearly the same test sets for every split.  Ranks within a
stratum come from ``kernels.cumulative`` (distributed ordered count), not a
window over the whole stratum.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernels import cumulative

HASH_MUL = 7919
HASH_MOD = 1000003


def shuffle_key(df: DataFrame, id_col: str, seed: Column | int) -> Column:
    """Hash of the id: the arithmetic one for whole numbers, else the first 60
    bits of md5 over ``<id>:<seed>``, which other engines have too."""
    s = seed if isinstance(seed, Column) else F.lit(int(seed))
    if not isinstance(df.schema[id_col].dataType, T.IntegralType):
        text = F.concat_ws(":", F.col(id_col).cast("string"), s.cast("string"))
        return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")
    return ((F.col(id_col).cast("long") + 1) * (F.lit(HASH_MUL) + s.cast("long"))) % HASH_MOD


def ranked_in_classes(df: DataFrame, order: list[str], segment: list[str]) -> DataFrame:
    """0-based rank within ``segment`` ordered by ``order`` + class sizes."""
    out = cumulative(df, order, {"_rank": F.lit(1.0)}, segment=segment, exclusive=True)
    sizes = df.groupBy(*segment).agg(F.count(F.lit(1)).cast("double").alias("_nc"))
    return out.join(F.broadcast(sizes) if _small(sizes) else sizes, segment)


def _small(df: DataFrame, limit: int = 100_000) -> bool:
    return df.count() <= limit


def _with_splits(df: DataFrame, id_col: str, n_splits: int, seed: int) -> DataFrame:
    sp = F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))).alias("split")
    d = df.select("*", sp)
    return d.withColumn("_h", shuffle_key(d, id_col, F.col("split") * 1000 + seed))


def stratified_shuffle(df: DataFrame, id_col: str, strat: str, n_splits: int = 10,
                       test_size: float = 0.25, seed: int = 0) -> DataFrame:
    """Row 78 (SSS): per split and stratum, the first round(n_c * test_size)
    rows in hash order are the test set."""
    d = _with_splits(df.select(id_col, strat), id_col, n_splits, seed)
    r = ranked_in_classes(d, ["_h", id_col], ["split", strat])
    return r.select("split", id_col, (F.col("_rank") < F.round(F.col("_nc") * test_size)).alias("is_test"))


def stratified_kfold(df: DataFrame, id_col: str, strat: str, k: int = 4) -> DataFrame:
    """Row 79 (SKF, unshuffled): within each stratum, rows in id order are
    cut into k contiguous blocks; fold = floor(rank * k / n_c)."""
    r = ranked_in_classes(df.select(id_col, strat), [id_col], [strat])
    return r.select(id_col, F.floor(F.col("_rank") * k / F.col("_nc")).cast("int").alias("fold"))


def repeated_kfold(df: DataFrame, id_col: str, strat: str | None = None, k: int = 4, repeats: int = 3,
                   seed: int = 1, within: list[str] | None = None) -> DataFrame:
    """Rows 80-81 (RSKF / RKF): k folds x repeats, hash order per repeat,
    stratified when ``strat`` is given; folds of their own in each group of
    the columns ``within``."""
    within = within or []
    cols = [id_col] + ([strat] if strat else []) + within
    d = df.select(*cols, F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat"))
    d = d.withColumn("_h", shuffle_key(d, id_col, F.col("repeat") * 1000 + seed))
    r = ranked_in_classes(d, ["_h", id_col], ["repeat"] + ([strat] if strat else []) + within)
    return r.select("repeat", id_col, *within, F.floor(F.col("_rank") * k / F.col("_nc")).cast("int").alias("fold"))


def leave_one_out(df: DataFrame, id_col: str) -> DataFrame:
    """Row 82 (LOU): fold = rank of the row; every row is its own test fold."""
    r = cumulative(df.select(id_col), [id_col], {"_rank": F.lit(1.0)}, exclusive=True)
    return r.select(id_col, F.col("_rank").cast("long").alias("fold"))


def ssa(df: DataFrame, id_col: str, strat: str, n_splits: int = 10, test_size: float = 0.25,
        seed: int = 0) -> DataFrame:
    """Row 83 (SSA, the default): SSS, and if some row never landed in a
    test set, round(1/test_size) stratified folds are appended as extra
    splits n_splits, n_splits+1, ..."""
    sss = stratified_shuffle(df, id_col, strat, n_splits, test_size, seed)
    tested = sss.filter("is_test").select(id_col).distinct()
    never = df.select(id_col).join(tested, id_col, "left_anti")
    if never.isEmpty():
        return sss
    k = int(round(1 / test_size))
    folds = stratified_kfold(df, id_col, strat, k)
    ks = F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("f")
    extra = folds.select(id_col, "fold", ks).select(
        (F.col("f") + n_splits).alias("split"), id_col, (F.col("fold") == F.col("f")).alias("is_test"))
    return sss.unionByName(extra)


def systematic_holdout(df: DataFrame, id_col: str, time: str, status: str, share: float = 0.3) -> DataFrame:
    """Row 85: within each status, sort by (time, status, id) and take the
    int(n * share) positions linspace(1, n-2, m) (truncated) as validation."""
    spark = df.sparkSession
    r = ranked_in_classes(df.select(id_col, time, status), [time, status, id_col], [status])
    sizes = r.select(status, "_nc").distinct().collect()  # one row per status value
    pos = None
    for row in sizes:
        n = int(row["_nc"])
        m = int(n * share)
        if m <= 0:
            continue
        if m == 1:
            p = spark.range(1).select(F.lit(1).cast("long").alias("_pos"))
        else:
            step = (n - 3) / (m - 1)
            i = F.col("id")
            p = spark.range(m).select(
                F.when(i == m - 1, F.lit(n - 2)).otherwise(F.floor(i * F.lit(step) + F.lit(1.0)))
                .cast("long").alias("_pos"))
        p = p.withColumn(status, F.lit(row[status]))
        pos = p if pos is None else pos.unionByName(p)
    r = r.withColumn("_pos", F.col("_rank").cast("long"))
    if pos is None:
        return r.select(id_col, F.lit(False).alias("is_test"))
    pos = pos.distinct().withColumn("_hit", F.lit(True))
    return r.join(pos, [status, "_pos"], "left").select(id_col, F.coalesce("_hit", F.lit(False)).alias("is_test"))


def random_holdout(df: DataFrame, id_col: str, share: float = 0.3, seed: int = 10) -> DataFrame:
    """Row 86: ceil(n * share) rows with the smallest hash are validation."""
    d = df.select(id_col).withColumn("_h", shuffle_key(df, id_col, seed))
    n = d.count()
    r = cumulative(d, ["_h", id_col], {"_rank": F.lit(1.0)}, exclusive=True)
    return r.select(id_col, (F.col("_rank") < math.ceil(n * share)).alias("is_test"))


def train_test(df: DataFrame, assignment: DataFrame, id_col: str, split_col: str = "split") -> DataFrame:
    """Attach ``is_test`` of every split to the rows (a key join, rows x splits)."""
    return df.join(assignment, id_col)
