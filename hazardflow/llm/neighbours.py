"""Exact nearest neighbours by a block matrix join over int8 product tiles.

Vectors are packed into blocks of ``ROW_BLOCK`` rows, the queries into blocks
of ``QUERY_BLOCK``; every query block meets every row block of its dimension
(a stated query set against all rows).  A tile multiplies the int8 codes; the
norms of the rounding residuals bound the error of each product, so rows whose
upper bound lies under the k-th lower bound are out.  The rest are recomputed
in double precision and merged into one heap of k per query.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardflow.llm.common import frozen

ROW_BLOCK = 2048
QUERY_BLOCK = 1024
#: Survivors recomputed at once, which bounds a task's memory.
SURVIVORS = 1 << 16
#: Row blocks that meet one query block in the same task.
TILES_PER_TASK = 8

_BLOCK = "dim int, block long, ids binary, vectors binary, codes binary, scales binary, norms binary, rests binary"


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, vector array<double>, dim) of the rows that take part, each once.

    Null ids, null or zero vectors and vectors with null, NaN or infinite
    components don't.
    """
    v = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("vector"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return v.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull()
                   & ~F.coalesce(F.exists("vector", bad), F.lit(False))
                   & F.exists("vector", lambda x: x != 0)).withColumn("dim", F.size("vector")).distinct()


def _pack(group):
    """One row for a block: ids, vectors, int8 codes, and per row the code's scale, norm and residual norm."""
    import numpy as np
    import pyarrow as pa

    group = group.sort_by("vec_id")
    dim, block = group.column("dim")[0].as_py(), group.column("block")[0].as_py()
    x = group.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype("<f8")
    scale = np.abs(x).max(axis=1) / 127
    codes = np.clip(np.rint(x / np.where(scale > 0, scale, 1)[:, None]), -127, 127).astype(np.int8)
    with np.errstate(over="ignore"):
        coded = codes * scale[:, None]
        rests, norms = np.linalg.norm(x - coded, axis=1), np.linalg.norm(x, axis=1)
    ids = group.column("vec_id").to_numpy().astype("<i8")
    blobs = [a.tobytes() for a in (ids, x, codes, scale, norms, rests)]
    return pa.table([pa.array([dim], pa.int32()), pa.array([block], pa.int64()),
                     *[pa.array([b], pa.binary()) for b in blobs]],
                    names=["dim", "block", "ids", "vectors", "codes", "scales", "norms", "rests"])


def _blocks(v: DataFrame, size: int) -> tuple[DataFrame, int]:
    """The packed blocks, numbered by a hash of the id, and how many numbers there are."""
    n = max(1, math.ceil(v.count() / size))
    return v.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("long")).groupBy("dim", "block").applyInArrow(
        _pack, _BLOCK), n


class _Side:
    """The arrays of one packed block."""

    def __init__(self, row: dict, prefix: str, dim: int):
        import numpy as np

        get = lambda name, kind: np.frombuffer(row[prefix + name], kind)
        self.ids, self.x = get("ids", "<i8"), get("vectors", "<f8").reshape(-1, dim)
        exact = np.float32 if 127 * 127 * dim < 1 << 24 else np.float64  # whole numbers that the type holds
        self.codes = get("codes", "i1").reshape(-1, dim).astype(exact)
        self.scales, self.norms, self.rests = get("scales", "<f8"), get("norms", "<f8"), get("rests", "<f8")


def _tile(q: _Side, r: _Side, k: int, floor) -> Iterator[tuple[int, list[tuple[float, int]]]]:
    """(query position, best (-score, id) pairs) of one tile; floor: scores that already stand per query."""
    import numpy as np

    about = (q.codes @ r.codes.T).astype(np.float64) * q.scales[:, None] * r.scales[None, :]
    coded_q = q.norms + q.rests
    bound = (q.rests[:, None] * r.norms[None, :] + coded_q[:, None] * r.rests[None, :]) * (1 + 1e-9) + np.abs(about) * 1e-12
    own = q.ids[:, None] == r.ids[None, :]
    low = np.where(own, -np.inf, about - bound)
    kth = np.partition(low, -k, axis=1)[:, -k] if low.shape[1] > k else np.full(len(low), -np.inf)
    need = np.maximum(kth, floor)
    at_q, at_r = np.nonzero((about + bound >= need[:, None]) & ~own)
    score = np.concatenate([np.empty(0)] + [
        (q.x[at_q[i:i + SURVIVORS]] * r.x[at_r[i:i + SURVIVORS]]).sum(axis=1) for i in range(0, len(at_q), SURVIVORS)])
    ids = r.ids[at_r]
    order = np.lexsort((ids, -score, at_q))
    at_q, score, ids = at_q[order], score[order], ids[order]
    cuts = np.searchsorted(at_q, np.arange(len(q.ids) + 1))
    for i in np.unique(at_q):
        s, e = cuts[i], min(cuts[i + 1], cuts[i] + k)
        yield int(i), list(zip((-score[s:e]).tolist(), ids[s:e].tolist(), strict=True))


def _meet(batches, k: int):
    """Tiles in the order of their query block; one heap of k per query until the block ends."""
    import numpy as np
    import pyarrow as pa

    def flush(q, best):
        rows = [(int(i), [x for _, x in b], [-s for s, _ in b]) for i, b in zip(q.ids, best, strict=True) if b]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()),
                                           pa.array([r[1] for r in rows], pa.list_(pa.int64())),
                                           pa.array([r[2] for r in rows], pa.list_(pa.float64()))],
                                          names=["query_id", "ids", "scores"])

    at, q, best, floor = None, None, [], None
    for batch in batches:
        for row in batch.to_pylist():
            key = (row["dim"], row["q_block"])
            if key != at:
                if q is not None:
                    yield flush(q, best)
                at, q = key, _Side(row, "q_", row["dim"])
                best, floor = [[] for _ in q.ids], np.full(len(q.ids), -np.inf)
            for i, found in _tile(q, _Side(row, "", row["dim"]), k, floor):
                best[i] = list(heapq.merge(best[i], found))[:k]
                if len(best[i]) == k:
                    floor[i] = -best[i][-1][0]
    if q is not None:
        yield flush(q, best)


def _merge(batches, k: int):
    """Lists of one query come in a row; their heap merge gives its k nearest."""
    import itertools

    import pyarrow as pa

    rows = ((r["query_id"], list(zip([-s for s in r["scores"]], r["ids"], strict=True)))
            for b in batches for r in b.to_pylist())
    for query, lists in itertools.groupby(rows, key=lambda r: r[0]):
        best: list[tuple[float, int]] = []
        for _, found in lists:
            best = list(itertools.islice(heapq.merge(best, found), k))
        yield pa.RecordBatch.from_arrays([
            pa.array([query] * len(best), pa.int64()), pa.array(range(1, len(best) + 1), pa.int32()),
            pa.array([x for _, x in best], pa.int64()), pa.array([-s for s, _ in best], pa.float64())],
            names=["query_id", "rank", "vec_id", "score"])


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, row_block: int = ROW_BLOCK,
            query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of largest inner product with each query row.

    ``is_query`` is a condition on vec_id.  A query's own id is no candidate;
    ties go to the smaller vec_id; fewer candidates than k are all returned;
    vectors meet those of their own length only.  Identical repeated rows
    count once.  An empty table, or one without queries, gives no rows.
    """
    v = frozen(usable(vectors))
    rows, numbers = _blocks(v, row_block)
    asked, _ = _blocks(v.where(is_query), query_block)
    asked = asked.select("dim", F.col("block").alias("q_block"),
                         *[F.col(c).alias(f"q_{c}") for c in ("ids", "vectors", "codes", "scales", "norms", "rests")])
    # a copy of every query block goes to every number; the join is by number and dimension
    dealt = asked.withColumn("to_block", F.explode(F.sequence(F.lit(0), F.lit(numbers - 1))))
    met = dealt.join(rows.withColumnRenamed("dim", "r_dim"),
                     (F.col("to_block") == F.col("block")) & (F.col("dim") == F.col("r_dim"))).drop("r_dim", "to_block")
    met = met.withColumn("lot", F.floor(F.col("block") / TILES_PER_TASK)).repartition("dim", "q_block", "lot")
    met = met.sortWithinPartitions("dim", "q_block", "block")
    lists = met.mapInArrow(lambda b: _meet(b, k), "query_id long, ids array<long>, scores array<double>")
    return lists.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(
        lambda b: _merge(b, k), "query_id long, rank int, vec_id long, score double")
