"""Vector code compression: integer product quantisation by per-dimension value dictionaries.

A component x becomes the integer floor(4096 * x).  Vectors are cut into
equal consecutive parts; each part position has a codebook that starts as that
part of the rows of least id and is refined by rounds of nearest-entry
assignment and floored means.  All arithmetic is exact.

One pass turns the table into blocks: for each dimension the block's distinct
values (the dictionary) and one dictionary code a row.  Each round tabulates
the squared differences of every distinct integer to all entries; a part's
distance to an entry is then the sum of one gathered number a dimension.
Tasks hand back one exact sum an entry, merged by Spark; only the codebooks
(entries x dimensions) and their sums reach the driver.
"""

from __future__ import annotations

import hashlib
import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardflow.llm.common import frozen

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
#: Components of a block, which bounds a task's memory at any vector length.
BLOCK_COMPONENTS = 1 << 19
#: Buckets over which the rows of one label are dealt when their sum is handed back.
SALTS = 32
LONG_MAX = (1 << 63) - 1


def kept_rows(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, label, v array<double>) of the rows whose vector and components are neither null nor non-finite."""
    v = F.col(vector).cast("array<double>")
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.where(v.isNotNull() & whole).select("vec_id", "label", v.alias("v"))


def grid(x):
    """The doubles floor(4096 * x) / 4096, which hold the integers of ``x`` exactly, overflow included."""
    import numpy as np

    with np.errstate(over="ignore"):
        scaled = np.asarray(x, np.float64) * SCALE
    return np.where(np.isfinite(scaled), np.floor(scaled) / SCALE, x)


def integers(g, safe: float):
    """The integers of grid values: int64 if all are within ``safe``, else exact Python numbers."""
    import numpy as np

    with np.errstate(over="ignore"):
        scaled = g * SCALE
    if not len(scaled) or np.abs(scaled).max() <= safe:
        return scaled.astype(np.int64)
    return np.array([int(s) if math.isfinite(s) else int(x) * SCALE for s, x in zip(scaled, g, strict=True)], object)


def blocks(kept: DataFrame) -> DataFrame:
    """(rows, dim, sizes, dictionary, codes): packed dictionary-coded vectors, one length a block."""
    kind = {f.name: f.dataType.simpleString() for f in kept.schema.fields}

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            ids, labels, vectors = b.column(0), b.column(1), b.column(2)
            lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(lengths).tolist():
                step = max(1, BLOCK_COMPONENTS // max(dim, 1))
                at = np.flatnonzero(lengths == dim)
                for k in range(0, len(at), step):
                    take = pa.array(at[k:k + step])
                    flat = vectors.take(take).flatten().to_numpy(zero_copy_only=False)
                    g = grid(flat).reshape(len(take), dim)
                    found = [np.unique(g[:, j], return_inverse=True) for j in range(dim)]
                    codes = np.array([c for _, c in found], "<u4").reshape(dim, len(take))
                    if codes.size == 0 or codes.max() < 1 << 16:
                        codes = codes.astype("<u2")
                    owners = pa.StructArray.from_arrays([ids.take(take), labels.take(take)], ["vec_id", "label"])
                    yield pa.RecordBatch.from_arrays([
                        pa.ListArray.from_arrays(pa.array([0, len(take)], pa.int32()), owners), pa.array([dim], pa.int32()),
                        pa.array([np.array([len(u) for u, _ in found], "<i4").tobytes()], pa.binary()),
                        pa.array([b"".join(u.tobytes() for u, _ in found)], pa.binary()),
                        pa.array([codes.tobytes()], pa.binary())], names=["rows", "dim", "sizes", "dictionary", "codes"])

    owner = f"struct<vec_id:{kind['vec_id']},label:{kind['label']}>"
    return kept.mapInArrow(run, f"rows array<{owner}>, dim int, sizes binary, dictionary binary, codes binary")


def _safe(dim: int) -> float:
    """Greatest integer whose squared differences, summed over a vector, stay far inside 63 bits."""
    return 2.0 ** 29 / max(1.0, math.sqrt(dim))


def _unpack(rows: int, dim: int, sizes: bytes, dictionary: bytes, codes: bytes):
    """The integers of each dimension's dictionary and the codes (dim x rows), two or four bytes each."""
    import numpy as np

    ends = np.cumsum(np.frombuffer(sizes, "<i4"))
    values = np.split(np.frombuffer(dictionary, "<f8"), ends[:-1]) if dim else []
    packed = np.frombuffer(codes, "<u2" if len(codes) == 2 * rows * dim else "<u4")
    return [integers(v, _safe(dim)) for v in values], packed.reshape(dim, rows)


def assigned(values, codes, book, width: int, safe: float):
    """For each part: nearest entry of every row, and its squared distance.

    ``book[part][entry]`` lists an entry's integers.  A table of squared
    differences is made for each dimension; rows gather from it and add.
    """
    import numpy as np

    rows, out = codes.shape[1], []
    for part, entries in enumerate(book):
        total = np.zeros((rows, len(entries)), np.int64)
        for pos in range(width):
            j = part * width + pos
            wanted = [e[pos] for e in entries]
            exact = values[j].dtype == object or max(map(abs, wanted), default=0) > safe
            value = values[j].astype(object) if exact else values[j]
            table = (value[:, None] - np.array(wanted, object if exact else np.int64)[None, :]) ** 2
            total = total + table[codes[j]]
        nearest = total.argmin(axis=1) if rows else np.zeros(0, np.int64)
        out.append((nearest, total[np.arange(rows), nearest]))
    return out


def _entry_sums(coded: DataFrame, book: list, width: int) -> DataFrame:
    """(part, entry, n, sums array<string>): exact sums and counts of the parts assigned to each entry."""
    safe = _safe(width * len(book))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        found: dict = {}
        for b in batches:
            for owners, dim, sizes, dictionary, packed in zip(*(c.to_pylist() for c in b.columns), strict=True):
                values, codes = _unpack(owners, dim, sizes, dictionary, packed)
                for part, (nearest, _) in enumerate(assigned(values, codes, book, width, safe)):
                    for entry in np.unique(nearest).tolist():
                        at = nearest == entry
                        sums = [int(values[j][codes[j][at]].sum()) for j in range(part * width, (part + 1) * width)]
                        n, old = found.get((part, entry), (0, [0] * width))
                        found[part, entry] = (n + int(at.sum()), [a + s for a, s in zip(old, sums, strict=True)])
        keys = sorted(found)
        yield pa.RecordBatch.from_arrays([
            pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()),
            pa.array([found[k][0] for k in keys], pa.int64()),
            pa.array([list(map(str, found[k][1])) for k in keys], pa.list_(pa.string()))], names=["part", "entry", "n", "sums"])

    schema = "part int, entry int, n long, sums array<string>"

    def merge(key, table):
        import pyarrow as pa

        rows = [list(map(int, s)) for s in table.column("sums").to_pylist()]
        sums = reduce(lambda a, b: [x + y for x, y in zip(a, b, strict=True)], rows)
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "entry": pa.array([key[1].as_py()], pa.int32()),
                         "n": pa.array([sum(table.column("n").to_pylist())], pa.int64()),
                         "sums": pa.array([list(map(str, sums))], pa.list_(pa.string()))})

    return (coded.select(F.size("rows").alias("rows"), "dim", "sizes", "dictionary", "codes").mapInArrow(run, schema)
            .groupBy("part", "entry").applyInArrow(merge, schema))


def train(kept: DataFrame, coded: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list:
    """The codebooks, ``book[part][entry]`` a list of integers; [] if no row is kept.

    They start as the rows of least vec_id (null ids last, equal ids by
    vector); fewer rows give fewer entries.  Vectors of several lengths, or of
    a length that ``parts`` doesn't divide, can't be cut alike: a ValueError.
    """
    dims = sorted(r.dim for r in coded.select("dim").distinct().limit(2).collect())
    if not dims:
        return []
    if len(dims) > 1 or dims[0] % parts:
        raise ValueError(f"vectors of {' and '.join(map(str, dims))} components can't be cut into {parts} equal parts")
    width = dims[0] // parts
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    seeds = [[int(i) for i in integers(grid(r.v), -1.0)] if width else [] for r in first]
    book = [[s[p * width:(p + 1) * width] for s in seeds] for p in range(parts)]
    for _ in range(rounds):
        moved = [list(entry) for entry in book]
        for r in _entry_sums(coded, book, width).collect():
            moved[r.part][r.entry] = [int(s) // r.n for s in r.sums]
        if moved == book:  # assignments depend on the codebooks alone, so later rounds repeat this one
            break
        book = moved
    return book


def book_text(book: list) -> str:
    """All entries' components by part, entry and position, joined by commas."""
    return ",".join(str(x) for entries in book for e in entries for x in e)


def encode(coded: DataFrame, book: list) -> DataFrame:
    """(vec_id, label, codes array<int>, error long): each row's entry a part and its summed squared distance.

    An error beyond 63 bits is null.
    """
    width = len(book[0][0]) if book and book[0] else 0
    safe = _safe(width * len(book))
    owner = coded.schema["rows"].dataType.elementType

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for k in range(b.num_rows):
                owners = b.column(0).slice(k, 1).flatten()
                dim, sizes, dictionary, packed = (b.column(c)[k].as_py() for c in range(1, 5))
                values, codes = _unpack(len(owners), dim, sizes, dictionary, packed)
                parts = assigned(values, codes, book, width, safe)
                errors = [int(e) for e in sum((d for _, d in parts), np.zeros(len(owners), np.int64))]
                yield pa.RecordBatch.from_arrays([
                    owners.field(0), owners.field(1), pa.array(np.stack([n for n, _ in parts], 1).tolist(), pa.list_(pa.int32())),
                    pa.array([e if e <= LONG_MAX else None for e in errors], pa.int64())],
                    names=["vec_id", "label", "codes", "error"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in owner.fields)
    return coded.mapInArrow(run, f"{kinds}, codes array<int>, error long")


def with_label_errors(encoded: DataFrame) -> DataFrame:
    """``encoded`` with label_error: the error summed over the rows of equal label, null labels together.

    A label's sum is copied once a salt, so the rows of a very common label
    meet it in many tasks.  A sum beyond 63 bits, or with a null error in it, is null.
    """
    sums = encoded.groupBy("label").agg(
        F.when(F.count("error") == F.count(F.lit(1)), F.sum(F.col("error").cast("decimal(38,0)"))).alias("total"))
    sums = sums.select(F.col("label").alias("_label"), F.expr("try_cast(total AS BIGINT)").alias("label_error"),
                       F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_part"))
    salted = encoded.withColumn("_salt", F.pmod(F.xxhash64("vec_id", "codes"), F.lit(SALTS)))
    same = F.col("label").eqNullSafe(F.col("_label")) & (F.col("_salt") == F.col("_part"))
    return salted.join(sums, same).drop("_label", "_part", "_salt")


def compress(rows: DataFrame, vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES,
             rounds: int = ROUNDS) -> tuple[DataFrame, list]:
    """Codes of every kept row, and the codebooks.

    ``rows`` has vec_id, label and the vector column; others are not looked at.
    Rows whose vector is null or holds a null or non-finite component are
    dropped, repeated rows are all encoded, an empty table gives no rows and
    no codebook.
    """
    kept = kept_rows(rows, vector)
    coded = frozen(blocks(kept))
    book = train(kept, coded, parts, entries, rounds)
    return with_label_errors(encode(coded, book)), book


def digest(book: list) -> str:
    return hashlib.sha256(book_text(book).encode()).hexdigest()
