"""Token id files: fixed-width bit packing with block offsets.

A file holds the documents of one range of doc_id in ascending order::

    8 bytes   magic b"TOKBITS1"
    payload   blocks of packed ids, least significant bit first; each block starts on a byte
    index     block offsets (blocks + 1), document starts (documents + 1), doc_ids, null marks
    8 x 6     bits an id, ids a block, number of documents, of ids, of blocks, place of the index

All numbers are little-endian unsigned 64-bit integers.  An id takes the
least bits that the vocabulary needs.  A reader gets any block by one seek;
whole blocks are unpacked by numpy.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardflow.llm.common import frozen, key_bounds, shared_path, shuffle_partitions, texts_of

MAGIC = b"TOKBITS1"
BLOCK_IDS = 1 << 16
_FILES = "bucket int, path string, first_row long, documents long, ids long"


def bits_for(vocabulary: int) -> int:
    """Least bits that hold every id under ``vocabulary``; 1 at least, 32 at most."""
    bits = max(1, (vocabulary - 1).bit_length())
    if bits > 32:
        raise ValueError("ids take 32 bits at most")
    return bits


def pack(ids, bits: int) -> bytes:
    """Ids (any unsigned integers) as ``bits`` bits each; raises where one doesn't fit."""
    import numpy as np

    ids = np.ascontiguousarray(ids, "<u4")
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    flags = np.unpackbits(ids.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(flags.ravel(), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, n: int):
    """The ``n`` ids of one block as a numpy array of unsigned 32-bit integers."""
    import numpy as np

    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype("<u4")
    flags = np.zeros((n, 32), np.uint8)
    flags[:, :bits] = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return np.packbits(flags, axis=1, bitorder="little").view("<u4").ravel()


class Writer:
    """Writes one file to an open stream, a block at a time."""

    def __init__(self, stream, bits: int, block_ids: int = BLOCK_IDS):
        self.out, self.bits, self.block_ids = stream, bits, block_ids
        self.at = len(MAGIC)
        self.out.write(MAGIC)
        self.offsets, self.starts, self.doc_ids, self.held, self.n_held = [self.at], [0], [], [], 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """``ids`` are little-endian unsigned 32-bit integers."""
        self.doc_ids.append(doc_id)
        self.starts.append(self.starts[-1] + len(ids) // 4)
        self.held.append(ids)
        self.n_held += len(ids) // 4
        if self.n_held >= self.block_ids:
            self._blocks(False)

    def _blocks(self, last: bool) -> None:
        import numpy as np

        ids = np.frombuffer(b"".join(self.held), "<u4")
        end = len(ids) if last else len(ids) // self.block_ids * self.block_ids
        for k in range(0, end, self.block_ids):
            data = pack(ids[k:min(end, k + self.block_ids)], self.bits)
            self.out.write(data)
            self.at += len(data)
            self.offsets.append(self.at)
        self.held, self.n_held = [ids[end:].tobytes()], len(ids) - end

    def close(self) -> None:
        import numpy as np

        self._blocks(True)
        number = lambda x: np.array(x, "<u8").tobytes()
        self.out.write(number(self.offsets) + number(self.starts)
                       + np.array([d or 0 for d in self.doc_ids], "<i8").tobytes()
                       + number([d is None for d in self.doc_ids])
                       + number([self.bits, self.block_ids, len(self.doc_ids), self.starts[-1], len(self.offsets) - 1])
                       + number([self.at]))
        self.out.close()


class Reader:
    """Random access to one file; ``source`` is seekable."""

    def __init__(self, source):
        import numpy as np

        self.file = source
        size = source.seek(0, 2)
        source.seek(size - 48)
        tail = np.frombuffer(source.read(48), "<u8")
        self.bits, self.block_ids, self.documents, self.ids, blocks = map(int, tail[:5])
        source.seek(0)
        if source.read(8) != MAGIC:
            raise ValueError("not a token id file")
        source.seek(int(tail[5]))
        index = source.read(size - 48 - int(tail[5]))
        n, d = blocks + 1, self.documents
        self.offsets = np.frombuffer(index, "<u8", n).astype(np.int64)
        self.starts = np.frombuffer(index, "<u8", d + 1, 8 * n).astype(np.int64)
        self.doc_ids = np.frombuffer(index, "<i8", d, 8 * (n + d + 1))
        self.nulls = np.frombuffer(index, "<u8", d, 8 * (n + d + 1 + d)) != 0

    def block(self, k: int):
        """The ids of block ``k``."""
        self.file.seek(int(self.offsets[k]))
        data = self.file.read(int(self.offsets[k + 1] - self.offsets[k]))
        return unpack(data, self.bits, min(self.block_ids, self.ids - k * self.block_ids))

    def read(self, start: int, stop: int):
        """Ids ``start`` to ``stop`` of the file; only the blocks that hold them are read."""
        import numpy as np

        if stop <= start:
            return np.empty(0, "<u4")
        first, last = start // self.block_ids, (stop - 1) // self.block_ids
        got = np.concatenate([self.block(k) for k in range(first, last + 1)])
        return got[start - first * self.block_ids:stop - first * self.block_ids]

    def __iter__(self) -> Iterator[tuple[int | None, object]]:
        """(doc_id, ids) of every document in order; one block and one document are held."""
        import numpy as np

        held, at, k = np.empty(0, "<u4"), 0, 0
        for d in range(self.documents):
            stop, parts = int(self.starts[d + 1]), []
            while at + len(held) < stop:
                parts.append(held)
                at += len(held)
                held, k = self.block(k), k + 1
            take = stop - at
            parts.append(held[:take])
            held, at = held[take:], stop
            yield (None if self.nulls[d] else int(self.doc_ids[d])), np.concatenate(parts)


def _open(path: str):
    """(file system, path) of a URI or a plain path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def write(docs: DataFrame, folder: str, encode: Callable[[str | None], bytes], bits: int,
          block_ids: int = BLOCK_IDS) -> DataFrame:
    """Writes the ids of every text to files under ``folder``; one row a file is returned.

    ``encode`` gives a text's ids as little-endian unsigned 32-bit integers.
    A file holds a range of doc_id, nulls first; its name carries the task
    attempt, and only files of attempts that ended well are in the result, so
    a repeated task does no harm.  An empty table writes no file.
    """
    texts = texts_of(docs)
    bounds = key_bounds(texts, "doc_id", shuffle_partitions(docs.sparkSession))

    def bucket_of(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for b in batches:
            ids = pc.fill_null(b.column(0), -(1 << 63)).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(bounds, ids, "right"), pa.int32()), *b.columns],
                                             names=["bucket", "doc_id", "text"])

    def store(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        system, root = _open(folder)
        system.create_dir(root, recursive=True)
        at, out, place, done = None, None, "", []
        for b in batches:
            for bucket, doc_id, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if bucket != at:
                    if out:
                        out.close()
                        done.append((at, place, 0, len(out.doc_ids), out.starts[-1]))
                    at = bucket
                    place = f"ids-{bucket:06d}-{TaskContext.get().taskAttemptId()}.bin"
                    out = Writer(system.open_output_stream(f"{root}/{place}"), bits, block_ids)
                out.add(doc_id, encode(text))
        if out:
            out.close()
            done.append((at, place, 0, len(out.doc_ids), out.starts[-1]))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)],
                                             schema=pa.schema([("bucket", pa.int32()), ("path", pa.string()), ("first_row", pa.int64()),
                                                               ("documents", pa.int64()), ("ids", pa.int64())]))

    dealt = texts.mapInArrow(bucket_of, "bucket int, doc_id long, text string")
    ordered = dealt.repartition(len(bounds) + 1, "bucket").sortWithinPartitions("bucket", F.col("doc_id").asc_nulls_first(), "text")
    return frozen(ordered.mapInArrow(store, _FILES))


def read(spark: SparkSession, files: DataFrame, folder: str, each: Callable, layout: str) -> DataFrame:
    """Reads files back: ``each(doc_id, start, ids)`` gives a row of ``layout`` for every document.

    ``start`` is the number of ids of all documents before it.  The file
    table has a row a file; its running sum is over that table alone.
    """
    from pyspark.sql import Window
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    over = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.select("path", F.coalesce(F.sum("ids").over(over), F.lit(0)).alias("start"))

    schema = to_arrow_schema(StructType.fromDDL(layout))

    def load(batches):
        import pyarrow as pa

        system, root = _open(folder)
        for b in batches:
            for path, start in zip(*(c.to_pylist() for c in b.columns), strict=True):
                with system.open_input_file(f"{root}/{path}") as f:
                    got, rows = Reader(f), []
                    for k, (doc_id, ids) in enumerate(got):
                        rows.append(each(doc_id, start + int(got.starts[k]), ids))
                        if len(rows) == 4096 or k + 1 == got.documents:
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                            rows = []

    return placed.repartition(max(1, files.count()), "path").mapInArrow(load, layout)


def digest(doc_id: int | None, start: int, ids) -> tuple:
    """doc_id, start, number and crc32 of a document's ids."""
    return doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())


def round_trip(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) as read from files written for ``docs``.

    Every text (null: empty) is encoded whole and followed by ``end_id``.
    Repeated rows stay, in the order of doc_id and text.
    """
    from hazardflow.llm.word_tokens import loaded

    spark = docs.sparkSession
    folder = folder or shared_path(spark, "token-ids")
    end = end_id.to_bytes(4, "little")
    bits = bits_for(max(end_id + 1, loaded(tokenizer).size))
    files = write(docs, folder, lambda text: loaded(tokenizer).encode(text) + end, bits)
    return read(spark, files, folder, digest, "doc_id long, start long, n_tokens long, ids_crc32 long")
