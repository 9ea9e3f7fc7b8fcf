"""Exact removal of repeated 100-byte strings, by a sparse suffix array sorted deep-shallow.

Which suffixes to sort: every 100-byte window has a minimiser, the leftmost
least hash of its ``GRAM``-byte grams.  Equal windows have their minimiser at
the same offset, so suffixes need to be compared only where they start at a
minimiser ("anchor") whose gram occurs more than once.

1. Units of text list their anchors; a gram's occurrences inside a unit are
   counted there, so a gram takes one entry a unit at most to the bucket that
   finds grams of several occurrences.
2. Documents are dealt by their id, next to their repeated anchors, and cut
   the segment of each: the bytes of all windows that the anchor stands for.
   Equal segments of one task are settled there, the earliest one goes on.
3. A bucket of grams sorts the distinct right contexts of its anchors and
   their reversed left contexts with ``deep_shallow``.  Two windows at the
   same distance x from their anchors are equal if their left contexts share
   x bytes and their right contexts share 100 - x: both can be read off the
   common prefixes of neighbours in sorted order.  All windows but the
   earliest of each class are repeats.
4. Anchors of grams with more than ``HOT`` occurrences are not gathered by
   gram: their windows are dealt by their content, so that equal windows meet
   (one a task at most) and a single gram fills no bucket.
5. The repeats' spans meet their documents again.

All buckets are packed arrays: a row of the shuffles holds a task's entries
for a bucket.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazardflow.llm.common import shuffle_partitions, texts_of
from hazardflow.llm.suffix_sort import deep_shallow

LENGTH = 100
GRAM = 24
#: Occurrences of a gram beyond which its windows are dealt by content.
HOT = 1 << 17
#: Bytes of text whose anchors are counted together, and bytes that a task holds before it sends them.
UNIT_BYTES, HELD_BYTES = 64 << 20, 64 << 20
#: Windows of a text handled at once; positions in a block fit in the low 24 bits.
BLOCK = 1 << 23
#: Buckets for each shuffle partition.
BUCKETS = 1
NO_ID = -(1 << 63)

_SPREAD = 0x9E3779B97F4A7C15
_ROW = "kind int, key long, blob binary"
# kinds of rows, in the order in which a key's rows must come
NOTICE, LOCAL, GRAMS, CANDIDATES, SPANS, SEGMENTS, WINDOWS, TEXT = range(8)

_ANCHOR = [("gram", "<u8"), ("doc", "<i8"), ("mark", "<u4"), ("at", "<u4"), ("left", "u1"), ("right", "u1")]
_WITNESS = [*_ANCHOR, ("count", "<u4"), ("unit", "<i8")]
_PLACE = [("doc", "<i8"), ("mark", "<u4"), ("at", "<u4"), ("left", "u1"), ("right", "u1"), ("hot", "u1")]
_SPAN = [("doc", "<i8"), ("mark", "<u4"), ("start", "<u4"), ("stop", "<u4")]


def _squeeze(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(data)


def _expand(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data)


def _batch(rows: list[tuple[int, int, bytes]]):
    import pyarrow as pa

    kinds, keys, blobs = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(keys, pa.int64()), pa.array(blobs, pa.binary())],
                                      names=["kind", "key", "blob"])


def _split(array, keys, kind: int) -> Iterator[tuple[int, int, bytes]]:
    """A row for each key with the array's entries of that key."""
    import numpy as np

    if not len(array):
        return
    order = np.argsort(keys, kind="stable")
    array, keys = array[order], keys[order]
    cuts = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1))
    for s, e in zip(cuts.tolist(), [*cuts[1:].tolist(), len(keys)], strict=True):
        yield kind, int(keys[s]), _squeeze(array[s:e].tobytes())


def _gram_hashes(data):
    """64-bit hashes of all 24-byte grams of an array of bytes."""
    import numpy as np

    h, width, factor = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(_SPREAD), 1, _SPREAD
    while width < 16:
        h = h[:-width] * np.uint64(factor) + h[width:]
        h ^= h >> np.uint64(29)
        eights = h if width == 4 else None if width < 4 else eights  # noqa: F821
        width, factor = 2 * width, (factor * 0xD6E8FEB86659FD93 + 2) % (1 << 64) | 1
    g = h[:-8] * np.uint64(factor) + eights[16:]
    g = (g ^ (g >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return g ^ (g >> np.uint64(29))


def _least(values, width: int):
    """Least value of every run of ``width``."""
    import numpy as np

    size = 1
    while 2 * size <= width:
        values, size = np.minimum(values[:-size], values[size:]), 2 * size
    return np.minimum(values[:size - width], values[width - size:]) if size < width else values


def anchors(data: bytes):
    """(gram hash, position, bytes to the left, bytes to the right) of each anchor of a text.

    The bytes from ``position - left`` to ``position + right`` are those of
    the consecutive windows that the anchor is the minimiser of.
    """
    import numpy as np

    parts, last = [], len(data) - LENGTH
    for base in range(0, last + 1, BLOCK):
        block = np.frombuffer(data, np.uint8, min(BLOCK, last + 1 - base) + LENGTH - 1, base)
        hashes = _gram_hashes(block)
        low = np.uint64((1 << 24) - 1)
        least = _least((hashes & ~low) | np.arange(len(hashes), dtype=np.uint64), LENGTH - GRAM + 1)
        at = (least & low).astype(np.int64)
        first = np.flatnonzero(np.diff(at, prepend=-1))  # first window of each anchor
        stop = np.append(first[1:], len(at))
        at = at[first]
        parts.append((hashes[at], at + base, at - first, stop - 1 + LENGTH - at))
    return [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else None


def _list_anchors(batches, buckets: int):
    """Entries of grams by bucket, and of grams that a unit has several times under the unit's number."""
    import numpy as np
    from pyspark import TaskContext

    unit = TaskContext.get().partitionId() << 24
    held, size = [], 0

    def flush():
        if not held:
            return
        all_ = np.concatenate(held)
        _, inverse, counts = np.unique(all_["gram"], return_inverse=True, return_counts=True)
        local = counts[inverse] > 1
        entries = np.zeros(len(all_), _WITNESS)
        for name, _ in _ANCHOR:
            entries[name] = all_[name]
        entries["count"], entries["unit"] = counts[inverse], unit
        _, one = np.unique(all_["gram"], return_index=True)
        rows = list(_split(entries[one], (entries["gram"][one] % np.uint64(buckets)).astype(np.int64), GRAMS))
        if local.any():
            rows.append((LOCAL, unit, _squeeze(all_[local].tobytes())))
        yield _batch(rows)

    for b in batches:
        for doc, text in zip(b.column("doc").to_pylist(), b.column("data").to_pylist(), strict=True):
            found = anchors(text)
            if found is None:
                continue
            part = np.zeros(len(found[0]), _ANCHOR)
            part["gram"], part["at"], part["left"], part["right"] = found
            part["doc"], part["mark"] = doc, zlib.crc32(text)
            held.append(part)
            size += len(text)
            if size > UNIT_BYTES:
                yield from flush()
                held, size, unit = [], 0, unit + 1
    yield from flush()


def _keyed(batches):
    """(key, {kind: blobs}) of runs of rows with one key, for kinds without TEXT."""
    key, got = None, {}
    for b in batches:
        for kind, k, blob in zip(*(b.column(c).to_pylist() for c in ("kind", "key", "blob")), strict=True):
            if k != key:
                if got:
                    yield key, got
                key, got = k, {}
            got.setdefault(kind, []).append(blob)
    if got:
        yield key, got


def _array(blobs: list[bytes], layout):
    import numpy as np

    return np.concatenate([np.frombuffer(_expand(b), layout) for b in blobs])


def _places(entries, hot, docs: int):
    """Candidate rows by the bucket of their document."""
    import numpy as np

    out = np.zeros(len(entries), _PLACE)
    for name in ("doc", "mark", "at", "left", "right"):
        out[name] = entries[name]
    out["hot"] = hot
    return _split(out, out["doc"] % docs, CANDIDATES)


def _find_repeats(batches, docs: int, hot: int):
    """Anchors whose gram another unit has too, and to each unit its grams of more than ``hot`` occurrences."""
    import numpy as np

    for key, got in _keyed(batches):
        rows = [(LOCAL, key, b) for b in got.get(LOCAL, [])]
        if GRAMS in got:
            e = _array(got[GRAMS], _WITNESS)
            _, inverse, entries = np.unique(e["gram"], return_inverse=True, return_counts=True)
            total = np.bincount(inverse, e["count"])[inverse]
            many = total > hot
            rows += _places(e[m := (e["count"] == 1) & (entries[inverse] > 1)], many[m], docs)
            told = e[many & (e["count"] > 1)]
            rows += _split(told["gram"], told["unit"], NOTICE)
        if rows:
            yield _batch(rows)


def _mark_hot(batches, docs: int):
    """Candidate rows of the grams that a unit has several times; other candidates pass."""
    import numpy as np

    for key, got in _keyed(batches):
        rows = [(CANDIDATES, key, b) for b in got.get(CANDIDATES, [])]
        if LOCAL in got:
            e = _array(got[LOCAL], _ANCHOR)
            told = _array(got[NOTICE], "<u8") if NOTICE in got else np.empty(0, "<u8")
            rows += _places(e, np.isin(e["gram"], told), docs)
        if rows:
            yield _batch(rows)


class _Outbox:
    """Distinct strings of a task with their earliest place; the later ones are repeats."""

    def __init__(self, buckets: int, docs: int):
        self.buckets, self.docs = buckets, docs
        self.segments: dict[bytes, tuple] = {}
        self.windows: dict[bytes, tuple] = {}
        self.spans: list[tuple] = []
        self.size = 0

    def _earliest(self, held: dict, key: bytes, new: tuple) -> None:
        """Places are (doc, position, mark, bytes to the left, to the right)."""
        old = held.setdefault(key, new)
        if old is new:
            self.size += len(key) + 150
        elif new[:2] < old[:2]:
            held[key] = new
            self._repeat(old)
        elif new[:2] > old[:2]:
            self._repeat(new)

    def _repeat(self, place: tuple) -> None:
        doc, at, mark, left, right = place
        self.spans.append((doc, mark, at - left, at + right))

    def segment(self, data: bytes, place: tuple) -> None:
        self._earliest(self.segments, bytes((place[3], place[4])) + data, place)

    def window(self, data: bytes, place: tuple) -> None:
        self._earliest(self.windows, data, place)

    def flush(self):
        import numpy as np
        import xxhash

        rows, digest = [], xxhash.xxh32_intdigest
        for kind, held in ((SEGMENTS, self.segments), (WINDOWS, self.windows)):
            by_key: dict[int, list] = {}
            for key, place in held.items():
                # windows of one gram at one offset meet: the gram, or the window itself, picks the bucket
                route = key[2 + place[3]:2 + place[3] + GRAM] if kind == SEGMENTS else key
                by_key.setdefault(digest(route) % self.buckets, []).append((place, key[2:] if kind == SEGMENTS else key))
            for bucket, entries in by_key.items():
                entries.sort(key=lambda e: e[1])
                places = np.array([(d, m, a, x, y, 0) for (d, a, m, x, y), _ in entries], _PLACE)
                head = len(places).to_bytes(8, "little")
                rows.append((kind, bucket, _squeeze(head + places.tobytes() + b"".join([e[1] for e in entries]))))
        if self.spans:
            spans = np.array(self.spans, _SPAN)
            rows += _split(spans, spans["doc"] % self.docs, SPANS)
        self.segments, self.windows, self.spans, self.size = {}, {}, [], 0
        if rows:
            yield _batch(rows)


def _entries(blobs: list[bytes]) -> list[tuple[bytes, tuple]]:
    """(bytes, place) as an outbox sent them."""
    import numpy as np

    out = []
    for blob in blobs:
        data = _expand(blob)
        n = int.from_bytes(data[:8], "little")
        places = np.frombuffer(data, _PLACE, n, 8)
        stops = np.cumsum(places["left"].astype(np.int64) + places["right"]) + 8 + n * places.itemsize
        starts = stops - places["left"] - places["right"]
        out += [(data[s:e], (d, a, m, x, y)) for s, e, (d, m, a, x, y, _) in zip(
            starts.tolist(), stops.tolist(), places.tolist(), strict=True)]
    return out


def _cut_segments(batches, buckets: int, docs: int):
    """Segments (or windows, for hot grams) of the candidates of every text that comes after them."""
    import numpy as np

    box, key, of_text = _Outbox(buckets, docs), None, {}
    for b in batches:
        for kind, k, blob, doc, data in zip(*(b.column(c).to_pylist() for c in ("kind", "key", "blob", "doc", "data")), strict=True):
            if k != key:
                key, blobs, of_text = k, [], None
            if kind == CANDIDATES:
                blobs.append(blob)
                continue
            if of_text is None:
                of_text = {}
                if blobs:
                    e = np.sort(_array(blobs, _PLACE), order=["doc", "mark", "at"])
                    cuts = np.flatnonzero(np.diff(e["doc"], prepend=0) | np.diff(e["mark"].astype(np.int64), prepend=0))
                    cuts = np.unique(np.append(0, cuts)).tolist()
                    for s, t in zip(cuts, [*cuts[1:], len(e)], strict=True):
                        of_text[(int(e["doc"][s]), int(e["mark"][s]))] = e[s:t]
            data = _expand(data)
            mark = zlib.crc32(data)
            for d, m, a, x, y, hot in np.unique(of_text.get((doc, mark), np.empty(0, _PLACE))).tolist():
                if a + y > len(data):
                    continue  # another text with the same id and mark
                if not hot:
                    box.segment(data[a - x:a + y], (d, a, m, x, y))
                else:
                    for p in range(a - x, a + y - LENGTH + 1):
                        box.window(data[p:p + LENGTH], (d, p, m, 0, LENGTH))
            if box.size > HELD_BYTES:
                yield from box.flush()
    yield from box.flush()


def _compare(entries: list[tuple[bytes, tuple]]) -> Iterator[tuple[int, int, int, int]]:
    """Spans of the windows that are repeats among the segments of a bucket."""
    import numpy as np

    first: dict[tuple[int, bytes], tuple] = {}
    for data, place in entries:
        key = (place[3], data)
        old = first.setdefault(key, place)
        if old is place or old[:2] == place[:2]:
            continue
        late = max(old, place, key=lambda p: p[:2])
        first[key] = min(old, place, key=lambda p: p[:2])
        yield late[0], late[2], late[1] - late[3], late[1] + late[4]
    of_gram: dict[bytes, int] = {}
    for left, data in first:
        gram = data[left:left + GRAM]
        of_gram[gram] = of_gram.get(gram, 0) + 1
    # a gram with one segment has nothing more to compare
    rest = [(place, data) for (left, data), place in first.items() if of_gram[data[left:left + GRAM]] > 1]
    if not rest:
        return
    rest.sort(key=lambda r: r[0][:2])
    sides = []
    for strings in ([d[:p[3]][::-1] for p, d in rest], [d[p[3]:] for p, d in rest]):
        number: dict[bytes, int] = {}
        member = np.array([number.setdefault(s, len(number)) for s in strings])
        order, shared = deep_shallow(list(number))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        sides.append((place[member], shared))
    (left_at, left_shared), (right_at, right_shared) = sides
    left, right = (np.array([p[k] for p, _ in rest]) for k in (3, 4))
    docs, marks, ats = (np.array([p[k] for p, _ in rest]) for k in (0, 2, 1))
    most, least = np.full(len(rest), -1), np.full(len(rest), LENGTH + 1)
    for x in range(LENGTH - GRAM + 1):
        has = np.flatnonzero((left >= x) & (right >= LENGTH - x))
        if len(has) < 2:
            continue
        same_left = np.cumsum(left_shared < x)[left_at[has]]
        same_right = np.cumsum(right_shared < LENGTH - x)[right_at[has]]
        keys = same_left * (len(right_shared) + 1) + same_right
        _, first_at, inverse = np.unique(keys, return_index=True, return_inverse=True)
        first_at = has[first_at[inverse]]  # rows come in the order of their places
        late = has[(docs[first_at] != docs[has]) | (ats[first_at] != ats[has])]
        most[late] = x
        least[late] = np.minimum(least[late], x)
    for k in np.flatnonzero(most >= 0).tolist():
        yield int(docs[k]), int(marks[k]), int(ats[k] - most[k]), int(ats[k] - least[k] + LENGTH)


def _settle(batches, docs: int):
    """Spans of repeats: of segments by sorted contexts, of hot grams' windows by their content."""
    import numpy as np

    for key, got in _keyed(batches):
        rows = [(SPANS, key, b) for b in got.get(SPANS, [])]
        found = list(_compare(_entries(got[SEGMENTS]))) if SEGMENTS in got else []
        if WINDOWS in got:
            box = _Outbox(1, docs)
            for data, place in _entries(got[WINDOWS]):
                box.window(data, place)
            found += box.spans
        if found:
            spans = np.array(found, _SPAN)
            rows += _split(spans, spans["doc"] % docs, SPANS)
        if rows:
            yield _batch(rows)


def merged(spans) -> list[tuple[int, int]]:
    """Maximal runs of bytes that an array of spans covers."""
    import numpy as np

    spans = np.sort(spans, order=["start", "stop"])
    starts, stops = spans["start"].astype(np.int64), np.maximum.accumulate(spans["stop"].astype(np.int64))
    cut = np.flatnonzero(starts[1:] > stops[:-1]) + 1
    first, last = np.append(0, cut), np.append(cut - 1, len(starts) - 1)
    return list(zip(starts[first].tolist(), stops[last].tolist(), strict=True))


def _apply(batches, each: Callable, names: list[str]):
    """The rows of the texts, with what ``each`` makes of a text and its repeated runs."""
    import numpy as np
    import pyarrow as pa

    key, blobs, of_text = None, [], None
    for b in batches:
        take, made = [], []
        columns = (b.column(c).to_pylist() for c in ("kind", "key", "blob", "doc", "data"))
        for i, (kind, k, blob, doc, data) in enumerate(zip(*columns, strict=True)):
            if k != key:
                key, blobs, of_text = k, [], None
            if kind == SPANS:
                blobs.append(blob)
                continue
            if of_text is None:
                of_text = {}
                if blobs:
                    e = np.sort(_array(blobs, _SPAN), order=["doc", "mark", "start"])
                    cuts = np.flatnonzero((e["doc"][1:] != e["doc"][:-1]) | (e["mark"][1:] != e["mark"][:-1])) + 1
                    for part in np.split(e, cuts):
                        of_text[(int(part["doc"][0]), int(part["mark"][0]))] = merged(part)
            data = _expand(data)
            take.append(i)
            made.append(each(data, of_text.get((doc, zlib.crc32(data)), [])))
        if take:
            row = b.column("row").take(pa.array(take))
            columns = [row, *(pa.array(c) for c in zip(*made, strict=True))]
            yield pa.RecordBatch.from_arrays(columns, names=["row", *names])


def remove_repeats(docs: DataFrame, keep: list[Column], each: Callable, layout: str, hot: int = HOT) -> DataFrame:
    """``row`` (a struct of ``keep``) and the columns of ``layout`` for every row of ``docs``.

    ``each(data, runs)`` gets a text's UTF-8 bytes and the maximal runs that
    are covered by 100-byte strings which start earlier too (in a smaller
    doc_id, or before in the same document), and returns the values of
    ``layout``.  A null text is empty, a null doc_id is the least.  Repeated
    rows get equal results and are no repeats of each other; neither are
    different texts under one doc_id at the same place.  An empty table gives
    an empty result.
    """
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    buckets = BUCKETS * parts
    texts_of(docs)  # small batches
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"),
                        F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("data"), F.struct(*keep).alias("row"))
    row = texts.schema["row"].dataType

    def deal(df: DataFrame) -> DataFrame:
        return df.repartition(parts, "key").sortWithinPartitions("key", "kind")

    def with_texts(df: DataFrame) -> DataFrame:
        squeezed = texts.mapInArrow(_squeeze_texts, texts.schema)
        rows = squeezed.select(F.lit(TEXT).alias("kind"), F.pmod("doc", F.lit(buckets)).alias("key"),
                               F.lit(None).cast("binary").alias("blob"), "doc", "data", "row")
        return deal(rows.unionByName(df.select("*", F.lit(None).cast("long").alias("doc"), F.lit(None).cast("binary").alias("data"),
                                               F.lit(None).cast(row).alias("row"))))

    listed = texts.select("doc", "data").mapInArrow(lambda b: _list_anchors(b, buckets), _ROW)
    repeats = deal(listed).mapInArrow(lambda b: _find_repeats(b, buckets, hot), _ROW)
    candidates = deal(repeats).mapInArrow(lambda b: _mark_hot(b, buckets), _ROW)
    cut = with_texts(candidates).drop("row").mapInArrow(lambda b: _cut_segments(b, buckets, buckets), _ROW)
    spans = deal(cut).mapInArrow(lambda b: _settle(b, buckets), _ROW)
    names = [f.split()[0] for f in layout.split(", ")]
    schema = T.StructType([T.StructField("row", row), *spark.createDataFrame([], layout).schema.fields])
    return with_texts(spans).mapInArrow(lambda b: _apply(b, each, names), schema)


def _squeeze_texts(batches):
    import pyarrow as pa

    for b in batches:
        data = pa.array([_squeeze(t) for t in b.column("data").to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([b.column("doc"), data, b.column("row")], names=["doc", "data", "row"])


def without(data: bytes, runs: list[tuple[int, int]]) -> bytes:
    """The bytes outside the runs."""
    out, at = [], 0
    for start, stop in runs:
        out.append(data[at:start])
        at = stop
    return b"".join([*out, data[at:]])


def whole_characters(data: bytes, runs: list[tuple[int, int]]) -> str:
    """The text outside the runs; a character goes only if all of its bytes do."""
    kept = []
    for start, stop in runs:
        while start < stop and data[start] & 0xC0 == 0x80:
            start += 1
        while stop > start and stop < len(data) and data[stop] & 0xC0 == 0x80:
            stop -= 1
        kept.append((start, stop))
    return without(data, kept).decode()


def clean_texts(docs: DataFrame) -> DataFrame:
    """Rows of ``docs``, with all their columns, and texts without their repeated runs.

    Characters that lose some of their bytes only are kept whole; ``n_chars``,
    where there is one, is the new text's.  A null text stays null.
    """
    found = remove_repeats(docs, [F.col(f"`{c}`") for c in docs.columns], lambda data, runs: (whole_characters(data, runs),),
                           "kept_text string")
    new = {"text": F.when(F.col("row.text").isNotNull(), F.col("kept_text")),
           "n_chars": F.length(F.coalesce("kept_text", F.lit(""))).cast("long")}
    return found.select(*[new[c].alias(c) if c in new else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
