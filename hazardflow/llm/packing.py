"""Best-fit packing of tokenised documents by bin completion on the table of lengths.

What decides a packing is how many pieces there are of each length, at most
``capacity`` numbers however many documents there are.  ``plan`` solves that
problem: it takes the largest length left, enumerates undominated fillings
around it, uses the chosen one as often as the counts allow, and goes back
when the waste so far rules out beating the incumbent, the best-fit
decreasing solution.  Spark numbers the pieces within their length and looks
their places up in the plan.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame

from hazardflow.llm.common import frozen, ranked, shuffle_partitions, texts_of

CAPACITY = 2048
#: Search nodes, besides those of one filling for each length; then the best solution so far stays.
NODES = 100_000
#: Fillings kept for a largest length, and search nodes spent on finding them.
FILLINGS, FILLING_NODES = 3, 300

_PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"

#: A pattern: (lengths, descending) and the number of sequences filled so.
Plan = list[tuple[tuple[int, ...], int]]


def best_fit(counts: dict[int, int], capacity: int) -> Plan:
    """Best-fit decreasing, with sequences of equal content handled together."""
    open_: dict[int, list[list]] = {}  # room left: [pattern, sequences]
    rooms: list[int] = []

    def put(pattern: tuple[int, ...], n: int, room: int) -> None:
        if room not in open_:
            open_[room] = []
            insort(rooms, room)
        open_[room].append([pattern, n])

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            k = bisect_left(rooms, length)
            if k < len(rooms):
                room = rooms[k]
                pattern, n = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[k]
            else:
                room, pattern, n = capacity, (), left
            each = min(room // length, left)  # a best fit stays the best fit while it has room
            used = min(n, left // each)
            put(pattern + (length,) * each, used, room - each * length)
            left -= used * each
            if pattern and n > used:
                put(pattern, n - used, room)
    return [(pattern, n) for groups in open_.values() for pattern, n in groups]


def _dominated(used: Counter, slack: int, counts: dict[int, int], lengths: list[int]) -> bool:
    """True if one longer unused length fits in place of one or two of the filling's."""
    kinds = sorted(used)
    pairs = [(a, b) for i, a in enumerate(kinds) for b in kinds[i:] if a < b or used[a] > 1]
    for s in [*((a,) for a in kinds), *pairs]:
        least, most = sum(s), sum(s) + slack
        if len(s) == 1:
            least += 1  # the same length would be no change
        for length in lengths[bisect_left(lengths, least):bisect_left(lengths, most + 1)]:
            if counts.get(length, 0) > used[length]:
                return True
    return False


def fillings(room: int, counts: dict[int, int], lengths: list[int], most_waste: int,
             keep: int = FILLINGS, nodes: int = FILLING_NODES, tally: list[int] | None = None) -> list[tuple[int, ...]]:
    """Undominated fillings of ``room``, least waste first and long pieces before short ones.

    ``lengths`` are the lengths that are left, ascending.  Where nothing fits,
    the empty filling is the only one; wasteful ones beyond ``most_waste`` are
    left out if any other is known.  ``tally`` gets the nodes spent.
    """
    found: list[tuple[int, tuple[int, ...]]] = []
    spent = 0

    def walk(left: int, below: int, chosen: tuple[tuple[int, int], ...]) -> Iterator[tuple[int, Counter]]:
        """Takes one length after the other, shorter ones each time, as often as fits and then less often."""
        nonlocal spent
        spent += 1
        ended = True
        for k in range(bisect_left(lengths, min(left + 1, below)) - 1, -1, -1):
            length = lengths[k]
            for times in range(min(counts[length], left // length), 0, -1):
                if spent >= nodes:
                    return
                ended = False
                yield from walk(left - times * length, length, (*chosen, (length, times)))
        used = Counter(dict(chosen))
        if ended and not any(counts[x] > used[x] for x in lengths[:bisect_left(lengths, left + 1)]):
            yield left, used

    for waste, used in walk(room, room + 1, ()):
        if waste and _dominated(used, waste, counts, lengths):
            continue
        found.append((waste, tuple(sorted(used.elements(), reverse=True))))
        found.sort(key=lambda f: (f[0], len(f[1])))
        del found[keep:]
        if len(found) == keep and found[-1][0] == 0:
            break
    if tally is not None:
        tally[0] += spent
    if not found:  # the nodes ran out: fill by the longest that fits
        used, left = Counter(), room
        for length in reversed(lengths):
            used[length] = min(counts[length], left // length)
            left -= used[length] * length
        found = [(left, tuple(sorted(used.elements(), reverse=True)))]
    within = [f for w, f in found if w <= most_waste]
    return within or [found[0][1]]


def plan(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES) -> Plan:
    """Patterns and multiplicities that use every piece once, in as few sequences as found."""
    counts = {k: int(n) for k, n in counts.items() if n}
    if any(not 0 < k <= capacity for k in counts):
        raise ValueError("lengths must be between 1 and the capacity")
    total = sum(k * n for k, n in counts.items())
    incumbent = best_fit(counts, capacity)
    best, least = sum(n for _, n in incumbent), -(-total // capacity)
    left, lengths = dict(counts), sorted(counts)

    def use(pattern: tuple[int, ...], n: int) -> None:
        for length in pattern:
            if not left[length]:
                insort(lengths, length)
            left[length] -= n
            if not left[length]:
                del lengths[bisect_left(lengths, length)]

    def choices() -> Iterator[tuple[int, ...]]:
        largest = lengths[-1]
        rest = {**left, largest: left[largest] - 1}
        some = lengths if rest[largest] else lengths[:-1]
        allowed = (best - 1) * capacity - total - waste
        return iter([(largest, *f) for f in fillings(
            capacity - largest, rest, some, max(0, allowed), tally=spent)])

    path: list[tuple[tuple[int, ...], int, Iterator, int]] = []
    waste, spent, most = 0, [0], nodes + FILLING_NODES * len(counts)
    options = choices() if lengths else iter(())
    while best > least and spent[0] < most:
        pattern = next(options, None)
        ends = lengths and pattern is not None and sum(pattern) == sum(k * left[k] for k in lengths)
        if pattern is not None:
            need = Counter(pattern)
            n = min(left[k] // u for k, u in need.items())
            more = 0 if ends else n * (capacity - sum(pattern))
            if waste + more > (best - 1) * capacity - total and not ends:
                continue
            use(pattern, n)
            path.append((pattern, n, options, more))
            waste += more
            if not lengths:
                made = sum(p[1] for p in path)
                if made < best:
                    best, incumbent = made, [(p[0], p[1]) for p in path]
                if best <= least:
                    break
                options = iter(())
            else:
                options = choices()
        elif path:
            pattern, n, options, more = path.pop()
            use(pattern, -n)
            waste -= more
        else:
            break
    return incumbent


def slots(patterns: Plan) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, pieces in a row, first sequence, offset) for each length of each pattern.

    Pieces of a length take their places in the order of their ranks.  There
    are at most as many rows for a pattern as different lengths fit in a
    sequence.
    """
    rows, ranks, sequence = [], Counter(), 0
    for pattern, n in patterns:
        offset = 0
        for length, each in sorted(Counter(pattern).items(), reverse=True):
            rows.append((length, ranks[length], each, sequence, offset))
            ranks[length] += each * n
            offset += each * length
        sequence += n
    return rows


def pieces(docs: DataFrame, encode: Callable[[str | None], bytes], capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every text's ids.

    ``encode`` gives a whole text's ids as little-endian unsigned 32-bit
    integers, one id at least; documents over ``capacity`` ids are cut.
    """
    def run(batches):
        import pyarrow as pa

        size = 4 * capacity
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = encode(text)
                rows += [(doc_id, k // size, k // 4, len(c := ids[k:k + size]) // 4, zlib.crc32(c))
                         for k in range(0, len(ids), size)]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                                             names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return texts_of(docs).mapInArrow(run, _PIECES)


def place(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut`` with sequence_id and offset, in as few sequences as ``plan`` finds.

    ``cut`` has the columns of ``pieces``; rows that are equal in all of them
    are interchangeable.  An empty table gives an empty result.
    """
    cut = frozen(cut)
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    table = sorted(slots(plan(counts, capacity)))
    numbered = ranked(cut, ["length"], ["doc_id", "piece", "ids_crc32"], max(64, shuffle_partitions(cut.sparkSession)))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        length, first, each, sequence, offset = np.array(table, np.int64).reshape(-1, 5).T
        keys = length << 48 | first
        for b in batches:
            size, rank = (b.column(c).to_numpy().astype(np.int64) for c in ("length", "rank"))
            k = np.searchsorted(keys, size << 48 | rank, "right") - 1
            at = rank - first[k]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:5], pa.array(sequence[k] + at // each[k]), pa.array(offset[k] + at % each[k] * size)],
                names=[*b.schema.names[:5], "sequence_id", "offset"])

    return numbered.mapInArrow(run, f"{_PIECES}, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """All documents' pieces and places; a null text is empty and has the end id alone."""
    from hazardflow.llm.word_tokens import loaded

    end = end_id.to_bytes(4, "little")
    return place(pieces(docs, lambda text: loaded(tokenizer).encode(text) + end, capacity), capacity)
