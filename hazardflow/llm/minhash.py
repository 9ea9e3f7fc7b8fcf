"""MinHash near-duplicates with sequential Bayesian verification.

A document's set holds its distinct four-word shingles.  Documents of equal
sets form a class; one signature of ``HASHES`` minima a class is cut into
bands.  Classes that share a band are candidates; a candidate's signatures are
compared batch by batch, and it is given up as soon as the posterior
probability that its similarity reaches the threshold falls under ``MISS``
(uniform prior).  Survivors are verified exactly on their full sets.

Candidates come in two steps, neither of which lists the pairs of a band
group.  First every member is compared with the least member of its group,
which is linear in the members and already connects groups of near copies.
Then, in groups of more than two that still hold several components, members of different
components are compared in blocks inside tasks: the signatures first, which tells
the members that have a candidate in the first band shared with it, then those
members with their full sets, which hands back only verified links.  Every pair of a
shared band is thus connected, given up by the posterior or verified.

A pair at the threshold shares no band with probability (1 - 0.8^6)^48, under
one in two million; a pair above it is lost with smaller probability.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from math import comb

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardflow.llm.common import few, frozen, texts_of
from hazardflow.llm.components import components

SHINGLE_WORDS = 4
#: Least similarity, as a fraction of integers: 100 x intersection >= 80 x union.
SIMILAR = (80, 100)
BANDS, ROWS = 48, 6
HASHES = BANDS * ROWS
#: Signature positions compared at a time.
BATCH = 32
#: Posterior probability of reaching the threshold under which a candidate is given up.
MISS = 1e-9
#: Members, and shingles, of a block of a band group (on average).
BLOCK, BLOCK_SHINGLES = 1024, 1 << 18
#: Members of a block of a band group where only signatures are compared.
SIG_BLOCK = 4096
#: Buckets over which the rows that look up one class are dealt.
SALTS = 16
#: Most rows of a key table (two longs at most) that is sent to every executor; a longer one is joined by a shuffle.
BROADCAST_KEYS = 1_000_000
#: Rows from which a class's answer is sent to every executor (at most rows / HOT classes).
HOT = 10_000
#: Shingle hashes minimised at once.
CHUNK = 1 << 16
_SEED = 0x9E3779B97F4A7C15


def _stream(seed: int, n: int):
    """``n`` well-mixed 64-bit numbers (the splitmix64 sequence)."""
    import numpy as np

    with np.errstate(over="ignore"):
        return mixed(np.uint64(seed) + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_SEED))


def mixed(x):
    """The splitmix64 finaliser."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(1)
def _tables():
    import numpy as np

    fold = np.arange(256, dtype=np.uint8)
    fold[65:91] += 32
    blank = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
    values = _stream(1, 256)[fold]
    values[blank] = 0
    return values, blank, _stream(2, HASHES) | np.uint64(1), _stream(3, 64) | np.uint64(1)


@lru_cache(8)
def _powers(n: int):
    """The first ``n`` powers of an odd number and of its inverse modulo 2^64."""
    import numpy as np

    base = int(_stream(4, 1)[0]) | 1
    up, down = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def word_hashes(data: bytes):
    """One 64-bit hash for each word (runs of bytes other than ASCII white space, A-Z lower-cased)."""
    import numpy as np

    values, blank, _, _ = _tables()
    b = np.frombuffer(data, np.uint8)
    if not len(b):
        return np.zeros(0, np.uint64)
    gap = np.concatenate(([True], blank[b], [True]))
    starts = np.flatnonzero(gap[:-1] & ~gap[1:])
    ends = np.flatnonzero(~gap[:-1] & gap[1:])
    up, down = _powers(1 << (len(b) - 1).bit_length())
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values[b] * up[:len(b)], dtype=np.uint64)))
    h = (sums[ends] - sums[starts]) * down[starts]
    return mixed(h + (ends - starts).astype(np.uint64) * np.uint64(_SEED))


def shingle_set(data: bytes | None, width: int = SHINGLE_WORDS):
    """Sorted distinct 64-bit hashes of the shingles; fewer words than ``width`` are one shingle, none give none."""
    import numpy as np

    words = word_hashes(data or b"")
    if not len(words):
        return words
    if len(words) < width:
        width = len(words)
    factors, n = _tables()[3], len(words) - width + 1
    total = np.full(n, width, np.uint64)
    for k in range(width):
        total += words[k:k + n] * factors[k]
    return np.unique(mixed(total))


def signatures(sets: list):
    """(documents x HASHES) 16-bit codes of the minima; documents without shingles have zeros."""
    import numpy as np

    out = np.full((HASHES, len(sets)), np.iinfo(np.uint64).max, np.uint64)
    factors = _tables()[2]
    pieces = [(d, s[k:k + CHUNK]) for d, s in enumerate(sets) for k in range(0, len(s), CHUNK)]
    i = 0
    while i < len(pieces):
        j, held = i, 0
        while j < len(pieces) and (j == i or held + len(pieces[j][1]) <= CHUNK):
            held += len(pieces[j][1])
            j += 1
        x = np.concatenate([s for _, s in pieces[i:j]])
        at = np.array([d for d, _ in pieces[i:j]])
        starts = np.concatenate(([0], np.cumsum([len(s) for _, s in pieces[i:j]])[:-1]))
        held_x = np.empty_like(x)
        for k, a in enumerate(factors):
            np.multiply(x, a, out=held_x)
            low = np.minimum.reduceat(held_x, starts)
            np.minimum.at(out[k], at, low)
        i = j
    return (mixed(out) >> np.uint64(48)).astype("<u2").T.copy()


def _keyed(docs: DataFrame) -> DataFrame:
    key = F.coalesce("doc_id", F.xxhash64("text")).alias("key")
    return texts_of(docs.select("doc_id", "text"), as_binary=True).select("doc_id", "text", key)


def prints(docs: DataFrame, width: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, key, n, digest, sig): set size, set digest and signature of every whole text.

    ``key`` finds a document again: its doc_id, or a hash of its text where the id is null.
    """
    given = _keyed(docs)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            sets = [shingle_set(t, width) for t in b.column(1).to_pylist()]
            sig = signatures(sets)
            yield pa.RecordBatch.from_arrays([
                b.column(0), b.column(2), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                pa.array([s.tobytes() for s in sig], pa.binary())], names=["doc_id", "key", "n", "digest", "sig"])

    return given.mapInArrow(run, "doc_id long, key long, n long, digest binary, sig binary")


def _classes(found: DataFrame) -> DataFrame:
    """(node, digest, first, key, rows, n, sig): one row for each different set that isn't empty."""
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("least")
    made = found.where("n > 0").groupBy("digest").agg(
        least, F.count(F.lit(1)).alias("rows"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    return made.select(F.monotonically_increasing_id().alias("node"), "digest", F.col("least.doc_id").alias("first"),
                       F.col("least.key").alias("key"), "rows", "n", "sig")


def _bands(nodes: DataFrame) -> DataFrame:
    """(band, node, n): a key for each band of a class's signature; its low six bits are the band's number."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        factors = _stream(5, ROWS) | np.uint64(1)
        for b in batches:
            sig = np.frombuffer(b"".join(b.column(2).to_pylist()), "<u2").reshape(-1, BANDS, ROWS).astype(np.uint64)
            keys = mixed((sig * factors).sum(axis=2, dtype=np.uint64)) >> np.uint64(6) << np.uint64(6)
            keys |= np.arange(BANDS, dtype=np.uint64)
            again = np.repeat(np.arange(b.num_rows), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view("<i8")), b.column(0).take(pa.array(again)),
                                              b.column(1).take(pa.array(again))], names=["band", "node", "n"])

    return nodes.select("node", "n", "sig").mapInArrow(run, "band long, node long, n long")


@lru_cache(1)
def least_matches() -> list[int]:
    """For each compared length, the least matches that leave the posterior at ``MISS`` or more.

    With a uniform prior the posterior P(J >= t | m of n) is P(Bin(n + 1, t) <= m).
    """
    t, out = SIMILAR[0] / SIMILAR[1], []
    for n in range(BATCH, HASHES + 1, BATCH):
        total, m = 0.0, 0
        while True:
            total += comb(n + 1, m) * t ** m * (1 - t) ** (n + 1 - m)
            if total >= MISS:
                break
            m += 1
        out.append(m)
    return out


def surviving(a, b):
    """Places of the signature pairs (rows of ``a`` and ``b``) that no batch gives up."""
    import numpy as np

    left, seen = np.arange(len(a)), np.zeros(len(a), np.int32)
    for k, least in enumerate(least_matches()):
        cut = slice(k * BATCH, (k + 1) * BATCH)
        seen = seen + (a[left, cut] == b[left, cut]).sum(axis=1)
        stay = seen >= least
        left, seen = left[stay], seen[stay]
    return left


def _settled(pairs: DataFrame) -> DataFrame:
    """A frozen table of pairs in as many partitions as it is worth."""
    pairs = frozen(pairs)
    return few(pairs, pairs.count())


def _keys(keys: DataFrame) -> DataFrame:
    """A narrow key table for a join, sent to every executor if it has at most ``BROADCAST_KEYS`` rows."""
    keys = frozen(keys)
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def _looked_up(pairs: DataFrame, side: str, facts: DataFrame, columns: list[str]) -> DataFrame:
    """``pairs`` with the facts of the class in ``side``, a class that many pairs name dealt over ``SALTS`` tasks."""
    salted = pairs.withColumn("_salt", F.pmod(F.xxhash64("a", "b"), F.lit(SALTS)))
    wanted = salted.select(side, "_salt").distinct().join(
        facts.select(F.col("node").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in columns]), side)
    return salted.join(wanted, [side, "_salt"]).drop("_salt")


def _compared(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose signatures pass all batches."""
    given = _looked_up(_looked_up(pairs, "a", nodes, ["sig"]), "b", nodes, ["sig"]).select("a", "b", "sig_a", "sig_b")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for t in batches:
            a, b = (np.frombuffer(b"".join(t.column(c).to_pylist()), "<u2").reshape(-1, HASHES) for c in (2, 3))
            at = pa.array(surviving(a, b))
            yield pa.RecordBatch.from_arrays([t.column(0).take(at), t.column(1).take(at)], names=["a", "b"])

    return given.mapInArrow(run, "a long, b long")


def _with_sets(nodes: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """(node, n, sig, set): the full shingle sets of ``nodes``, whose texts alone are read again."""
    def run(batches):
        import pyarrow as pa

        for b in batches:
            sets = [shingle_set(t, width) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                pa.array([s.view("<i8") for s in sets], pa.list_(pa.int64()))], names=["digest", "set"])

    texts = _keyed(docs).join(_keys(nodes.select("key").distinct()), "key", "left_semi").select("text")
    sets = texts.mapInArrow(run, "digest binary, set array<long>").join(nodes.select("node", "digest"), "digest")
    return nodes.select("node", "n", "sig").join(sets.select("node", "set").dropDuplicates(["node"]), "node")


def _verified(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs whose full sets reach the threshold."""
    both = _looked_up(_looked_up(pairs, "a", nodes, ["set"]), "b", nodes, ["set"])
    same = F.size(F.array_intersect("set_a", "set_b"))
    union = F.size("set_a") + F.size("set_b") - same
    return both.where(same * SIMILAR[1] >= union * SIMILAR[0]).select("a", "b")


def block_links(band: int, ours, theirs, node, label, sig, sets) -> list[tuple[int, int]]:
    """Links that join the components ``label`` of members ``ours`` and ``theirs``, one for each two joined.

    A pair is looked at in the first band that both share; its signatures are
    compared in batches, and what is left is verified on the full sets.
    """
    import numpy as np

    n = np.array([len(s) for s in sets])
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    ids = np.split(ids, np.cumsum(n)[:-1])
    flat = np.concatenate([ids[k] for k in theirs])
    starts = np.concatenate(([0], np.cumsum(n[theirs])[:-1]))
    held = np.zeros(max(map(np.max, ids)) + 1, bool)
    label, found = label.copy(), []
    for i in ours.tolist():
        fit = (label[theirs] != label[i]) & (n[theirs] * SIMILAR[1] >= n[i] * SIMILAR[0]) & (
            n[i] * SIMILAR[1] >= n[theirs] * SIMILAR[0])
        at = np.flatnonzero(fit)
        at = at[surviving(np.broadcast_to(sig[i], (len(at), HASHES)), sig[theirs[at]])]
        shared = (sig[theirs[at]] == sig[i]).reshape(len(at), BANDS, ROWS).all(axis=2)
        at = at[shared.argmax(axis=1) == band] if len(at) else at
        if not len(at):
            continue
        held[ids[i]] = True
        same = np.add.reduceat(held[flat], starts, dtype=np.int64)[at]
        held[ids[i]] = False
        for j in theirs[at[same * SIMILAR[1] >= (n[i] + n[theirs[at]] - same) * SIMILAR[0]]].tolist():
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                found.append((min(node[i], node[j]), max(node[i], node[j])))
    return found


def block_hits(band: int, ours, theirs, label, n, sig):
    """Places of the members of ``ours`` and ``theirs`` that ``block_links`` may link to another component.

    Two members are compared until both are hits: the answer names members, never pairs.
    """
    import numpy as np

    hit = np.zeros(len(label), bool)
    for i in ours.tolist():
        at = theirs[(label[theirs] != label[i]) & ~(hit[i] & hit[theirs]) & (n[theirs] * SIMILAR[1] >= n[i] * SIMILAR[0]) & (
            n[i] * SIMILAR[1] >= n[theirs] * SIMILAR[0])]
        at = at[surviving(np.broadcast_to(sig[i], (len(at), HASHES)), sig[at])]
        if len(at):
            at = at[(sig[at] == sig[i]).reshape(len(at), BANDS, ROWS).all(axis=2).argmax(axis=1) == band]
            hit[at] = True
            hit[i] |= len(at) > 0
    return np.flatnonzero(hit)


def _by_blocks(rows: DataFrame, facts: DataFrame, work, schema: str) -> DataFrame:
    """``work`` on the members of every two blocks of a band group.

    ``rows`` has (band, node, root, blocks).  A member goes to every pair of
    blocks that holds its own; a task holds at most two blocks.  ``work`` takes
    their rows with the ``facts`` of the class, and the places of either block.
    """
    dealt = rows.select("band", "node", "root", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("own"),
                        F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))).alias("other"))
    dealt = dealt.select("band", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "node",
                         "root").join(facts, "node")

    def found(rows):
        import numpy as np

        own = rows.column("own").to_numpy()
        return work(rows, np.flatnonzero(own == rows.column("low")[0].as_py()), np.flatnonzero(own == rows.column("high")[0].as_py()))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        held = None
        for b in batches:  # sorted, so the rows of a pair of blocks follow each other
            rows = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            keys = np.stack([rows.column(c).to_numpy() for c in ("band", "low", "high")])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            for s, e in zip([0, *cuts[:-1]], cuts, strict=True) if len(cuts) else ():
                yield found(rows.slice(s, e - s))
            held = rows.slice(cuts[-1]) if len(cuts) else rows
        if held is not None and held.num_rows:
            yield found(held)

    order = ["band", "low", "high"]
    return dealt.repartition(*order).sortWithinPartitions(*order).mapInArrow(run, schema)


def _signed(rows):
    """Columns ``node`` and ``root`` and the signatures of Arrow rows."""
    import numpy as np

    return (*(rows.column(c).to_numpy() for c in ("node", "root")),
            np.frombuffer(b"".join(rows.column("sig").to_pylist()), "<u2").reshape(-1, HASHES))


def _hits(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(band, node, root, n): the members of ``rows`` that have a candidate in another component, by signatures alone."""
    def work(rows, ours, theirs):
        import pyarrow as pa

        _, root, sig = _signed(rows)
        at = pa.array(block_hits(rows.column("band")[0].as_py() & 63, ours, theirs, root, rows.column("n").to_numpy(), sig))
        return pa.RecordBatch.from_arrays([rows.column(c).combine_chunks().take(at) for c in ("band", "node", "root", "n")],
                                          names=["band", "node", "root", "n"])

    return _by_blocks(rows, nodes.select("node", "n", "sig"), work, "band long, node long, root long, n long").distinct()


def _block_links(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links between the components of band groups, found block against block."""
    def work(rows, ours, theirs):
        if not len(ours) or not len(theirs):
            return _edges([])
        node, root, sig = _signed(rows)
        sets = [x.values.to_numpy() for x in rows.column("set")]
        return _edges(block_links(rows.column("band")[0].as_py() & 63, ours, theirs, node, root, sig, sets))

    return _by_blocks(rows, nodes.select("node", "sig", "set"), work, "a long, b long")


def _blocked(tagged: DataFrame, block: int, shingles: int | None = None) -> DataFrame:
    """The rows (band, node, root, n) of groups that hold several components, with the number of their group's ``blocks``."""
    blocks = F.ceil(F.count(F.lit(1)) / block)
    if shingles:
        blocks = F.greatest(blocks, F.ceil(F.sum("n") / shingles))
    several = tagged.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), blocks.alias("blocks")).where("lo < hi")
    return tagged.join(several.select("band", "blocks"), "band").select("band", "node", "root", "blocks")


def _edges(links: list):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])


def _roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, root) of every class; a class without links is its own root."""
    found = components(edges, merged=True)
    return nodes.select("node").join(found, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def links(nodes: DataFrame, docs: DataFrame, width: int = SHINGLE_WORDS) -> DataFrame:
    """Verified edges (a < b) between classes, whose components are those of all verified pairs of a shared band."""
    bands = _bands(nodes)
    shared = frozen(bands.groupBy("band").agg(F.count(F.lit(1)).alias("members"), F.min("node").alias("a"), F.max("node").alias("b"))
                    .where("members > 1"))
    more = shared.where("members > 2")
    members = frozen(bands.join(_keys(more.select("band")), "band").join(more.select("band", "a", "members"), "band"))
    stars = _settled(shared.where("members = 2").select("a", "b").unionByName(
        members.where("node <> a").select("a", F.col("node").alias("b"))).distinct())
    ends = stars.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    nodes = frozen(_with_sets(frozen(nodes.join(_keys(ends), "node", "left_semi")), docs, width))
    first = _settled(_verified(_settled(_compared(stars, nodes)), nodes))

    # groups of several components: their members meet those of the other components, by signatures first;
    # a full set goes only to the bands in which its class has a candidate left
    tagged = members.join(_roots(nodes, first), "node").select("band", "node", "root", "n")
    hits = frozen(_hits(_blocked(tagged, SIG_BLOCK), nodes))
    left = frozen(nodes.join(_keys(hits.select("node").distinct()), "node", "left_semi"))
    return first.unionByName(_block_links(_blocked(hits, BLOCK, BLOCK_SHINGLES), left)).distinct()


def near_duplicates(docs: DataFrame, width: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): the least doc_id reachable over links, itself included.

    Texts without words (null texts too) have no shingles and are linked with
    nothing: each such row is its own component.  A null doc_id keeps its row
    and takes no part in the minimum; a component of null ids alone has a null
    id, and its rows are kept.  Repeated rows are copies of each other.  Other
    columns are not looked at; an empty table gives an empty result.
    """
    found = frozen(prints(docs, width))
    nodes = frozen(_classes(found))
    roots = frozen(_roots(nodes, frozen(links(nodes, docs, width))))
    placed = nodes.select("node", "digest", "first", "rows").join(roots, "node")
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    answers = frozen(placed.join(least, "root").select("digest", "rows", "component_id"))
    kept = F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    out = [F.col("doc_id"), F.col("n").alias("n_shingles"), F.col("component_id"), kept]
    hot = answers.where(F.col("rows") > HOT).select("digest", "component_id", F.lit(True).alias("hot"))
    rows = found.where("n > 0").select("doc_id", "n", "digest").join(F.broadcast(hot), "digest", "left")
    cold = rows.where("hot IS NULL").select("doc_id", "n", "digest").join(
        answers.where(F.col("rows") <= HOT).select("digest", "component_id"), "digest")
    alone = found.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return (rows.where("hot").select(*out).unionByName(cold.select(*out)).unionByName(alone.select(*out)))
