"""Sharding by balanced label propagation: linked rows stay together, counts stay one apart.

Labels start from a packing: the table of group sizes (at most sqrt(2 rows) of
them) is packed into the quotas on the driver, largest first; Spark numbers
the groups within their size and looks their shards up.  Rows without links
fill every shard up to its quota.

Then labels propagate over an edge table.  A round is a few Spark joins: every
row counts its neighbours by shard and asks to move to the shard of most of
them, if that cuts fewer of its edges.  Quotas stay kept by exchanges: requests
from one shard to another are admitted against requests the other way, and the
rest against rows without links, which go back in their place.  Only the
counts of requests by pair of shards reach the driver.  A round that cuts no
fewer edges in all is dropped; propagation ends when nothing asks to move, no
request can be admitted, or ``PATIENCE`` rounds in a row were dropped.  In turn
all rows may ask, one half and the other half, halved anew each time, so that
neighbours don't just change places.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardflow.llm.common import few, frozen, ranked, shuffle_partitions

SHARDS = 40
#: Rounds in a row without fewer cut edges after which propagation ends.
PATIENCE = 3
#: Members from which a group's place is sent to every executor (at most rows / HOT groups).
HOT = 10_000


def quotas(rows: int, shards: int) -> list[int]:
    """Rows of each shard, at most one apart."""
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def _level(n: int, members: int, room: list[int]) -> list[int]:
    """How many of ``n`` groups each shard takes so that what is left free is as even as can be."""
    def takes(left: int) -> list[int]:
        return [max(0, r - left) // members for r in room]

    if sum(takes(0)) <= n:
        return takes(0)
    low, high = 0, max(room)  # at low too many or just enough are taken, at high too few
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if sum(takes(mid)) >= n else (low, mid)
    found, more = takes(high), takes(low)
    over = n - sum(found)
    for s, (few, many) in enumerate(zip(found, more, strict=True)):
        if over and many > few:
            found[s], over = many, over - 1
    return found


def _tightest(n: int, members: int, room: list[int]) -> list[int]:
    """How many of ``n`` groups each shard takes, the fullest that they fit first."""
    found = [0] * len(room)
    for s in sorted(range(len(room)), key=lambda s: room[s]):
        found[s] = min(n, room[s] // members)
        n -= found[s]
    return found


def _spread(rows: int, room: list[int]) -> tuple[list[int], list[int]]:
    """Shards for a group that is cut, few of them, and the numbers of its rows at which each ends."""
    shards, stops, at = [], [], 0
    while at < rows:
        fits = [s for s, r in enumerate(room) if r >= rows - at]
        s = min(fits, key=room.__getitem__) if fits else max(range(len(room)), key=room.__getitem__)
        n = min(room[s], rows - at)
        room[s] -= n
        at += n
        shards.append(s)
        stops.append(at)
    return shards, stops


def packed(sizes: dict[int, int], quota: list[int]) -> tuple[list[tuple], list[int], int]:
    """Shards for ``sizes`` (members: number of groups), what is left of ``quota``, and how many groups that fit are cut.

    A place is (members, first, last, shards, stops): groups first to last - 1
    of their size go to the one shard, or a single group to several.  Groups
    are dealt evenly, or, if that cuts more of them, to the fullest shards.
    """
    def placed(deal) -> tuple[list[tuple], list[int], int]:
        room, places, cut = list(quota), [], []
        for members in sorted(sizes, reverse=True):
            first, n = 0, sizes[members]
            if members > max(quota):
                places += [(members, i, i + 1, *_spread(members, room)) for i in range(n)]
                continue
            for s, some in enumerate(deal(n, members, room)):
                if some:
                    places.append((members, first, first + some, [s], [members]))
                    room[s] -= some * members
                    first += some
            cut += [(members, i) for i in range(first, n)]
        places += [(members, i, i + 1, *_spread(members, room)) for members, i in cut]
        return places, room, len(cut)

    even = placed(_level)
    return min(even, placed(_tightest), key=lambda x: x[2]) if even[2] else even


def start(nodes: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(node, shard): groups of equal ``link`` packed into the quotas, rows without links filling them.

    A group is cut only if it is larger than a shard, or if no shard had room
    for it; of the latter there are fewer than shards.
    """
    spark = nodes.sparkSession
    salts = max(64, 4 * shuffle_partitions(spark))
    groups = frozen(nodes.where("link IS NOT NULL").groupBy("link").agg(F.count(F.lit(1)).alias("members")).where("members > 1"))
    quota = quotas(nodes.count(), shards)
    places, room, _ = packed({r["members"]: r["count"] for r in groups.groupBy("members").count().collect()}, quota)
    of_size = F.broadcast(spark.createDataFrame(places, "of long, first long, last long, shards array<int>, stops array<long>"))
    numbered = ranked(groups, ["members"], ["link"], salts, "nth")
    whereto = frozen(numbered.join(of_size, (F.col("members") == F.col("of")) & (F.col("nth") >= F.col("first"))
                                   & (F.col("nth") < F.col("last"))).select("link", "members", "shards", "stops"))
    hot = whereto.where(F.col("members") > HOT).select("link", F.col("shards").alias("hot_shards"), F.col("stops").alias("hot_stops"))
    cold = nodes.join(F.broadcast(hot), "link", "left")
    found = cold.where("hot_shards IS NOT NULL").select("node", "link", F.col("hot_shards").alias("shards"), F.col("hot_stops").alias("stops"))
    cold = cold.where("hot_shards IS NULL").select("node", "link").join(
        whereto.where(F.col("members") <= HOT).select("link", "shards", "stops"), "link", "left")
    labels = frozen(found.unionByName(cold.select("node", "link", "shards", "stops")))
    whole = labels.where(F.size("shards") == 1).select("node", F.col("shards")[0].alias("shard"))
    cut = ranked(labels.where(F.size("shards") > 1), ["link"], ["node"], salts, "nth")
    cut = cut.select("node", F.get("shards", F.size(F.filter("stops", lambda x: x <= F.col("nth")))).alias("shard"))
    free = ranked(labels.where("shards IS NULL").select("node"), [], ["node"], salts, "place")
    stops, at = [], 0
    for r in room:
        at += r
        stops.append(at)
    to = reduce(add, [(F.col("place") >= s).cast("int") for s in stops[:-1]], F.lit(0))
    return whole.unionByName(cut).unionByName(free.select("node", to.alias("shard")))


def hub_edges(nodes: DataFrame) -> DataFrame:
    """(a, b): each row of a link and the link's least row; hubs of links keep all rows of equal link connected."""
    linked = nodes.where("link IS NOT NULL")
    hubs = linked.groupBy("link").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("members")).where("members > 1")
    hot = hubs.where(F.col("members") > HOT).select("link", F.col("a").alias("hub"))
    rows = linked.join(F.broadcast(hot), "link", "left")
    large = rows.where("hub IS NOT NULL").select(F.col("hub").alias("a"), F.col("node").alias("b"))
    small = rows.where("hub IS NULL").select("link", "node").join(
        hubs.where(F.col("members") <= HOT).select("link", "a"), "link").select("a", F.col("node").alias("b"))
    return large.unionByName(small).where("a <> b")


def _neighbour_shards(edges: DataFrame, labels: DataFrame, ends: int) -> DataFrame:
    """(node, shard, votes): how many neighbours of a node lie in each shard; ``ends`` is twice the number of edges."""
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("peer")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("a").alias("peer")))
    # an edge's end may have very many edges: its label goes to each of the salts that ask for it
    salted = both.withColumn("salt", F.pmod(F.xxhash64("node", "peer"), F.lit(16)))
    wanted = few(salted.select("peer", "salt").distinct(), ends).join(labels.select(F.col("node").alias("peer"), "shard"), "peer")
    found = few(salted.join(few(wanted, ends), ["peer", "salt"]), ends).groupBy("node", "shard")
    return few(found.agg(F.count(F.lit(1)).alias("votes")), ends)


def _counted(edges: DataFrame, labels: DataFrame, ends: int) -> tuple[DataFrame, int]:
    """(node, own, shard, votes) and the edges whose ends lie in different shards."""
    found = _neighbour_shards(edges, labels, ends).join(labels.select("node", F.col("shard").alias("own")), "node")
    votes = frozen(few(found, ends))
    return votes, (votes.where("shard <> own").agg(F.sum("votes")).first()[0] or 0) // 2


def cut_edges(edges: DataFrame, labels: DataFrame) -> int:
    """Edges whose ends lie in different shards."""
    return _counted(edges, labels, 2 * edges.count())[1]


def _admitted(asked: dict, free: list[int]) -> tuple[dict, dict]:
    """Requests admitted by (from, to), and fillers sent by (from, to), so that every shard keeps its count."""
    moves, fillers, left = {}, {}, list(free)
    for s, t in sorted({tuple(sorted(k)) for k in asked}):
        there, back = asked.get((s, t), 0), asked.get((t, s), 0)
        both = min(there, back)
        low, high, more = (s, t, there - both) if there > back else (t, s, back - both)
        extra = min(more, left[high])  # rows without links go from ``high`` to ``low``
        left[high] -= extra
        if extra:
            fillers[high, low] = extra
        for k, n in (((s, t), both), ((t, s), both)):
            if n + (extra if k == (low, high) else 0):
                moves[k] = n + (extra if k == (low, high) else 0)
    return moves, fillers


def _case(limits: dict, source: str, target: str):
    """The admitted number of a row's pair of shards, 0 if there is none."""
    pairs = [v for (s, t), n in limits.items() for v in (F.lit(f"{s}>{t}"), F.lit(n))]
    return F.coalesce(F.create_map(*pairs)[F.concat_ws(">", source, target)], F.lit(0)) if pairs else F.lit(0)


def propagate(labels: DataFrame, edges: DataFrame, shards: int = SHARDS) -> tuple[DataFrame, list[int]]:
    """Labels (node, shard) after propagation over ``edges`` (a, b), and the cut edges at the start and after each round.

    Every shard keeps its number of rows.
    """
    labels, edges = frozen(labels), frozen(edges)
    rows, ends_of = labels.count(), 2 * edges.count()
    labels, edges = few(labels, rows), few(edges, ends_of)
    votes, cut = _counted(edges, labels, ends_of)
    history, failed, turn = [cut], 0, 0
    ends = few(votes.select("node").distinct(), ends_of)
    while history[-1] and failed < PATIENCE:
        best = votes.groupBy("node", "own").agg(
            F.max(F.struct("votes", (-F.col("shard")).alias("low"))).alias("best"),
            F.coalesce(F.max(F.when(F.col("shard") == F.col("own"), F.col("votes"))), F.lit(0)).alias("stay"))
        wish = best.where("best.votes > stay").select("node", "own", (-F.col("best.low")).alias("to"))
        half = F.pmod(F.xxhash64("node", F.lit(turn // 3)), F.lit(2))
        asks = frozen(few(wish.where(half == turn % 3 - 1) if turn % 3 else wish, ends_of))
        if turn % 3 == 0 and asks.isEmpty():  # all may ask and nobody does
            break
        turn += 1
        asked = {(r["own"], r["to"]): r["count"] for r in asks.groupBy("own", "to").count().collect()}  # at most shards^2
        idle = few(labels.join(ends, "node", "left_anti"), rows)
        free = {r["shard"]: r["count"] for r in idle.groupBy("shard").count().collect()} if asked else {}
        moves, fillers = _admitted(asked, [free.get(s, 0) for s in range(shards)])
        if not moves:
            failed += 1
            continue
        chosen = ranked(asks, ["own", "to"], ["node"], name="nth").where(F.col("nth") < _case(moves, "own", "to"))
        moved = chosen.select("node", F.col("to").alias("new"))
        if fillers:
            stops: dict = {}
            for (s, t), n in fillers.items():
                stops.setdefault(s, []).append((t, n))
            target = F.lit(None).cast("int")
            for s, ts in stops.items():
                at = 0
                for t, n in ts:
                    target = F.when((F.col("shard") == s) & (F.col("nth") >= at) & (F.col("nth") < at + n), t).otherwise(target)
                    at += n
            back = ranked(idle.where(F.col("shard").isin(list(stops))), ["shard"], ["node"], name="nth")
            moved = moved.unionByName(back.select("node", target.alias("new")).where("new IS NOT NULL"))
        tried = labels.join(few(moved, rows), "node", "left").select("node", F.coalesce("new", "shard").alias("shard"))
        tried = frozen(few(tried, rows))
        found, cut = _counted(edges, tried, ends_of)
        if cut < history[-1]:
            labels, votes, failed = tried, found, 0
            history.append(cut)
        else:
            failed += 1
    return labels, history


def shard(rows: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``rows`` with ``shard`` and ``slot`` (gapless from 0 in each shard).

    ``rows`` has ``id`` and ``link``; rows of equal link belong together, a
    null link stands alone.  Shards' counts are at most one apart; a group
    that is larger than a shard, or finds no shard with room, is spread over
    several.  Repeated rows each take a slot.  An empty table gives an empty
    result.
    """
    owned = frozen(rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"),
                               F.monotonically_increasing_id().alias("node")))
    nodes = owned.select("node", F.col("row.link").alias("link"))
    labels, _ = propagate(start(nodes, shards), hub_edges(nodes), shards)
    placed = ranked(labels, ["shard"], ["node"], max(64, 4 * shuffle_partitions(rows.sparkSession)), "slot")
    both = owned.join(placed, "node")
    return both.select(*[F.col(f"row.`{c}`").alias(c) for c in rows.columns], "shard", "slot")
