"""Source divergence audit: how unlike the term shares of the sources of each language are.

Terms are runs of letters (A-Z lower-cased, every character above 0x7F a
letter).  Each language keeps the terms of enough of its documents.  A source
gives a kept term with ``count`` occurrences the smoothed share
p = 1 + floor(10^9 (count + 5) / (N + 5 V)), in integers.

Pairs of sources are compared by a sparse merge: each source's counts become
sorted (term id, count) arrays, one a range of term ids; the two arrays of an
unordered pair and range meet in one task (a co-group), where a galloping
intersection finds the shared terms.  Shared terms cost |p - q|, one-sided
terms cost p against the other's share of an absent term, and the terms absent
from both are priced at once from their number.  The result serves both
directions.  A task holds two arrays of at most ``RANGE`` terms.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazardflow.llm.common import BATCH_ROWS, frozen, ranked

LEAST_DOCS = 30
TOP_TERMS = 50
#: Term ids of one array, which bounds a pair's task at any vocabulary.
RANGE = 1 << 15
#: Most kept terms that are sent to every executor with their numbers; more are joined by a shuffle.
BROADCAST_TERMS = 200_000
#: Different (group, term) counts that a task gathers before it hands them on.
HELD = 400_000
#: Bytes that belong to no term become blanks, A-Z becomes a-z; bytes of characters above 0x7F stay.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents with the term, summed as far as a task goes.

    Null text, lang and source are ''.
    """
    spark, key = docs.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    given = docs.select(blank("lang"), blank("source"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))

    def run(batches):
        import pyarrow as pa

        held: dict = {}

        def flush():
            rows = [(lang, source, t.decode(), n, seen[t]) for (lang, source), (total, seen) in held.items()
                    for t, n in total.items()]
            held.clear()
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                              names=["lang", "source", "term", "n", "docs"])

        for b in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                total, seen = held.setdefault((lang, source), (Counter(), Counter()))
                found = terms(text)
                total.update(found)
                seen.update(set(found))
            if sum(len(t) for t, _ in held.values()) > HELD:
                yield flush()
        yield flush()

    return given.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def share(n, total, kinds):
    """1 + floor(10^9 (n + 5) / (total + 5 kinds)) for integer arrays, exact while total + 5 kinds < 2^53.

    Long division in base 1000, so that no product leaves 63 bits.
    """
    import numpy as np

    rest, size = np.asarray(n, np.int64) + 5, total + 5 * kinds
    found = rest // size
    rest = rest % size
    for _ in range(3):
        rest = rest * 1000
        found, rest = found * 1000 + rest // size, rest % size
    return found + 1


def _share_column(n, total, kinds):
    """``share`` as a column expression."""
    size = F.expr(f"{total} + 5L * {kinds}")
    div = lambda x: F.call_function("div", x, size)
    rest = F.expr(f"{n} + 5L")
    found, rest = div(rest), rest % size
    for _ in range(3):
        found, rest = found * 1000 + div(rest * 1000), (rest * 1000) % size
    return found + 1


def gallop(small, large):
    """Places in the sorted array ``large`` of the elements of sorted ``small`` found there, and which those are.

    Each element starts where its rank would lie if both were spread alike,
    strides double until they pass it, then a bisection ends inside the stride.
    """
    import numpy as np

    m, n = len(small), len(large)
    if not m or not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = np.arange(m, dtype=np.int64) * n // m
    high, stride = low.copy(), 1
    going = np.flatnonzero(large[low] > small)  # start lies beyond: stride down
    while len(going):
        high[going] = low[going]
        low[going] = np.maximum(low[going] - stride, 0)
        going = going[(large[low[going]] > small[going]) & (low[going] > 0)]
        stride *= 2
    high = np.maximum(high, low)
    going, stride = np.flatnonzero(large[high] < small), 1
    while len(going):
        low[going] = np.maximum(low[going], high[going])
        high[going] = np.minimum(high[going] + stride, n - 1)
        going = going[(large[high[going]] < small[going]) & (high[going] < n - 1)]
        stride *= 2
    while True:  # the first element not below lies in low..high, if any does
        open_ = low < high
        if not open_.any():
            break
        mid = (low + high) // 2
        below = large[mid] < small
        low = np.where(open_ & below, mid + 1, low)
        high = np.where(open_ & ~below, mid, high)
    hit = np.flatnonzero(large[low] == small)
    return low[hit], hit


def merge_price(ids_a, n_a, ids_b, n_b, total_a: int, total_b: int, kinds: int) -> tuple[int, int]:
    """Summed |p_a - p_b| over the terms of either array, and the number of those terms."""
    import numpy as np

    if len(ids_a) > len(ids_b):
        ids_a, n_a, ids_b, n_b, total_a, total_b = ids_b, n_b, ids_a, n_a, total_b, total_a
    in_b, in_a = gallop(ids_a, ids_b)
    p_a, p_b = share(n_a, total_a, kinds), share(n_b, total_b, kinds)
    none_a, none_b = int(share(0, total_a, kinds)), int(share(0, total_b, kinds))
    only_a, only_b = np.ones(len(ids_a), bool), np.ones(len(ids_b), bool)
    only_a[in_a] = False
    only_b[in_b] = False
    both = np.abs(p_a[in_a] - p_b[in_b]).sum()
    sided = np.abs(p_a[only_a] - none_b).sum() + np.abs(p_b[only_b] - none_a).sum()
    return int(both + sided), len(ids_a) + len(ids_b) - len(in_a)


class Audit:
    """Kept terms, group totals and both parts of the audit of ``docs``.

    Nulls are ''; an empty table gives empty results; a language none of whose
    terms is kept has value 0 for all its pairs and no terms.  Repeated rows
    count as often as they occur; other columns are not looked at.
    """

    def __init__(self, docs: DataFrame, least_docs: int = LEAST_DOCS, id_range: int = RANGE):
        self.range = id_range
        # rows meet by language and term once: sums, document counts and the choice of terms need no other shuffle
        dealt = counts(docs).repartition("lang", "term")
        found = dealt.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        whole = Window.partitionBy("lang", "term")
        found = frozen(found.withColumn("lang_n", F.sum("n").over(whole)).withColumn("d", F.sum("docs").over(whole))
                       .where(F.col("d") >= least_docs).select("lang", "source", "term", "n", "lang_n"))
        kept = found.select("lang", "term", "lang_n").distinct()
        #: (lang, term, lang_n, id): kept terms, numbered from 0 in each language
        self.kept = frozen(ranked(kept, ["lang"], ["term"], name="id"))
        ids = self.kept.select("lang", "term", "id")
        if ids.count() <= BROADCAST_TERMS:
            ids = F.broadcast(ids)
        #: (lang, source, term, id, n, lang_n): occurrences of kept terms
        self.counts = frozen(found.join(ids, ["lang", "term"]))
        langs = self.kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kinds"), F.sum("lang_n").alias("lang_total"))
        blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
        totals = self.counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        groups = docs.select(blank("lang"), blank("source")).distinct()
        #: (lang, source, total, kinds, lang_total): every group that occurs
        self.groups = frozen(groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
                             .fillna(0, ["total", "kinds", "lang_total"]))

    def term_parts(self, top: int = TOP_TERMS) -> DataFrame:
        """(lang, source, item, value, rank): the terms that a source gives more than its language, farthest first."""
        priced = self.counts.where("n > 0").join(self.groups, ["lang", "source"]).select(
            "lang", "source", F.col("term").alias("item"), _share_column("n", "total", "kinds").alias("p"),
            _share_column("lang_n", "lang_total", "kinds").alias("q"))
        order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        return (priced.where("p > q").select("lang", "source", "item", (F.col("p") - F.col("q")).alias("value"))
                .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top))

    def _sides(self) -> DataFrame:
        """(lang, source, part, ids, ns): sorted arrays of term ids and counts, one a range of ids."""
        pair = F.array_sort(F.collect_list(F.struct("id", "n"))).alias("x")
        rows = self.counts.withColumn("part", F.floor(F.col("id") / self.range))
        return rows.groupBy("lang", "source", "part").agg(pair).select(
            "lang", "source", "part", F.col("x.id").alias("ids"), F.col("x.n").alias("ns"))

    def pair_tasks(self) -> DataFrame:
        """(lang, a, b, price, union_size): per unordered pair and id range, the price of its terms and their number."""
        keys = ["lang", "a", "b", "part"]
        own = self.groups.select("lang", "source", F.col("total").alias("mine"))
        other = self.groups.select("lang", F.col("source").alias("other"), F.col("total").alias("theirs"), "kinds")
        sides = self._sides().join(own, ["lang", "source"])
        left = sides.withColumnRenamed("source", "a").join(other.withColumnRenamed("other", "b"), "lang").where("a < b")
        right = sides.withColumnRenamed("source", "b").join(other.withColumnRenamed("other", "a"), "lang").where("a < b")
        # named anew, so that the two sides of the co-group share no column of one origin
        columns = [F.col(c).alias(c) for c in (*keys, "ids", "ns", "mine", "theirs", "kinds")]

        def price(key, mine, theirs):
            import numpy as np
            import pyarrow as pa

            def arrays(t):
                if not t.num_rows:
                    return np.zeros(0, np.int64), np.zeros(0, np.int64)
                return tuple(t.column(c).combine_chunks().flatten().to_numpy() for c in ("ids", "ns"))

            if mine.num_rows:
                one = mine.select(["mine", "theirs", "kinds"]).to_pylist()[0]
                total_a, total_b = one["mine"], one["theirs"]
            else:
                one = theirs.select(["mine", "theirs", "kinds"]).to_pylist()[0]
                total_b, total_a = one["mine"], one["theirs"]
            cost, size = merge_price(*arrays(mine), *arrays(theirs), total_a, total_b, one["kinds"])
            return pa.table({"lang": [key[0].as_py()], "a": [key[1].as_py()], "b": [key[2].as_py()],
                             "price": pa.array([cost], pa.int64()), "union_size": pa.array([size], pa.int64())})

        return left.select(columns).groupBy(*keys).cogroup(right.select(columns).groupBy(*keys)).applyInArrow(
            price, "lang string, a string, b string, price long, union_size long")

    def pairs(self) -> DataFrame:
        """(lang, a, b, value): summed |p - q| over all kept terms for each unordered pair a < b of a language."""
        g = self.groups.select("lang", F.col("source").alias("a"), F.col("total").alias("total_a"), "kinds")
        h = self.groups.select("lang", F.col("source").alias("b"), F.col("total").alias("total_b"))
        priced = self.pair_tasks().groupBy("lang", "a", "b").agg(F.sum("price").alias("price"),
                                                                 F.sum("union_size").alias("union_size"))
        every = g.join(h, "lang").where("a < b").join(priced, ["lang", "a", "b"], "left")
        absent = (F.col("kinds") - F.coalesce("union_size", F.lit(0))) * F.abs(
            _share_column("0", "total_a", "kinds") - _share_column("0", "total_b", "kinds"))
        value = F.when(F.col("kinds") > 0, F.coalesce("price", F.lit(0)) + absent).otherwise(0)
        return every.select("lang", "a", "b", value.cast("long").alias("value"))

    def pair_parts(self) -> DataFrame:
        """(lang, source, item, value, rank): each other source of the language, most unlike first."""
        priced = self.pairs()
        both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")),
                                 F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
        order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        return (priced.select("lang", both.alias("s"), "value").select("lang", "s.source", "s.item", "value")
                .withColumn("rank", F.row_number().over(order)))
