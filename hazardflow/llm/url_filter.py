"""URL filter: host and path rules, and boosted trees on lexical features for the rest.

The rules label the URLs they fit; gradient-boosted trees (Spark ML) are
trained on a bounded sample of those and judge every other URL from its
length, depth, digit ratio, entropy, parameters and suffix statistics.
"""

from __future__ import annotations

import string
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardflow.llm.common import frozen

#: Labelled URLs that the trees are fitted on, taken in the order of a hash of the URL.
SAMPLE_ROWS = 20_000
TREES, DEPTH, SEED = 16, 4, 7
#: Sample URLs that the mean of all suffixes counts as, in a suffix's share of blocked ones.
PRIOR = 5.0


@dataclass(frozen=True)
class Rule:
    """Fits ``host``, its subdomains, and paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null URL or one without ``://``."""
    url = F.coalesce(url, F.lit(""))
    parts = r"://([^/?#]*)([^?#]*)"
    return (F.translate(F.regexp_extract(url, parts, 1), string.ascii_uppercase, string.ascii_lowercase),
            F.regexp_extract(url, parts, 2))


def longest_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, or nulls."""
    text = verdict = None
    for r in sorted(rules, key=lambda r: (-len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        text = F.when(fits, F.lit(r.text)) if text is None else text.when(fits, F.lit(r.text))
        verdict = F.when(fits, F.lit(r.verdict)) if verdict is None else verdict.when(fits, F.lit(r.verdict))
    nothing = F.lit(None).cast("string")
    return (nothing, nothing) if text is None else (text, verdict)


def _lexical(url: str) -> list[float]:
    import math
    from collections import Counter

    n = len(url)
    host, _, rest = url.partition("://")[2].partition("/")
    path, _, query = rest.partition("#")[0].partition("?")
    entropy = sum(-c / n * math.log2(c / n) for c in Counter(url).values()) if n else 0.0
    digits = sum(c in string.digits for c in url)
    return [float(n), float(len(host)), float(host.count(".")), float(len(path)),
            float(sum(bool(p) for p in path.split("/"))), digits / n if n else 0.0, entropy,
            float(sum(bool(p) for p in query.split("&"))), float(url.count("-") + url.count("_")),
            float(url.startswith("https")), float(sum(c in string.digits for c in path))]


def _features(series: Iterator) -> Iterator:
    import pandas as pd

    for urls in series:
        yield pd.Series([_lexical(u or "") for u in urls])


def _suffix(host: Column, labels: int) -> Column:
    return F.array_join(F.slice(F.reverse(F.split(host, r"\.")), 1, labels), ".")


def judge(pages: DataFrame, rules: Sequence[Rule], sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of ``pages``.

    Where no rule fits, ``rule`` is null and the trees give the verdict.  If
    the rules fit URLs of one verdict only, that is the verdict of the rest;
    if they fit none, it is ``allow``.  Repeated rows stay; an empty table
    gives an empty result.
    """
    lexical = F.pandas_udf(_features, "array<double>", F.PandasUDFType.SCALAR_ITER)
    host, path = host_and_path(F.col("url"))
    urls = pages.select(F.col("page_id"), "url", host.alias("host"), path.alias("path"))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    urls = urls.withColumns({"rule": rule, "given": verdict, "tld": _suffix(F.col("host"), 1), "site": _suffix(F.col("host"), 2)})
    sample = frozen(urls.where("given IS NOT NULL").select("url", "tld", "site", (F.col("given") == "block").cast("int").alias("label"))
                    .distinct().orderBy(F.xxhash64("url"), "url").limit(sample_rows))
    seen = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    if len(seen) < 2:
        only = "block" if 1 in seen else "allow"
        return urls.select("page_id", "host", "path", "rule", F.coalesce("given", F.lit(only)).alias("verdict"))
    mean = seen[1] / (seen[0] + seen[1])

    def with_shares(df: DataFrame) -> DataFrame:
        """Adds each suffix's share of blocked URLs in the sample, of at most ``sample_rows`` suffixes."""
        for c in ("tld", "site"):
            share = sample.groupBy(F.col(c).alias(f"{c}_of")).agg(
                ((F.sum("label") + PRIOR * mean) / (F.count(F.lit(1)) + PRIOR)).alias(f"{c}_share"),
                F.log1p(F.count(F.lit(1))).alias(f"{c}_seen"))
            df = df.join(F.broadcast(share), F.col(c) == F.col(f"{c}_of"), "left").drop(f"{c}_of").fillna(
                {f"{c}_share": mean, f"{c}_seen": 0.0})
        shares = F.array("tld_share", "tld_seen", "site_share", "site_seen")
        return df.withColumn("features", array_to_vector(F.concat(lexical("url"), shares)))

    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    trees = GBTClassifier(featuresCol="features", labelCol="label", maxIter=TREES, maxDepth=DEPTH, stepSize=0.2,
                          seed=SEED, cacheNodeIds=False).fit(frozen(with_shares(sample).select("features", "label")))
    rest = trees.transform(with_shares(urls))
    method = F.when(F.col("prediction") == 1, F.lit("block")).otherwise(F.lit("allow"))
    return rest.select("page_id", "host", "path", "rule", F.coalesce("given", method).alias("verdict"))
