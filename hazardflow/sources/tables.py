"""Scans and sinks.

* sample tables: tab-separated text with a header row, ``#`` comment lines,
  first column = sample id; or Parquet.
* role tables: ``Variables, Group, Type`` → feature list, feature groups and
  outcome sets (``Group`` containing ``S_`` pairs a ``Type='S'`` status column
  with a ``Type='T'`` time column).
* sinks: Parquet (default) or tab-separated text.
"""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def scan_samples(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Row 1/2: tab-separated sample table (training or prediction set).

    Without a schema the numeric columns are inferred from the values; pass
    an explicit schema in production so the scan does not read twice.
    """
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    r = spark.read.option("sep", "\t").option("header", True).option("comment", "#") \
        .option("nanValue", "NaN").option("nullValue", "")
    if schema is not None:
        return r.schema(schema).csv(path)
    return r.option("inferSchema", True).csv(path)


@dataclass
class Outcome:
    name: str
    status: str
    time: str


@dataclass
class Roles:
    features: list[str]
    groups: dict[str, str]
    outcomes: list[Outcome] = field(default_factory=list)
    labels: list[str] = field(default_factory=list)


def scan_roles(spark: SparkSession, path: str) -> DataFrame:
    return (spark.read.option("sep", "\t").option("header", True).option("comment", "#")
            .schema("Variables STRING, `Group` STRING, Type STRING").csv(path))


def split_roles(roles_df: DataFrame) -> Roles:
    """Row 3: label / feature / outcome lists from the role table.

    The role table is metadata (one row per column of the sample table), so
    it is collected once.
    """
    rows = roles_df.select("Variables", "Group", "Type").collect()
    outcomes: dict[str, dict] = {}
    features, labels, groups = [], [], {}
    for r in rows:
        var, grp, typ = r["Variables"], r["Group"] or "", r["Type"] or ""
        if var is None:
            continue
        if "S_" in grp:
            outcomes.setdefault(grp, {})[typ] = var
        elif grp == "Y":
            labels.append(var)
        else:
            features.append(var)
            groups[var] = grp
    outs = [Outcome(g, d["S"], d["T"]) for g, d in outcomes.items() if "S" in d and "T" in d]
    return Roles(features=features, groups=groups, outcomes=outs, labels=labels)


def resolve_columns(df: DataFrame, wanted: list[str]) -> list[str]:
    """Row 4: ordered intersection of data columns with role features."""
    want = set(wanted)
    return [c for c in df.columns if c in want]


def write_table(df: DataFrame, path: str, fmt: str = "parquet", order_by: list[str] | None = None) -> None:
    """Row 5: table sink; with ``order_by`` the files in order of their names hold the rows in that order."""
    w = (df.orderBy(*order_by) if order_by else df).write.mode("overwrite")
    if fmt == "tsv":
        w.option("sep", "\t").option("header", True).csv(path)
    else:
        w.parquet(path)


def event_flag(status_col: str) -> F.Column:
    """Row 7: ``event = S > 0``; NULL status counts as censored."""
    return F.coalesce(F.col(status_col) > 0, F.lit(False))
