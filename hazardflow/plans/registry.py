"""Query registry: name -> (Spark builder, DuckDB oracle SQL or None).

Every registered query reads the driver tables (through the derived
survival views) at whatever scale ``sf_dir`` points to.  Floating outputs
are rounded to 6 decimals on both sides so engines that sum in different
orders still agree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
DIGITS = 6


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def r6(c: Column | str, name: str) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col.cast("double"), DIGITS).alias(name)
