"""Registration of queries with their SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
S, MIN, H, D = 10**9, 60 * 10**9, 3600 * 10**9, 86400 * 10**9
T0 = 1_704_067_200 * S
#: Events as points, for the SQL side.
P = "p AS (SELECT event_id, event_type, user_id, value, epoch_us(ts) * 1000 AS ts, props FROM events)"


def query(sql: str | None = None):
    """Registers a query under its function's name; ``p`` is the table of points in ``sql``."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            text = sql.strip()
            recursive = text.startswith("WITH RECURSIVE ")
            rest = text.removeprefix("WITH ").removeprefix("RECURSIVE ")
            if re.search(r"\bp\b", text):
                text = f"WITH {'RECURSIVE ' * recursive}{P}{', ' if text.startswith('WITH ') else ' '}{rest}"
            SQL[f.__name__] = text
        return f

    return add


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.select([F.round(c, digits).alias(c) if c in names else F.col(c) for c in df.columns])
