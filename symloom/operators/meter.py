"""Usage counters: how many tokens went in and out, over how many calls."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COUNTERS = ["input_tokens", "output_tokens", "calls"]
_MAX = (1 << 63) - 1
_UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400}


def parse(lines: DataFrame, column: str = "value") -> DataFrame:
    """Rows (key, value) of key=value lines; blank lines, comments and lines without a number are passed over, of equal keys the last counts."""
    line = F.trim(F.col(column))
    parts = F.split(line, "=", 2)
    rows = lines.where((line != "") & ~F.startswith(line, F.lit("#")) & F.contains(line, F.lit("="))).select(F.trim(parts[0]).alias("key"), F.trim(parts[1]).try_cast("bigint").alias("value"), *[c for c in lines.columns if c != column])
    return rows.where("value >= 0")


def totals(calls: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of (input_tokens, output_tokens) and the number of rows as calls, for each key; sums stop at the largest number."""
    total = lambda c: F.least(F.sum(F.col(c).cast("decimal(38,0)")), F.lit(_MAX)).cast("bigint").alias(c)
    return calls.groupBy(*keys).agg(total("input_tokens"), total("output_tokens"), F.count("*").alias("calls"))


def difference(now: DataFrame, before: DataFrame, keys: list[str]) -> DataFrame:
    """Counters of now less those of before, never below 0; what before doesn't have counts as 0."""
    b = before.select(*keys, *[F.col(c).alias(f"_{c}") for c in COUNTERS])
    return now.join(b, keys, "left").select(*keys, *[F.greatest(F.col(c) - F.coalesce(F.col(f"_{c}"), F.lit(0)), F.lit(0)).alias(c) for c in COUNTERS])


def seconds(duration: Column) -> Column:
    """Ns, Nm, Nh or Nd as seconds; null for anything else."""
    n = F.regexp_extract(duration, r"^(\d+)[smhd]$", 1).try_cast("bigint")
    unit = F.substring(duration, -1, 1)
    factor = F.lit(None)
    for u, s in _UNITS.items():
        factor = F.when(unit == u, F.lit(s)).otherwise(factor)
    return n * factor


def duration_seconds(text: str) -> int:
    found = re.fullmatch(r"(\d+)([smhd])", text.strip())
    if not found:
        raise ValueError(f"not a duration: {text!r}")
    return int(found[1]) * _UNITS[found[2]]


def since(counters: DataFrame, now: Column, window: Column, stamp: str = "last_updated") -> DataFrame:
    """The counters as they are if they were updated within the window, else zeros."""
    fresh = (now - F.col(stamp)) <= window
    return counters.select(*[F.when(F.coalesce(fresh, F.lit(False)), F.col(c)).otherwise(0).cast("bigint").alias(c) if c in COUNTERS else F.col(c) for c in counters.columns])
