"""Windows, top-k, quotas, percentiles and runs.

Ranks always have a total order given by the caller. Groups of any size are sorted with spilling by Spark's window operator; where a
group may hold a large part of all rows, values are counted first (``nearest_rank``) or cut to k rows by partition first (``top_k``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, salts: int = 32) -> DataFrame:
    """The first k rows of each key. A salted pre-selection keeps at most salts * k rows of a key before the final rank, so a key that
    holds a third of all rows is ranked by many tasks. ``rank`` counts from 1."""
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(salts)))
    part = salted.withColumn("__n", F.row_number().over(W.partitionBy(*keys, "__salt").orderBy(*order))).where(F.col("__n") <= k)
    return part.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k).drop("__salt", "__n")


def nearest_rank(df: DataFrame, keys: list[str], value: str, percents: list[float]) -> DataFrame:
    """Percentiles by nearest rank, round(p / 100 * n + 0.5) with halves to even, within 1..n (D20). Values are counted before they are
    ranked, nulls left out."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("c"))
    all_ = W.partitionBy(*keys)
    placed = counts.withColumns({"upto": F.sum("c").over(all_.orderBy(value)), "n": F.sum("c").over(all_)})
    at = lambda p: F.least(F.greatest(F.bround(F.lit(p / 100) * F.col("n") + 0.5), F.lit(1)), F.col("n"))
    hit = lambda p: (F.col("upto") >= at(p)) & (F.col("upto") - F.col("c") < at(p))
    return placed.groupBy(*keys).agg(F.max("n").alias("n"), *(F.max(F.when(hit(p), F.col(value))).alias(f"p{p:g}") for p in percents))


def index_percentile(df: DataFrame, keys: list[str], value: str, parts: list[float]) -> DataFrame:
    """Percentiles by index, sorted[int(n * p)]."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("c"))
    all_ = W.partitionBy(*keys)
    placed = counts.withColumns({"upto": F.sum("c").over(all_.orderBy(value)), "n": F.sum("c").over(all_)})
    at = lambda p: F.least(F.floor(F.col("n") * F.lit(p)), F.col("n") - 1)
    hit = lambda p: (F.col("upto") > at(p)) & (F.col("upto") - F.col("c") <= at(p))
    return placed.groupBy(*keys).agg(F.max("n").alias("n"), *(F.max(F.when(hit(p), F.col(value))).alias(f"p{round(p * 100):d}") for p in parts))


def with_quotas(df: DataFrame, key: str, order: list[Column], per_key: int, budget: int) -> DataFrame:
    """At most ``per_key`` rows of each key, then at most ``budget`` rows in all, by rank within the key first."""
    few = top_k(df, [key], order, per_key)
    return few.orderBy("rank", key).limit(budget)


def sessions(df: DataFrame, keys: list[str], at: str, gap: float) -> DataFrame:
    """Rows numbered by runs without a gap larger than ``gap``."""
    w = W.partitionBy(*keys).orderBy(at)
    opens = F.coalesce((F.col(at) - F.lag(at).over(w) > gap).cast("int"), F.lit(1))
    return df.withColumn("__open", opens).withColumn("run", F.sum("__open").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("__open")


def carried_forward(df: DataFrame, keys: list[str], at: str, value: str, into: str) -> DataFrame:
    """The last value that isn't null so far."""
    return df.withColumn(into, F.last(value, ignorenulls=True).over(W.partitionBy(*keys).orderBy(at).rowsBetween(W.unboundedPreceding, 0)))
