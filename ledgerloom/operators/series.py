"""Indicators over bars of a series (group H), and vector search.

Bars are (key, at, close, high, low), ordered by ``at`` within a key; bars with a missing price are dropped (H0). Indicators stand on
every bar where they are defined and are null before. Moving averages, deviations and ranges are windows; only the exponential average,
which is recursive, folds an ordered array of a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def bars(df: DataFrame) -> DataFrame:
    """H0: bars with all prices."""
    return df.na.drop(subset=["close", "high", "low"])


def _last(n: int) -> W:
    return W.partitionBy("key").orderBy("at").rowsBetween(1 - n, 0)


def sma(n: int, c: str = "close") -> Column:
    """H1: the mean of the last n values, null with fewer."""
    return F.when(F.count(c).over(_last(n)) == n, F.avg(c).over(_last(n)))


def indicators(df: DataFrame) -> DataFrame:
    """H1, H2, H5, H6, H7: moving averages, RSI by simple means, Bollinger bands, ATR, and the distance from the average in percent."""
    o = W.partitionBy("key").orderBy("at")
    previous = F.lag("close").over(o)
    steps = bars(df).withColumns(
        {"up": F.greatest(F.col("close") - previous, F.lit(0.0)), "down": F.greatest(previous - F.col("close"), F.lit(0.0)), "range": F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - previous), F.abs(F.col("low") - previous)), "no": F.row_number().over(o)}
    )
    enough = F.col("no") >= 15
    gain, loss = F.avg("up").over(_last(14)), F.avg("down").over(_last(14))
    with_ = steps.withColumns({"sma20": sma(20), "sma50": sma(50), "deviation": F.when(F.count("close").over(_last(20)) == 20, F.stddev_pop("close").over(_last(20)))})
    return with_.withColumns(
        {
            "rsi14": F.when(enough, F.when(loss == 0, 100.0).otherwise(100 - 100 / (1 + gain / F.nullif(loss, F.lit(0.0))))),
            "upper": F.col("sma20") + 2 * F.col("deviation"),
            "lower": F.col("sma20") - 2 * F.col("deviation"),
            "atr14": F.when(enough, F.avg("range").over(_last(14))),
            "from_sma20": F.round(F.try_divide(F.col("close") - F.col("sma20"), F.col("sma20")) * 100, 2),
        }
    ).drop("up", "down", "range", "deviation", "no")


def ema(df: DataFrame, n: int) -> DataFrame:
    """H3: key, ema of the last bar: begun with the mean of the first n closes; null with fewer bars."""
    closes = F.transform(F.array_sort(F.collect_list(F.struct("at", "close"))), lambda x: x["close"])
    k = 2 / (n + 1)
    first = F.aggregate(F.slice("c", 1, n), F.lit(0.0), lambda a, x: a + x) / n
    value = F.aggregate(F.slice("c", F.lit(n + 1), F.greatest(F.size("c") - n, F.lit(0))), first, lambda a, x: x * k + a * (1 - k))
    return bars(df).groupBy("key").agg(closes.alias("c")).select("key", F.when(F.size("c") >= n, value).alias("ema"))


def large(value: Column) -> Column:
    """H8: an amount in trillions, billions, millions or thousands; what is under a thousand or negative is shown whole."""
    out = F.when(value >= 1e12, F.format_string("$%.2fT", value / 1e12))
    for step, unit in ((1e9, "B"), (1e6, "M"), (1e3, "K")):
        out = out.when(value >= step, F.format_string(f"$%.2f{unit}", value / step))
    return out.otherwise(F.format_string("$%.2f", value))


def dot(a: Column, b: Column) -> Column:
    """The dot product of two vectors, which for unit vectors is their cosine."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def vector_search(vectors: DataFrame, key: str, vector: str, query: list[float], k: int, scope: Column | None = None) -> DataFrame:
    """The k nearest vectors to a query by dot product, the smaller key first on ties; a scope filters before the scan is scored."""
    own = vectors if scope is None else vectors.where(scope)
    scored = own.select(key, dot(F.col(vector), F.array(*map(F.lit, query))).alias("score"))
    return scored.orderBy(F.col("score").desc(), key).limit(k)


def restates(figure: Column, decimals: Column, grounded: Column) -> Column:
    """H9: whether a figure is a grounded value, rounded to the figure's own decimals, at a scale of 1, 1e3, 1e6 or 1e9."""
    steps = F.array(*map(F.lit, (1.0, 1e3, 1e6, 1e9)))
    fits = lambda g, s: F.abs(F.floor(g / s * F.pow(F.lit(10.0), decimals) + 0.5) - figure * F.pow(F.lit(10.0), decimals)) < 1e-6
    return (decimals <= 4) & F.exists(grounded, lambda g: F.exists(steps, lambda s: fits(g, s)))


def scaled(value: Column, scale: Column, sign: Column) -> Column:
    """A tagged value at its scale, negated if its sign says so."""
    return value * F.pow(F.lit(10.0), scale) * F.when(sign == "-", -1.0).otherwise(1.0)
