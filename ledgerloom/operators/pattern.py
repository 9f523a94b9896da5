"""Graph-pattern joins: nodes joined to edges joined to nodes, declared and left to Catalyst.

Shared results: an edge whose end is null or not stored matches nothing; parallel edges give one row each; columns that clash are told
apart by the prefixes given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select([F.col(f"`{c}`").alias(prefix + c) for c in df.columns])


def hop(left: DataFrame, left_key: str, edges: DataFrame, right: DataFrame, right_key: str, reverse: bool = False) -> DataFrame:
    """One typed hop (C1): rows of ``left`` joined over edges to ``right``. reverse: against the direction of the edges."""
    a, b = ("dst", "src") if reverse else ("src", "dst")
    over = edges.withColumnsRenamed({a: "__from", b: "__to"})
    return left.join(over, F.col(left_key) == F.col("__from")).join(right, F.col("__to") == F.col(right_key)).drop("__from", "__to")


def symmetric(edges: DataFrame) -> DataFrame:
    """Every edge in both directions (C5), a self loop once."""
    back = edges.where("src <> dst").withColumnsRenamed({"src": "__x"}).withColumnsRenamed({"dst": "src"}).withColumnsRenamed({"__x": "dst"})
    return edges.unionByName(back)


def unordered_first(edges: DataFrame, order: str, rel: str = "rel") -> DataFrame:
    """One edge per unordered pair and type (I3), the first by ``order``; the direction of that edge is kept."""
    w = W.partitionBy(F.least("src", "dst"), F.greatest("src", "dst"), rel).orderBy(order, "src", "dst")
    return edges.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def endpoints_stored(edges: DataFrame, sources: DataFrame, source_key: str, targets: DataFrame, target_key: str) -> tuple[DataFrame, DataFrame]:
    """Edges with both ends stored, and the dangling others (C9). An edge with a null end dangles."""
    keyed = edges.join(sources.select(F.col(source_key).alias("src"), F.lit(True).alias("__s")).distinct(), "src", "left").join(targets.select(F.col(target_key).alias("dst"), F.lit(True).alias("__t")).distinct(), "dst", "left")
    whole = F.col("__s").isNotNull() & F.col("__t").isNotNull()
    return keyed.where(whole).select(edges.columns), keyed.where(~whole).select(edges.columns)


def induced(edges: DataFrame, nodes: DataFrame, key: str = "id") -> DataFrame:
    """Edges between chosen nodes."""
    ids = nodes.select(F.col(key).alias("__k")).distinct()
    return edges.join(ids, F.col("src") == F.col("__k"), "left_semi").join(ids, F.col("dst") == F.col("__k"), "left_semi")


def containment(points: DataFrame, spans: DataFrame, by: str, width: int = 1000) -> DataFrame:
    """Each point with the first span (by start, then end) that holds it, start <= offset < end (C14). Points and spans meet in bins of
    ``width``, so the join is an equality join; a span takes as many bins as it is long. Points that no span holds are left out.
    Rows with a null offset, start or end match nothing; repeated points stay apart by their ``point_id``."""
    p = points.withColumn("__bin", F.floor(F.col("offset") / width))
    s = spans.where("start < end").withColumn("__bin", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))))
    hit = p.join(s, [by, "__bin"]).where("start <= offset AND offset < end")
    first = F.min(F.struct("start", "end", "span_id")).alias("hit")
    return hit.groupBy("point_id").agg(first).select("point_id", F.col("hit.span_id").alias("span_id"), F.col("hit.start").alias("start"))


def as_of(points: DataFrame, marks: DataFrame, by: list[str], at: str, value: str) -> DataFrame:
    """Each point with the value of the latest mark at or before it (C15), null before the first. One pass: points and marks are sorted
    together within their group, and the last mark is carried on. Marks at equal places: the greatest value wins. A null place is before
    all marks."""
    p = points.withColumns({"__mark": F.lit(False), "__value": F.lit(None).cast(marks.schema[value].dataType)})
    m = marks.groupBy(*by, at).agg(F.max(value).alias("__value")).withColumn("__mark", F.lit(True))
    w = W.partitionBy(*by).orderBy(F.col(at).asc_nulls_first(), F.col("__mark").desc()).rowsBetween(W.unboundedPreceding, 0)
    both = p.unionByName(m, allowMissingColumns=True).withColumn(value, F.last("__value", ignorenulls=True).over(w))
    return both.where("NOT __mark").drop("__mark", "__value")


def contains_word(text: Column, word: Column) -> Column:
    """Whether a text holds a word or phrase between characters that are no letters or digits, without case."""
    flat = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), F.lit(" "))
    return flat.contains(F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(word), "[^a-z0-9]+", " ")), F.lit(" ")))
