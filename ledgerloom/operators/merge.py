"""Merging and loading: idempotent loads, upserts, and the rules by which several observations of one thing become one.

Every "first" or "last" goes by an explicit order column; ties go to the smaller remaining columns named, so shuffled input gives the
same rows. A null key is a key of its own in deduplication and matches nothing in an anti join unless said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def first_wins(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """One row per key, the first by order."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def idempotent_nodes(batch: DataFrame, stored: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows to add: first occurrences of keys that are not stored yet (C10). Rows without a key are not added."""
    return first_wins(batch.where(F.col(key).isNotNull()), [key], order).join(stored.select(key).distinct(), key, "left_anti")


def same_text(*columns: str) -> list[Column]:
    """Columns as text, null like the empty text."""
    return [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]


def new_arcs(batch: DataFrame, stored: DataFrame, columns: list[str]) -> DataFrame:
    """Edges to add: distinct edges of the batch that are not stored, all properties compared, null like the empty text (C11)."""
    sign = F.sha2(F.to_json(F.array(*same_text(*columns))), 256)
    own = batch.withColumn("__sign", sign).dropDuplicates(["__sign"])
    return own.join(stored.select(sign.alias("__sign")), "__sign", "left_anti").drop("__sign")


def richer_nodes(rows: DataFrame, key: str, columns: list[str], order: str) -> DataFrame:
    """One row per key, in each column the longest text, the first on ties."""
    best = [F.max_by(F.col(c), F.struct(F.length(F.coalesce(F.col(c), F.lit(""))).alias("l"), (-F.col(order)).alias("o"))).alias(c) for c in columns]
    return rows.groupBy(key).agg(*best)


def disambiguated(rows: DataFrame, name: str, hint: str) -> DataFrame:
    """Names that several rows share get their hint behind them."""
    n = F.count("*").over(W.partitionBy(name))
    return rows.withColumn(name, F.when((n > 1) & (F.coalesce(F.col(hint), F.lit("")) != ""), F.concat_ws(" · ", name, hint)).otherwise(F.col(name)))


def best_confidence(rows: DataFrame, keys: list[str], confidence: str, order: str) -> DataFrame:
    """One row per key, of the highest confidence, the first on ties; rows without one come last."""
    return first_wins(rows, keys, [F.col(confidence).desc_nulls_last(), F.col(order)])


def observations(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Observations of an entity merged in order (D13, A19): of name and type the longer text wins, of descriptions the one more than half
    as long again that does not lie within the incoming one's predecessor. Missing values never replace present ones."""
    seen = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), *(F.trim(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in ("name", "entity_type", "description")))))

    def step(acc: Column, x: Column) -> Column:
        longer = lambda c: F.when(F.length(x[c]) > F.length(acc[c]), x[c]).otherwise(acc[c]).alias(c)
        richer = (F.length(acc["description"]) == 0) | ((F.length(x["description"]) > F.length(acc["description"]) * 1.5) & ~acc["description"].contains(x["description"]))
        return F.struct(longer("name"), longer("entity_type"), F.when(richer, x["description"]).otherwise(acc["description"]).alias("description"))

    start = F.struct(F.lit("").alias("name"), F.lit("").alias("entity_type"), F.lit("").alias("description"))
    return rows.groupBy(key).agg(F.aggregate(seen, start, step).alias("m")).select(key, "m.*")


def undominated(rows: DataFrame, text: str, length: str, position: str, within: list[str]) -> DataFrame:
    """Of rows with equal text but for case, the shortest, the first on ties."""
    return first_wins(rows.withColumn("__t", F.lower(F.col(text))), [*within, "__t"], [length, position]).drop("__t")


def resolved_conflicts(rows: DataFrame, keys: list[str], value: str, rank: str, order: str) -> DataFrame:
    """One value per key, of the lowest rank, the first on ties, and how many other values there were."""
    return rows.groupBy(*keys).agg(F.min_by(value, F.struct(rank, order)).alias(value), (F.count_distinct(value) - 1).alias("n_conflicts"))


def collapsed_digraph(edges: DataFrame, order: str) -> DataFrame:
    """At most one edge per ordered pair, the last written."""
    return first_wins(edges, ["src", "dst"], [F.col(order).desc()])
