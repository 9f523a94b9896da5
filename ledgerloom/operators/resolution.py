"""Entity resolution (group N): exact names and aliases, blocking by shared words, and the best match above a threshold.

Partitions (kind, scope) never merge with each other. The batch rules are free of order but for the display name, which is the first
seen. Null and empty names resolve to nothing.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions.strings import content_tokens, decomposed, folded, hyphen_slug, jaccard, polarity_conflict


def index_key(name: Column) -> Column:
    """The folded name in any script, percentages apart from amounts."""
    return F.concat(folded(decomposed(name)), F.when(F.trim(name).endswith("(%)"), F.lit(" percent")).otherwise(F.lit("")))


def register(names: DataFrame, within: list[str], name: str, order: str) -> DataFrame:
    """A row per entity (N1, N3): within columns, entity_id, display name (the first seen), number of spellings and of mentions."""
    keyed = names.withColumn("key", index_key(F.col(name))).where("key <> ''")
    out = keyed.groupBy(*within, "key").agg(F.min_by(name, order).alias("display"), F.count_distinct(name).alias("n_spellings"), F.count("*").alias("n_mentions"))
    return out.select(*within, hyphen_slug(F.col("key")).alias("entity_id"), "display", "n_spellings", "n_mentions")


def _ratios(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a.to_pylist(), b.to_pylist())], pa.float64())


def candidates(names: DataFrame, known: DataFrame, least: float = 0.0) -> DataFrame:
    """Pairs (id, known_id) that share a word and can have a Jaccard similarity of at least ``least`` (C26, N4): all of them, whatever
    the words' frequency. The words of both sides are ranked from the rarest on; two sets that are similar enough share one of their
    first n - ceil(least n) + 1 words, so frequent words are joined on only where a name has hardly others."""
    post = known.select("known_id", F.explode(content_tokens(F.col("known_name"))).alias("word"))
    width = post.groupBy("word").agg(F.count("*").alias("width"))

    def prefix(words: DataFrame, key: str) -> DataFrame:
        ranked = words.join(width, "word", "left").select(key, "word", F.row_number().over(W.partitionBy(key).orderBy(F.coalesce("width", F.lit(0)), "word")).alias("rank"), F.count("*").over(W.partitionBy(key)).alias("n"))
        return ranked.where(F.col("rank") <= F.col("n") - F.greatest(F.ceil(F.lit(least) * F.col("n") - 1e-9), F.lit(1)) + 1).select(key, "word", F.col("n").alias(f"n_{key}"))

    asked = prefix(names.select("id", F.explode(content_tokens(F.col("name"))).alias("word")), "id")
    near = asked.join(prefix(post, "known_id"), "word").where((F.col("n_id") >= least * F.col("n_known_id") - 1e-9) & (F.col("n_known_id") >= least * F.col("n_id") - 1e-9))
    return near.select("id", "known_id").distinct()


def best_fuzzy(names: DataFrame, known: DataFrame, threshold: float = 0.88) -> DataFrame:
    """id, known_id, score, runner_up: the best known name from the threshold on (N5, J17, E12): nine tenths common words, one tenth the
    ratio of matching runs; names of opposite sense never match; ties go to the smaller id."""
    # The ratio of runs adds at most a tenth, so this much has to come of common words.
    pairs = candidates(names, known, max((threshold - 0.1) / 0.9, 0.0)).join(names.select("id", "name"), "id").join(known.select("known_id", "known_name"), "known_id")
    words = jaccard(content_tokens(F.col("name")), content_tokens(F.col("known_name")))
    # The ratio adds at most a tenth, so pairs that cannot reach the threshold never leave the JVM.
    close = pairs.withColumn("w", words).where((F.col("w") * 0.9 + 0.1 >= threshold) & ~polarity_conflict(F.col("name"), F.col("known_name")))
    scored = close.withColumn("score", F.col("w") * 0.9 + F.arrow_udf(_ratios, T.DoubleType())("name", "known_name") * 0.1).where(F.col("score") >= threshold)
    o = W.partitionBy("id").orderBy(F.col("score").desc(), "known_id")
    return scored.withColumns({"n": F.row_number().over(o), "runner_up": F.lead("score").over(o)}).where("n = 1").select("id", "known_id", "score", "runner_up")


def resolved_edges(edges: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges with their ends replaced by what they resolve to (N8, I10, I11): kept ones once each, and per reason how many were dropped."""
    m = mapping.select("id", "entity_id")
    both = edges.join(m.withColumnsRenamed({"id": "src", "entity_id": "a"}), "src", "left").join(m.withColumnsRenamed({"id": "dst", "entity_id": "b"}), "dst", "left")
    why = F.when(F.col("a").isNull() | F.col("b").isNull(), "orphan").when(F.col("a") == F.col("b"), "self loop")
    marked = both.withColumn("why", why)
    return marked.where("why IS NULL").select(F.col("a").alias("src"), F.col("b").alias("dst"), "rel").distinct(), marked.where("why IS NOT NULL").groupBy("why").agg(F.count("*").alias("n"))
