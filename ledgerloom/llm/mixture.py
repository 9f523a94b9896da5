"""Problem 8: mixing sources to target weights, as a time-varying curriculum.

A source's weight schedule is w(t) = share * (1 + slope * (2 t - 1)) over training time t from 0 to 1; its integral is the source's
cumulative demand, and inverting it in closed form assigns a training position to each use of a document. Slopes are chosen so that the
weights of all sources sum to 1 at any time, and so that sources which may be repeated more often come later.

A source's demand is its share of the total size of the listed sources' documents; the source is passed through as often as the demand
asks, at most ``max_repeats`` times, in the order of a hash of the id. A use is taken if its middle lies within the demand, so a source
misses its demand by at most half a document, unless the cap ends it earlier.

Sizes are tokens, counted where the texts are read; only ids and sizes move. Running sums are taken in two steps, over hash buckets
first and within a bucket then, so no source is ever gathered in one task.

Defined results: documents with a source that is null or not listed, or that is listed with no share, have use count 0; null and empty
texts have 0 tokens; listed sources without documents reach share 0; a source listed twice counts with its first row by share; rows
with equal ids are told apart by nothing and are used alike.
"""

from __future__ import annotations

import base64
import sys
import types

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import LongType

from ..session import written

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How much the schedules tilt at most.
TILT = 0.5
BUCKETS = 4096
# Fixed value: the pattern that splits text before byte-pair encoding, as published with this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def token_counter(path: str):
    """A function from texts to token counts; the vocabulary is read once a Python worker."""
    kept = sys.modules.setdefault("_ledgerloom_tokenizers", types.ModuleType("_ledgerloom_tokenizers")).__dict__
    if path not in kept:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        kept[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    encode = kept[path].encode_ordinary
    return lambda texts: [len(encode(t)) if t else 0 for t in texts]


def tokens_of(text: Column, path: str = TOKENIZER) -> Column:
    def count(values: pa.Array) -> pa.Array:
        return pa.array(token_counter(path)(values.to_pylist()), pa.int64())

    return F.arrow_udf(count, LongType())(text)


def sized(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """doc_id, source, n_tokens; the texts stay behind."""
    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", tokens_of(F.col("text"), path).alias("n_tokens"))


def _targets(targets: DataFrame) -> DataFrame:
    """source, share, cap, slope of each listed source."""
    once = targets.where("source IS NOT NULL").groupBy("source").agg(F.max_by("target_share", "target_share").alias("share"), F.max_by("max_repeats", "target_share").alias("cap"))
    own = once.select("source", F.coalesce("share", F.lit(0.0)).alias("share"), F.greatest(F.coalesce("cap", F.lit(1)), F.lit(0)).alias("cap"))
    mean, most = own.agg(F.sum(F.col("share") * F.col("cap")) / F.sum("share"), F.max("cap")).first()  # one row of the plan
    tilt = (F.col("cap") - F.lit(mean or 0.0)) / F.lit(max(most or 1, 1))
    return own.select("source", "share", "cap", (F.lit(TILT) * tilt).alias("slope"))


def mixed(documents: DataFrame, targets: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """doc_id, source, n_tokens, use_count, first_position: a row per document; the position of its first use is in training time from
    0 to 1, null for unused documents."""
    own = written(sized(documents, path), "sized")
    listed = F.broadcast(_targets(targets))  # a row per source of the mixing plan
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS))
    placed = own.join(listed, "source").withColumn("bucket", bucket)
    # At most sources x BUCKETS rows.
    sums = placed.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("n"))
    sums = sums.withColumn("before", F.sum("n").over(W.partitionBy("source").orderBy("bucket")) - F.col("n")).withColumn("supply", F.sum("n").over(W.partitionBy("source")))
    total = own.join(listed, "source", "left_semi").agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    sums = sums.drop("n")
    within = W.partitionBy("source", "bucket").orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id")
    at = placed.withColumn("own", F.sum("n_tokens").over(within.rowsBetween(W.unboundedPreceding, 0)) - F.col("n_tokens")).join(sums, ["source", "bucket"])
    middle = F.col("before") + F.col("own") + F.col("n_tokens") / 2
    demand = F.col("share") * F.lit(float(total))
    uses = F.least(F.col("cap"), F.greatest(F.lit(0), F.ceil((demand - middle) / F.greatest("supply", F.lit(1)))))
    used = at.withColumn("middle", middle).withColumn("demand", F.least(demand, F.col("cap") * F.col("supply"))).withColumn("use_count", F.when(demand > 0, uses).otherwise(0).cast("int"))
    out = used.select("doc_id", "source", "n_tokens", "use_count", F.when(F.col("use_count") > 0, position(F.col("middle") / F.col("demand"), F.col("slope"))).alias("first_position"))
    rest = own.join(listed.select("source"), "source", "left_anti").select("doc_id", "source", "n_tokens", F.lit(0).alias("use_count"), F.lit(None).cast("double").alias("first_position"))
    return out.unionByName(rest)


def position(part: Column, slope: Column) -> Column:
    """The time t at which a source has met a part of its demand: the root of t + slope (t^2 - t) = part."""
    part = F.least(F.greatest(part, F.lit(0.0)), F.lit(1.0))
    b = 1 - slope
    return F.when(F.abs(slope) < 1e-9, part).otherwise(2 * part / (b + F.sqrt(b * b + 4 * slope * part)))


def shares(documents: DataFrame, targets: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """A row per listed source: its target, documents, tokens, uses, tokens used, and the share it reached of the target size and of
    the size reached by all."""
    mix = mixed(documents, targets, path).groupBy("source").agg(
        F.count("*").alias("n_documents"), F.sum("n_tokens").alias("n_tokens"), F.sum("use_count").alias("n_uses"), F.sum(F.col("use_count") * F.col("n_tokens")).alias("tokens_used"), F.max("use_count").alias("most_uses")
    )
    got = _targets(targets).join(mix, "source", "left").na.fill(0, ["n_documents", "n_tokens", "n_uses", "tokens_used", "most_uses"])
    size, reached = (F.sum(c).over(W.partitionBy(F.lit(1))) for c in ("n_tokens", "tokens_used"))  # a row per source of the plan
    rate = lambda a, b: F.coalesce(F.try_divide(F.col(a), b), F.lit(0.0))
    return got.select("source", F.col("share").alias("target_share"), F.col("cap").alias("max_repeats"), "n_documents", "n_tokens", "n_uses", "most_uses", "tokens_used", rate("tokens_used", size).alias("share_of_target"), rate("tokens_used", reached).alias("share_reached"))


def training_order(documents: DataFrame, targets: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """doc_id, source, use_no, position: a row per use, in range-sorted order of position."""
    mix = mixed(documents, targets, path).where("use_count > 0")
    per = mix.groupBy("source").agg(F.sum("n_tokens").alias("supply"), F.sum(F.col("n_tokens") * F.col("use_count")).alias("used"))
    plan = F.broadcast(per.join(_targets(targets), "source"))
    each = mix.join(plan, "source").withColumn("use_no", F.explode(F.sequence(F.lit(1), F.col("use_count"))))
    # A later use lies one pass through the source further on.
    part = F.col("first_position") + F.col("slope") * (F.col("first_position") * F.col("first_position") - F.col("first_position"))
    later = part + (F.col("use_no") - 1) * F.try_divide(F.col("supply"), F.col("used"))
    placed = each.select("doc_id", "source", "use_no", position(later, F.col("slope")).alias("position"))
    return placed.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id", "use_no")
