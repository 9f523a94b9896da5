"""Queries pN_... of the operators in this folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import abuse, boilerplate, forms, history, leakage, match, mixture, split


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return split.split_texts(table(spark, sf, "chunk"), with_text=False, oversized_only=True).where("piece_no = 1").select("chunk_id")


def p1_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return split.split_texts(table(spark, sf, "chunk"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    chunks = table(spark, sf, "chunk").select(F.lit("chunk").alias("record_kind"), F.col("id").alias("record_id"), F.col("text").alias("value"))
    names = table(spark, sf, "extracted_entity").select(F.lit("extracted_entity").alias("record_kind"), F.col("mention_id").cast("string").alias("record_id"), F.col("name").alias("value"))
    marked = [df.withColumn("flag", forms.disguised(F.col("value"))) for df in (chunks, names)]
    return marked[0].unionByName(marked[1]).where("flag").select("record_kind", "record_id")


def p2_names(spark: SparkSession, sf: str) -> DataFrame:
    return forms.with_forms(table(spark, sf, "extracted_entity").select("mention_id", "name"), "name")


def p2_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return forms.with_forms(table(spark, sf, "chunk").select("id", "text"), "text").select("id", "form", "disguised")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return history.found(table(spark, sf, "filing"))


def p3_accepted(spark: SparkSession, sf: str) -> DataFrame:
    return history.dedup(table(spark, sf, "filing"))[0]


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return match.found(table(spark, sf, "extracted_entity"), table(spark, sf, "canonical_entity"))


def p5_matches(spark: SparkSession, sf: str) -> DataFrame:
    return match.match_names(table(spark, sf, "extracted_entity"), table(spark, sf, "canonical_entity"))


def p5_unmatched(spark: SparkSession, sf: str) -> DataFrame:
    return match.unmatched_names(table(spark, sf, "extracted_entity"), table(spark, sf, "canonical_entity"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return boilerplate.found(table(spark, sf, "parsed_document"))


def p6_documents(spark: SparkSession, sf: str) -> DataFrame:
    return boilerplate.without_repeated(table(spark, sf, "parsed_document"))


def p6_lines(spark: SparkSession, sf: str) -> DataFrame:
    return boilerplate.lines_removed(table(spark, sf, "parsed_document"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.found(table(spark, sf, "documents"), table(spark, sf, "eval_question"))


def p7_leaks(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.leaks(table(spark, sf, "documents"), table(spark, sf, "eval_question"))


def p8_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mixture.mixed(table(spark, sf, "documents"), table(spark, sf, "mix_target"))


def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mixture.shares(table(spark, sf, "documents"), table(spark, sf, "mix_target"))


def p8_order(spark: SparkSession, sf: str) -> DataFrame:
    return mixture.training_order(table(spark, sf, "documents"), table(spark, sf, "mix_target"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return abuse.found(table(spark, sf, "documents"), table(spark, sf, "content_label"))


def p9_scores(spark: SparkSession, sf: str) -> DataFrame:
    return abuse.score(table(spark, sf, "documents"), table(spark, sf, "content_label"))


def p9_rates(spark: SparkSession, sf: str) -> DataFrame:
    return abuse.rates(p9_scores(spark, sf))


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_pieces, p2_found, p2_names, p2_chunks, p3_found, p3_accepted, p5_found, p5_matches, p5_unmatched, p6_found, p6_documents,
        p6_lines, p7_found, p7_leaks, p8_mix, p8_shares, p8_order, p9_found, p9_scores, p9_rates,
    )
}
