"""Provenance grading of answers, sentence by sentence (group P), and evaluation scores.

Answers are (answer_id, question, answer), evidence is (answer_id, tag, text, issuer). The rules are one chain of conditions per sentence;
the only state, whether an earlier sentence is stated, is a running maximum. An answer without sentences is refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.strings import citations, figures, normalise_number, sentences
from .series import restates

# Patterns of arithmetic, hedging, and claims from outside the filings.
ARITHMETIC = r"(?i)(?:[-−+*/×÷]\s*\d)|(?:=\s*\d)|(?:\d+\s*(?:/|÷)\s*\d)|\b(?:subtract|subtracted|minus|divided by|times|less|equals|computed|calculated|derived from|which is|giving|therefore|implies a)\b"
HEDGE = r"(?i)\b(?:may|might|could|would|likely|unlikely|suggests?|suggesting|implies?|appears?|seems?|potentially|arguably|plausibly|perhaps|possibly|tends? to|is likely|is expected|points? to|suggests that)\b"
EXTERNAL = r"(?i)\b(?:news(?:wire)?|this week|today|yesterday|press (?:release|reports?)|analyst|consensus estimate|market share|third[- ]party|according to (?:reports|news|analysts)|currently|as of today)\b"


def _decimals(figure: Column) -> Column:
    return F.length(F.regexp_extract(F.regexp_replace(figure, "[%,)]", ""), r"\.(\d*)$", 1))


def graded_sentences(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """answer_id, sentence_no, sentence, cites, figures, unknown, ungrounded, misattributed, provenance."""
    s = answers.select("answer_id", "question", F.posexplode(sentences(F.col("answer"))).alias("sentence_no", "sentence"))
    s = s.withColumns({"all_cites": citations(F.col("sentence")), "figures": figures(F.col("sentence"))})
    own = evidence.groupBy("answer_id").agg(
        F.map_from_entries(F.collect_list(F.struct("tag", F.struct("text", "issuer").alias("e")))).alias("block"), F.collect_set("issuer").alias("issuers")
    )
    s = s.join(own, "answer_id", "left").withColumns({"block": F.coalesce("block", F.create_map().cast("map<string,struct<text:string,issuer:string>>")), "issuers": F.coalesce("issuers", F.array().cast("array<string>"))})
    s = s.withColumn("cites", F.filter("all_cites", lambda c: F.map_contains_key("block", c))).withColumn("unknown", F.array_except("all_cites", "cites"))
    cited = F.transform("cites", lambda c: F.try_element_at("block", c))
    s = s.withColumn("grounds", F.flatten(F.transform(cited, lambda e: F.transform(figures(e["text"]), normalise_number))))
    s = s.withColumn("ungrounded", F.filter("figures", lambda f: normalise_number(f).isNotNull() & ~F.array_contains("grounds", normalise_number(f)) & ~restates(normalise_number(f), _decimals(f), F.col("grounds"))))
    word = lambda text, i: F.concat(F.lit(" "), F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), F.lit(" ")).contains(F.concat(F.lit(" "), F.lower(i), F.lit(" ")))
    named = F.filter("issuers", lambda i: word(F.col("sentence"), i))
    asked = F.filter("issuers", lambda i: word(F.col("question"), i))
    cited_issuers = F.array_distinct(F.filter(F.transform(cited, lambda e: e["issuer"]), lambda i: F.coalesce(i, F.lit("")) != ""))
    wrong = F.when(F.size(cited_issuers) == 0, F.array().cast("array<string>")).when(F.size(named) > 0, F.array_except(named, cited_issuers)).when(F.size("figures") > 0, F.array_except(asked, cited_issuers)).otherwise(F.array().cast("array<string>"))
    s = s.withColumn("misattributed", F.array_sort(wrong))
    arithmetic, cites, loose = F.col("sentence").rlike(ARITHMETIC), F.size("cites") > 0, F.size("ungrounded") > 0
    first = (
        F.when((F.size("unknown") > 0) | (F.size("misattributed") > 0), "GAP")
        .when(F.col("sentence").rlike(EXTERNAL), "EXTERNAL")
        .when(loose & ~(arithmetic & cites), "GAP")
        .when(arithmetic & cites, "DERIVED")
        .when(cites, "STATED")
        .when(F.col("sentence").rlike(HEDGE), "HEDGED")
        .otherwise("GAP")
    )
    s = s.withColumn("first", first)
    stated = F.coalesce(F.max(F.col("first") == "STATED").over(W.partitionBy("answer_id").orderBy("sentence_no").rowsBetween(W.unboundedPreceding, -1)), F.lit(False))
    final = F.when(F.col("first") != "HEDGED", F.col("first")).when(stated, "INFERRED").otherwise("GAP")
    return s.withColumn("provenance", final).select("answer_id", "sentence_no", "sentence", "cites", "figures", "unknown", "ungrounded", "misattributed", "provenance")


def verdicts(answers: DataFrame, graded: DataFrame) -> DataFrame:
    """answer_id, verdict, and a count of each provenance (P8, D26, V25): refused if any sentence is a gap or cites fiction, qualified if
    any is inferred or external, else supported; refused without sentences."""
    n = lambda p: F.count_if(F.col("provenance") == p).alias(f"n_{p.lower()}")
    mix = graded.groupBy("answer_id").agg(F.count("*").alias("n"), *map(n, ("STATED", "DERIVED", "INFERRED", "EXTERNAL", "GAP")), F.sum(F.size("unknown")).alias("n_unknown"))
    all_ = answers.select("answer_id").join(mix, "answer_id", "left").na.fill(0)
    refused = (F.col("n") == 0) | (F.col("n_gap") > 0) | (F.col("n_unknown") > 0)
    return all_.withColumn("verdict", F.when(refused, "REFUSED").when(F.col("n_inferred") + F.col("n_external") > 0, "QUALIFIED").otherwise("SUPPORTED"))


def match_rate(graded: DataFrame, expected: DataFrame) -> DataFrame:
    """How many answers show one of their acceptable tag sets (P10, P11): expected is (answer_id, acceptable array<array<string>>)."""
    shown = graded.groupBy("answer_id").agg(F.array_sort(F.collect_set("provenance")).alias("shown"))
    both = expected.join(shown, "answer_id", "left").withColumn("ok", F.exists("acceptable", lambda a: F.array_sort(F.array_distinct(a)) == F.coalesce("shown", F.array().cast("array<string>"))))
    return both.agg(F.count("*").alias("n"), F.count_if("ok").alias("n_match"), F.round(F.coalesce(100.0 * F.avg(F.col("ok").cast("int")), F.lit(0.0)), 4).alias("rate"))
