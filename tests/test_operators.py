import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import fiscal, strings
from ledgerloom.operators import documents, grading, merge, pattern, ranking, resolution, series, traversal


def one(spark, column, schema="x string", row=("",)):
    return spark.createDataFrame([row], schema).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("name, slug", [("Riftia pachyptila", "riftiapachyptila"), ("RIFTIA PACHYPTILA!", "riftiapachyptila"), ("Riftia_pachyptila", "riftiapachyptila"), ("Café Müller", "cafemuller"), ("Bell's telescope", "bellstelescope"), ("Mercury (planet)", "mercury"), ("Dr Ada Lovelace", "adalovelace"), ("Queen Elizabeth", "queenelizabeth"), ("", ""), ("...", ""), ("—", "")])
def test_slugs(spark, name, slug):
    assert one(spark, strings.squash_slug(F.col("x")), row=(name,)) == slug


def test_usable_names(spark):
    for bad in ("unknown", "N/A", "none", "TBD", "the", "", "x", None):
        assert one(spark, strings.usable_name(F.col("x")), row=(bad,)) is False, bad
    assert one(spark, strings.usable_name(F.col("x")), row=("Riftia",)) is True


def test_tokens(spark):
    assert one(spark, strings.tokens(F.col("x")), row=("Hello, world.",)) == ["Hello", ",", "world", "."]
    assert one(spark, strings.tokens(F.col("x")), row=("a-b c'd",)) == ["a-b", "c'd"]


@pytest.mark.parametrize("cell, value", [("(1,234)", (-1234.0, False)), ("1,234", (1234.0, False)), ("$ 5.5", (5.5, False)), ("14.9%", (14.9, True)), ("—", None), ("", None), ("12abc", None), ("7 (a)", (7.0, False)), (None, None)])
def test_number_cells(spark, cell, value):
    got = one(spark, strings.parse_number(F.col("x")), row=(cell,))
    assert (got and tuple(got)) == value


def test_polarity_and_concepts(spark):
    df = spark.createDataFrame([("Common stock, beginning balances", "Common stock, ending balances"), ("Net sales", "Net sales")], "a string, b string")
    assert [r[0] for r in df.select(strings.polarity_conflict(F.col("a"), F.col("b"))).collect()] == [True, False]
    c = lambda x: one(spark, strings.canonical_concept(F.col("x")), row=(x,))
    assert c("Net sales (in millions)") == "Net sales" and c("China (1)") == "China" and c("iPhone®.") == "iPhone" and c("Earnings per share (diluted)") == "Earnings per share (diluted)"


def test_figures_and_citations(spark):
    text = "Sales were $416,161 million in 2025 [E1, E3], filed 2025-10-31 and up 31.97% [E2->E15]."
    assert one(spark, strings.figures(F.col("x")), row=(text,)) == ["416,161", "31.97%"]
    assert one(spark, strings.citations(F.col("x")), row=(text,)) == ["E1", "E3", "E2", "E15"]
    assert one(spark, strings.sentences(F.col("x")), row=("It was 1.5 up. J. Doe left. [E1] holds!",)) == ["It was 1.5 up.", "J. Doe left.", "[E1] holds!"]


def test_name_variants(spark):
    assert one(spark, strings.name_variants(F.col("x")), row=("transformer architectures",)) == ["transformer architectures", "transformer architecture"]


def test_fiscal_rules(spark):
    d = "d date, s date"
    from datetime import date

    assert one(spark, fiscal.fiscal_year(F.col("d"), F.lit(9), F.lit(27)), d, (date(2025, 9, 28), None)) == 2026
    assert one(spark, fiscal.fiscal_year_start(F.col("d"), F.lit(9), F.lit(27)), d, (date(2025, 9, 28), None)) == date(2025, 9, 28)
    assert tuple(one(spark, fiscal.period_span(F.lit("3M"), F.col("d")), d, (date(2025, 12, 27), None))) == (date(2025, 9, 28), 91)
    assert one(spark, fiscal.cumulative(F.lit("3M"), F.col("s"), F.col("d")), d, (date(2025, 9, 28), date(2025, 10, 2))) is True
    assert one(spark, fiscal.duration_code(F.col("x")), row=("Three Months Ended",)) == "3M" and one(spark, fiscal.duration_code(F.col("x")), row=("Years ended",)) == "FY"
    assert one(spark, fiscal.period_key(F.col("x")), row=("ended December 27, 2025",)) == "2025-12-27" and one(spark, fiscal.period_key(F.col("x")), row=("Year 2025",)) == "FY2025"
    assert one(spark, fiscal.calendar_year_overlap(F.col("s"), F.col("d")), d, (date(2026, 1, 20), date(2025, 10, 1))) == 2025
    assert tuple(one(spark, fiscal.concept_period(F.col("x")), row=("Net Sales (3M-2026-03-28)",))) == ("Net Sales", "3M", "2026-03-28")
    assert one(spark, fiscal.coerced(F.col("x"), "date"), row=("01/02/2024",)) == date(1, 1, 1) and one(spark, fiscal.coerced(F.col("x"), "bigint"), row=("High",)) == -1


def edges(spark, *pairs):
    return spark.createDataFrame([(a, b, "r", i) for i, (a, b) in enumerate(pairs)], "src string, dst string, rel string, seq int")


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def test_neighbourhoods(spark):
    e = edges(spark, ("alpha", "beta"), ("beta", "gamma"), ("gamma", "delta"), ("alpha", "alpha"))
    hop = lambda f, s, n: {r["id"]: r["depth"] for r in f(e, ids(spark, s), n).collect()}
    assert hop(traversal.k_hop, "alpha", 1) == {"alpha": 0, "beta": 1} and hop(traversal.k_hop, "beta", 1) == {"beta": 0, "alpha": 1, "gamma": 1}
    assert hop(traversal.k_hop, "alpha", 2) == {"alpha": 0, "beta": 1, "gamma": 2}
    assert hop(traversal.ring_neighbourhood, "alpha", 2) == {"alpha": 0, "beta": 1, "gamma": 2, "delta": 2}
    assert traversal.eccentricity(e, ids(spark, "alpha")) == 3 and hop(traversal.k_hop, "nobody", 2) == {"nobody": 0}


def test_paths_and_trim(spark):
    e = edges(spark, ("s", "a"), ("a", "t"), ("s", "t"), ("a", "b"), ("b", "a"), ("b", "t"), ("t", "s"))
    p = {tuple(r["path"]) for r in traversal.simple_paths(e, spark.createDataFrame([("s", "t")], "s string, t string")).collect()}
    assert p == {("s", "t"), ("s", "a", "t"), ("s", "a", "b", "t")}
    two = {(r["b"], r["c"]) for r in traversal.two_hop_paths(e, ids(spark, "s")).collect()}
    assert two == {("a", None), ("t", None), ("a", "t"), ("a", "b")}
    hub = edges(spark, *[("hub", f"n{i:02d}") for i in range(60)])
    n, x = traversal.trimmed(traversal.k_hop(hub, ids(spark, "hub"), 1), hub, 10, 20)
    kept = {r["id"] for r in n.collect()}
    assert len(kept) == 10 and "hub" in kept and all(r["dst"] in kept for r in x.collect())


def test_components(spark):
    e = edges(spark, *[(f"a{i}", f"a{i + 1}") for i in range(20)], ("x", "y"))
    got = {r["id"]: r["component"] for r in traversal.components(e, ids(spark, "a20", "y", "lonely")).collect()}
    assert got == {"a20": "a0", "y": "x", "lonely": "lonely"}


def test_edges_and_loads(spark):
    e = edges(spark, ("Alpha", "Missing"), ("Alpha", "Beta"), (None, "Beta"))
    kept, dangling = pattern.endpoints_stored(e, ids(spark, "Alpha"), "id", ids(spark, "Beta"), "id")
    assert kept.count() == 1 and dangling.count() == 2
    batch = spark.createDataFrame([("k1", 1), ("k1", 2), ("k2", 3), (None, 4)], "id string, seq int")
    assert {tuple(r) for r in merge.idempotent_nodes(batch, ids(spark, "k2"), "id", ["seq"]).collect()} == {("k1", 1)}
    a = spark.createDataFrame([("x", None), ("x", ""), ("y", "p")], "src string, prop string")
    assert merge.new_arcs(a, spark.createDataFrame([("y", "p")], "src string, prop string"), ["src", "prop"]).count() == 1
    seen = spark.createDataFrame([(1, "k", "Al", "T", ""), (2, "k", "Alpha", "", "a much richer description"), (3, "k", "", "", "short")], "seq int, id string, name string, entity_type string, description string")
    assert tuple(merge.observations(seen, "id", "seq").first()) == ("k", "Alpha", "T", "a much richer description")


def test_span_and_as_of(spark):
    p = spark.createDataFrame([(i, "d", o) for i, o in enumerate([0, 9, 10, 25, 99, None])], "point_id int, doc string, offset int")
    s = spark.createDataFrame([("a", "d", 0, 10), ("b", "d", 10, 30), ("c", "d", 20, 30)], "span_id string, doc string, start int, end int")
    assert {(r[0], r[1]) for r in pattern.containment(p, s, "doc", 7).collect()} == {(0, "a"), (1, "a"), (2, "b"), (3, "b")}
    marks = spark.createDataFrame([("d", 5, "first"), ("d", 20, "second")], "doc string, offset int, section string")
    got = {r["point_id"]: r["section"] for r in pattern.as_of(p, marks, ["doc"], "offset", "section").collect()}
    assert got == {0: None, 1: "first", 2: "first", 3: "second", 4: "second", 5: None}


def test_ranks(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([("hot" if rng.random() < 0.8 else "k", rng.randrange(50), i) for i in range(500)], "k string, v int, i int")
    got = {(r["k"], r["i"], r["rank"]) for r in ranking.top_k(df, ["k"], [F.col("v").desc(), F.col("i")], 3).collect()}
    want = {(k, i, n + 1) for k in ("hot", "k") for n, (_, i) in enumerate(sorted((-r["v"], r["i"]) for r in df.collect() if r["k"] == k)[:3])}
    assert got == want
    p = ranking.nearest_rank(spark.createDataFrame([("a", float(i)) for i in range(1, 51)] + [("b", 7.0), ("b", None)], "k string, v double"), ["k"], "v", [50, 99])
    assert {(r["k"], r["p50"], r["p99"]) for r in p.collect()} == {("a", 26.0, 50.0), ("b", 7.0, 7.0)}


def test_documents(spark):
    df = spark.createDataFrame([(1, "w " * 2000), (2, ""), (3, None)], "id int, text string")
    rows = documents.token_windows(df, "id", "text").orderBy("window_no").collect()
    assert all(r["token_end"] - r["token_start"] == 800 for r in rows[:-1]) and rows[-1]["token_end"] == 2000 and rows[1]["token_start"] == 700
    html = "<html><script>x</script><p>Hi&nbsp;there</p><table><tr><td>a<td>b<table><tr><td>in</td></tr></table></td></tr><tr><th>c</th></tr></table><div style='display:none'>no</div>"
    h = spark.createDataFrame([(1, html), (2, None), (3, "")], "id int, html string")
    assert {tuple(r)[1:] for r in documents.html_cells(h, "id", "html").collect()} == {(1, 1, 1, "a"), (1, 1, 2, "b"), (2, 1, 1, "in"), (1, 2, 1, "c")}
    assert h.select(documents.html_text(F.col("html")).alias("t")).first()["t"].startswith("Hi there")
    x = spark.createDataFrame([(1, '<ix:nonFraction name="t" contextRef="c" scale="6" sign="-" unitRef="usd">1,234</ix:nonFraction> <ix:nonFraction name="u" contextRef="c">—</ix:nonFraction>')], "id int, html string")
    assert {(r["tag"], r["value"]) for r in documents.xbrl_facts(x, "id", "html").collect()} == {("t", -1234e6), ("u", None)}
    body = "Contents\nItem 1. Business\nItem 1A. Risk\n" + "x" * 200 + "\nItem 1. Business\n" + "text " * 60 + "\nItem 1A. Risk Factors\n" + "risk " * 60
    got = [(r["item_code"], r["title"]) for r in documents.item_sections(spark.createDataFrame([(1, body)], "id int, text string"), "id", "text").orderBy("start").collect()]
    assert got[-2:] == [("1", "Business"), ("1A", "Risk Factors")]
    assert documents.char_chunks(df, "id", "text").where("id <> 1").count() == 0


def test_grading(spark):
    answers = spark.createDataFrame([(1, "About Apple?", "Net sales were 416,161 [E1]. This may suggest growth."), (2, "", "Net sales were 999 [E1]."), (3, "", "It rose [E9]."), (4, "", ""), (5, "Apple", "Microsoft sold 416,161 [E1]."), (6, "", "Sales were $416.2 billion [E1]."), (7, "", "This may suggest growth.")], "answer_id int, question string, answer string")
    evidence = spark.createDataFrame([(i, "E1", "Net sales 416161", "Apple") for i in range(1, 8)] + [(5, "E2", "other", "Microsoft")], "answer_id int, tag string, text string, issuer string")
    g = grading.graded_sentences(answers, evidence)
    got = {(r["answer_id"], r["sentence_no"]): r["provenance"] for r in g.collect()}
    assert got == {(1, 0): "STATED", (1, 1): "INFERRED", (2, 0): "GAP", (3, 0): "GAP", (5, 0): "GAP", (6, 0): "STATED", (7, 0): "GAP"}
    v = {r["answer_id"]: r["verdict"] for r in grading.verdicts(answers, g).collect()}
    assert v == {1: "QUALIFIED", 2: "REFUSED", 3: "REFUSED", 4: "REFUSED", 5: "REFUSED", 6: "SUPPORTED", 7: "REFUSED"}


def test_resolution(spark):
    n = spark.createDataFrame([(1, "Net sales of services"), (2, "Cash, ending balances"), (3, ""), (4, None)], "id int, name string")
    k = spark.createDataFrame([(10, "Net sales of services total"), (11, "Cash, beginning balances"), (12, "Net sales of services")], "known_id int, known_name string")
    assert {(r["id"], r["known_id"]) for r in resolution.best_fuzzy(n, k).collect()} == {(1, 12)}


def test_series(spark):
    df = spark.createDataFrame([("k", i, float(i), float(i + 1), float(i - 1)) for i in range(15)] + [("k", 99, None, 1.0, 1.0), ("short", 1, 1.0, 1.0, 1.0)], "key string, at int, close double, high double, low double")
    last = series.indicators(df).where("key = 'k' AND at = 14").first()
    assert last["rsi14"] == 100.0 and last["atr14"] == 2.0 and last["sma20"] is None
    assert {r["key"]: r["ema"] is None for r in series.ema(df, 3).collect()} == {"k": False, "short": True}
