import random

from ledgerloom.llm import boilerplate, match

REFERENCE = [
    (1, "Virzeskor Motors Inc.", "Company", "QVEX", None), (2, "Borálosh Petroleum Group", "Company", "ZBOR", "Nidajelk Railways"), (3, "Goutselt Cement Ltd.", "Supplier", None, None),
    (4, "Kinruth Optics Inc.", "Company", "QKIN", None), (5, "Kinruth Cement Corp.", "Company", "ZOTL", None), (6, "Trodax Bay", "GeographicMarket", None, None),
]


def frames(spark, names):
    m = spark.createDataFrame([(i, n, "x") for i, n in enumerate(names)], "mention_id bigint, name string, canonical_name string")
    return m, spark.createDataFrame(REFERENCE, "canonical_id bigint, canonical_name string, entity_type string, ticker string, former_name string")


def test_spellings(spark):
    stands = {
        "Virzeskor Motors Inc.": 1, "VIRZESKOR MOTORS, incorporated": 1, "Virzeskor  Motors": 1, "Virzeskor": 1, "VirzeskorMotorsInc.": 1, "Vizreskor Motors Inc.": 1, "Virzeskor Motrs": 1, "Motors, Virzeskor Inc.": 1,
        "Virzeskor Mot.": 1, "Virzeskor (Motors)": 1, "$QVEX": 1, "XNV: QVEX": 1, "(qvex)": 1, "the Virzeskor Motors Inc.’s": 1, "Ｂoralosh Petroleum grp.": 2, "Nidajelk Railways (old name)": 2, "Bоrálоsh Petroleum": 2,
        "Goutselt Cement Ltd. (the “Company”)": 3, "Goutselt_Cement_Ltd.": 3, "our partner Goutselt Cement Ltd. and its subsidiaries": 3, "Kinruth Cement": 5, "KINRUTH OPTICS [1]": 4, "Tordax Bay": 6,
    }
    not_ = ["Virzeskor Dairy Inc.", "Kinruth", "Kinruth Telecom plc", "none", "", "   ", "the Company", None, "Рукюфю", "Goutselt AG", "Trodax Valley", "x" * 5000]
    m, r = frames(spark, [*stands, *not_])
    got = {x["name"]: x["canonical_id"] for x in match.match_names(m, r).collect()}
    assert got == stands
    found = {x["mention_id"] for x in match.found(m, r).collect()}
    assert found == {i for i, n in enumerate(stands) if n != "Virzeskor Motors Inc."}
    assert match.unmatched_names(m, r).count() == len(not_)


def test_pigeonhole_join_equals_brute_force(spark):
    rng = random.Random(2)
    base = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(9, 15))) + " valve" for _ in range(12)]

    def typo(s):
        for _ in range(rng.randrange(0, 4)):
            i = rng.randrange(len(s))
            s = rng.choice([s[:i] + s[i + 1 :], s[:i] + rng.choice("abcxyz") + s[i:], s[:i] + rng.choice("xyz") + s[i + 1 :]])
        return s

    names = sorted({typo(rng.choice(base)) for _ in range(150)})
    ref = spark.createDataFrame([(i, b, "P", None, None) for i, b in enumerate(base)], "canonical_id bigint, canonical_name string, entity_type string, ticker string, former_name string")
    m = spark.createDataFrame(list(enumerate(names)), "mention_id bigint, name string")

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
        return row[-1]

    want = {}
    for i, n in enumerate(names):
        d = sorted((distance(n.replace(" ", ""), b.replace(" ", "")), k) for k, b in enumerate(base))
        if d[0][0] <= 2 and d[0][0] != d[1][0]:
            want[i] = d[0][1]
    got = {x["mention_id"]: x["canonical_id"] for x in match.match_names(m, ref).collect()}
    assert {k: v for k, v in want.items() if got.get(k) != v} == {}


def test_empty_reference_and_mentions(spark):
    m, r = frames(spark, ["Virzeskor Motors Inc.", "Virzeskor Motors Inc."])
    assert match.match_names(m, r).count() == 2  # a mention recorded twice
    assert match.match_names(m, r.limit(0)).count() == 0
    assert match.match_names(m.limit(0), r).count() == 0


def test_repeated_lines(spark):
    docs = []
    for i in range(8):
        docs.append((i, " qvex" if i % 2 else "QVEX ", f"Unique sentence {chr(97 + i)}.\r\nShare  this RELEASE {i}\nPage {i} of 9\n-----\n{i}\nonly five" if i < 5 else f"Other {chr(97 + i)}.\nshare this release ９\nPage {i} of 10", "x"))
    docs += [(20 + i, None, "Share this release", "x") for i in range(9)] + [(40, "QVEX", None, "x"), (41, "QVEX", "", "x"), (42, "ABC", "Share this release", "x"), (43, "QVEX", "a b\nnone", "x")]
    df = spark.createDataFrame(docs, "parsed_id bigint, ticker string, content string, line string")
    got = {tuple(r) for r in boilerplate.found(df).collect()}
    assert got == {(i, 2) for i in range(8)} | {(i, 3) for i in range(8)}
    clean = {r["parsed_id"]: r for r in boilerplate.without_repeated(df).collect()}
    assert len(clean) == len(docs) and clean[40]["content"] is None and clean[42]["content"] == "Share this release"
    assert clean[0]["content"] == "Unique sentence a.\r\n-----\n0\nonly five" and clean[0]["n_removed"] == 2
    lines = boilerplate.lines_removed(df).collect()
    assert {(r["site"], r["n_documents"]) for r in lines} == {("QVEX", 8)} and len(lines) == 2
    assert boilerplate.found(df.limit(0)).count() == 0


def test_both_ways_of_removing_agree(spark, monkeypatch):
    docs = [(i, "A", f"one {chr(97 + i)}\nkept by all\ntail {chr(97 + i)}\n") for i in range(7)]
    df = spark.createDataFrame(docs, "parsed_id bigint, ticker string, content string")
    small = {tuple(r) for r in boilerplate.without_repeated(df).collect()}
    monkeypatch.setattr(boilerplate, "BROADCAST_LINES", 0)
    assert {tuple(r) for r in boilerplate.without_repeated(df).collect()} == small
    assert {tuple(r) for r in boilerplate.found(df).collect()} == {(i, 2) for i in range(7)}


def test_the_summary_never_falls_short(spark, monkeypatch):
    monkeypatch.setattr(boilerplate, "WIDTH", 3)  # many collisions cost time, never lines
    docs = [(i, "A", f"one {chr(97 + i)}\nkept by all\ntail {chr(97 + i)}") for i in range(7)]
    df = spark.createDataFrame(docs, "parsed_id bigint, ticker string, content string")
    assert {tuple(r) for r in boilerplate.found(df).collect()} == {(i, 2) for i in range(7)}
