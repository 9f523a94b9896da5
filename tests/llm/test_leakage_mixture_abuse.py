import random

import numpy as np

from ledgerloom.llm import abuse, leakage, mixture
from ledgerloom.llm.forms import words_of


def test_leaks_equal_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [(f"E{i}", " ".join(rng.choices(vocabulary, k=25)), " ".join(rng.choices(vocabulary, k=60)) if i % 5 else None) for i in range(30)] + [("short", "too few words here", "")]
    docs = []
    for d in range(60):
        w = rng.choices(vocabulary, k=rng.randrange(0, 200))
        if d % 3 == 0:
            q = (rng.choice(items[:30])[1]).split()
            a = rng.randrange(0, 13)
            w[10:10] = q[a : a + rng.randrange(10, 14)]
        docs.append((d, " ".join(x.upper() if rng.random() < 0.3 else x for x in w)))
    docs += [(100, None), (101, ""), (102, "​".join(items[0][1].replace(" ", " "))), (103, ", ".join(items[1][1].split())), (103, ", ".join(items[1][1].split()))]
    win = {}
    for key, q, e in items:
        for t in (q, e):
            w = words_of(t or "")
            for i in range(len(w) - 11):
                win.setdefault(tuple(w[i : i + 12]), set()).add(key)
    want = {(d, k) for d, t in docs for w in [words_of(t or "")] for i in range(len(w) - 11) for k in win.get(tuple(w[i : i + 12]), ())}
    D = spark.createDataFrame([(*d, "x") for d in docs], "doc_id bigint, text string, eval_id string")
    E = spark.createDataFrame([(*i, "x") for i in items], "id string, question string, expected string, text string")
    got = leakage.found(D, E).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) and (102, "E0") in want
    assert leakage.found(D.limit(0), E).count() == 0 and leakage.found(D, E.limit(0)).count() == 0


def test_slices_and_chunks_change_nothing(spark, monkeypatch):
    rng = random.Random(9)
    v = [f"t{i}" for i in range(500)]
    items = [(f"E{i}", " ".join(rng.choices(v, k=20)), None) for i in range(20)]
    long = " ".join(rng.choices(v, k=3000)) + " " + items[7][1] + " " + " ".join(rng.choices(v, k=50))
    D = spark.createDataFrame([(1, long), (2, items[3][1])], "doc_id bigint, text string")
    E = spark.createDataFrame(items, "id string, question string, expected string")
    monkeypatch.setattr(leakage, "SLICE", 6)
    monkeypatch.setattr(leakage, "CHUNK", 64)
    assert {tuple(r) for r in leakage.found(D, E).collect()} == {(1, "E7"), (2, "E3")}


def test_blocks_find_all_fingerprints_within_the_radius():
    rng = np.random.default_rng(1)
    index = leakage.Index([(f"E{i}", "question", " ".join(f"a{rng.integers(1000)}" for _ in range(14))) for i in range(50)])
    near = index.prints ^ (np.uint64(1) << rng.integers(0, 64, len(index.prints)).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, len(index.prints)).astype(np.uint64))
    l, r = index.near(near)
    brute = {(i, j) for i in range(len(near)) for j in range(len(index.prints)) if int(near[i] ^ index.prints[j]).bit_count() <= leakage.RADIUS}
    assert set(zip(l.tolist(), r.tolist())) == brute


def test_simhash_of_windows():
    s = np.arange(1, 40, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    got = leakage.simhashes(s, 11)
    bits = np.unpackbits(s.view(np.uint8).reshape(-1, 8), axis=1).astype(int)
    want = [np.packbits((bits[i : i + 11].sum(0) > 5).astype(np.uint8)).view(np.uint64)[0] for i in range(len(s) - 10)]
    assert got.tolist() == [int(x) for x in want]


TARGETS = [("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.1, 2), ("none", 0.1, 5)]


def mix_frames(spark):
    rng = random.Random(2)
    docs = [(i, " ".join(["word"] * rng.randrange(1, 60)), rng.choice("aaaabbcd")) for i in range(800)]
    docs += [(900, None, "a"), (901, "", "b"), (902, "x y", None), (903, "x y", "unlisted")]
    return spark.createDataFrame([(*d, "x") for d in docs], "doc_id bigint, text string, source string, share string"), spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")


def test_mix_reaches_shares_or_caps(spark):
    docs, targets = mix_frames(spark)
    rows = mixture.mixed(docs, targets).collect()
    assert len(rows) == docs.count()
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
    total = sum(r["n_tokens"] for s in ("a", "b", "c") for r in by[s])
    for s, share, cap in TARGETS[:3]:
        used, supply = sum(r["n_tokens"] * r["use_count"] for r in by[s]), sum(r["n_tokens"] for r in by[s])
        want = min(share * total, cap * supply)
        assert abs(used - want) <= max(r["n_tokens"] for r in by[s]), s
        counts = {r["use_count"] for r in by[s]}
        assert max(counts) <= cap and max(counts) - min(counts) <= 1
    assert all(r["use_count"] == 0 and r["first_position"] is None for s in ("d", None, "unlisted") for r in by[s])
    shares = {r["source"]: r for r in mixture.shares(docs, targets).collect()}
    assert set(shares) == {"a", "b", "c", "none"} and shares["none"]["tokens_used"] == 0
    assert abs(sum(r["share_reached"] for r in shares.values()) - 1) < 1e-9


def test_order_follows_the_schedules(spark):
    docs, targets = mix_frames(spark)
    rows = mixture.training_order(docs, targets).collect()
    assert len(rows) == sum(r["use_count"] for r in mixture.mixed(docs, targets).collect())
    assert len({(r["doc_id"], r["use_no"]) for r in rows}) == len(rows)
    assert all(0 <= r["position"] <= 1 for r in rows)
    late = [r["position"] for r in rows if r["source"] == "b"]
    early = [r["position"] for r in rows if r["source"] == "a"]
    assert np.mean(late) > np.mean(early)  # what may be repeated more comes later
    assert mixture.mixed(docs.limit(0), targets).count() == 0 and mixture.mixed(docs, targets.limit(0)).where("use_count > 0").count() == 0


def test_position_inverts_the_integral(spark):
    from pyspark.sql import functions as F

    df = spark.range(101).select((F.col("id") / 100).alias("p"), F.lit(0.4).alias("s"))
    t = mixture.position(F.col("p"), F.col("s"))
    assert df.select(F.max(F.abs(t + F.col("s") * (t * t - t) - F.col("p"))).alias("e")).first()["e"] < 1e-9


def abuse_frames(spark, n=400):
    rng = random.Random(6)
    name = lambda: "".join(rng.choice(["ka", "ro", "ti", "sel", "mun", "dra"]) for _ in range(3)).title()
    plain = [lambda: f"Sales of {name()} rose {rng.randrange(90)}% in the first quarter.", lambda: f"The auditors of {name()} identified lease accounting as a critical matter.", lambda: f"We depend on {name()} for the valve and supply may stop.", lambda: f"The report quotes a clerk who called a colleague lazy; {name()} was dismissed."]
    bad = [lambda: f"You people are filthy morons and {name()} is the biggest idiot of all.", lambda: f"Get rid of every {name()} here, they breed and ruin everything.", lambda: f"I will smash that stupid face of {name()} in."]
    docs, labels, truth = [], [], set()
    for i in range(n):
        s = [rng.choice(plain)() for _ in range(rng.randrange(4, 12))]
        if i % 6 == 0:
            truth.add(i)
            s.insert(rng.randrange(len(s)), rng.choice(bad)())
        docs.append((i, " ".join(s), rng.choice(["web", "news", None])))
        if i < n // 2:
            labels.append((i, "ann", int(i in truth) if rng.random() > 0.03 else None))
    docs += [(n, None, "web"), (n + 1, "", "web"), (n + 2, "You people are f-i-l-t-h-y moooorons and Karo is the biggest id10t of all.", "web")]
    return spark.createDataFrame([(*d, "x") for d in docs], "doc_id bigint, text string, source string, score string"), spark.createDataFrame(labels, "doc_id bigint, annotator string, abusive int"), truth


def test_held_out_documents_are_told_apart(spark):
    docs, labels, truth = abuse_frames(spark)
    got = {r["doc_id"]: r for r in abuse.score(docs, labels).collect()}
    assert len(got) == docs.count()
    held = [i for i in range(200, 400)]
    hits = sum(got[i]["abusive"] for i in held if i in truth)
    wrong = sum(got[i]["abusive"] for i in held if i not in truth)
    assert hits >= 0.9 * sum(i in truth for i in held) and wrong <= 0.02 * len(held)
    assert not got[400]["abusive"] and not got[401]["abusive"] and got[402]["abusive"]
    rates = {r["source"]: r for r in abuse.rates(abuse.score(docs, labels)).collect()}
    assert set(rates) == {"web", "news", None} and sum(r["n_documents"] for r in rates.values()) == 403


def test_without_labels_nothing_is_abusive(spark):
    docs, labels, _ = abuse_frames(spark, 20)
    assert abuse.found(docs, labels.limit(0)).count() == 0
    assert abuse.found(docs.limit(0), labels).count() == 0
    assert abuse.found(docs, labels.where("abusive = 1")).count() == 0


def test_plain_spelling():
    assert abuse.plain("m-a-g-g-o-t-s") == "maggots" and abuse.plain("scuuuum") == "scum" and "naked" in abuse.plain("so n@k3d now")
    assert abuse.plain("it cost 1,234.5 today. Next") == "it cost 0 today. next"


def test_rare_wordings_enter_the_dictionary_at_any_number_of_labels():
    rng = random.Random(3)
    plain = [lambda: f"sales of _ rose {rng.randrange(90)} percent in the {rng.choice(['first', 'second'])} quarter.", lambda: f"the auditors identified {rng.choice(['lease', 'pension', 'revenue'])} accounting as a critical matter."]
    bad = ["you people are filthy morons and _ is the biggest idiot of all.", "i will smash that stupid face of _ in, you just wait."]
    rare = "cállate ya, pedazo de imbécil, ojalá te pudras bajo un puente."
    for n in (60, 360):
        ordinary = {i: [rng.choice(plain)() for _ in range(5)] for i in range(3 * n)}
        abusive = {i: [rng.choice(plain)() for _ in range(4)] + [rng.choice(bad)] for i in range(3 * n, 4 * n - 2)}
        abusive |= {4 * n + k: [plain[0](), plain[1](), rare] for k in range(2)}
        plain_data, bad_data, limit = abuse.fit(ordinary, abusive)
        assert rare.encode() in bad_data, n
        assert abuse.Scorer(plain_data, bad_data).document([plain[0](), rare])[0] > limit, n
