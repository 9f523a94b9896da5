"""Registered queries take every row of their tables: rows that DuckDB's rules can't follow are held against brute force."""

import re
import unicodedata

import pyarrow as pa
import pyarrow.parquet as pq

from ledgerloom.queries import QUERIES

TEXTS = ["Plain Words here, 12,345 up.", "Société Générale l’a dit — 56,789 €.", "ＦＵＬＬ １２,３４５ wide on ２０２４-０１-０２", "Дом Книги x", "", "Société Génerale holds", None, "word " * 900 + "é"]
TOKEN = re.compile(r"\w+(?:[-'’]\w+)*|[^\w\s]")
# Python's \w has no combining marks, Java's has.
TOKENS = [None if t is None else re.findall(r"(?:[^\W]|[̀-ͯ])+(?:[-'’](?:[^\W]|[̀-ͯ])+)*|[^\w\s]", t) for t in TEXTS]


def stored(path, name, /, **columns):
    pq.write_table(pa.table(columns), f"{path}/{name}.parquet")
    return str(path)


def test_tokens_of_all_texts(spark, tmp_path):
    at = stored(tmp_path, "documents", doc_id=list(range(len(TEXTS))), text=TEXTS)
    stored(tmp_path, "chunk", id=[str(i) for i in range(len(TEXTS))], text=TEXTS)
    assert {r["doc_id"]: r["n"] for r in QUERIES["j9_count_tokens"](spark, at).collect()} == {i: None if t is None else len(t) for i, t in enumerate(TOKENS)}
    want = set()
    for i, t in enumerate(TOKENS):
        n, a = len(t or []), 0
        while n:
            want.add((str(i), a // 350, a, min(a + 400, n)))
            if a + 400 >= n:
                break
            a += 350
    assert {tuple(r) for r in QUERIES["m9_token_windows"](spark, at).collect()} == want


def test_spans_of_all_texts(spark, tmp_path):
    at = stored(tmp_path, "documents", doc_id=list(range(len(TEXTS))), text=TEXTS)
    got = {r["doc_id"]: r["n"] for r in QUERIES["m28_capitalised_spans"](spark, at).collect()}
    # Plain Words; Société Générale; FULL; Дом Книги; Société Générale with accents apart
    assert {k: v for k, v in got.items() if k != 6} == {0: 1, 1: 1, 2: 1, 3: 1, 4: 0, 5: 1, 7: 0} and 6 in got


def test_figures_of_all_texts(spark, tmp_path):
    at = stored(tmp_path, "chunk", id=[str(i) for i in range(len(TEXTS))], text=TEXTS)
    got = {r["id"]: r["figures"] for r in QUERIES["j20_figures"](spark, at).collect()}
    assert got == {"0": "12,345", "1": "56,789", "2": "１２,３４５", "3": "", "4": "", "5": "", "6": None, "7": ""}


NAMES = ["Müller AG", "Müller ag", "MULLER A.G.", "ＭＵＬＬＥＲ　ＡＧ", "Straße ﬁne", "STRASSE fine", "Дом", "дом", "東京", "Acme", "Ｎ／Ａ", "É", None, "", "…", "Acme"]


def folded_by_hand(name):
    text = unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", name).casefold())
    text = "".join(c for c in text if unicodedata.category(c) != "Mn").replace(".", "")
    return re.sub(r"[\s_]+", " ", re.sub(r"[^\w\s]", " ", text)).strip()


def test_entities_of_all_names(spark, tmp_path):
    at = stored(tmp_path, "extracted_entity", mention_id=list(range(len(NAMES))), name=NAMES, entity_type=["T"] * len(NAMES))
    groups = {}
    for n in NAMES:
        if n and folded_by_hand(n):
            groups.setdefault(folded_by_hand(n), []).append(n)
    want = {("T", g[0], len(set(g)), len(g)) for g in groups.values()}
    got = QUERIES["n1_registry"](spark, at).select("entity_type", "display", "n_spellings", "n_mentions").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) and ("T", "Müller AG", 4, 4) in want and ("T", "Straße ﬁne", 2, 2) in want
    assert tuple(QUERIES["v12_resolution_report"](spark, at).first()) == ("T", len(want), sum(w[3] for w in want))
    usable = {r["mention_id"]: r["usable"] for r in QUERIES["j12_usable_name"](spark, at).collect()}
    # Ｎ／Ａ is a placeholder, É a single letter
    assert usable == {i: i not in (10, 11, 12, 13, 14) for i in range(len(NAMES))}


def test_components_of_all_suppliers(spark, tmp_path):
    rows = [(i, i % 4 if i % 5 else 9) for i in range(1, 24)]
    at = stored(tmp_path, "supplier", s_suppkey=[s for s, _ in rows], s_nationkey=[n for _, n in rows])
    want = {}
    for n in {n for _, n in rows}:
        nodes = {f"N{n}"} | {f"P{s}" for s, m in rows if m == n}
        want |= {x: min(nodes) for x in nodes}
    assert {r["id"]: r["component"] for r in QUERIES["i_components"](spark, at).collect()} == want and len(want) == 28


def test_eccentricity_over_all_customers(spark, tmp_path):
    at = stored(tmp_path, "nation", n_nationkey=[1, 2, 3], n_regionkey=[1, 1, 2])
    stored(tmp_path, "supplier", s_suppkey=[1, 2], s_nationkey=[1, 3])
    stored(tmp_path, "customer", c_custkey=[3, 7, 8], c_nationkey=[2, 1, 3])
    pairs = [("N1", "R1"), ("N2", "R1"), ("N3", "R2"), ("P1", "N1"), ("P2", "N3"), ("C3", "N2"), ("C7", "N1"), ("C8", "N3")]
    seen, level, depth = {"P1"}, {"P1"}, -1
    while level:
        level, depth = {y for a, b in pairs for x, y in ((a, b), (b, a)) if x in level} - seen, depth + 1
        seen |= level
    assert QUERIES["i7_eccentricity"](spark, at).first()["depth"] == depth == 4
