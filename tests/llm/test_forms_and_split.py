import random
import re
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import forms, split


def test_texts_that_look_the_same_get_one_form():
    same = ["Bivra firm", "Ｂｉｖｒａ ﬁrm", "Bi​vra firm", "Bіvrа firm", "BIVRA FIRM", "Bivra fi­rm"]
    assert {forms.one_form(x) for x in same} == {"bivra firm"}
    assert forms.one_form("é") == forms.one_form("é") == forms.one_form("É")
    assert forms.one_form("Straße") == forms.one_form("STRASSE")


def test_what_is_disguised():
    for x in ["Ｂ", "ﬁ", "é", "a​", "a b", "a b", "Соuх", "ΧDPV", "﻿a", "со­х"]:
        assert forms.is_disguised(x), x
    for x in ["", "plain text\n\ttabs", "é ü ñ", "“quoted” — dash • ™ ’", "Рукюфю", "Ξωφο Λασασω", "x™"]:
        assert not forms.is_disguised(x), x


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_the_form_is_stable(text):
    once = forms.one_form(text)
    assert forms.one_form(once) == once
    assert not re.search("[​­﻿⁠]", once)


def test_column_and_function_agree(spark):
    texts = [None, "", "ABC", "Ｂｉｖ ﬁrm", "é", "a​b", "Соuflіflеrn", "x" * 50_000, "ABC", "a\rb", "\u0001x"]
    df = spark.createDataFrame([(i, t, "own") for i, t in enumerate(texts)], "id int, text string, form string")
    rows = {r["id"]: r for r in forms.with_forms(df, "text").collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        assert rows[i]["form"] == (None if t is None else forms.one_form(t))
        assert bool(rows[i]["disguised"]) == (t is not None and forms.is_disguised(t))
    assert forms.with_forms(df.limit(0), "text").count() == 0


def greedy(n, natural, most, overlap):
    cuts, s = [], 0
    while True:
        end = s + most
        if end >= n:
            return cuts + [n]
        lo = (cuts[-1] if cuts else overlap)
        good = [b for b in natural if lo < b <= end]
        cuts.append(max(good) if good else end)
        s = cuts[-1] - overlap


def test_cuts_equal_a_sequential_greedy_split():
    import numpy as np

    rng = random.Random(7)
    for _ in range(200):
        sizes = [rng.randrange(30, 400) for _ in range(rng.randrange(1, 5))]
        nat = [np.array(sorted(rng.sample(range(1, n), rng.randrange(0, min(n - 1, 12)))), dtype=np.int64) for n in sizes]
        got = split.cuts(sizes, nat, 29, 5)
        assert [g.tolist() for g in got] == [greedy(n, b.tolist(), 29, 5) for n, b in zip(sizes, nat)]


def test_pieces_cover_the_text_and_overlap():
    rng = random.Random(3)
    words = lambda n: " ".join("w" * rng.randrange(1, 9) + rng.choice(["", "", ".", ",", "\n", "\n\n"]) for _ in range(n))
    for text in [words(5000), "x " * 3000, "|a|b|\n" * 900, "één-twee d'accord " * 700, "." * 2500]:
        rows = list(split.pieces_of(["k"], [text], 800, 100))
        assert all(r[5] - r[4] <= 800 for r in rows)
        assert rows[0][4] == 0 and rows[-1][5] == rows[0][3] == len(split.TOKEN.findall(text))
        assert all(b[4] == a[5] - 100 for a, b in zip(rows, rows[1:]))
        assert text.startswith(rows[0][7]) and text.endswith(rows[-1][7])
        assert all(len(split.TOKEN.findall(r[7])) == r[5] - r[4] for r in rows)


def test_split_of_a_table(spark):
    long = "Eins zwei drei. " * 400
    df = spark.createDataFrame([("a", long, 1), ("b", "short", 2), ("c", "", 3), ("d", None, 4), ("a", long, 5)], "id string, text string, piece_no int")
    rows = split.split_texts(df).collect()
    assert {r["chunk_id"] for r in rows} == {"a", "b", "c"}
    assert sum(r["chunk_id"] == "a" for r in rows) == 2 * rows[0]["n_pieces"] if rows[0]["chunk_id"] == "a" else True
    found = [r["chunk_id"] for r in split.split_texts(df, with_text=False, oversized_only=True).where("piece_no = 1").collect()]
    assert found == ["a", "a"]
    assert split.split_texts(df.limit(0)).count() == 0


def test_counts_follow_the_token_rule():
    assert split.TOKEN.findall("a-b c'd 5.3 x​y ™") == ["a-b", "c'd", "5", ".", "3", "x", "y", "™"]
    assert unicodedata.category("​") == "Cf"


def test_the_flag_follows_the_form():
    from ledgerloom.llm.forms import is_disguised

    for case in ("\u0133s", "\u01c6ep", "\ufe8d", "\ufb01ne", "\u0410cme", "e\u0301", "x\u0302", "\u00e4\u00a0b", "a\u200bb", "\u0410\u0441me", "\ufdfa", "\U0001d400cme", "\u212aelvin", "\u3000\u00e4", "\uff71"):
        assert is_disguised(case), case
    for plain in ("M\u00fcller\u2122", "“a” – b • c…", "5 \u00b5m\u00b2, n\u00ba 3 \u00bd", "Дом \u21165", "東京", "\u0e19\u0e49\u0e33", "\u212b\u00c5", "a\r\n\u00e9", "①", "\u00e9\u00b4", "", "\u314b\u314b", "Ⓡ ® ©"):
        assert not is_disguised(plain), plain


def test_the_form_of_a_form_is_itself():
    rng = random.Random(7)
    every = [c for c in map(chr, [*range(1, 0xD800), *range(0xE000, 0x30000)]) if unicodedata.category(c) != "Cn"]
    for _ in range(100_000):
        text = "".join(rng.choice(every) if rng.random() < 0.7 else rng.choice("abcDEF Оа") for _ in range(4))
        assert forms.one_form(forms.one_form(text)) == forms.one_form(text)


def test_look_alikes_of_many_scripts_beside_latin_letters():
    for text, form in (("օrange", "orange"), ("Ꭺpple", "apple"), ("ꓮpple", "apple"), ("Ⲟil", "oil"), ("Соса", "coca")):
        assert forms.one_form(text) == form and forms.is_disguised(text)
    for text in ("γ-globulin", "Рукюфю", "Σίσυφος", "ᎪᎳᎩ"):
        assert not forms.is_disguised(text)


def test_pieces_without_overlap_make_up_the_text():
    text = "  One two. Three four five!\n\nSix  seven eight nine ten. Eleven twelve. "
    got = [r[-1] for r in split.pieces_of(["k"], [text], 4, 0)]
    assert "".join(got) == text and len(got) > 2 and all(len(split.TOKEN.findall(x)) <= 4 for x in got)
