"""Problem 2: one consistent form of text that looks the same but differs in its characters.

The form is Unicode's compatibility normalisation, composed, after removal of default-ignorable characters, with every kind of
space mapped to the ordinary one, look-alike letters of other scripts replaced inside words that are meant as Latin, and full case
folding. Applying it twice changes nothing.

Pure ASCII values never leave the JVM; the others are sent to Arrow functions that treat each distinct value of a batch once.

Defined results: null stays null, the empty text stays empty; repeated values give repeated results; other columns are untouched.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

# Letters of other scripts and the Latin letters they look like.
CYRILLIC_LOOKALIKES = {
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C",
    "Т": "T", "У": "Y", "Х": "X", "Ү": "Y", "Ѵ": "V", "Ԛ": "Q", "Ԝ": "W", "Ӏ": "I",
    "а": "a", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѵ": "v", "һ": "h",
    "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l",
}
GREEK_LOOKALIKES = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T",
    "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v",
}
#: Resemble a Latin letter only loosely: replaced beside Latin letters, no sign of a Latin word by themselves.
LOOSE_LOOKALIKES = {"α": "a", "γ": "y", "ι": "i", "κ": "k", "ρ": "p", "υ": "u", "χ": "x", "ϲ": "c", "к": "k"}
#: Letters of scripts in which whole words of such letters are ordinary words: replaced beside Latin letters only.
OTHER_LOOKALIKES = {
    "Օ": "O", "օ": "o", "Տ": "S", "Ս": "U", "ս": "u", "Լ": "L", "հ": "h", "ո": "n", "ց": "g", "զ": "q", "յ": "j",
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭵ": "i", "Ꭹ": "Y", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮍ": "y", "Ꮐ": "G", "Ꮓ": "Z",
    "Ꮟ": "b", "Ꮢ": "R", "Ꮤ": "W", "Ꮩ": "V", "Ꮪ": "S", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ꮷ": "d", "Ᏻ": "G", "Ᏼ": "B",
    "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N", "ꓡ": "L", "ꓢ": "S",
    "ꓣ": "R", "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U",
    "Ⲃ": "B", "Ⲏ": "H", "Ⲓ": "I", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲟ": "O", "ⲟ": "o", "Ⲣ": "P", "ⲣ": "p", "Ⲥ": "C", "ⲥ": "c", "Ⲧ": "T", "Ⲩ": "Y", "Ⲭ": "X", "Ⲍ": "Z",
    "ס": "o", "ዐ": "O", "ሀ": "U", "ყ": "y", "ⵔ": "O", "ⵝ": "X", "Ϳ": "J", "ϳ": "j", "Ϲ": "C", "Ϻ": "M", "Ϝ": "F", "σ": "o", "Ԍ": "G",
}
LOOKALIKES = CYRILLIC_LOOKALIKES | GREEK_LOOKALIKES | LOOSE_LOOKALIKES | OTHER_LOOKALIKES
# Unicode's default-ignorable code points, as ranges of a character class.
IGNORABLE = (
    "­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ"
    "￰-￸\U0001bca0-\U0001bca3\U0001d173-\U0001d17a\U000e0000-\U000e0fff"
)
SPACES = "   -   　"
BREAKS = "\u000b\u000c\u0085  "
CONTROLS = "\u0000-\u0008\u000e-\u001f\u007f-\u0084\u0086-\u009f"
ACCENTS = "̀-ͯ᪰-᫿᷀-᷿⃐-⃿"
WIDE = "！-～｟-ﾟﾡ-￮ﬀ-ﬆﬓ-ﬗ"

_IGNORED = re.compile(f"[{IGNORABLE}{CONTROLS}]")
_ODD_ASCII = re.compile("[\\x00-\\x08\\x0b-\\x1f\\x7f]")
_SPACE = re.compile(f"[{SPACES}]")
_BREAK = re.compile(f"\r\n?|[{BREAKS}]")
_LOOK = re.compile(f"[{''.join(LOOKALIKES)}]")
_WORD_WITH_LOOK = re.compile(rf"[^\W\d_]*[{''.join(LOOKALIKES)}][^\W\d_]*")
_TO_LATIN = str.maketrans(LOOKALIKES)
_STRICT = frozenset(CYRILLIC_LOOKALIKES | GREEK_LOOKALIKES)
_LATIN = re.compile("[A-Za-z\u00aa\u00ba\u00c0-\u024f\u1e00-\u1eff]")
_DISGUISED = re.compile(f"[{WIDE}{ACCENTS}{IGNORABLE}{CONTROLS}{SPACES}]")
WORD = re.compile(r"[^\W_]+")


def meant_as_latin(word: str) -> bool:
    """A word with look-alike letters counts as Latin if it has Latin letters too, or no letter but strict look-alikes."""
    return bool(_LATIN.search(word)) or all(c in _STRICT for c in word)


def _latin(m: re.Match[str]) -> str:
    return m[0].translate(_TO_LATIN) if meant_as_latin(m[0]) else m[0]


def uncased_form(text: str) -> str:
    """The consistent form of one text but for case."""
    if text.isascii():
        return _BREAK.sub("\n", _IGNORED.sub("", text)) if _ODD_ASCII.search(text) else text
    text = unicodedata.normalize("NFKC", _IGNORED.sub("", text))
    text = _BREAK.sub("\n", _SPACE.sub(" ", text))
    return _WORD_WITH_LOOK.sub(_latin, text) if _LOOK.search(text) else text


def one_form(text: str) -> str:
    """The consistent form of one text: its steps are repeated until nothing changes, for each may give the others something to do (a
    cased letter may fold into a look-alike, which only then stands beside Latin letters and joins with an accent)."""
    for _ in range(20):  # three passes are the most that was ever seen
        if text.isascii():
            break
        after = unicodedata.normalize("NFKC", uncased_form(text).casefold())
        if after == text:
            return text
        text = after
    return uncased_form(text).lower() if text.isascii() else text


def _no_case(c: str) -> bool:
    """Characters that the consistent form changes though they disguise nothing: signs, raised letters, single accented letters, and
    letters of other scripts that are written so. Wide and narrow forms, ligatures and spaces are cases."""
    tag, kind, to = unicodedata.decomposition(c).rpartition(">")[0], unicodedata.category(c), unicodedata.normalize("NFKC", c)
    if to == c or kind[0] == "Z" or tag in ("<wide", "<narrow", "<initial", "<medial", "<final", "<isolated") and kind[0] in "LSPN":
        return False
    if kind[0] not in "LM" and kind != "Nl" or tag in ("<super", "<sub"):
        return True
    return not (to.isascii() or _LATIN.search(to) and tag or 0xFB00 <= ord(c) <= 0xFDFF and tag)


# By rule: most letters that change are of the first planes; no Latin form lies beyond.
_NO_CASES = frozenset(c for c in map(chr, range(0xA0, 0x30000)) if unicodedata.decomposition(c) and _no_case(c))
_WITHOUT = dict.fromkeys(map(ord, _NO_CASES), "|")


def is_disguised(text: str) -> bool:
    """Whether a text holds a full-width or ligature form, an accent apart from its letter, an invisible character, a space other
    than the ordinary one, or a letter of another script in place of a Latin one: what the consistent form changes, but for case, line
    breaks and the characters that are no cases, or an accent that no letter joins with."""
    if text.isascii():
        return any(c in text for c in _ASCII_CONTROLS) if not text.isprintable() else False
    text = _BREAK.sub("\n", text if _NO_CASES.isdisjoint(text) else text.translate(_WITHOUT))
    return uncased_form(text) != text or bool(_DISGUISED.search(text))


_ASCII_CONTROLS = "".join(map(chr, [*range(9), *range(14, 32), 127]))


def words_of(text: str) -> list[str]:
    """Maximal runs of letters or digits of the consistent form."""
    return WORD.findall(one_form(text))


def per_distinct(values: pa.Array, of, kind: pa.DataType) -> pa.Array:
    """``of`` applied once to each distinct value of an Arrow batch."""
    coded = values.dictionary_encode()
    got = pa.array([None if x is None else of(x) for x in coded.dictionary.to_pylist()], kind)
    return got.take(coded.indices)


def _forms(values: pa.Array) -> pa.Array:
    return per_distinct(values, one_form, pa.string())


def _flags(values: pa.Array) -> pa.Array:
    return per_distinct(values, is_disguised, pa.bool_())


#: Texts that lowering in the JVM brings into the consistent form: printable ASCII with tabs and line feeds.
_PLAIN = r"^[\x20-\x7e\t\n]*$"


def form_of(text: Column) -> Column:
    plain = text.rlike(_PLAIN)
    return F.when(plain, F.lower(text)).otherwise(F.arrow_udf(_forms, StringType())(F.when(~plain, text)))


def disguised(text: Column) -> Column:
    plain = text.rlike(_PLAIN)
    return F.when(plain, F.lit(False)).otherwise(F.arrow_udf(_flags, BooleanType())(F.when(~plain, text)))


def with_forms(df: DataFrame, text: str, form: str = "form", flag: str = "disguised") -> DataFrame:
    """``df`` with the consistent form of a column and whether the column needed one for its characters (not for its case).

    The new columns replace any columns of the same names.
    """
    return df.withColumn(form, form_of(F.col(f"`{text}`"))).withColumn(flag, disguised(F.col(f"`{text}`")))
