"""String functions as Column expressions (group J). Null in, null out unless said otherwise; the empty text is an ordinary value.

Only ``decomposed`` needs more than built-in functions: names that aren't ASCII leave the JVM there, nothing else does.
"""

from __future__ import annotations

import unicodedata
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# By rule: letters whose compatibility decomposition begins with an ASCII letter, and that letter.
_PAIRS = [(chr(c), unicodedata.normalize("NFKD", chr(c))[0]) for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]]
_PAIRS = [(a, b) for a, b in _PAIRS if b.isascii() and a != b]
ACCENTED, PLAIN = "".join(a for a, _ in _PAIRS), "".join(b for _, b in _PAIRS)

# Fixed values.
STOPWORDS = ("a", "an", "and", "as", "at", "by", "for", "from", "in", "into", "is", "it", "its", "of", "on", "or", "that", "the", "to", "with")
POLARITY = (
    ("beginning", "ending"), ("opening", "closing"), ("start", "end"), ("gross", "net"), ("inflow", "outflow"), ("inflows", "outflows"), ("provided", "used"),
    ("increase", "decrease"), ("increased", "decreased"), ("acquired", "disposed"), ("issued", "withheld"), ("assets", "liabilities"),
)
TITLES = r"^(dr|prof|professor|mr|mrs|ms|miss|sir|dame|lord|lady|capt|captain|gen|general|rev|reverend|st|saint|president|senator|governor|judge|the)\.?\s+"
KEPT_TITLES = r"(?i)^(king|queen|prince|princess|pope|emperor|empress|duke|duchess|earl)\b"
# Placeholders, and words that name nothing.
PLACEHOLDERS = (
    "unknown", "n a", "na", "none", "null", "n/a", "tbd", "example", "placeholder", "test", "entity", "entities", "document", "text", "passage", "various",
    "misc", "multiple", "unnamed", "unspecified",
)
NON_ENTITY_WORDS = (
    "a", "an", "the", "and", "or", "but", "nor", "so", "yet", "if", "then", "than", "that", "this", "these", "those", "there", "here", "when", "where",
    "which", "who", "whom", "whose", "what", "why", "how", "is", "are", "was", "were", "be", "been", "being", "am", "do", "does", "did", "done", "has",
    "have", "had", "will", "would", "shall", "should", "may", "might", "must", "can", "could", "of", "in", "on", "at", "to", "for", "from", "by", "with",
    "as", "it", "its", "they", "them", "their", "he", "she", "his", "her", "we", "us", "our", "you", "your", "not", "no", "yes", "all", "any", "some",
    "each", "every", "both", "other", "others", "another", "into", "onto", "over", "under", "above", "below", "between", "among", "during", "before",
    "after", "about", "afterwards",
)
DASHES = ("", "-", "--", "—", "–", "n/a", "na", "nm", "none", "nil")


def _chain(c: Column, *steps: tuple[str, str]) -> Column:
    return reduce(lambda x, s: F.regexp_replace(x, *s), steps, c)


def clean_text(c: Column) -> Column:
    """No-break spaces and their entities as spaces, runs of white space as one, trimmed."""
    return F.trim(_chain(c, ("&nbsp;|&#160;|&#xa0;| ", " "), (r"\s+", " ")))


def unaccented(c: Column) -> Column:
    """Letters without their accents, whether composed or apart."""
    return F.regexp_replace(F.translate(c, ACCENTED, PLAIN), r"\p{Mn}+", "")


def _decompositions(values: pa.Array) -> pa.Array:
    coded = values.dictionary_encode()
    got = [None if x is None else unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", x).casefold()) for x in coded.dictionary.to_pylist()]
    return pa.array(got, pa.string()).take(coded.indices)


def decomposed(c: Column) -> Column:
    """Compatibility forms (full-width letters, ligatures) as ordinary characters, accents apart, case folded unless ASCII."""
    ascii_only = ~c.rlike(r"[^\x00-\x7F]")
    return F.when(ascii_only, c).otherwise(F.arrow_udf(_decompositions, StringType())(F.when(~ascii_only, c)))


def folded(c: Column) -> Column:
    """Lower case without accents, full stops deleted, other punctuation as spaces, runs of spaces as one."""
    return F.trim(_chain(F.lower(unaccented(c)), (r"\.", ""), (r"[^\p{L}\p{N}_\s]", " "), (r"[\s_]+", " ")))


def hyphen_slug(c: Column) -> Column:
    """The folded name with hyphens; a hash where no Latin letter or digit is left."""
    slug = _chain(folded(c), ("[^a-z0-9]+", "-"), ("^-+|-+$", ""))
    return F.when(slug != "", slug).otherwise(F.concat(F.lit("x"), F.substring(F.sha1(c.cast("binary")), 1, 12)))


def clean_name(c: Column) -> Column:
    """A display form: no accents, no parentheses, no possessive, outer punctuation gone."""
    return _chain(unaccented(F.trim(c)), (r"\s*\([^)]*\)", ""), (r"['’]s?$", ""), ("’", "'"), (r"\s+", " "), (r"^[ \t\n\r.,;:!?'-]+|[ \t\n\r.,;:!?'-]+$", ""))


def squash_slug(c: Column) -> Column:
    """Letters and digits only, a leading title dropped unless it belongs to the name; '' for names that have none."""
    name = clean_name(c)
    bare = F.regexp_replace(name, "(?i)" + TITLES, "")
    return F.regexp_replace(F.lower(F.when(name.rlike(KEPT_TITLES) | (bare == ""), name).otherwise(bare)), "[^0-9a-z]+", "")


def content_tokens(c: Column) -> Column:
    """Distinct folded tokens of at least three letters, without stop words, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.split(folded(c), " "), lambda t: (F.length(t) >= 3) & ~t.isin(*STOPWORDS))))


#: Words, joined over inner hyphens and apostrophes, or single signs.
TOKEN = r"(?U)\w+(?:[-'’]\w+)*|[^\w\s]"


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(TOKEN), 0)


def count_tokens(c: Column) -> Column:
    """J9."""
    return F.regexp_count(c, F.lit(TOKEN))


def singular(word: Column) -> Column:
    """A plausible singular of one word."""
    low, cut = F.lower(word), lambda n: F.substring(word, F.lit(1), F.length(word) - n)
    return (
        F.when((F.length(low) < 4) | ~low.endswith("s") | low.rlike("(ss|us|is|as|os)$"), word)
        .when(low.endswith("ies") & (F.length(low) > 4), F.concat(cut(3), F.lit("y")))
        .when(low.rlike("(ches|shes|sses|xes|zes)$"), cut(2))
        .otherwise(cut(1))
    )


def name_variants(text: Column) -> Column:
    """A name, then it with more and more of its last words in the singular, from the longest tail on."""
    words = F.split(F.trim(text), r"\s+")
    tail = lambda k: F.array_join(F.transform(words, lambda w, i: F.when(i >= k, singular(w)).otherwise(w)), " ")
    all_ = F.concat(F.array(F.trim(text)), F.transform(F.sequence(F.lit(0), F.size(words) - 1), tail))
    return F.when(F.trim(text) == "", F.array().cast("array<string>")).otherwise(F.array_distinct(all_))


def usable_name(c: Column) -> Column:
    """False for null, placeholders, function words and single letters."""
    name = clean_name(decomposed(c))
    return F.coalesce((F.length(name) >= 2) & ~F.lower(name).isin(*PLACEHOLDERS, *NON_ENTITY_WORDS), F.lit(False))


_UNIT = r"(?i)\s*\(\s*(?:in\s+)?(?:(?:[$€£¥]|usd|eur|gbp|jpy|rmb|cny|dollars?|euros?|pounds?|yen)\s*)?(?:in\s+)?(?:thousands|millions|billions|trillions|shares|units|per\s+share)\s*\)\s*$|(?i)\s*\(\s*(?:in\s+)?(?:[$€£¥]|usd|eur|gbp|jpy|rmb|cny|dollars?|euros?|pounds?|yen)\s*\)\s*$"
_NOTE = r"(?i)\s*\((?:\d{1,3}|[ivxlcdm]{1,5}|[a-z])\)\s*$"


def canonical_concept(label: Column) -> Column:
    """A label without its unit, par value, footnote marks, trademark signs, trailing punctuation and long numeric tail."""
    c = F.regexp_replace(clean_text(label), _UNIT, "")
    c = F.regexp_replace(c, r"(?i),\s*\$[\d.]+(?:\s*par\s+value)?(?::.*)?$", "")
    for _ in range(3):
        c = F.regexp_replace(c, _NOTE, "")
    c = F.regexp_replace(c, "[®™©℗]", "")
    c = F.regexp_replace(c, r"[\s.:;,]+$", "")
    head, tail = F.regexp_extract(c, r"^([^:]{4,80}):\s*(.*\d.*)$", 1), F.regexp_extract(c, r"^([^:]{4,80}):\s*(.*\d.*)$", 2)
    return F.trim(F.when(F.length(tail) > 40, head).otherwise(c))


def polarity_conflict(a: Column, b: Column) -> Column:
    """Whether two names differ in a word that turns the sense round."""
    x, y = F.split(folded(a), " "), F.split(folded(b), " ")
    return reduce(lambda p, q: p | q, (F.array_contains(x, w) != F.array_contains(y, w) for pair in POLARITY for w in pair))


def jaccard(a: Column, b: Column) -> Column:
    """Common tokens of all; 0 where either has none."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def parse_number(cell: Column) -> Column:
    """struct(value, is_percent) of a table cell; null for dashes (never 0) and for text glued to digits."""
    t = _chain(clean_text(cell), (r"[$€£¥]\s*", ""))
    percent = t.rlike(r"%\s*\)?\s*$")
    t = F.trim(_chain(t, (r"%\s*$", ""), (r"(?i)\(\s*([a-z*]+|\d{1,2})\s*\)\s*$", ""), (r"(?i)\(\s*in\s+[a-z ]+\)\s*$", "")))
    # A bare number in parentheses is a negative one, not a footnote.
    whole = _chain(clean_text(cell), (r"[$€£¥]\s*", ""), (r"%\s*\)", ")"), (r"%\s*$", ""))
    negative = whole.rlike(r"^\(\s*[\d.,\s]+\)$")
    digits = F.regexp_replace(F.when(negative, whole).otherwise(t), r"[(),\s]", "")
    value = F.when(digits.rlike(r"^[-+]?\d*\.?\d+([eE][-+]?\d+)?$"), digits.try_cast("double"))
    return F.when(value.isNotNull() & ~F.lower(clean_text(cell)).isin(*DASHES), F.struct(F.when(negative, -value).otherwise(value).alias("value"), percent.alias("is_percent")))


def normalise_number(token: Column) -> Column:
    """The number that a figure in prose stands for, whatever signs surround it."""
    t = F.regexp_replace(F.trim(F.translate(token, "０１２３４５６７８９", "0123456789")), r"(?i)10-[KQ](/A)?|8-K", "")
    digits = F.regexp_replace(t, r"[^\d.]", "")
    value = F.when((digits != "") & (digits != "."), digits.try_cast("double"))
    return F.when(F.trim(t).rlike("^[(−-]"), -value).otherwise(value)


SEPARATOR = r"\s*(?:,|[-]{1,2}(?:>|→)|=>|→)\s*"
CITATION = rf"\[(E\d+(?:{SEPARATOR}E\d+)*)\]"


def citations(c: Column) -> Column:
    """Cited tags in order of first appearance."""
    groups = F.regexp_extract_all(c, F.lit(CITATION), 1)
    return F.array_distinct(F.flatten(F.transform(groups, lambda g: F.regexp_extract_all(g, F.lit(r"E\d+"), 0))))


def figures(c: Column) -> Column:
    """Numbers that a text asserts, in digits of any script: none of citations, dates, years, small counts and identifiers."""
    masked = _chain(c, (CITATION, " "), (r"(?U)\d{4}-\d{2}-\d{2}", " "), (r"(?U)\b\d{1,2}/\d{1,2}/\d{2,4}\b", " "))
    raw = F.transform(F.regexp_extract_all(masked, F.lit(r"(?U)\(?-?\d[\d,]*\.?\d*\)?%?"), 0), lambda x: F.regexp_replace(x, ",+$", ""))
    core = lambda x: F.regexp_replace(F.regexp_replace(x, r"^[()%]+|[()%]+$", ""), ",", "")
    return F.filter(raw, lambda x: (core(x) != "") & ~core(x).rlike(r"(?U)^(\d{4}|0\d{6,9}|\d{1,2})$"))


def sentences(c: Column) -> Column:
    """Sentences, without breaks at decimal points and single initials."""
    kept = _chain(c, (r"(\d)\.(\d)", "$1\u0001$2"), (r"\b([A-Za-z])\.(?=\s|$)", "$1\u0001"))
    parts = F.split(kept, r"(?<=[.!?])\s+(?=[A-Z\[*\"'(])")
    return F.filter(F.transform(parts, lambda p: F.trim(F.regexp_replace(p, "\u0001", "."))), lambda p: p != "")


def grounded(name: Column, text: Column) -> Column:
    """Whether a name stands in a text as a run of words, or all its words of three letters and more stand there."""
    flat = lambda x: F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " ")), F.lit(" "))
    long = F.filter(F.split(F.trim(flat(name)), " "), lambda w: F.length(w) >= 3)
    return flat(text).contains(flat(name)) | ((F.size(long) > 0) & F.forall(long, lambda w: flat(text).contains(F.concat(F.lit(" "), w, F.lit(" ")))))


def padded(c: Column) -> Column:
    """Lower case, punctuation as spaces, one space between words and around."""
    return F.concat(F.lit(" "), F.trim(_chain(F.lower(c), (r"[^a-z0-9\s]", " "), (r"\s+", " "))), F.lit(" "))


def issuer_forms(name: Column) -> Column:
    """The spellings of an issuer without legal noise."""
    parts = F.split(F.trim(name), r"(?i)[,.]|\s+(?:inc|corporation|corp|ltd|plc|co|company|holdings)\b")
    return F.array_distinct(F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != ""))


def dehyphenated(c: Column) -> Column:
    """Words that a line end cuts, joined."""
    return F.regexp_replace(c, r"(\w)-\n(\w)", "$1$2")


def space_density(c: Column) -> Column:
    """Spaces per letter or digit; 0 without any."""
    n = F.length(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))
    return F.coalesce(F.try_divide(F.length(F.regexp_replace(c, "[^ ]", "")), n), F.lit(0.0))


def truncated(c: Column, most: int) -> Column:
    """At most ``most`` characters, ended at a sentence end where there is one."""
    head = F.substring(c, 1, most)
    return F.when(F.length(c) <= most, c).otherwise(F.coalesce(F.nullif(F.regexp_extract(head, r"(?s)^(.*[.!?])(?:\s|$)", 1), F.lit("")), head))
