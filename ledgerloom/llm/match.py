"""Problem 5: mapping freely written names to a reference list, in SQL only.

1. Names and reference names are folded (case, spaces, separators, accents, full-width forms, look-alikes, decorations such as
   "(unaudited)" or "and its subsidiaries", long and short legal suffixes) by built-in expressions.
2. Every reference item gets a few aliases: the whole name, the name without legal suffix, its words in sorted order, its former name,
   its ticker, and its first word where no other item shares it.
3. Names and aliases meet in a partition-based pigeonhole join: an alias is cut into k + 1 segments; a form within k edits has at least
   one of them at a position shifted by no more than the lengths and the other segments allow. An equality join on (number of segments,
   alias length, segment number, substring) finds the candidates, the built-in levenshtein verifies each pair once. Whole names of
   FUZZY_LENGTH characters and more allow EDITS edits, short ones, tickers, first words and sorted words none. All matches, equal ones
   too, come out of this join; one kind of abbreviation follows it.
4. What no alias reaches is reported through an anti-join.

The reference list is counted before it is broadcast; beyond ``BROADCAST_ITEMS`` the same joins run as shuffle joins, in which a salt
spreads a frequent piece. Names are deduplicated before the join, and joined back on the name with a salt, so a frequent spelling
spreads over tasks.

Defined results: a null or empty name, a placeholder and a name with two equally close items are unmatched; a mention recorded twice
gives two rows; clashing or extra columns are not read; an empty reference list leaves every mention unmatched.
"""

from __future__ import annotations

import unicodedata
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .forms import ACCENTS, IGNORABLE, LOOKALIKES

EDITS = 2
#: Aliases shorter than this match exactly only.
FUZZY_LENGTH = 8
#: Most items of a reference list that is broadcast; an item gives at most 6 aliases and 9 segments, of under 100 bytes each.
BROADCAST_ITEMS = 50_000
SALTS = 16

# Legal suffixes, long and short forms.
LEGAL = {
    "incorporated": "inc", "inc": "inc", "corporation": "corp", "corp": "corp", "limited": "ltd", "ltd": "ltd", "llc": "llc", "plc": "plc",
    "company": "co", "co": "co", "group": "group", "grp": "group", "holdings": "holdings", "holding": "holdings", "hldgs": "holdings",
    "hldg": "holdings", "ag": "ag", "gmbh": "gmbh", "sa": "sa", "nv": "nv",
}
# Names that stand for nothing.
PLACEHOLDERS = ("", "none", "n/a", "na", "tbd", "unknown", "the", "-", "null", "management", "the company", "company")


def _pairs() -> tuple[str, str]:
    """Characters and the ASCII ones that stand for them: by rule from Unicode's decompositions, and the look-alikes."""
    pairs = dict(LOOKALIKES)
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF01, 0xFF5F)]:
        base = unicodedata.normalize("NFKD", chr(code))[:1]
        if base.isascii() and base != chr(code):
            pairs[chr(code)] = base
    pairs |= {"’": "'", "‘": "'", "“": '"', "”": '"', "–": "-", "—": "-", "‐": "-", "‑": "-", "ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D"}
    return "".join(pairs), "".join(pairs.values())


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def folded(name: str) -> str:
    """SQL for the lower-case ASCII form of a name, with its words still apart."""
    source, target = _pairs()
    sql = f"regexp_replace({name}, {_quoted(f'[{IGNORABLE}]')}, '')"
    for ligature, plain in (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl")):
        sql = f"replace({sql}, '{ligature}', '{plain}')"
    sql = f"regexp_replace(translate({sql}, {_quoted(source)}, {_quoted(target)}), {_quoted(f'[{ACCENTS}]')}, '')"
    return f"lower({sql})"


def cleaned(folded_name: str) -> str:
    """SQL for a folded name without its decorations, words separated by one space."""
    sql = folded_name
    for pattern, to in (
        (r"[\s_]+", " "),
        (r"\(the \"[a-z ]*\"\)|\(\"[a-z ]*\"\)|\((unaudited|old name|formerly|audited)\)|\[\d+\]", " "),
        (r"^ *(the|messrs\.?|our partner|our customer|our supplier|formerly|f/k/a|fka|dba|d/b/a) +", ""),
        (r" and its (subsidiaries|affiliates) *$", ""),
        (r" ?'s? *$", ""),
        (r"\b([a-z])\.([a-z])\.([a-z])\.?( |$)", "$1$2$3 "),
        (r"\b([a-z])\.([a-z])\.( |$)", "$1$2 "),
        (r"\.", ". "),
        (r"[^a-z0-9.$]+", " "),
    ):
        sql = f"regexp_replace({sql}, {_quoted(pattern)}, '{to}')"
    return f"trim({sql})"


_LEGAL_SQL = "map(" + ", ".join(f"'{a}', '{b}'" for a, b in LEGAL.items()) + ")"
_LEGAL_LIST = "array(" + ", ".join(sorted({f"'{b}'" for b in LEGAL.values()})) + ")"

#: From a column ``c`` (a cleaned name): words without dots, legal forms unified.
_WORDS = f"filter(transform(split(c, ' '), w -> coalesce(try_element_at({_LEGAL_SQL}, replace(w, '.', '')), replace(replace(w, '.', ''), '$', ''))), w -> w <> '')"


def _names(table: str, name: str, keep: str) -> str:
    return f"SELECT {keep}, c, {_WORDS} AS words, filter({_WORDS}, w -> NOT array_contains({_LEGAL_LIST}, w)) AS core FROM (SELECT {keep}, {cleaned(folded(name))} AS c FROM {table})"


def aliases(reference: DataFrame) -> DataFrame:
    """canonical_id, alias, kind: the forms under which each item is known. An alias that several items share is dropped."""
    spark = reference.sparkSession
    name = f"lk_{uuid.uuid4().hex[:12]}_reference"
    reference.select("canonical_id", "canonical_name", "ticker", "former_name").createOrReplaceTempView(name)
    out = spark.sql(f"""
        WITH n AS ({_names("lk_reference", "canonical_name", "canonical_id, ticker, former_name")}),
        o AS ({_names("(SELECT * FROM lk_reference WHERE former_name IS NOT NULL)", "former_name", "canonical_id")}),
        a AS (
          SELECT canonical_id, array_join(words, '') AS alias, 'name' AS kind FROM n
          UNION ALL SELECT canonical_id, array_join(core, ''), 'core' FROM n
          UNION ALL SELECT canonical_id, array_join(array_sort(words), ' '), 'sorted' FROM n WHERE size(words) > 1
          UNION ALL SELECT canonical_id, array_join(array_sort(core), ' '), 'sorted' FROM n WHERE size(core) > 1
          UNION ALL SELECT canonical_id, words[0], 'first' FROM n WHERE size(words) > 1 AND length(words[0]) > 3
          UNION ALL SELECT canonical_id, array_join(words, ''), 'former' FROM o
          UNION ALL SELECT canonical_id, array_join(array_sort(words), ' '), 'sorted' FROM o WHERE size(words) > 1
          UNION ALL SELECT canonical_id, words[0], 'first' FROM o WHERE size(words) > 1 AND length(words[0]) > 3
          UNION ALL SELECT canonical_id, lower(trim(ticker)), 'ticker' FROM n WHERE length(trim(ticker)) > 1
        )
        SELECT max(canonical_id) AS canonical_id, alias, min(kind) AS kind, max(length(alias)) AS len
        FROM a WHERE alias <> '' GROUP BY alias HAVING count(DISTINCT canonical_id) = 1""".replace("lk_reference", name))
    spark.catalog.dropTempView(name)
    return out


def match_names(mentions: DataFrame, reference: DataFrame, edits: int = EDITS) -> DataFrame:
    """mention_id, name, canonical_id, distance, segments: a row per mention that stands for an item of the reference list. segments:
    into how many its alias was cut for the join that found it, ``edits`` + 1, or 1 for an alias that has to be equal; 0 for an
    abbreviated second word."""
    spark, own = mentions.sparkSession, f"lk_{uuid.uuid4().hex[:12]}_"
    made: list[str] = []

    def sql(text: str) -> DataFrame:
        return spark.sql(text.replace("lk_", own))

    def view(name: str, df: DataFrame) -> None:  # views of this call's own name
        made.append(name.replace("lk_", own))
        df.createOrReplaceTempView(made[-1])

    few = reference.count() <= BROADCAST_ITEMS
    hint, salts = ("/*+ BROADCAST(a) */", 1) if few else ("", SALTS)
    k1 = edits + 1
    view("lk_reference", reference.select("canonical_id", "canonical_name", "ticker", "former_name"))
    view("lk_alias", written(aliases(reference), "aliases"))
    view("lk_mention", mentions.select("mention_id", "name").where("name IS NOT NULL"))
    placeholders = ", ".join(_quoted(p) for p in PLACEHOLDERS)
    keyed = sql(f"""
        SELECT name, c, array_join(words, '') AS whole, array_join(core, '') AS short, words, core, regexp_extract(c, '(?:^|[a-z]{{2,4}} |[$])([a-z0-9]{{2,6}})$', 1) AS symbol
        FROM ({_names("(SELECT name FROM lk_mention GROUP BY name)", "name", "name")}) WHERE c NOT IN ({placeholders})""")
    view("lk_key", written(keyed, "keyed"))
    # The forms of a name, in the order in which they count.
    view("lk_form", sql("SELECT name, rank, form FROM lk_key LATERAL VIEW posexplode(array(whole, array_join(array_sort(words), ' '), short, array_join(array_sort(core), ' '), symbol)) f AS rank, form WHERE form <> ''"))
    # An alias is cut into k + 1 segments: whole names that are long enough for ``edits`` edits, others for none. The i-th of k + 1
    # segments of a string of length n begins after ((i - 1) * n) div (k + 1) characters.
    segments = sql(f"""
        SELECT canonical_id, alias, kind, len, parts, i, substr(alias, ((i - 1) * len DIV parts) + 1, (i * len DIV parts) - ((i - 1) * len DIV parts)) AS piece, salt
        FROM (SELECT *, CASE WHEN kind IN ('name', 'core', 'former') AND len >= {FUZZY_LENGTH} THEN {k1} ELSE 1 END AS parts FROM lk_alias)
        LATERAL VIEW explode(sequence(1, parts)) s AS i LATERAL VIEW explode(sequence(0, {salts - 1})) t AS salt""")
    view("lk_segment", segments)
    # Substrings of a form that can hold a segment of an alias of length len: shifts bounded from both ends. A frequent piece is
    # spread by a salt where the reference list is not broadcast.
    probes = sql(f"""
        WITH q AS (SELECT form, max(rank IN (0, 2)) AS whole FROM lk_form GROUP BY form),
        p AS (SELECT form, len, i, length(form) - len AS d FROM q
            LATERAL VIEW explode(sequence(length(form) - {edits}, length(form) + {edits})) l AS len
            LATERAL VIEW explode(sequence(1, {k1})) s AS i WHERE whole AND len >= {FUZZY_LENGTH})
        SELECT form, length(form) AS len, 1 AS parts, 1 AS i, form AS piece, 0 AS salt FROM q
        UNION ALL SELECT form, len, {k1}, i, substr(form, ((i - 1) * len DIV {k1}) + shift + 1, (i * len DIV {k1}) - ((i - 1) * len DIV {k1})) AS piece, CAST(pmod(xxhash64(form), {salts}) AS INT) FROM p
            LATERAL VIEW explode(CASE WHEN greatest(1 - i, d - ({k1} - i)) <= least(i - 1, d + ({k1} - i))
              THEN sequence(greatest(1 - i, d - ({k1} - i)), least(i - 1, d + ({k1} - i))) END) v AS shift
            WHERE ((i - 1) * len DIV {k1}) + shift >= 0""")
    view("lk_probe", probes)
    met = sql(f"""
        SELECT form, canonical_id, kind, parts, min(distance) AS distance FROM (
          SELECT form, canonical_id, kind, parts, levenshtein(form, alias, parts - 1) AS distance FROM (
            SELECT {hint} DISTINCT w.form, a.canonical_id, a.kind, a.parts, a.alias
            FROM lk_probe w JOIN lk_segment a ON a.parts = w.parts AND a.len = w.len AND a.i = w.i AND a.piece = w.piece AND a.salt = w.salt)
        ) WHERE distance >= 0 GROUP BY form, canonical_id, kind, parts""")
    view("lk_met", written(met, "met"))
    # The nearest item of each form, if only one is as near; aliases of one word only stand for whole names.
    view("lk_name", sql("""
        SELECT name, min_by(canonical_id, o) AS canonical_id, min(distance) AS distance, min_by(parts, o) AS segments FROM (
          SELECT name, canonical_id, distance, parts, struct(distance, rank) AS o, count(DISTINCT canonical_id) OVER (PARTITION BY name, distance, rank) AS n FROM (
            SELECT f.name, f.rank, m.canonical_id, m.parts, m.distance, min(m.distance) OVER (PARTITION BY f.name, f.rank) AS least
            FROM lk_form f JOIN lk_met m ON m.form = f.form
            WHERE CASE WHEN m.distance > 0 THEN f.rank IN (0, 2) WHEN m.kind = 'first' THEN f.rank = 0 ELSE f.rank < 4 OR m.kind = 'ticker' END
          ) WHERE distance = least
        ) WHERE n = 1 GROUP BY name""".replace("count(DISTINCT canonical_id) OVER (PARTITION BY name, distance, rank)", "size(collect_set(canonical_id) OVER (PARTITION BY name, distance, rank))")))
    # Abbreviated second word: "Heaproskot Foo." for "Heaproskot Foods LLC".
    view("lk_two", sql(f"SELECT canonical_id, words[0] AS w0, words[1] AS w1 FROM ({_names('lk_reference', 'canonical_name', 'canonical_id')}) WHERE size(words) > 1"))
    view("lk_short", sql(f"""
        SELECT name, max(canonical_id) AS canonical_id FROM (
          SELECT {hint} k.name, a.canonical_id FROM (
            SELECT name, split(c, ' ') AS w FROM lk_key WHERE c RLIKE '^[a-z0-9]+ [a-z]{{3,}}\\\\.$'
          ) k JOIN lk_two a ON a.w0 = k.w[0] AND startswith(a.w1, replace(k.w[1], '.', ''))
        ) GROUP BY name HAVING count(DISTINCT canonical_id) = 1"""))
    view("lk_all", sql("""
        SELECT n.name, CASE WHEN n.distance > 0 AND s.name IS NOT NULL THEN s.canonical_id ELSE n.canonical_id END AS canonical_id,
          CASE WHEN n.distance > 0 AND s.name IS NOT NULL THEN 0 ELSE n.distance END AS distance, CASE WHEN n.distance > 0 AND s.name IS NOT NULL THEN 0 ELSE n.segments END AS segments
        FROM lk_name n LEFT JOIN lk_short s ON s.name = n.name
        UNION ALL SELECT name, canonical_id, 0, 0 FROM lk_short LEFT ANTI JOIN lk_name USING (name)"""))
    out = sql(f"""
        SELECT m.mention_id, m.name, n.canonical_id, n.distance, n.segments
        FROM (SELECT *, coalesce(pmod(mention_id, {SALTS}), 0L) AS salt FROM lk_mention) m
        JOIN (SELECT *, explode(sequence(0L, {SALTS - 1}L)) AS salt FROM lk_all) n ON n.name = m.name AND n.salt = m.salt""")
    for name in made:
        spark.catalog.dropTempView(name)
    return out


def unmatched_names(mentions: DataFrame, reference: DataFrame, edits: int = EDITS) -> DataFrame:
    """mention_id, name of the mentions that stand for no item, through an anti-join."""
    return mentions.select("mention_id", "name").join(match_names(mentions, reference, edits).select("mention_id"), "mention_id", "left_anti")


def found(mentions: DataFrame, reference: DataFrame) -> DataFrame:
    """Mentions that stand for an item but are written otherwise than its name."""
    names = reference.select("canonical_id", "canonical_name")
    if reference.count() <= BROADCAST_ITEMS:
        names = F.broadcast(names)
    return match_names(mentions, reference).join(names, "canonical_id").where("name <> canonical_name").select("mention_id", "canonical_id").distinct()
