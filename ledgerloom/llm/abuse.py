"""Problem 9: abusive, hateful or sexual passages, by compression distance.

Two Zstandard dictionaries are made from labelled documents, one of ordinary and one of abusive windows (sentences). A window's
score is how many bytes a character it saves with the abusive dictionary against the ordinary one; a document's score is that of its
worst window. Labels belong to whole documents, of which one window or a few are abusive, and they are not always right: the abusive
windows are found by alternation, beginning with those whose words lean towards abusive documents, else with those that the ordinary
dictionary compresses worst, always scoring a window with dictionaries that haven't seen its document. The rule is the same for any
number of labels. The threshold is the one with the best F1 over held-out scores: for each of FOLDS parts of the labelled documents
everything (leanings, choice of windows, dictionaries) is made anew from the other parts only.

The dictionaries hold whole windows, chosen so that they cover the others, as raw content. Zstandard's own training (COVER), which
picks frequent fragments, was tried and does worse by far; the README has the figures.

Windows are brought into the consistent form, and spellings that evade word lists (stretched letters, letters apart, signs in place
of letters) into plain ones. Scoring reads each document once and shuffles nothing; the trainings run as tasks beside each other.

The fit uses a bounded sample of labelled documents: at most ``FIT_DOCUMENTS`` ordinary and abusive ones, by hash of the id. Everything else covers
all documents. Defined results: null and empty texts score 0 and aren't abusive; without labels of both classes all scores are 0;
labels of ties or nulls only are left out; a null source has its own row in the rates.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .forms import uncased_form

#: Most labelled documents of the fit, ordinary and abusive.
FIT_DOCUMENTS = (10_000, 2_500)
#: Parts for held-out scores, parts within a training, rounds of its alternation, and the compression level.
FOLDS, INNER, ROUNDS, LEVEL = 4, 3, 2, 3
#: From which leaning on a window counts as abusive.
LEAN = 1.6
#: Share of held-out ordinary windows that may stand out as much as a window taken for abusive: against the ordinary dictionary at first
#: and later on, and between the dictionaries.
FIRST_SHARE, HIGH_SHARE, SHARE = 0.02, 0.005, 0.003
DICTIONARY_BYTES = 112_640
#: Texts that are added to a dictionary at once.
GROWTH = 80
#: Windows of fewer characters join the next one; longer ones are cut at spaces.
SHORT, LONG = 25, 240
#: Capitalised words in a row that still count as a name.
LONGEST_NAME = 4

_END = re.compile(r"(?<=[.!?…])[\"'”’)\]]*\s+|\n+")
_MAYBE_APART, _JOINTS = re.compile(r"[-._*·]\w[-._*·]\w| \w \w \w "), re.compile(r"[-._*· ]")
_APART = re.compile(r"(?<!\w)[^\W\d_](?:[-._*·][^\W\d_]){2,}(?!\w)|(?<!\S)[^\W\d_](?: [^\W\d_]){3,}(?!\w)")
_STRETCHED = [c * 3 for c in "abcdefghijklmnopqrstuvwxyz"]
_STRETCH = re.compile(r"([^\W\d_])\1{2,}")
_MAYBE_SIGNED = re.compile(r"[@$!|013457](?:(?=[a-z])|(?<=[a-z].))")
_SIGNED = re.compile(r"(?=\S*[a-z])(?=\S*[@$!|013457])[a-z@$!|013457]{3,}")
_NAME = re.compile(r"(?<=.) [A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ’'-]+(?: [A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ’'-]+)*")
_NAME_LINE = re.compile(r"[^.!?…\n]+")
_NUMBER = re.compile(r"(?<![a-z@$!|\d])[$€£]?\d(?:[\d.,]*\d)?%?(?![a-z])")
#: German writes all nouns with capitals: there they are no sign of a name.
_GERMAN = re.compile(r"(?i)(?<!\w)(?:und|der|die|das|nicht|ist|ihr|du|dein|deine|mit|für|von|den)(?!\w)")
# Signs and the letters that they stand for.
_SIGNS = str.maketrans("@$!|013457", "asiloieast")


def plain(text: str) -> str:
    """A text with its names masked (runs of capitalised words within a sentence, but not the long ones of a title, nor in a sentence with
    two German function words), case and evasive spellings undone, and numbers masked."""
    text = _NAME_LINE.sub(_masked, uncased_form(text)).casefold()
    if _MAYBE_APART.search(text):
        text = _APART.sub(lambda m: _JOINTS.sub("", m[0]), text)
    if any(c in text for c in _STRETCHED):
        text = _STRETCH.sub(r"\1", text)
    text = _NUMBER.sub("0", text)
    return _SIGNED.sub(lambda m: m[0].translate(_SIGNS), text) if _MAYBE_SIGNED.search(text) else text


def _masked(m: re.Match[str]) -> str:
    sentence = m[0]
    if len(_GERMAN.findall(sentence)) > 1:
        return sentence
    return _NAME.sub(lambda n: " _" if n[0].count(" ") <= LONGEST_NAME else n[0], sentence)


def windows(text: str) -> list[str]:
    out, rest = [], ""
    for part in _END.split(plain(text)):
        rest = f"{rest} {part}" if rest else part
        while len(rest) > LONG:
            cut = rest.rfind(" ", SHORT, LONG)
            cut = cut if cut > 0 else LONG
            out.append(rest[:cut])
            rest = rest[cut:].lstrip()
        if len(rest) >= SHORT:
            out.append(rest)
            rest = ""
    if rest:
        out.append(rest)
    return out


def dictionary(texts: list[str]) -> bytes:
    """The content of a dictionary that covers the texts: part by part of them, those that it compresses worst yet are added to it."""
    samples = sorted({t.encode() for t in texts}, key=xxhash.xxh3_64_intdigest)
    size = sum(map(len, samples))
    if size <= DICTIONARY_BYTES:
        return b"\n".join(samples)
    kept = samples[:: max(1, len(samples) // 200)][:200]
    seen, room = set(kept), DICTIONARY_BYTES - sum(len(w) + 1 for w in kept)
    parts = max(1, math.ceil(room * len(samples) / size / GROWTH))
    for at in range(parts):
        cost, added = Scorer._compressor(b"\n".join(reversed(kept))), 0
        for w in sorted(samples[at::parts], key=lambda w: -len(cost(w)) / (len(w) + 40)):
            if added == GROWTH or room <= 0:
                break
            if w not in seen:
                seen.add(w)
                kept.append(w)
                room -= len(w) + 1
                added += 1
    return b"\n".join(reversed(kept))


class Scorer:
    """Compares compressed lengths with two dictionaries."""

    def __init__(self, ordinary: bytes, abusive: bytes):
        self.parts = [self._compressor(ordinary), self._compressor(abusive)]

    @staticmethod
    def _compressor(data: bytes):
        kept = zstandard.ZstdCompressionDict(data or b" ", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        kept.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=kept, write_content_size=False, write_dict_id=False, write_checksum=False).compress

    def window(self, text: str) -> float:
        data = text.encode()
        return (len(self.parts[0](data)) - len(self.parts[1](data))) / math.sqrt(len(data) * 60)

    def document(self, texts: list[str], known: dict[str, float] | None = None) -> tuple[float, str]:
        known = {} if known is None else known
        for w in texts:
            if w not in known:
                known[w] = self.window(w)
        return max(((known[w], w) for w in texts), default=(0.0, ""))


def _fold(key) -> int:
    return xxhash.xxh3_64_intdigest(str(key)) % FOLDS


def _inner(key) -> int:
    return xxhash.xxh3_64_intdigest(f"in{key}") % INNER


def _top(values: list[float], share: float) -> float:
    """The value that a share of the values exceeds."""
    ranked = sorted(values, reverse=True)
    return ranked[min(len(ranked) - 1, int(share * len(ranked)))] if ranked else 0.0


def leaning(ordinary: dict, abusive: dict, source: dict) -> Callable[[str], float]:
    """How much more often the three-word sequences of a window stand in abusive documents than ordinary documents would have it, those
    of the same sources and all of them: the mean logarithm of the three that lean most. Sequences of fewer than three abusive documents say nothing.
    As labels are not always right, the windows that lean are taken out of ordinary documents. In abusive ones they are taken first, and
    the others, rare wordings among them, on stronger evidence of the compression."""

    def sequences(w: str) -> set[str]:
        x = w.split()
        return {" ".join(x[i : i + 3]) for i in range(len(x) - 2)}

    held = lambda ws: {g for w in ws for g in sequences(w)}
    seen: Counter[str] = Counter()
    for ws in abusive.values():
        seen.update(held(ws))
    by_source: dict = {}
    for i, ws in ordinary.items():
        by_source.setdefault(source.get(i), Counter()).update(g for g in held(ws) if seen[g] >= 3)
    sizes, asked = Counter(source.get(i) for i in ordinary), Counter(source.get(i) for i in abusive)

    def one(g: str) -> float:
        expected = sum(n * (by_source.get(k, {}).get(g, 0) + 0.3) / (sizes[k] + 1) for k, n in asked.items())
        overall = len(abusive) * (sum(c[g] for c in by_source.values()) + 0.3) / (len(ordinary) + 1)
        return math.log((seen[g] + 0.5) / (max(expected, overall) + 0.5))

    leans = {g: one(g) for g, n in seen.items() if n >= 3}
    return lambda w: sum(sorted((leans[g] for g in sequences(w) if g in leans), reverse=True)[:3]) / 3


def train(ordinary: dict, abusive: dict, source: dict) -> tuple[bytes, bytes]:
    """Dictionaries of ordinary and abusive windows from windows and sources of labelled documents by id."""
    lean = leaning(ordinary, abusive, source)
    ordinary = {i: [w for w in ws if lean(w) < LEAN] for i, ws in ordinary.items()}
    leaning_on = {i: {w for w in ws if lean(w) >= LEAN} for i, ws in abusive.items()}
    plain_ = {k: dictionary([w for i, ws in ordinary.items() if _inner(i) != k for w in ws]) for k in range(INNER)}

    def badly(k: int) -> Callable[[str], float]:
        size = Scorer._compressor(plain_[k])
        return lambda w: len(size(w.encode())) / (len(w.encode()) + 40)

    # What leans is taken first, else what stands out against ordinary documents that the dictionary hasn't seen.
    chosen: dict = {}
    for k in range(INNER):
        f = badly(k)
        bar = _top([f(w) for i, ws in ordinary.items() if _inner(i) == k for w in ws], FIRST_SHARE)
        for i, ws in abusive.items():
            if _inner(i) == k:
                chosen[i] = [w for w in ws if w in leaning_on[i]] or [w for w in sorted(ws, key=f, reverse=True)[:2] if f(w) > bar]
    for _ in range(ROUNDS):
        again = {}
        for k in range(INNER):
            s, f = Scorer(plain_[k], dictionary([w for i, ws in chosen.items() if _inner(i) != k for w in ws] or [" "])), badly(k)
            others = [w for i, ws in ordinary.items() if _inner(i) == k for w in ws]
            bar, high = _top([s.window(w) for w in others], SHARE), _top([f(w) for w in others], HIGH_SHARE)
            for i, ws in abusive.items():
                if _inner(i) == k:
                    taken = [w for w in ws if (v := s.window(w)) > 0 and w in leaning_on[i] or v > bar and f(w) > high]
                    again[i] = taken or [w for w in sorted(ws, key=f, reverse=True)[:1] if f(w) > high]
        chosen = again
    return dictionary([w for ws in ordinary.values() for w in ws]), dictionary([w for ws in chosen.values() for w in ws] or [" "])


def held_out(ordinary: dict, abusive: dict, source: dict, fold: int) -> tuple[bytes, bytes, list[tuple[float, int]]]:
    """The dictionaries made without one part of the documents, and that part's scores with them; of all documents if there is no such part."""
    rest = [{i: ws for i, ws in group.items() if _fold(i) != fold} for group in (ordinary, abusive)]
    if not all(rest):
        return b"", b"", []
    made = train(*rest, source)
    s = Scorer(*made)
    return *made, [(s.document(ws)[0], bad) for bad, group in enumerate((ordinary, abusive)) for i, ws in group.items() if _fold(i) == fold]


def fit(ordinary: dict, abusive: dict, source: dict | None = None) -> tuple[bytes, bytes, float]:
    """Dictionaries and threshold from windows and sources of labelled documents by id, all in this process."""
    if not ordinary or not abusive:
        return b"", b"", math.inf
    *parts, whole = (held_out(ordinary, abusive, source or {}, k) for k in range(FOLDS + 1))
    return whole[0], whole[1], threshold([x for p in parts for x in p[2]])


def fitted(spark: SparkSession, ordinary: dict, abusive: dict, source: dict) -> tuple[bytes, bytes, float]:
    """As ``fit``, each training a task of its own."""
    if not ordinary or not abusive:
        return b"", b"", math.inf
    shared = spark.sparkContext.broadcast((ordinary, abusive, source))  # bounded by FIT_DOCUMENTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                a, b, scores = held_out(*shared.value, k)
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([a], pa.binary()), pa.array([b], pa.binary()), pa.array([[v for v, _ in scores]], pa.list_(pa.float64())), pa.array([[x for _, x in scores]], pa.list_(pa.int64()))], ["fold", "plain", "abusive", "scores", "bad"])

    rows = spark.range(0, FOLDS + 1, 1, FOLDS + 1).toDF("fold").mapInArrow(run, "fold bigint, plain binary, abusive binary, scores array<double>, bad array<bigint>").collect()
    whole = next(r for r in rows if r["fold"] == FOLDS)
    return bytes(whole["plain"]), bytes(whole["abusive"]), threshold([x for r in sorted(rows, key=lambda r: r["fold"]) if r["fold"] < FOLDS for x in zip(r["scores"], r["bad"])])


def threshold(scores: list[tuple[float, int]]) -> float:
    """Midway between the two scores at which F1 is best, at least 0: a window must save bytes with the abusive dictionary."""
    ranked = sorted(scores, reverse=True)
    total, hits, best, at = sum(b for _, b in ranked), 0, -1.0, math.inf
    for n, (v, bad) in enumerate(ranked, 1):
        hits += bad
        below = ranked[n][0] if n < len(ranked) else v - 0.1
        if below < v and (f := 2 * hits / (n + total)) > best:
            best, at = f, (v + below) / 2
    return max(at, 0.0)


def labelled(documents: DataFrame, labels: DataFrame, most: tuple[int, int] = FIT_DOCUMENTS) -> tuple[dict, dict, dict]:
    """Windows and sources of at most ``most`` documents of each class: the majority of a document's judgements decides."""
    votes = labels.where("abusive IS NOT NULL").groupBy("doc_id").agg(F.avg("abusive").alias("a")).where("a <> 0.5")
    ranked = votes.withColumn("bad", F.col("a") > 0.5).withColumn("h", F.xxhash64("doc_id"))
    sample = ranked.where("bad").orderBy("h", "doc_id").limit(most[1]).unionByName(ranked.where("NOT bad").orderBy("h", "doc_id").limit(most[0]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = pa.array([windows(t) or [" "] for t in batch.column(3).to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], cut], ["doc_id", "source", "bad", "windows"])

    own = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", "text").where("text IS NOT NULL").join(F.broadcast(sample.select("doc_id", "bad")), "doc_id")
    rows = own.dropDuplicates(["doc_id"]).select("doc_id", "source", "bad", "text").mapInArrow(run, "doc_id bigint, source string, bad boolean, windows array<string>").collect()
    out: tuple[dict, dict, dict] = {}, {}, {}
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        out[int(r["bad"])][r["doc_id"]] = r["windows"]
        out[2][r["doc_id"]] = r["source"]
    return out


def score(documents: DataFrame, labels: DataFrame, most: tuple[int, int] = FIT_DOCUMENTS) -> DataFrame:
    """doc_id, source, score, abusive, passage (the worst window of abusive documents)."""
    ordinary, abusive, limit = fitted(documents.sparkSession, *labelled(documents, labels, most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(ordinary, abusive) if limit < math.inf else None
        for batch in batches:
            ids, sources, texts = (c.to_pylist() for c in batch.columns)
            known: dict[str, float] = {}  # masked sentences recur
            got = [scorer.document(windows(t), known) if scorer and t else (0.0, "") for t in texts]
            bad = [w != "" and v > limit for v, w in got]
            columns = [pa.array(ids, pa.int64()), pa.array(sources, pa.string()), pa.array([v for v, _ in got], pa.float64()), pa.array(bad, pa.bool_()), pa.array([w if b else None for (_, w), b in zip(got, bad)], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "source", "score", "abusive", "passage"])

    return documents.select(F.col("doc_id").cast("bigint"), "source", "text").mapInArrow(run, "doc_id bigint, source string, score double, abusive boolean, passage string")


def rates(scored: DataFrame) -> DataFrame:
    """source, n_documents, n_abusive, rate, mean_score."""
    return scored.groupBy("source").agg(F.count("*").alias("n_documents"), F.sum(F.col("abusive").cast("int")).alias("n_abusive"), F.avg(F.col("abusive").cast("int")).alias("rate"), F.avg("score").alias("mean_score"))


def found(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return score(documents, labels).where("abusive").select("doc_id").distinct()
