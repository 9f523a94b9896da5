"""Problem 7: evaluation texts that leak into training text.

Every window of ``WORDS`` consecutive words gets a 64-bit SimHash over its two-word shingles, on the evaluation side and on the corpus
side. The fingerprints are cut into RADIUS + 1 blocks; two fingerprints within RADIUS bits agree in one block at least, so looking up
each block finds all of them. Candidates are verified by their exact weighted-shingle similarity (a shingle weighs the more, the fewer
evaluation windows hold it); a similarity of 1 means that all words are equal.

The corpus is never shuffled; only matches leave a task. The evaluation side is counted, and up to ``SLICE`` items are looked up in
one pass over the corpus with one broadcast index (under 70 MB); a larger set is taken in slices of that size, a pass for each, so that
neither the driver nor a task ever holds more. Equal windows of several items are looked up once.

Defined results: null or empty texts and texts of fewer words than a window match nothing; an item given twice is reported once per id;
repeated documents are reported once per id; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .forms import WORD, one_form

WORDS, RADIUS = 12, 2
#: Most items of an index: at about 70 windows each, under 70 MB.
SLICE = 10_000
#: Words that are fingerprinted at once.
CHUNK = 20_000

FOUND = "doc_id bigint, eval_id string, field string, n_windows int, weight double, of_weight double"


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got


def word_hashes(text: str, cache: _Hashes) -> np.ndarray:
    words = WORD.findall(one_form(text))
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


def shingles(words: np.ndarray) -> np.ndarray:
    """A hash of each pair of neighbouring words."""
    with np.errstate(over="ignore"):
        h = words[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ (words[1:] + np.uint64(0xD1B54A32D192ED03)) * np.uint64(0xC2B2AE3D27D4EB4F)
        return (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)


def simhashes(pairs: np.ndarray, width: int) -> np.ndarray:
    """The SimHash of each window of ``width`` shingles."""
    bits = np.unpackbits(pairs.view(np.uint8).reshape(-1, 8), axis=1)
    n, total, done, power, span = len(pairs) - width + 1, None, 0, bits, 1
    while True:  # sums over windows of 1, 2, 4, ... shingles; those of the binary digits of the width make up its sums
        if width & span:
            piece = power[done : done + n]
            total = piece if total is None else total + piece
            done += span
        if span * 2 > width:
            return np.packbits(total > width // 2, axis=1).view(np.uint64).ravel()
        power, span = power[:-span] + power[span:], span * 2


def blocks(radius: int) -> list[tuple[np.uint64, np.uint64]]:
    """Shift and mask of each of the radius + 1 blocks."""
    edges = [64 * i // (radius + 1) for i in range(radius + 2)]
    return [(np.uint64(a), np.uint64((1 << (b - a)) - 1)) for a, b in zip(edges[:-1], edges[1:])]


class Index:
    """The windows of evaluation texts, each different one once, looked up by blocks of their fingerprints.

    The shingles of all texts lie end to end; a window is the place where it begins, so an index takes about 60 bytes a window.
    """

    def __init__(self, items: list[tuple[str, str, str | None]], words: int = WORDS, radius: int = RADIUS):
        self.words, self.radius, cache, width = words, radius, _Hashes(), words - 1
        self.owners: list[tuple[str, str]] = []
        texts, prints = [], []
        for key, field, text in items:
            h = word_hashes(text or "", cache)
            if len(h) >= words:
                texts.append(shingles(h))
                prints.append(simhashes(texts[-1], width))
                self.owners.append((key, field))
        sizes = np.array([len(t) for t in texts], np.int64)
        begins, counts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64) if texts else np.zeros(0, np.int64), sizes - width + 1
        self.flat = np.concatenate(texts) if texts else np.zeros(0, np.uint64)
        starts = np.concatenate([b + np.arange(n) for b, n in zip(begins, counts)]) if texts else np.zeros(0, np.int64)
        of = np.repeat(np.arange(len(texts)), counts)
        # A shingle weighs the more, the fewer windows hold it: each place lies in as many windows of its text as reach over it.
        at = np.arange(len(self.flat)) - np.repeat(begins, sizes)
        covering = np.minimum(np.minimum(at + 1, np.repeat(sizes, sizes) - at), np.minimum(width, np.repeat(counts, sizes)))
        _, place = np.unique(self.flat, return_inverse=True)
        self.weights = (1 / np.bincount(place, covering))[place] if texts else np.zeros(0)
        sums = np.concatenate([[0.0], np.cumsum(self.weights)])
        totals = sums[starts + width] - sums[starts]
        self.of_weight = np.bincount(of, totals, len(texts)) if texts else np.zeros(0)
        # Equal windows are one window with several owners.
        with np.errstate(over="ignore"):
            same = np.zeros(len(starts), np.uint64)
            for k in range(width):
                same = same * np.uint64(0x9E3779B97F4A7C15) + self.flat[starts + k]
        _, first, inverse = np.unique(same, return_index=True, return_inverse=True)
        order = np.argsort(inverse, kind="stable")
        self.own_edges, self.own = np.searchsorted(inverse[order], np.arange(len(first) + 1)), of[order].astype(np.int32)
        self.starts, self.totals = starts[first], totals[first]
        self.prints = (np.concatenate(prints) if prints else np.zeros(0, np.uint64))[first]
        self.tables = []
        for shift, mask in blocks(radius):
            part = self.prints >> shift & mask
            order = np.argsort(part, kind="stable").astype(np.int32)
            there = np.zeros(int(mask) + 1, bool)
            there[part.astype(np.int64)] = True
            self.tables.append((shift, mask, there, part[order].astype(np.uint32), order))

    def owners_of(self, window: int) -> list[int]:
        return self.own[self.own_edges[window] : self.own_edges[window + 1]].tolist()

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (place in ``prints``, window of the index) within the radius, each once."""
        left, right = [], []
        for shift, mask, there, sorted_part, order in self.tables:
            part = (prints >> shift & mask).astype(np.uint32)
            hit = np.flatnonzero(there[part.astype(np.int64)])
            a, b = np.searchsorted(sorted_part, part[hit], "left"), np.searchsorted(sorted_part, part[hit], "right")
            n = b - a
            at = np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)
            l, r = np.repeat(hit, n), order[at]
            close = np.bitwise_count(prints[l] ^ self.prints[r]) <= self.radius
            left.append(l[close])
            right.append(r[close])
        pairs = np.unique(np.stack([np.concatenate(left), np.concatenate(right)]), axis=1) if self.tables else np.zeros((2, 0), np.int64)
        return pairs[0], pairs[1]

    def verified(self, s: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (window of a text's shingles ``s``, window of the index) of a weighted similarity of at least ``least``."""
        width = self.words - 1
        if len(s) < width or not len(self.prints):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        l, r = self.near(simhashes(s, width))
        place = self.starts[r][:, None] + np.arange(width)
        same = s[l[:, None] + np.arange(width)] == self.flat[place]
        good = (same * self.weights[place]).sum(1) >= (least - 1e-9) * self.totals[r]
        return l[good], r[good]


def matches(ids: list, texts: list[str | None], index: Index, least: float) -> Iterator[tuple]:
    """Rows of FOUND. Texts are laid end to end, and cut into overlapping chunks, so that any text length is served alike."""
    cache = _Hashes()
    width = index.words - 1
    hold: list[tuple[object, np.ndarray]] = []
    size = 0

    def flush() -> Iterator[tuple]:
        words = np.concatenate([h for _, h in hold])
        edges = np.cumsum([0, *(len(h) for _, h in hold)])
        s = shingles(words)
        hits: dict[tuple[int, int], set[int]] = {}
        for a in range(0, len(s), CHUNK):
            l, r = index.verified(s[a : a + CHUNK + width - 1], least)
            l = l + a
            own = np.searchsorted(edges, l, "right") - 1
            inside = l + index.words <= edges[own + 1]
            for o, w in set(zip(own[inside].tolist(), r[inside].tolist())):
                for item in index.owners_of(w):
                    hits.setdefault((o, item), set()).add(w)
        for (o, item), windows in hits.items():
            at = np.fromiter(windows, np.int64)
            yield hold[o][0], *index.owners[item], len(windows), float(index.totals[at].sum()), float(index.of_weight[item])

    for key, text in zip(ids, texts):
        if text:
            h = word_hashes(text, cache)
            if len(h) >= index.words:
                hold.append((key, h))
                size += len(h)
        if size >= CHUNK:
            yield from flush()
            hold, size = [], 0
    if hold:
        yield from flush()


def leaks(documents: DataFrame, evaluation: DataFrame, words: int = WORDS, radius: int = RADIUS, least: float = 1.0) -> DataFrame:
    """A row per document, evaluation item and field (question, expected) of which the document holds at least one window: how many of
    its windows, and their weight of the item's whole weight."""
    spark = documents.sparkSession
    n = evaluation.count()
    slices = max(1, -(-n // SLICE))
    own = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text"))
    part = evaluation.select("id", "question", "expected").withColumn("slice", F.pmod(F.xxhash64("id"), F.lit(slices)))
    out = None
    for k in range(slices):
        items = [(r["id"], f, r[f]) for r in part.where(F.col("slice") == k).collect() if r["id"] is not None for f in ("question", "expected")]
        shared = spark.sparkContext.broadcast(Index(items, words, radius))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.float64(), pa.float64()]
            for batch in batches:
                rows = list(matches(batch.column(0).to_pylist(), batch.column(1).to_pylist(), shared.value, least))
                columns = list(zip(*rows)) or [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], ["doc_id", "eval_id", "field", "n_windows", "weight", "of_weight"])

        got = own.mapInArrow(run, FOUND)
        out = got if out is None else out.unionByName(got)
    return out


def found(documents: DataFrame, evaluation: DataFrame) -> DataFrame:
    return leaks(documents, evaluation).select("doc_id", "eval_id").distinct()
