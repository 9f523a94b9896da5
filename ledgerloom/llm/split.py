"""Problem 1: splitting oversized texts at natural boundaries.

A cut after p tokens has one farthest legal successor: the last boundary within the next ``max_tokens - overlap`` tokens, for the
piece that ends there begins ``overlap`` tokens before p. Where no boundary lies within reach, a hard cut takes its place. All
boundaries of all texts of an Arrow batch stand in one sorted array; a sorted-array join finds all successors at once, and squaring
the successor table (pointer doubling) marks every cut of every text in as many steps as the logarithm of the longest chain.

No shuffle: the rows stay where they are read. Texts too short to be oversized never leave the JVM.

Defined results: a null text gives no piece; a text within the limit gives one piece, itself (also the empty text); pieces cover
the text from its first to its last character; repeated rows give repeated pieces; columns other than the two named are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .forms import CONTROLS, IGNORABLE

MAX_TOKENS, OVERLAP = 800, 100

# The token pattern; a run of word characters joined over inner hyphens or apostrophes, or one other visible character.
TOKEN = re.compile(rf"\w+(?:[-'’]\w+)*|[^\w\s{IGNORABLE}{CONTROLS}]")
#: Paragraph and line ends; sentence ends, with closing quotes and brackets, before white space.
BOUNDARY = re.compile(r"\s*\n\s*|(?<=[.!?…。！？])[\"'”’»)\]]*\s+")

PIECES = "chunk_id string, piece_no int, n_pieces int, chunk_tokens int, token_start int, token_end int, natural boolean, text string"


def boundaries(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the tokens begin and end, and after how many tokens natural boundaries lie."""
    spans = np.array([m.span() for m in TOKEN.finditer(text)], np.int64).reshape(-1, 2)
    ends = np.fromiter((m.end() for m in BOUNDARY.finditer(text)), np.int64)
    return spans[:, 0], spans[:, 1], np.unique(np.searchsorted(spans[:, 0], ends))


def positions(natural: np.ndarray, n: int, overlap: int, step: int) -> np.ndarray:
    """All cuts that a greedy split of n tokens can make: the virtual start, natural boundaries, hard cuts in gaps, and the end."""
    natural = np.concatenate([[overlap], natural[(natural > overlap) & (natural < n)], [n]])
    hard = [np.arange(a + step, b, step) for a, b in zip(natural[:-1], natural[1:]) if b - a > step]
    return np.unique(np.concatenate([natural, *hard]))


def reached(at: np.ndarray, limit: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which positions the greedy chains from ``first`` pass: ``at`` is sorted, ``limit`` the reach of each position."""
    jump = np.searchsorted(at, limit, "right") - 1
    on = np.zeros(len(at), bool)
    on[first] = True
    while True:
        before = int(on.sum())
        on[jump[on]] = True
        jump = jump[jump]
        if int(on.sum()) == before:
            return on


def cuts(tokens: list[int], naturals: list[np.ndarray], max_tokens: int, overlap: int) -> list[np.ndarray]:
    """The ends of the pieces of each text, in tokens."""
    step, base, at, limit, first, sizes = max_tokens - overlap, 0, [], [], [], []
    for n, natural in zip(tokens, naturals):
        p = positions(natural, n, overlap, step)
        first.append(sum(sizes))
        sizes.append(len(p))
        at.append(p + base)
        limit.append(np.minimum(p + step, n) + base)
        base += n + step + 1
    if not at:
        return []
    on = reached(np.concatenate(at), np.concatenate(limit), np.array(first))
    on[first] = False
    edges, own = np.cumsum([0, *sizes]), np.concatenate(at)
    starts = np.cumsum([0, *(n + step + 1 for n in tokens)])
    return [own[a:b][on[a:b]] - s for a, b, s in zip(edges[:-1], edges[1:], starts)]


def pieces_of(ids: list, texts: list[str], max_tokens: int, overlap: int, with_text: bool = True) -> Iterator[tuple]:
    """Rows of PIECES for texts of one batch."""
    counts = [len(TOKEN.findall(t)) for t in texts]
    large = [i for i, n in enumerate(counts) if n > max_tokens]
    spans = {i: boundaries(texts[i]) for i in large}
    ends = dict(zip(large, cuts([len(spans[i][0]) for i in large], [spans[i][2] for i in large], max_tokens, overlap)))
    for i, (key, text) in enumerate(zip(ids, texts)):
        if i not in ends:
            yield key, 1, 1, counts[i], 0, counts[i], True, text if with_text else None
            continue
        begins, stops, natural = spans[i]
        m, marks = len(ends[i]), set(natural.tolist())
        for k, e in enumerate(ends[i].tolist()):
            s = 0 if k == 0 else int(ends[i][k - 1]) - overlap
            # Without an overlap the white space between two pieces belongs to the later one.
            a, b = (0 if k == 0 else int(begins[s]) if overlap else int(stops[s - 1])), (len(text) if k == m - 1 else int(stops[e - 1]))
            yield key, k + 1, m, len(begins), s, e, e in marks or k == m - 1, text[a:b] if with_text else None


def split_texts(df: DataFrame, key: str = "id", text: str = "text", max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP, with_text: bool = True, oversized_only: bool = False) -> DataFrame:
    """Ordered pieces of at most ``max_tokens`` tokens; neighbours share ``overlap`` tokens. A row per piece."""
    if not 0 <= overlap < max_tokens:
        raise ValueError("overlap must be at least 0 and less than max_tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["chunk_id", "piece_no", "n_pieces", "chunk_tokens", "token_start", "token_end", "natural", "text"]
        kinds = [pa.string(), *[pa.int32()] * 5, pa.bool_(), pa.string()]
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a in range(0, len(ids), 500):
                rows = [r for r in pieces_of(ids[a : a + 500], texts[a : a + 500], max_tokens, overlap, with_text) if r[2] > 1 or not oversized_only]
                columns = zip(*rows) if rows else [[]] * 8
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)

    own = df.select(F.col(f"`{key}`").cast("string").alias("chunk_id"), F.col(f"`{text}`").alias("text")).where("text IS NOT NULL")
    if oversized_only:  # a token has at least one character
        own = own.where(F.length("text") > max_tokens)
    return own.mapInArrow(run, PIECES)
