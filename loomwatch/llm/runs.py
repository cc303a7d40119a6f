"""Periodic runs of words, from a dictionary of basic factors.

A run is a stretch of consecutive words with a smallest period ``q``, at least
``max(12, 2 * q)`` words long, that no neighbouring word extends with the same
period. The dictionary names, for each power of two ``L``, the factors of ``L``
words that a text repeats. Occurrences of one factor whose gaps are at most
``L / 2`` form an arithmetic progression, and its difference is a period that a
shorter length has met already. So only distances from ``L`` up to ``2 * L``
between members of different progressions are proposed as periods, and of two
progressions one side must be a first member: a pair that no word to its left
extends has one. That leaves a few pairs for each occurrence. The names of all
lengths give the longest common extension of a pair in one step per length.
Runs found with several periods keep the smallest.

How it runs: a text is the unit, and nothing is shuffled. Arrow batches are cut
by bytes of text; names are ranks within a batch and exact, as words are told
apart by their bytes. Memory is a few integers for each word and power of two
up to the longest repeated factor, so a very long text costs a multiple of its
own size in the task that reads it.

Nulls and ties: null and empty text have no words and no runs; their digests
are those of the empty string. A row without an id is not rewritten by the
report. Of runs of the greatest length the first by start, then by period, is
reported. Rows are independent of each other: repeated rows give repeated
results. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwatch.llm.bytescan import Words, slices, spread

LEAST = 12  #: words of the shortest run
_REPORT = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
_RUNS = "doc_id long, start long, length long, period long"


class _Bounds(Words):
    """Words without their hashes, which aren't needed here."""

    def lowered(self) -> np.ndarray:
        return self.data

    def _hashes(self, low: np.ndarray) -> np.ndarray:
        return np.zeros(0, np.uint64)


class Texts:
    """The words of a batch of texts: bytes without gaps, bounds, and names within each text."""

    def __init__(self, column: pa.Array):
        words = _Bounds(column)
        self.first = words.first
        self.size = words.end - words.start
        self.bytes = words.data[spread(words.start, self.size)]
        self.at = np.concatenate([[0], np.cumsum(self.size)])

    def names(self) -> np.ndarray:
        """An integer for each word; equal ones have equal bytes."""
        if not len(self.size):
            return np.zeros(0, np.int64)
        offsets, data = pa.py_buffer(self.at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(self.bytes))
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self.size), [None, offsets, data])
        return words.dictionary_encode().indices.to_numpy().astype(np.int64)


def _renamed(keys: np.ndarray) -> np.ndarray:
    """Names from 0 for keys that occur twice at least, -1 for others."""
    if not len(keys):
        return np.zeros(0, np.int32)
    _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    names = np.where(counts > 1, np.cumsum(counts > 1) - 1, -1)
    return names[inverse].astype(np.int32)


def dictionary(words: np.ndarray, doc: np.ndarray) -> list[np.ndarray]:
    """Names of the factors of 1, 2, 4, ... words at each position, as far as any text repeats one.

    Positions whose factor its text has once only, or which is cut off by the
    text's end, have -1. A name belongs to one text.
    """
    level = _renamed(doc * (int(words.max(initial=0)) + 1) + words)
    levels, length = [], 1
    while (level >= 0).any():
        levels.append(level)
        both = np.flatnonzero(level >= 0)
        both = both[both + length < len(level)]
        right = level[both + length]
        # The right half counts only inside the same text: a text's names are no other's.
        inside = (right >= 0) & (doc[np.minimum(both + length, len(doc) - 1)] == doc[both])
        both, right = both[inside], right[inside].astype(np.int64)
        level = np.full(len(level), -1, np.int32)
        level[both] = _renamed(levels[-1][both] * (int(right.max(initial=0)) + 1) + right)
        length *= 2
    return levels


def proposals(level: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of equal factors ``length`` to ``2 * length - 1`` apart, of different progressions, one of them the first of its own."""
    at = np.flatnonzero(level >= 0)
    order = np.argsort(level[at], kind="stable")
    at = at[order]
    key = level[at].astype(np.int64) * (len(level) + 1) + at
    begins = np.ones(len(at), bool)
    begins[1:] = (level[at[1:]] != level[at[:-1]]) | (2 * (at[1:] - at[:-1]) > length)
    progression = np.cumsum(begins) - 1
    heads = np.flatnonzero(begins)
    base = key[heads] - at[heads]

    def within(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = np.searchsorted(key, np.maximum(lo, base)), np.searchsorted(key, np.minimum(hi, base + len(level)))
        b = np.maximum(a, b)
        return np.repeat(heads, b - a), spread(a, b - a)

    head, later = within(key[heads] + length, key[heads] + 2 * length)
    head2, earlier = within(key[heads] - 2 * length + 1, key[heads] - length + 1)
    i, j = np.concatenate([head, earlier]), np.concatenate([later, head2])
    apart = progression[i] != progression[j]
    return at[i[apart]], at[j[apart]]


def find_runs(words: np.ndarray, first: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and period of every run of the texts ``words[first[k]:first[k + 1]]``, by start and period."""
    n = len(words)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    levels = dictionary(words, doc)
    padded = [np.append(level, np.int32(-1)) for level in levels]
    pairs = [proposals(level, 1 << k) for k, level in enumerate(levels)]
    i = np.concatenate([np.zeros(0, np.int64), *(p[0] for p in pairs)])
    j = np.concatenate([np.zeros(0, np.int64), *(p[1] for p in pairs)])
    if not len(i):
        return i, i, i
    opens = first[:-1][doc[i]] == i
    left = opens | (words[np.maximum(i - 1, 0)] != words[np.maximum(j - 1, 0)])
    i, j = i[left], j[left]
    period = j - i
    x, y = i.copy(), j.copy()
    for k in range(len(levels) - 1, -1, -1):
        names = padded[k]
        a, b = names[np.minimum(x, n)], names[np.minimum(y, n)]
        step = np.where((a >= 0) & (a == b), 1 << k, 0)
        x, y = x + step, y + step
    good = (y - i >= 2 * period) & (y - i >= least)
    i, y, period = i[good], y[good], period[good]
    order = np.lexsort((period, y, i))
    i, y, period = i[order], y[order], period[order]
    new = np.ones(len(i), bool)
    new[1:] = (i[1:] != i[:-1]) | (y[1:] != y[:-1])  # the smallest period of a stretch
    i, y, period = i[new], y[new], period[new]
    order = np.lexsort((y, period, i))
    return i[order], y[order], period[order]


def collapsed(n: int, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which of ``n`` words stay when every run keeps its first period only."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, start + period, 1)
    np.add.at(steps, end, -1)
    return np.cumsum(steps[:-1]) == 0


def rewritten(first: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """For each word the word that takes its place: every tenth text gets a periodic tail, by the crc32 of its id."""
    out = np.arange(int(first[-1]))
    for k in np.flatnonzero((crc >= 0) & (crc % 10 == 0) & (np.diff(first) > 0)):
        lo, n, g = int(first[k]), int(first[k + 1] - first[k]), int(crc[k]) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        out[lo + a : lo + n] = lo + a + np.arange(n - a) % p
    return out


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    key = F.col(id_col).cast("long")
    crc = F.coalesce(F.crc32(key.cast("string").cast("binary")), F.lit(-1).cast("long"))
    return docs.select(key.alias("doc_id"), crc.alias("crc"), F.col(text_col).cast("string").alias("text"))


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """One row per run of the texts as they are: doc_id, start (word number), length, period."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = Texts(part.column(2))
                start, end, period = find_runs(texts.names(), texts.first, least)
                row = np.searchsorted(texts.first, start, side="right") - 1
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(start - texts.first[row]), pa.array(end - start), pa.array(period)], names=["doc_id", "start", "length", "period"])

    return _source(docs, id_col, text_col).mapInArrow(run, _RUNS)


def run_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document, after every tenth got its periodic tail: the number of runs, the longest, and digests.

    ``runs_sha256`` is of every run's ``start,length,period`` and a line feed,
    ``collapsed_sha256`` of the words that stay, joined by one space.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = Texts(part.column(2))
                yield _report(part.column(0), part.column(1).to_numpy(), texts)

    return _source(docs, id_col, text_col).mapInArrow(run, _REPORT)


def _report(ids: pa.Array, crc: np.ndarray, texts: Texts) -> pa.RecordBatch:
    first = texts.first
    origin = rewritten(first, crc)
    start, end, period = find_runs(texts.names()[origin], first)
    origin = origin[collapsed(len(origin), start, end, period)]
    # kept words, each with a space behind it, then one digest a text
    size = texts.size[origin]
    at = np.concatenate([[0], np.cumsum(size + 1)])
    out = np.full(int(at[-1]), 0x20, np.uint8)
    out[spread(at[:-1], size)] = texts.bytes[spread(texts.at[origin], size)]
    stay = np.zeros(int(first[-1]) + 1, np.int64)
    keep = collapsed(int(first[-1]), start, end, period)
    stay[1:] = np.cumsum(keep)
    bounds = at[stay[first]]
    runs = np.searchsorted(start, first)
    columns: dict[str, list] = {name: [] for name in ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")}
    for k in range(len(first) - 1):
        lo, hi = runs[k], runs[k + 1]
        s, n, q = start[lo:hi] - first[k], end[lo:hi] - start[lo:hi], period[lo:hi]
        best = [None] * 4
        if hi > lo:
            b = int(np.argmax(n))  # the first of the longest, by start and period
            best = [int(s[b]), int(n[b]), int(q[b]), int(1000 * n[b] // q[b])]
        listed = "".join(f"{x},{y},{z}\n" for x, y, z in zip(s.tolist(), n.tolist(), q.tolist()))
        text = out[bounds[k] : max(bounds[k], bounds[k + 1] - 1)]
        for name, value in zip(columns, (int(hi - lo), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(text.tobytes()).hexdigest())):
            columns[name].append(value)
    arrays = [pa.array(v, pa.string() if name.endswith("sha256") else pa.int64()) for name, v in columns.items()]
    return pa.RecordBatch.from_arrays([ids, *arrays], names=["doc_id", *columns])
