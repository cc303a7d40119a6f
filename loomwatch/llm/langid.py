"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased, white space is folded, and the n-grams of 1 to ``n``
code points are hashed into ``2 ** bits`` features. Training adds up feature
counts per language in numpy blocks; the result is one matrix of log
probabilities, which is broadcast, and scoring is a sparse product per batch.

How it runs: every labelled row is learned from, none is sampled. A task adds
up its own counts first and sends one block of counts for each language and
slice of the features, so what is shuffled doesn't depend on the skew of
languages or sources. The matrix has ``languages x 2 ** bits`` doubles; more
than ``most_languages`` labels raise an error instead of a large broadcast.

Nulls and ties: a text that is null or has no letter is ``und`` with score 0.
Rows with a null label are scored and not learned from; a null id counts as
the empty string for the hold-out rule. Equal posteriors go to the label that
comes first in order. With nothing to learn from, all rows are ``und``. Other
columns of the input are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwatch.llm.bytescan import slices
from loomwatch.llm.shared import in_batches

_SLICE = 4096
_LATIN = re.compile("[A-Za-z]")
_ROWS, _CELLS = 64, 1 << 18  # texts counted at once, and cells of their sparse counts multiplied at once
_UNDEFINED = "und"


def crc_of_id(id_col: str, buckets: int) -> Column:
    """crc32 of the id's text, modulo ``buckets``."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(buckets))


def has_letter(text: str) -> bool:
    """Whether any character is a letter; digits and numbers of other scripts, as in a square or a circle, are none."""
    return _LATIN.search(text) is not None or any(map(str.isalpha, text))


def features(text: str, n: int, bits: int) -> np.ndarray:
    """Hashed n-grams of 1 to ``n`` code points."""
    points = np.frombuffer(f" {' '.join(text.lower().split())} ".encode("utf-32-le", "replace"), np.uint32)
    out, rolling = [], np.zeros(len(points), np.uint32)
    with np.errstate(over="ignore"):
        for k in range(n):
            if len(points) <= k:
                break
            rolling = rolling[: len(points) - k] * np.uint32(0x01000193) + points[k:] + np.uint32(k)
            mixed = (rolling ^ (rolling >> np.uint32(15))) * np.uint32(0x85EBCA6B)
            out.append(mixed >> np.uint32(32 - bits))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", folds: int = 5, n: int = 3, bits: int = 15, smoothing: float = 0.5, most_languages: int = 500) -> tuple[list[str], np.ndarray]:
    """Labels in order, and the matrix of log probabilities (labels x 2**bits + prior column).

    Learns from rows whose ``crc_of_id`` modulo ``folds`` is not 0.
    """
    source = docs.filter((crc_of_id(id_col, folds) != 0) & F.col(label_col).isNotNull() & F.col(text_col).isNotNull())
    source = source.select(F.col(label_col).alias("label"), F.col(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        docs_of: dict[str, int] = {}
        for batch in batches:
            for part in slices(batch, "text"):
                for label, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    if has_letter(text):
                        if label not in sums:
                            sums[label] = np.zeros(1 << bits, np.int64)
                        sums[label] += np.bincount(features(text, n, bits), minlength=1 << bits)
                        docs_of[label] = docs_of.get(label, 0) + 1
        for label, counts in sums.items():
            blocks = range(0, 1 << bits, _SLICE)
            yield pa.RecordBatch.from_pydict(
                {
                    "label": [label] * (len(blocks) + 1),
                    "slice": [-1, *blocks],
                    "counts": [np.array([docs_of[label]], "<i8").tobytes(), *(counts[b : b + _SLICE].astype("<i8").tobytes() for b in blocks)],
                },
                schema=pa.schema([("label", pa.string()), ("slice", pa.int32()), ("counts", pa.binary())]),
            )

    def add(group):
        total = sum(np.frombuffer(c, "<i8") for c in group["counts"])
        return group.iloc[:1].assign(counts=[total.tobytes()])

    schema = "label string, slice int, counts binary"
    labels = sorted(r[0] for r in source.select("label").distinct().limit(most_languages + 1).collect())
    if len(labels) > most_languages:
        raise ValueError(f"more than {most_languages} labels")
    rows = in_batches(source, count, schema).groupBy("label", "slice").applyInPandas(add, schema).collect()
    at = {label: i for i, label in enumerate(labels)}
    matrix, prior = np.zeros((len(labels), 1 << bits)), np.zeros(len(labels))
    for r in rows:
        values = np.frombuffer(r["counts"], "<i8")
        if r["slice"] < 0:
            prior[at[r["label"]]] = values[0]
        else:
            matrix[at[r["label"]], r["slice"] : r["slice"] + len(values)] = values
    seen = prior > 0
    labels, matrix, prior = [x for x, s in zip(labels, seen) if s], matrix[seen], prior[seen]
    logs = np.log(matrix + smoothing) - np.log((matrix + smoothing).sum(axis=1, keepdims=True))
    return labels, np.hstack([logs, np.log(prior / max(prior.sum(), 1))[:, None]])


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text", folds: int = 5, n: int = 3, bits: int = 15) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score (posterior of the prediction)."""
    scorer = _Scorer(docs, model, n, bits)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), (crc_of_id(id_col, folds) == 0).alias("held_out"), F.col(text_col).cast("string").alias("text"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                best, scores = scorer(part.column(2))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(best, pa.string()), pa.array(scores, pa.float64())],
                    names=["doc_id", "held_out", "lang_pred", "score"],
                )

    return in_batches(source, score, "doc_id long, held_out boolean, lang_pred string, score double")


class _Scorer:
    """Labels and posteriors of a column of texts, with the broadcast matrix."""

    def __init__(self, docs: DataFrame, model: tuple[list[str], np.ndarray], n: int, bits: int):
        self.labels, self.n, self.bits = model[0], n, bits
        self.logs = docs.sparkSession.sparkContext.broadcast(np.ascontiguousarray(model[1].T))

    def __call__(self, texts: pa.Array) -> tuple[list[str], list[float]]:
        table = self.logs.value
        given = texts.to_pylist()
        best, scores = [_UNDEFINED] * len(given), [0.0] * len(given)
        known = [i for i, t in enumerate(given) if self.labels and t is not None and has_letter(t)]
        for lo in range(0, len(known), _ROWS):
            rows = known[lo : lo + _ROWS]
            sums = _sparse_product(*_sparse_counts([features(given[i], self.n, self.bits) for i in rows], self.bits), table) + table[-1]
            top = sums.argmax(axis=1)
            share = 1 / np.exp(sums - sums[np.arange(len(rows)), top][:, None]).sum(axis=1)
            for i, k, s in zip(rows, top.tolist(), share.tolist()):
                best[i], scores[i] = self.labels[k], s
        return best, scores


def _sparse_counts(found: list[np.ndarray], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of features as a sparse matrix by rows: counts, columns, where each row begins."""
    size = np.array([len(f) for f in found])
    cells = np.concatenate(found).astype(np.int64) + np.repeat(np.arange(len(found)) << bits, size)
    dense = np.bincount(cells, minlength=len(found) << bits)
    have = np.flatnonzero(dense)
    return dense[have].astype(np.float64), have & ((1 << bits) - 1), np.searchsorted(have, np.arange(len(found) + 1) << bits)


def _sparse_product(counts: np.ndarray, columns: np.ndarray, begin: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The sparse matrix times ``table``, a bounded number of cells at a time."""
    out = np.zeros((len(begin) - 1, table.shape[1]))
    row = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    step = max(1, _CELLS // max(1, table.shape[1]))
    for lo in range(0, len(counts), step):
        some = slice(lo, lo + step)
        first = np.flatnonzero(np.diff(row[some], prepend=-1))
        out[row[some][first]] += np.add.reduceat(counts[some, None] * table[columns[some]], first, axis=0)
    return out


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """Train on the learning folds and predict every row."""
    return predict(docs, train(docs, id_col, text_col, label_col), id_col, text_col)


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", least: float = 0.5) -> DataFrame:
    """The rows whose language is recognised, with all their columns.

    Rejected are texts without a letter and those whose best posterior is
    below ``least``.
    """
    scorer = _Scorer(docs, train(docs, id_col, text_col, label_col), 3, 15)
    at = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                best, scores = scorer(part.column(at))
                yield part.filter(pa.array([b != _UNDEFINED and s >= least for b, s in zip(best, scores)], pa.bool_()))

    return in_batches(docs, keep, docs.schema)
