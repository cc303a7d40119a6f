"""Document quality by gated attention over passages: multiple-instance learning.

A document is a bag of passages of 64 words. A passage is encoded from hashed
counts of byte trigrams, of one to three character classes, and four measures
of its words, by one learned layer. Gated attention, the product of a tanh and
a sigmoid gate, gives each passage a score; its softmax over the document
weighs the passages, and a logistic unit scores the weighted sum. Only
documents have labels: what to attend to is learned from them.

How it runs: all labelled rows outside the held-out fold are counted, and of
each class the ``most`` rows with the smallest hashes are learned from, which
bounds the sample whatever the input; their documents are joined, encoded once
and stored in ``SHARDS`` shards. A round starts every shard from the same
parameters, takes ``STEPS`` steps of Adam over it in a task of its own and
averages what comes back, some tens of kilobytes a shard. The logit is shifted
from the sample's odds to those of all labelled rows. Scoring is row-wise in
Arrow batches with the parameters broadcast; whole texts are read, and a text
costs a few kilobytes a passage while its batch is scored.

Nulls and ties: null and empty text are one passage without words and get a
score too. A null id counts as the empty string for the fold and matches no
label; null labels are not learned from, and labels other than 1 count as 0. A
document with several labels is a bag of each; of several texts under one id
the one with the least hash is learned from. With labels of one class or none,
every score is the smoothed share of label 1. Repeated rows get equal scores.
Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwatch.llm.bytescan import LOWER, slices, spread
from loomwatch.llm.langid import crc_of_id
from loomwatch.llm.runs import Texts
from loomwatch.llm.shared import stored

PASSAGE = 64  #: words
BUCKETS = 256  #: of each kind of hashed counts
WIDTH = 2 * BUCKETS + 4
SHARDS, ROUNDS, STEPS, BAGS = 16, 8, 32, 32
_ENCODED, _GATE = 32, 16

#: Classes of bytes: each sign is one of its own, letters, digits and what lies beyond ASCII fall together.
CLASS = np.arange(256, dtype=np.uint32)
CLASS[ord("0") : ord("9") + 1] = 1
CLASS[ord("A") : ord("Z") + 1] = 2
CLASS[ord("a") : ord("z") + 1] = 3
CLASS[128:] = 3


def _hashed(rolling: np.ndarray, salt: int) -> np.ndarray:
    mixed = (rolling ^ (rolling >> np.uint32(15))) * np.uint32(0x85EBCA6B + 2 * salt)
    return (mixed ^ (mixed >> np.uint32(13))) % np.uint32(BUCKETS)


def encode(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage (float32), and where each text's passages begin."""
    texts = Texts(column)
    counts = np.diff(texts.first)
    passages = np.maximum(-(-counts // PASSAGE), 1)
    begin = np.concatenate([[0], np.cumsum(passages)])
    word = np.arange(len(texts.size)) - np.repeat(texts.first[:-1], counts)
    of_word = np.repeat(begin[:-1], counts) + word // PASSAGE
    at = np.concatenate([[0], np.cumsum(texts.size + 1)])
    data = np.full(int(at[-1]), 0x20, np.uint8)
    data[spread(at[:-1], texts.size)] = texts.bytes
    of_byte = np.repeat(of_word, texts.size + 1)
    total = int(begin[-1])
    out = np.zeros((total, WIDTH), np.float32)

    def add(values: np.ndarray, n: int, salt: int, column_at: int) -> None:
        if len(values) < n:
            return
        with np.errstate(over="ignore"):
            rolling = np.zeros(len(values) - n + 1, np.uint32)
            for k in range(n):
                rolling = rolling * np.uint32(0x01000193) + values[k : len(values) - n + 1 + k]
            cell = _hashed(rolling, salt).astype(np.int64)
        where = of_byte[: len(cell)]
        whole = where == of_byte[n - 1 :]
        sums = np.bincount(where[whole] * BUCKETS + cell[whole], minlength=total * BUCKETS)
        out[:, column_at : column_at + BUCKETS] += sums.reshape(total, BUCKETS)

    add(LOWER[data].astype(np.uint32), 3, 7, 0)
    for n in (1, 2, 3):
        add(CLASS[data], n, n, BUCKETS)
    for lo in (0, BUCKETS):
        part = np.sqrt(out[:, lo : lo + BUCKETS])
        out[:, lo : lo + BUCKETS] = part / np.maximum(np.linalg.norm(part, axis=1, keepdims=True), 1e-9)
    words = np.bincount(of_word, minlength=total)
    if len(of_word):
        names = texts.names()
        distinct = np.unique(of_word * (int(names.max()) + 1) + names) // (int(names.max()) + 1)
        some = np.maximum(words, 1)
        letters = np.bincount(of_byte, weights=np.isin(CLASS[data], (2, 3)), minlength=total)
        length = np.bincount(of_word, weights=texts.size, minlength=total)
        out[:, -4] = np.bincount(distinct, minlength=total) / some
        out[:, -3] = np.log1p(length / some) / 3
        out[:, -2] = np.log1p(words) / 4
        out[:, -1] = letters / np.maximum(length, 1)
    return out, begin


def start(seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    draw = lambda *shape: rng.normal(0, shape[0] ** -0.5, shape).astype(np.float32)
    return {"W": draw(WIDTH, _ENCODED) * 2, "b": np.zeros(_ENCODED, np.float32), "V": draw(_ENCODED, _GATE), "U": draw(_ENCODED, _GATE), "w": draw(_GATE, 1)[:, 0], "c": draw(_ENCODED, 1)[:, 0], "d": np.zeros(1, np.float32)}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def forward(p: dict[str, np.ndarray], x: np.ndarray, begin: np.ndarray) -> dict[str, np.ndarray]:
    """Encodings h, attention a within each bag, bags z and logits."""
    h = np.tanh(x @ p["W"] + p["b"])
    t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
    s = (t * g) @ p["w"]
    bag = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    e = np.exp(s - np.maximum.reduceat(s, begin[:-1])[bag])
    a = e / np.add.reduceat(e, begin[:-1])[bag]
    z = np.add.reduceat(a[:, None] * h, begin[:-1], axis=0)
    return {"h": h, "t": t, "g": g, "a": a, "bag": bag, "z": z, "logit": z @ p["c"] + p["d"][0]}


def gradient(p: dict[str, np.ndarray], x: np.ndarray, begin: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Gradient of the mean logistic loss over the bags."""
    f = forward(p, x, begin)
    h, t, g, a, bag = (f[k] for k in ("h", "t", "g", "a", "bag"))
    off = ((_sigmoid(f["logit"]) - y) / len(y)).astype(np.float32)
    dz = off[:, None] * p["c"]
    dh = a[:, None] * dz[bag]
    da = (h * dz[bag]).sum(axis=1)
    ds = a * (da - np.add.reduceat(a * da, begin[:-1])[bag])
    dt, dg = ds[:, None] * p["w"] * g * (1 - t * t), ds[:, None] * p["w"] * t * g * (1 - g)
    dh = dh + dt @ p["V"].T + dg @ p["U"].T
    dx = dh * (1 - h * h)
    return {"W": x.T @ dx, "b": dx.sum(axis=0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ ds, "c": f["z"].T @ off, "d": np.array([off.sum()])}


def _fit_shard(p: dict[str, np.ndarray], bags: list[np.ndarray], y: np.ndarray, steps: int, seed: int, rate: float = 5e-3) -> dict[str, np.ndarray]:
    """Steps of Adam over the bags of one shard, which are gone through in a new order again and again."""
    p = {k: v.copy() for k, v in p.items()}
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    rng, order = np.random.default_rng(seed), np.zeros(0, np.int64)
    for n in range(1, steps + 1):
        if not len(order):
            order = rng.permutation(len(bags))
        some, order = order[:BAGS], order[BAGS:]
        begin = np.concatenate([[0], np.cumsum([len(bags[i]) for i in some])])
        grads = gradient(p, np.concatenate([bags[i] for i in some]).astype(np.float32), begin, y[some])
        for k, d in grads.items():
            d = d + 1e-4 * p[k]
            m[k] = 0.9 * m[k] + 0.1 * d
            v[k] = 0.99 * v[k] + 0.01 * d * d
            p[k] = (p[k] - rate * (m[k] / (1 - 0.9**n)) / (np.sqrt(v[k] / (1 - 0.99**n)) + 1e-8)).astype(np.float32)
    return p


def _flat(p: dict[str, np.ndarray]) -> bytes:
    return np.concatenate([p[k].ravel() for k in sorted(p)]).astype("<f4").tobytes()


def _shaped(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    ends = np.cumsum([like[k].size for k in sorted(like)])
    return {k: part.reshape(like[k].shape).astype(np.float32) for k, part in zip(sorted(like), np.split(flat, ends[:-1]))}


class Model:
    """Parameters and the shift of the logit; no parameters where nothing could be learned."""

    def __init__(self, parameters: dict[str, np.ndarray] | None, shift: float, share: float):
        self.parameters, self.shift, self.share = parameters, shift, share


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 3, held: int = 1, most: int = 4096) -> Model:
    """Learn from rows of ``labels`` whose ``crc_of_id`` modulo ``folds`` is not ``held``, ``most`` of each class at most."""
    source = labels.filter((crc_of_id(id_col, folds) != held) & F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    source = source.select(F.col(id_col).cast("long").alias("doc_id"), (F.col(label_col) == 1).cast("int").alias("y"))
    counts = {r["y"]: r["n"] for r in source.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = counts.get(0, 0), counts.get(1, 0)
    share = (n1 + 1) / (n0 + n1 + 2)
    if not n0 or not n1:
        return Model(None, 0.0, share)
    first = lambda y: source.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    sample = texts.join(F.broadcast(first(0).unionByName(first(1))), "doc_id")  # 2 * most rows
    sample = sample.groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("one")).select("doc_id", "y", "one.text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                x, begin = encode(part.column(2))
                bags = [x[a:b].astype("<f2").tobytes() for a, b in zip(begin, begin[1:])]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(bags, pa.binary())], names=["doc_id", "y", "bag"])

    encoded = sample.mapInArrow(run, "doc_id long, y int, bag binary").withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(SHARDS)).cast("int"))
    encoded = stored(encoded, "quality-sample")
    drawn = {r["y"]: r["n"] for r in encoded.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not drawn.get(0) or not drawn.get(1):
        return Model(None, 0.0, share)
    like = start()

    def fit(p: dict[str, np.ndarray], turn: int):
        flat = _flat(p)

        def shard(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values(["doc_id", "y"], kind="stable")
            bags = [np.frombuffer(b, "<f2").reshape(-1, WIDTH) for b in rows["bag"]]
            new = _fit_shard(_shaped(np.frombuffer(flat, "<f4"), like), bags, rows["y"].to_numpy(np.float32), STEPS, 1000 * turn + int(rows["shard"].iloc[0]))
            return pd.DataFrame({"shard": rows["shard"].iloc[:1], "rows": [len(rows)], "flat": [_flat(new)]})

        return shard

    p = like
    for turn in range(ROUNDS):
        parts = encoded.groupBy("shard").applyInPandas(fit(p, turn), "shard int, rows long, flat binary").collect()  # SHARDS rows
        parts.sort(key=lambda r: r["shard"])
        flat = sum(r["rows"] * np.frombuffer(r["flat"], "<f4").astype(np.float64) for r in parts) / sum(r["rows"] for r in parts)
        p = _shaped(flat, like)
    return Model(p, float(np.log(n1 / n0) - np.log(drawn[1] / drawn[0])), share)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", folds: int = 3, held: int = 1) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, n_passages, top_passage (the one most attended to)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), (crc_of_id(id_col, folds) == held).alias("held_out"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                x, begin = encode(part.column(2))
                if known.parameters is None:
                    score, top = np.full(part.num_rows, known.share), np.zeros(part.num_rows, np.int64)
                else:
                    f = forward(known.parameters, x, begin)
                    score = _sigmoid(f["logit"].astype(np.float64) + known.shift)
                    best = np.lexsort((np.arange(len(x)), -f["a"], f["bag"]))
                    top = best[begin[:-1]] - begin[:-1]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32)), pa.array(np.diff(begin)), pa.array(top)],
                    names=["doc_id", "held_out", "score", "predicted", "n_passages", "top_passage"],
                )

    return source.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, n_passages long, top_passage long")


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """Learn from the labels outside the held-out fold and score every document."""
    return predict(docs, train(docs, labels, id_col, text_col, label_col), id_col, text_col)
