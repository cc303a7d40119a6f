"""Language-model scores by deleted interpolation.

A word's probability is a mixture of maximum-likelihood estimates of orders 0
(uniform) to ``order``. The mixture weights depend on how often the context was
seen (buckets of doubling frequency) and are learned by expectation
maximisation on counts that were held out: a part of the learning documents
tunes the weights against n-gram counts of the rest. Scores then use the counts
of all learning documents.

How it runs. Documents are packed into chunks of bounded size, stored
compressed in the shared folder. Each chunk asks for the counts of its distinct
n-grams: blobs of sorted hashes, one for each range of hashes. A task per range
adds up what all chunks have and answers each with a count for every hash it
asked for, in the same order, so an answer is small and no row is made for a
single n-gram. A tuning chunk is answered twice, without and with what is held
out for tuning. Ranges are as many as the tokens need; what is shuffled follows
the number of distinct n-grams per chunk and is blind to frequent words. Words
have hashes of 64 bits; longer n-grams have 24 bits more than the number of
tokens has (64 at most), so that one in 16 million shares its hash with another,
whatever the size of the corpus. The weights come from a histogram of quantised
probabilities whose size doesn't depend on the corpus.

Tokens are words without A-Z case, then one end per text. Nulls and ties: null
text is empty, which is the end alone. A null id counts as the empty string for
the hold-out rule; rows that repeat an id are scored each, and their text counts
each time. If there is nothing to learn from, only the uniform part remains. An
empty table gives an empty result. Other columns of the input are not read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwatch.llm.bytescan import Words, chain, release, slices
from loomwatch.llm.langid import crc_of_id
from loomwatch.llm.shared import stored

_TEST, _TUNE, _FIT = 0, 1, 2
_END, _BEGIN = np.uint64(0x2545F4914F6CDD1D), np.uint64(0xBF58476D1CE4E5B9)
_BUCKETS = 48
_SPARE_BITS = 24  # bits of an n-gram's hash beyond those of the number of tokens
_HEAD = struct.Struct("<QB")  # how many values, and bytes of each
_STEP = 4  # histogram cells for each doubling of a probability
_PACKED = "chunk long, split int, tokens long, payload binary"
_REQUEST = "level int, part int, chunk long, split int, hashes binary, counts binary"
_REPLY = "chunk long, level int, part int, fit binary, train binary, fit_types long, fit_tokens long, train_types long, train_tokens long"
_SCORE = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _planes(values: np.ndarray) -> bytes:
    """Non-negative values byte by byte, as many bytes as the largest needs, compressed."""
    v = values.astype("<u8")
    width = (int(v.max(initial=0)).bit_length() + 7) // 8
    raw = v.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()
    return _HEAD.pack(len(v), width) + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def _unplanes(blob: bytes) -> np.ndarray:
    n, width = _HEAD.unpack_from(blob)
    out = np.zeros((n, 8), np.uint8)
    if n and width:
        raw = pa.decompress(blob[_HEAD.size :], decompressed_size=n * width, codec="zstd")
        out[:, :width] = np.frombuffer(raw, np.uint8).reshape(width, n).T
    return out.view("<u8").ravel().astype(np.uint64)


def _parts_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    """The range of each hash; ranges are in the order of hashes."""
    return ((hashes >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def _unused_bits(level: int, tokens: int) -> np.uint64:
    """Low bits that a hash of this level is without."""
    return np.uint64(0 if level == 0 else max(0, 64 - _SPARE_BITS - tokens.bit_length()))


def _pack(rows: list[pa.RecordBatch]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        for r in rows:
            out.write_batch(r)
    return sink.getvalue().to_pybytes()


def _unpack(payload: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(payload).read_all().combine_chunks().to_batches()[0]


def pack_chunks(docs: DataFrame, id_col: str, text_col: str, folds: int, chunk_bytes: int) -> DataFrame:
    """Chunks of documents of one split each: test, tune or fit."""
    crc = crc_of_id(id_col, folds)
    split = F.when(crc == 0, _TEST).when(crc == 1, _TUNE).otherwise(_FIT).cast("int")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), split.alias("split"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made = TaskContext.get().partitionId() << 32, 0
        waiting: dict[int, list] = {s: [] for s in (_TEST, _TUNE, _FIT)}
        size = dict.fromkeys(waiting, 0)

        def flush(s: int) -> pa.RecordBatch:
            nonlocal made
            made += 1
            tokens = sum(len(Words(r.column(1)).hash) + r.num_rows for r in waiting[s])
            row = {"chunk": base + made, "split": s, "tokens": tokens, "payload": _pack(waiting[s])}
            waiting[s], size[s] = [], 0
            schema = pa.schema([("chunk", pa.int64()), ("split", pa.int32()), ("tokens", pa.int64()), ("payload", pa.binary())])
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                splits = part.column(1).to_numpy()
                for s in waiting:
                    mine = part.filter(pa.array(splits == s)).select(["doc_id", "text"])
                    if mine.num_rows:
                        waiting[s].append(mine)
                        size[s] += mine.nbytes
                        if size[s] >= chunk_bytes:
                            yield flush(s)
        for s in waiting:
            if waiting[s]:
                yield flush(s)

    return source.mapInArrow(run, _PACKED)


class _Sequence:
    """The tokens of a chunk, and its distinct n-grams of each order."""

    def __init__(self, payload: bytes, order: int, tokens: int):
        batch = _unpack(payload)
        self.doc_ids = batch.column(0)
        words = Words(batch.column(1))
        self.tokens = np.insert(words.hash, words.first[1:], _END)
        self.sizes = words.counts() + 1
        self.first = np.cumsum(self.sizes) - self.sizes
        self.opens = np.zeros(len(self.tokens), bool)
        self.opens[self.first] = True
        depth = np.arange(len(self.tokens)) - np.repeat(self.first, self.sizes)
        grams = self.tokens
        self.unique: list[np.ndarray] = []
        self.back: list[np.ndarray] = []
        for k in range(1, order + 1):
            if k > 1:
                earlier = np.full(len(self.tokens), _BEGIN)
                earlier[k - 1 :] = np.where(depth[k - 1 :] >= k - 1, self.tokens[: len(self.tokens) - k + 1], _BEGIN)
                grams = chain(earlier, grams + np.uint64(k))
            low = _unused_bits(k - 1, tokens)
            u, b = np.unique(grams >> low << low, return_inverse=True)
            self.unique.append(u)
            self.back.append(b.astype(np.int32))

    def counts(self, level: int) -> np.ndarray:
        return np.bincount(self.back[level], minlength=len(self.unique[level])).astype(np.uint64)

    def sums(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, self.first)


def gram_counts(packed: DataFrame, order: int, parts: int, tokens: int) -> DataFrame:
    """Each chunk's answers: counts in all learning documents and, for a tuning chunk, in the fit part; and totals (chunk -1)."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("level", pa.int32()), ("part", pa.int32()), ("chunk", pa.int64()), ("split", pa.int32()), ("hashes", pa.binary()), ("counts", pa.binary())])
        for batch in batches:
            for chunk, split, payload in zip(*(batch.column(k) for k in (0, 1, 2))):
                release()
                seq = _Sequence(payload.as_py(), order, tokens)
                for level in range(order):
                    hashes, counts, low = seq.unique[level], seq.counts(level), _unused_bits(level, tokens)
                    cuts = np.searchsorted(_parts_of(hashes, parts), np.arange(parts + 1))
                    rows = []
                    for p in range(parts):
                        h = hashes[cuts[p] : cuts[p + 1]] >> low
                        if len(h):
                            n = b"" if split.as_py() == _TEST else _planes(counts[cuts[p] : cuts[p + 1]])
                            rows.append((level, p, chunk.as_py(), split.as_py(), _planes(np.diff(h, prepend=np.uint64(0))), n))
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def answer(group: pd.DataFrame) -> pd.DataFrame:
        hashes = [np.cumsum(_unplanes(h), dtype=np.uint64) for h in group.pop("hashes")]
        ends = np.cumsum([len(h) for h in hashes])
        known, back = np.unique(np.concatenate(hashes), return_inverse=True)
        del hashes
        fit, train = np.zeros(len(known), np.int64), np.zeros(len(known), np.int64)
        pieces = np.split(back, ends[:-1])
        for where, split, counts in zip(pieces, group["split"], group["counts"]):
            if split != _TEST:
                n = _unplanes(counts).astype(np.int64)
                train[where] += n
                if split == _FIT:
                    fit[where] += n
        level, part = int(group["level"].iloc[0]), int(group["part"].iloc[0])
        rows = [(chunk, level, part, _planes(fit[w]) if split == _TUNE else b"", _planes(train[w]), 0, 0, 0, 0) for w, chunk, split in zip(pieces, group["chunk"], group["split"])]
        release()
        rows.append((-1, level, part, b"", b"", int((fit > 0).sum()), int(fit.sum()), int((train > 0).sum()), int(train.sum())))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in _REPLY.split(", ")])

    asked = packed.select("chunk", "split", "payload").mapInArrow(ask, _REQUEST)
    return asked.groupBy("level", "part").applyInPandas(answer, _REPLY)


def _estimates(seq: _Sequence, replies: pd.DataFrame, column: str, totals: dict) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Counts of order 1, probabilities of orders 0 to n, and buckets of the highest order's context."""
    tokens, types = totals[f"{column}_tokens"], totals[f"{column}_types"]
    replies = replies.sort_values(["level", "part"])
    counts = []
    for level in range(len(seq.unique)):
        blobs = replies.loc[replies["level"] == level, column]
        table = np.concatenate([_unplanes(b) for b in blobs]).astype(np.int64)
        counts.append(table[seq.back[level]])
    docs = totals[f"{column}_docs"]
    probabilities = [np.full(len(seq.tokens), 1.0 / (types + 1)), counts[0] / max(tokens, 1)]
    context = np.full(len(seq.tokens), tokens)
    for level in range(1, len(counts)):
        context = np.concatenate([[0], counts[level - 1][:-1]])
        context[seq.opens] = docs
        probabilities.append(counts[level] / np.maximum(context, 1))
    buckets = np.minimum(np.log2(context + 1).astype(np.int64), _BUCKETS - 1)
    return counts[0], probabilities, buckets


def learn_weights(histogram: pd.DataFrame, order: int, rounds: int = 60) -> np.ndarray:
    """Mixture weights by bucket (rows) and order 0 to n (columns), by expectation maximisation."""
    weights = np.full((_BUCKETS, order + 1), 1.0 / (order + 1))
    if not len(histogram):
        return weights
    p = np.column_stack([np.where(histogram[f"q{k}"] < 0, 0.0, np.exp2(-histogram[f"q{k}"] / _STEP)) for k in range(order + 1)])
    n, bucket = histogram["n"].to_numpy(float), histogram["bucket"].to_numpy()
    pooled = weights[0]
    for _ in range(rounds):  # one set of weights for all buckets, as a start and for unseen buckets
        share = p * pooled
        share /= share.sum(axis=1, keepdims=True)
        pooled = (share * n[:, None]).sum(axis=0) / n.sum()
    weights[:] = pooled
    for _ in range(rounds):
        share = p * weights[bucket]
        share /= share.sum(axis=1, keepdims=True)
        sums = np.zeros_like(weights)
        np.add.at(sums, bucket, share * n[:, None])
        sums += 2.0 * pooled  # a bucket with little data stays near the pooled weights
        weights = sums / sums.sum(axis=1, keepdims=True)
    return np.maximum(weights, 1e-9)


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, order: int = 3, chunk_bytes: int = 4 << 20, part_tokens: int = 400_000) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    packed = stored(pack_chunks(docs, id_col, text_col, folds, chunk_bytes), "lm-chunks")
    size = packed.groupBy("split").agg(F.sum("tokens").alias("tokens")).collect()
    tokens = int(sum(r["tokens"] for r in size))
    parts = max(4, -(-tokens // part_tokens))
    replies = stored(gram_counts(packed, order, parts, tokens), "lm-counts")
    sums = replies.filter("chunk = -1 AND level = 0").agg(*[F.sum(c).alias(c) for c in ("fit_types", "fit_tokens", "train_types", "train_tokens")]).first()
    totals = {k: int(v or 0) for k, v in sums.asDict().items()}
    answers = replies.filter("chunk >= 0").select("chunk", "level", "part", "fit", "train")
    scored = answers.drop("fit")
    end_docs = packed.select("split", "chunk", "payload")

    def count_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [_unpack(p.as_py()).num_rows for p in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=["split", "n"])

    by_split = {r["split"]: r["n"] for r in end_docs.mapInArrow(count_docs, "split int, n long").groupBy("split").agg(F.sum("n").alias("n")).collect()}
    totals["fit_docs"] = by_split.get(_FIT, 0)
    totals["train_docs"] = totals["fit_docs"] + by_split.get(_TUNE, 0)

    def tune(chunk: pd.DataFrame, mine: pd.DataFrame) -> pd.DataFrame:
        names = ["bucket", *[f"q{k}" for k in range(order + 1)], "n"]
        if not len(chunk):
            return pd.DataFrame(columns=names).astype("int64")
        seq = _Sequence(chunk["payload"].iloc[0], order, tokens)
        _, probabilities, buckets = _estimates(seq, mine, "fit", totals)
        with np.errstate(divide="ignore"):
            cells = [buckets, *[np.where(p > 0, np.round(-np.log2(np.where(p > 0, p, 1.0)) * _STEP), -1).astype(np.int64) for p in probabilities]]
        keys, n = np.unique(np.column_stack(cells), axis=0, return_counts=True)
        return pd.DataFrame(np.column_stack([keys, n]), columns=names)

    fields = ["bucket", *[f"q{k}" for k in range(order + 1)]]
    tuning = packed.filter(F.col("split") == _TUNE)
    mine = answers.drop("train").join(tuning.select("chunk"), "chunk", "left_semi")
    cells = tuning.groupBy("chunk").cogroup(mine.groupBy("chunk")).applyInPandas(tune, ", ".join(f"{f} long" for f in [*fields, "n"]))
    weights = learn_weights(cells.groupBy(*fields).agg(F.sum("n").alias("n")).toPandas(), order)
    shared = spark.sparkContext.broadcast(weights)

    def score(chunk: pd.DataFrame, mine: pd.DataFrame) -> pd.DataFrame:
        names = [c.split()[0] for c in _SCORE.split(", ")]
        if not len(chunk):
            return pd.DataFrame(columns=names)
        release()
        seq = _Sequence(chunk["payload"].iloc[0], order, tokens)
        counts, probabilities, buckets = _estimates(seq, mine, "train", totals)
        mixed = np.zeros(len(buckets))
        for k in range(order + 1):
            mixed += shared.value[buckets, k] * probabilities[k]
        n, v = totals["train_tokens"], totals["train_types"]
        base = np.log10((counts + 0.1) / (n + 0.1 * (v + 1)))
        return pd.DataFrame(
            {
                "doc_id": seq.doc_ids.to_pandas(integer_object_nulls=True),
                "held_out": int(chunk["split"].iloc[0]) == _TEST,
                "n_tokens": seq.sizes,
                "n_known": seq.sums((counts > 0).astype(np.int64)),
                "train_tokens": n,
                "base_score": seq.sums(base),
                "score": seq.sums(np.log10(mixed)),
            },
            columns=names,
        )

    return packed.groupBy("chunk").cogroup(scored.groupBy("chunk")).applyInPandas(score, _SCORE)
