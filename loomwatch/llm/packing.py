"""Packing of tokenised documents into fixed-length sequences.

Shortest-pack-first over the histogram of lengths: lengths are placed longest
first, each into the open packs with the most room, and what is updated are the
counts of packing patterns, not single documents. Documents longer than a
sequence are first cut into full sequences and a rest. The patterns are then
joined back to the pieces by the rank of a piece among those of its length.

How it runs: texts are tokenised once, in Arrow batches, and only piece lengths
and checksums are kept (a written table). The histogram has at most
``sequence_length`` rows. Ranks are taken within (length, chunk) and shifted by
prefix sums over chunks, so that a length shared by a third of all pieces is
not numbered by one task.

Nulls and ties: a null or empty text is the end id alone. Rows with a null id
are packed like others. Ties between pieces of one length go by hash, id and
start; repeated rows with a repeated id get places of their own. Other columns
of the input are not read.
"""

from __future__ import annotations

import functools
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwatch.llm.bytescan import Words, slices, spread
from loomwatch.llm.shared import in_batches, stored

_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"

#: ASCII bytes that end a word of letters or digits, and always stand in tokens of their own.
_MARK = np.zeros(256, dtype=bool)
_MARK[[ord(c) for c in '.,;:!?&%$#*|()"=@+']] = True
_ALNUM = np.zeros(256, dtype=bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True


class _Pretokens(Words):
    """Words cut further where ASCII letters or digits meet ASCII marks."""

    def bounds(self, low: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> None:
        mark, alnum = _MARK[low], _ALNUM[low]
        meet = (mark[1:] & alnum[:-1]) | (alnum[1:] & mark[:-1])
        begins[1:] |= meet
        ends[:-1] |= meet


class WordEncoder:
    """Ids of words by a tokenizer whose tokens never cross white space.

    Each distinct word is encoded once per worker. Known words are flat arrays
    (hashes in order, place and number of ids), emptied beyond ``most`` words.
    Words of ASCII letters alone go to the vocabulary's merges directly, since
    lower case is all that the tokenizer does to them before.
    """

    def __init__(self, path: str, most: int = 800_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = self.tokenizer.model
        self.most = most
        self.forget()

    def forget(self) -> None:
        self.hash = np.zeros(0, np.uint64)
        self.at, self.n = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.uint32)

    def learn(self, words: _Pretokens, hashes: np.ndarray, where: np.ndarray) -> None:
        new = ~np.isin(hashes, self.hash, assume_unique=True)
        if len(self.hash) + int(new.sum()) > self.most:
            self.forget()
            new[:] = True
        if not new.any():
            return
        start, end = words.start[where[new]], words.end[where[new]]
        n, flat = [], []
        for lo in range(0, len(start), 10_000):  # Python objects for a few words at a time
            coded = self.codes([words.data[a:b].tobytes() for a, b in zip(start[lo : lo + 10_000], end[lo : lo + 10_000])])
            n.append(np.fromiter(map(len, coded), np.int32, len(coded)))
            flat.append(np.fromiter((i for ids in coded for i in ids), np.uint32, int(n[-1].sum())))
        n, flat = np.concatenate(n), np.concatenate(flat)
        to = np.searchsorted(self.hash, hashes[new])
        self.hash = np.insert(self.hash, to, hashes[new])
        self.at = np.insert(self.at, to, len(self.ids) + np.cumsum(n, dtype=np.int32) - n)
        self.n = np.insert(self.n, to, n)
        self.ids = np.concatenate([self.ids, flat])

    def codes(self, words: list[bytes]) -> list[list[int]]:
        coded: list = [None] * len(words)
        rest = []
        for k, word in enumerate(words):
            if word.isalpha() and len(word) < 1000:
                coded[k] = [t.id for t in self.merges.tokenize(word.lower().decode("ascii"))]
            else:
                rest.append(k)
        strings = [words[k].decode("utf-8", "replace") for k in rest]
        for k, e in zip(rest, self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)):
            coded[k] = e.ids
        return coded

    def encode(self, words: _Pretokens) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and where each word's ids begin."""
        if not len(words.hash):
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        hashes, where, back = np.unique(words.hash, return_index=True, return_inverse=True)
        self.learn(words, hashes, where)
        at = np.searchsorted(self.hash, hashes)[back]
        n = self.n[at].astype(np.int64)
        return self.ids[spread(self.at[at].astype(np.int64), n)], np.concatenate([[0], np.cumsum(n)])


@functools.lru_cache(maxsize=1)
def encoder_of(path: str) -> WordEncoder:
    """One encoder for all tasks of a Python worker: loading a tokenizer is slow and takes memory each time."""
    return WordEncoder(path)


def piece_reader(path: str, end_id: int, longest: int):
    """A function for mapInArrow: (id, text) batches to rows of pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                words = _Pretokens(part.column(1))
                ids, at = encoder.encode(words)
                bounds = at[words.first].tolist()
                raw = ids.astype("<u4").tobytes()
                special = b"<|" in words.data.tobytes()
                rows: list[tuple] = []
                for i, doc in enumerate(part.column(0).to_pylist()):
                    body = raw[4 * bounds[i] : 4 * bounds[i + 1]]
                    if special and "<|" in (text := part.column(1)[i].as_py() or ""):
                        whole = encoder.tokenizer.encode(text, add_special_tokens=False).ids
                        body = np.array(whole, "<u4").tobytes()
                    body += end
                    n = len(body) // 4
                    for a in range(0, n, longest):
                        b = min(a + longest, n)
                        rows.append((doc, a, b - a, zlib.crc32(body[4 * a : 4 * b]), n))
                columns = list(zip(*rows))
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    return run


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Packing patterns (count, lengths) that hold every length of the histogram.

    Work and result depend on the number of different lengths, not on counts.
    """
    room: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    spaces: list[int] = []  # a heap of the negative keys of room

    def put(space: int, count: int, lengths: tuple[int, ...]) -> None:
        if space not in room:
            room[space] = []
            heapq.heappush(spaces, -space)
        room[space].append((count, lengths))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} is not from 1 to {capacity}")
        while left:
            widest = -spaces[0] if spaces else 0
            if widest < length:
                put(capacity - length, left, (length,))
                break
            count, lengths = room[widest].pop()
            taken = min(count, left)
            if count > taken:
                room[widest].append((count - taken, lengths))
            elif not room[widest]:
                del room[widest]
                heapq.heappop(spaces)
            put(widest - length, taken, (*lengths, length))
            left -= taken
    return [pack for packs in room.values() for pack in packs]


def slot_table(patterns: list[tuple[int, tuple[int, ...]]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: ranks at which a slot begins, its first sequence, its offset there."""
    slots: dict[int, list[list[int]]] = {}
    base = 0
    for count, lengths in sorted(patterns, key=lambda p: (-sum(p[1]), p[1])):
        offset = 0
        for length in lengths:
            have = slots.setdefault(length, [])
            rank = have[-1][0] + have[-1][3] if have else 0
            have.append([rank, base, offset, count])
            offset += length
        base += count
    return {k: tuple(np.array(c, np.int64) for c in list(zip(*v))[:3]) for k, v in slots.items()}


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", sequence_length: int = 4096, end_id: int = 2, chunks: int = 10_000) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``chunks`` bounds the rows of the (length, chunk) table, besides
    ``sequence_length``: a length gets as many chunks as its share of pieces.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = stored(in_batches(source, piece_reader(tokenizer_path, end_id, sequence_length), _PIECES), "pack-pieces")
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most sequence_length rows
    slots = spark.sparkContext.broadcast(slot_table(shortest_pack_first(histogram, sequence_length)))
    total = sum(histogram.values())
    share = max(1000, -(-total // chunks))
    parts = spark.createDataFrame([(k, -(-n // share)) for k, n in sorted(histogram.items())] or [(0, 1)], "length long, parts long")
    cut = pieces.join(F.broadcast(parts), "length").withColumn("chunk", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.col("parts")))
    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    shift = cut.groupBy("length", "chunk").count().select("length", "chunk", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("shift"))
    inside = Window.partitionBy("length", "chunk").orderBy("doc_id", "start")
    ranked = (
        cut.withColumn("rank", F.row_number().over(inside) - 1)
        .join(shift, ["length", "chunk"])
        .select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("rank") + F.col("shift")).alias("rank"))
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = slots.value
        for batch in batches:
            length = batch.column(2).to_numpy()
            rank = batch.column(5).to_numpy()
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[order])) + 1
            for rows in np.split(order, cuts):
                if len(rows):
                    begin, base, at = table[int(length[rows[0]])]
                    k = np.searchsorted(begin, rank[rows], side="right") - 1
                    sequence[rows] = base[k] + rank[rows] - begin[k]
                    offset[rows] = at[k]
            columns = [*batch.columns[:5], pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:5], "sequence_id", "offset"])

    return in_batches(ranked, place, _PIECES + ", sequence_id long, offset long")
