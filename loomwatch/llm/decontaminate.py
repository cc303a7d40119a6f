"""Benchmark decontamination: passages within an edit distance of a benchmark item.

Words are letters and digits without case or punctuation. The CGK embedding
walks over a word sequence: at each step it writes the current word and moves
on or stays, as a random bit of (step, word) says; twice as many steps as words
lead it over the whole sequence. Two sequences at a small edit distance fall
into step again after an edit, so their embeddings agree in many places: edit
distance becomes Hamming distance. Bit sampling then reads a few places of the
embedding as a key; ``walks`` walks, each with its own samples, are repeated so
that a passage at the largest allowed distance shares a key with its item with
the target recall. Windows that share a key with an item are verified by the
exact edit distance of the item to the best part of the window and its
surroundings.

How it runs: the benchmark is cut into blocks of about ``block_words`` words,
the items of each distinct text once. A block is broadcast, and every document
is scanned against it where it lies, in Arrow batches: there is no shuffle of
texts or windows, no task holds more than a slice of a few MB, and a lost
executor costs its tasks alone. A larger benchmark means more blocks and more
scans, never a larger broadcast. A window is embedded only if enough of its
word pairs occur in items of its size: one within ``d`` edits of an item of
``m`` words has ``m - 1 - 2 d`` of them, so nothing is lost. Windows with the
same words, as those of passages that many documents share, are embedded and
verified once in a slice.

Nulls and ties: null or empty texts and items match nothing. An item whose text
is repeated is reported under each of its ids; rows that repeat a document's id
are scanned each by its own text, and their matches are merged into one with
the least distance. Of equal distances the earliest place is reported. A null
document or item id is reported as null. Other columns of the input are not
read, whatever their names; ``drop_contaminated`` returns them.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwatch.llm.bytescan import PlainWords, chain, mix, slices, spread
from loomwatch.llm.shared import in_batches, stored

_PAD = np.uint64(0xA0761D6478BD642F)
_FOLD = np.random.Generator(np.random.PCG64(5)).integers(0, 2**63, 1 << 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_GRID = 1024  # windows that are embedded or verified at once
_MATCH = "doc_id long, nth long, start_word long, distance int"


def window_size(m: int) -> int:
    """The least size of the series 1, 2, ..., each a tenth above the one before, that holds m words."""
    size = 1
    while size < m:
        size = max(size + 1, size * 11 // 10)
    return size


def budget(m: int, percent: int) -> int:
    """Edits allowed for an item of m words at a similarity of ``percent``."""
    return m * (100 - percent) // 100


def walks_for(size: int, recall: float) -> int:
    """Walks for windows of a size, more for longer ones, whose walks drift apart for longer.

    Measured with a fifth of the words edited: if every edit is a deletion, the
    hardest case, a recall of 0.99 takes 13 walks at 15 words, 44 at 60, 66 at
    100 and 165 at 200; other edits take about half of that.
    """
    return int(np.ceil((4 + 0.8 * size) * np.log(1 - recall) / np.log(0.01)))


@functools.lru_cache(maxsize=256)
def _plan(size: int, walks: int, samples: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Seeds by (64 steps, walk), sampled steps by (walk, sample), and how many walks still have samples at each step."""
    steps = max(2, 2 * size)
    rng = np.random.Generator(np.random.PCG64([size, 7919]))
    seeds = rng.integers(1, 2**63, (-(-steps // 64), walks), dtype=np.uint64)
    picked = np.sort(np.array([rng.choice(steps, size=min(samples, steps), replace=False) for _ in range(walks)]), axis=1)
    picked = picked[np.argsort(-picked[:, -1], kind="stable")]  # walks that end early come last
    live = (picked[:, -1][:, None] >= np.arange(steps)).sum(axis=0)
    return seeds, picked, live


def grid(words: np.ndarray, start: np.ndarray, end: np.ndarray, width: int) -> np.ndarray:
    """The words of windows as rows of one width, with a mark behind the last one."""
    at = start[:, None] + np.arange(width)
    return np.where(at < end[:, None], words[np.minimum(at, len(words) - 1)], _PAD)


def walk_keys(windows: np.ndarray, size: int, walks: int, samples: int) -> np.ndarray:
    """LSH keys of the rows of ``grid(..., size + 1)``, one column for each walk."""
    seeds, picked, live = _plan(size, walks, samples)
    out = np.empty((len(windows), walks), np.uint64)
    for lo in range(0, len(windows), _GRID):
        part = windows[lo : lo + _GRID]
        known, flat = np.unique(part, return_inverse=True)
        flat = flat.reshape(-1)
        at = np.broadcast_to(np.arange(len(part)) * (size + 1), (walks, len(part))).copy()
        key = np.broadcast_to((np.arange(walks, dtype=np.uint64) + np.uint64(size * 1000))[:, None], at.shape).copy()
        column = np.arange(walks)[:, None]
        for j, n in enumerate(live.tolist()):
            if not n:
                break
            if j % 64 == 0:
                bits = mix(known[:, None] ^ seeds[j // 64][None, :])
                bits[known == _PAD] = 0  # a walk stays at the end
                bits = bits.reshape(-1)
            word = flat[at[:n]]
            take = np.flatnonzero((picked[:n] == j).any(axis=1))
            if len(take):
                key[take] = chain(key[take], known[word[take]])
            at[:n] += ((bits[word * walks + column[:n]] >> np.uint64(j % 64)) & np.uint64(1)).astype(np.int64)
        out[lo : lo + _GRID] = mix(key).T
    return out


@dataclass
class Block:
    """A bounded part of the benchmark's distinct items, ready to be broadcast."""

    nth: np.ndarray  # number of each item
    words: np.ndarray
    first: np.ndarray
    size: np.ndarray  # window size of each item
    classes: list[tuple[int, int]]  # size, pairs that a window needs
    single: np.ndarray  # one-word items, sorted
    pairs: np.ndarray  # hashes, sorted
    masks: np.ndarray  # sizes in which a pair occurs, as bits
    maybe: np.ndarray  # a bit for each leading value of a pair
    shift: int
    keys: np.ndarray  # sorted
    key_item: np.ndarray

    @classmethod
    def of(cls, nth: np.ndarray, items: list[np.ndarray], percent: int, recall: float, samples: int) -> Block:
        size = np.array([window_size(len(i)) for i in items], np.int64)
        words = np.concatenate(items) if items else np.zeros(0, np.uint64)
        first = np.concatenate([[0], np.cumsum([len(i) for i in items])]).astype(np.int64)
        classes, hashes, masks, keys, owner = [], [], [], [], []
        for k, s in enumerate(np.unique(size).tolist()):
            mine = np.flatnonzero(size == s)
            classes.append((s, min(len(items[i]) - 1 - 2 * budget(len(items[i]), percent) for i in mine)))
            for i in mine:
                if s > 1:
                    h = chain(items[i][:-1], items[i][1:])
                    hashes.append(h)
                    masks.append(np.full(len(h), 1 << (k % 64), np.uint64))
            walks = walks_for(s, recall)
            keys.append(walk_keys(grid(words, first[mine], first[mine + 1], s + 1), s, walks, samples).ravel())
            owner.append(np.repeat(mine, walks))
        pairs, at = np.unique(np.concatenate(hashes), return_inverse=True) if hashes else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        merged = np.zeros(len(pairs), np.uint64)
        if hashes:
            np.bitwise_or.at(merged, at, np.concatenate(masks))
        bits = max(16, int(np.ceil(np.log2(len(pairs) + 1))) + 4)
        maybe = np.zeros(1 << bits, bool)
        maybe[(pairs >> np.uint64(64 - bits)).astype(np.int64)] = True
        keys, owner = (np.concatenate(keys), np.concatenate(owner)) if keys else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        order = np.argsort(keys, kind="stable")
        single = np.unique(words[first[:-1][size == 1]])
        return cls(nth, words, first, size, classes, single, pairs, merged, np.packbits(maybe, bitorder="little"), 64 - bits, keys[order], owner[order])

    def pair_masks(self, h: np.ndarray, last: np.ndarray) -> np.ndarray:
        """For each word, the sizes in which it and the next one are a known pair; ``last`` are last words of texts."""
        out = np.zeros(len(h), np.uint64)
        if len(self.pairs) and len(h) > 1:
            pair = chain(h[:-1], h[1:])
            slot = (pair >> np.uint64(self.shift)).astype(np.int64)
            at = np.flatnonzero((self.maybe[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1)
            k = np.minimum(np.searchsorted(self.pairs, pair[at]), len(self.pairs) - 1)
            out[at] = np.where(self.pairs[k] == pair[at], self.masks[k], np.uint64(0))
        out[last] = 0
        return out


def edit_distances(items: np.ndarray, sizes: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least edit distance of each item to a part of its window, and where the first such part begins."""
    count, n = windows.shape
    ladder = np.arange(n + 1)
    cost, begin = np.zeros((count, n + 1), np.int64), np.broadcast_to(ladder, (count, n + 1)).copy()
    least, place = np.zeros(count, np.int64), np.zeros(count, np.int64)
    for k in range(1, int(sizes.max(initial=0)) + 1):
        # best of substitution and deletion, with the smaller beginning on ties
        swap = np.empty_like(cost)
        swap[:, 0] = k
        swap[:, 1:] = cost[:, :-1] + (windows != items[:, k - 1 : k])
        moved = np.zeros_like(begin)
        moved[:, 1:] = begin[:, :-1]
        drop = cost + 1
        b = np.where(swap <= drop, moved, begin)
        # insertions: running minimum of best - position
        shifted = np.minimum(swap, drop) - ladder
        low = np.minimum.accumulate(shifted, axis=1)
        source = np.maximum.accumulate(np.where(shifted == low, ladder, 0), axis=1)
        cost, begin = low + ladder, np.take_along_axis(b, source, axis=1)
        done = np.flatnonzero(sizes == k)
        if len(done):
            j = cost[done].argmin(axis=1)
            least[done], place[done] = cost[done, j], begin[done, j]
    return least, place


def _first_of(*columns: np.ndarray) -> np.ndarray:
    """Places of the first row of each distinct combination of all columns but the last, by the last."""
    order = np.lexsort(columns[::-1])
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([c[order][1:] != c[order][:-1] for c in columns[:-1]], axis=0)
    return order[new]


def scan_slice(found: PlainWords, block: Block, percent: int, recall: float, samples: int) -> tuple[np.ndarray, ...]:
    """Verified matches of a column of texts: row, item (its place in the block), start word, distance."""
    h, first = found.hash, found.first
    out: list[tuple[np.ndarray, ...]] = []
    known = block.pair_masks(h, first[1:][first[1:] > first[:-1]] - 1)
    places = np.flatnonzero(known)
    for k, (size, need) in enumerate(block.classes):
        if size == 1:
            at = np.flatnonzero(np.isin(h, block.single))
        else:
            need = max(need, 1)
            mine = places[(known[places] & np.uint64(1 << (k % 64))) != 0]
            # windows around any ``need`` known pairs that are near enough
            low, high = mine[need - 1 :] - (size - 2), mine[: max(len(mine) - need + 1, 0)]
            near = low <= high
            at = spread(np.maximum(low[near], 0), (high - np.maximum(low, 0) + 1)[near])
            at = np.unique(at)
        if not len(at):
            continue
        row = np.searchsorted(first, at, side="right") - 1
        end = np.minimum(at + size, first[row + 1])
        if size > 1:  # pairs beyond the text don't count
            enough = np.searchsorted(mine, end - 1) - np.searchsorted(mine, at) >= need
            at, row, end = at[enough], row[enough], end[enough]
        # windows with the same words are embedded once
        content = (end - at).astype(np.uint64)
        for j in range(size):
            content += np.where(at + j < end, h[np.minimum(at + j, len(h) - 1)], _PAD) * _FOLD[j % len(_FOLD)]
        _, one, same = np.unique(content, return_index=True, return_inverse=True)
        walks = walks_for(size, recall)
        pairs = []
        for lo in range(0, len(one), _GRID):
            some = one[lo : lo + _GRID]
            keys = walk_keys(grid(h, at[some], end[some], size + 1), size, walks, samples)
            left = np.searchsorted(block.keys, keys.ravel())
            hit = np.flatnonzero(block.keys[np.minimum(left, len(block.keys) - 1)] == keys.ravel())
            many = np.searchsorted(block.keys, keys.ravel()[hit], side="right") - left[hit]
            window = np.repeat(lo + hit // walks, many)
            pairs.append(np.unique(window * len(block.nth) + block.key_item[spread(left[hit], many)]))
        pairs = np.concatenate(pairs)
        window, item = np.divmod(pairs, len(block.nth))
        # back to every place of a window; of a row's windows that begin within a quarter of their size one is verified
        begins = np.searchsorted(window, np.arange(len(one) + 1))
        many = np.diff(begins)[same]
        at, row = np.repeat(at, many), np.repeat(row, many)
        item = item[spread(begins[:-1][same], many)]
        one = _first_of(row, item, (at - first[row]) // (size // 4 + 1), at)
        out.append(_verify(h, first, at[one], row[one], item[one], size, block, percent))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64),) * 4


def _verify(h: np.ndarray, first: np.ndarray, at: np.ndarray, row: np.ndarray, item: np.ndarray, size: int, block: Block, percent: int) -> tuple[np.ndarray, ...]:
    more = size * 3 // 4 + 2  # room for edits on either side
    lo, hi = np.maximum(at - more, first[row]), np.minimum(at + size + more, first[row + 1])
    distance, begin, good = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64), np.zeros(len(at), bool)
    for a in range(0, len(at), _GRID):
        some = slice(a, min(a + _GRID, len(at)))
        windows = grid(h, lo[some], hi[some], size + 2 * more)
        content = mix(item[some].astype(np.uint64)) + windows @ np.resize(_FOLD, windows.shape[1])
        _, one, same = np.unique(content, return_index=True, return_inverse=True)
        windows, which = windows[one], item[some][one]
        m = block.first[which + 1] - block.first[which]
        allowed = m * (100 - percent) // 100
        wanted = grid(block.words, block.first[which], block.first[which + 1], int(m.max()))
        # too few words in common, whatever their order
        common = np.zeros(len(one), np.int64)
        for k in range(wanted.shape[1]):
            common += (windows == wanted[:, k : k + 1]).any(axis=1) & (k < m)
        able = np.flatnonzero(common >= m - allowed)
        d, b = np.full(len(one), 1 << 30), np.zeros(len(one), np.int64)
        d[able], b[able] = edit_distances(wanted[able], m[able], windows[able])
        distance[some], begin[some], good[some] = d[same], b[same], (d <= allowed)[same]
    return row[good], item[good], lo[good] + begin[good] - first[row[good]], distance[good]


def read_items(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item_id, words) of the items that have words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = PlainWords(part.column(1))
                words = pa.ListArray.from_arrays(pa.array(found.first.astype(np.int32)), pa.array(found.hash.view(np.int64)))
                out = pa.RecordBatch.from_arrays([part.column(0), words], names=["item_id", "words"])
                yield out.filter(pa.array(np.diff(found.first) > 0))

    source = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text"))
    return in_batches(source, run, "item_id long, words array<long>")


class Benchmark:
    """The benchmark's distinct texts, numbered, in blocks of bounded size."""

    def __init__(self, benchmark: DataFrame, item_col: str, text_col: str, percent: int, recall: float, samples: int, block_words: int):
        self.spark = benchmark.sparkSession
        self.percent, self.recall, self.samples = percent, recall, samples
        self.items = stored(read_items(benchmark, item_col, text_col), "leak-items")
        once = self.items.groupBy("words").agg(F.count(F.lit(1)).alias("n"))
        self.texts = stored(once.select("words", F.monotonically_increasing_id().alias("nth")), "leak-texts")
        total = self.texts.agg(F.sum(F.size("words")).alias("w")).first()["w"] or 0
        self.blocks = -(-total // block_words)

    def block(self, b: int):
        """Block ``b``, broadcast: about ``block_words`` words, whatever the size of the benchmark."""
        rows = self.texts.filter(F.pmod(F.xxhash64("nth"), F.lit(self.blocks)) == b).orderBy("nth").toPandas()
        items = [np.array(w, np.int64).view(np.uint64) for w in rows["words"]]
        return self.spark.sparkContext.broadcast(Block.of(rows["nth"].to_numpy(np.int64), items, self.percent, self.recall, self.samples))

    def scanner(self, b: int) -> Callable[[pa.Array], tuple[np.ndarray, ...]]:
        """Matches of a column of texts with block ``b``: row, nth, start word, distance."""
        shared, setting = self.block(b), (self.percent, self.recall, self.samples)

        def scan(texts: pa.Array) -> tuple[np.ndarray, ...]:
            block = shared.value
            row, item, start, distance = scan_slice(PlainWords(texts), block, *setting)
            return row, block.nth[item], start, distance

        return scan

    def ids(self) -> DataFrame:
        """(nth, item_id, item_words): every id of every distinct text."""
        return self.items.join(self.texts, "words").select("nth", "item_id", F.size("words").alias("item_words"))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", percent: int = 80, recall: float = 0.99, samples: int = 2, block_words: int = 2_000_000) -> DataFrame:
    """One row per (document, item) within reach: doc_id, item_id, start_word, distance, item_words.

    ``percent`` is the least similarity, 1 - distance / words of the item. The
    walks are as many as ``recall`` needs at four fifths; a lower ``percent``
    keeps their number and so finds less of what is farther away.
    """
    items = Benchmark(benchmark, item_col, item_text_col, percent, recall, samples, block_words)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = docs.sparkSession.createDataFrame([], _MATCH)
    for b in range(items.blocks):
        scan = items.scanner(b)

        def run(batches: Iterator[pa.RecordBatch], scan=scan) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text"):
                    row, nth, start, distance = scan(part.column(1))
                    columns = [part.column(0).take(pa.array(row)), pa.array(nth), pa.array(start), pa.array(distance.astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "nth", "start_word", "distance"])

        found = found.unionByName(in_batches(source, run, _MATCH))
    best = F.min(F.struct("distance", "start_word")).alias("best")
    per_text = found.groupBy("doc_id", "nth").agg(best)
    return per_text.join(items.ids(), "nth").groupBy("doc_id", "item_id", "item_words").agg(F.min("best").alias("best")).select("doc_id", "item_id", "best.start_word", "best.distance", "item_words")


def decontamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The matches with their similarity."""
    return contaminated(docs, benchmark).withColumn("similarity", F.round(1 - F.col("distance") / F.col("item_words"), 6))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", percent: int = 80, recall: float = 0.99, samples: int = 2, block_words: int = 2_000_000) -> DataFrame:
    """The documents that hold no benchmark passage, with all their columns.

    Each row is decided by its own text; its id is not looked at.
    """
    items = Benchmark(benchmark, item_col, item_text_col, percent, recall, samples, block_words)
    at = docs.columns.index(text_col)
    for b in range(items.blocks):
        scan = items.scanner(b)

        def run(batches: Iterator[pa.RecordBatch], scan=scan) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, text_col):
                    clean = np.ones(part.num_rows, bool)
                    clean[scan(part.column(at).cast(pa.string()))[0]] = False
                    yield part.filter(pa.array(clean))

        docs = in_batches(docs, run, docs.schema)
    return docs
