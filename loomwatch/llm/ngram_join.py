"""Exact Jaccard self-join on word n-gram sets, with a token-group matrix.

Rows with equal sets are folded into one class. Classes are partitioned into
groups of similar sets: of a set's minima under several hash functions the one
that most other sets share names its group, in blocks of bounded size. A group
is described by the union of its members' tokens: a query can only have a
member with Jaccard similarity ``t`` in a group whose union holds at least ``t``
of the query's tokens. The token-group matrix first finds the groups that share
a prefix token with the query (a query's rarest ``n - ceil(t * n) + 1`` tokens,
of which any partner must have one among its own), then a group's full union
bounds the overlap, and only groups that still qualify are opened and compared
set by set.

How it runs: tokens are 64-bit hashes made in Arrow batches. Stored are each
row's set size, set fingerprint, minima and prefix, which is a tenth of its
tokens. Work goes from many to few. First the members of each block are
compared with each other; blocks of one group are then chained through one
member of each of their linked clusters, level by level, which connects a group
of N near copies in N comparisons with blocks and not N * N / block. What is
linked becomes a group of its own. Only then does the matrix look for links
between different groups; a pair of groups is asked in one direction, from sets
that are still alone to those that are linked. Candidates are (query, block)
rows, never pairs of sets. Bitmaps of fixed size keep tokens and texts that no
exact join will want out of the shuffles. Frequent tokens go last in the order
of tokens, so passages that many documents share don't fill prefixes.
Components come from label propagation with stored tables in between; nothing
is collected.

Nulls and ties: null or empty text has an empty set and is linked with nothing;
its component is its own id. Rows are told apart by their place and not by
their id: rows that repeat an id with other texts are linked each by its own
text, and a row without an id is linked like others. A component's id is its
smallest id, null if it has none. Other columns are not read, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwatch.llm.bitmap import Bitmap, filtered_lists, keep_decided, rows_where
from loomwatch.llm.bytescan import Words, chain, mix, release, slices, spread
from loomwatch.llm.components import connected_components
from loomwatch.llm.shared import in_batches, stored

_PROFILE = "doc_id long, th long, n long, f1 long, f2 long, keys array<long>, prefix array<long>"
_TEXT = 2 << 20  # bytes of text whose words and n-grams a worker holds at once
_MINIMA = np.array([0, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93], np.uint64)  # one for each hash function


def ngram_sets(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of each row, sorted, and where each row's begin.

    A row with fewer than ``n`` words, one at least, has its whole sequence as
    the only n-gram.
    """
    words = Words(column)
    counts = words.counts()
    rows = len(counts)
    h = words.hash
    grams = np.maximum(counts - n + 1, 0)
    first = words.first[:-1]
    at = np.repeat(first, grams) + np.arange(int(grams.sum())) - np.repeat(np.cumsum(grams) - grams, grams)
    tokens = chain(*[h[at + k] for k in range(n)])
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        whole = [mix(chain(*[h[first[i] + k : first[i] + k + 1] for k in range(counts[i])]) + np.uint64(counts[i])) for i in short]
        tokens = np.insert(tokens, np.cumsum(grams)[short], np.concatenate(whole))
        grams[short] = 1
    ends = np.cumsum(grams)
    for a, b in zip((ends - grams).tolist(), ends.tolist()):
        tokens[a:b].sort()
    row = np.repeat(np.arange(rows), grams)
    new = np.ones(len(tokens), bool)
    new[1:] = (tokens[1:] != tokens[:-1]) | (row[1:] != row[:-1])
    return tokens[new], np.concatenate([[0], np.cumsum(np.bincount(row[new], minlength=rows))])


def _among(values: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Whether each token is one of the sorted values, without a copy of them."""
    if not len(values):
        return np.zeros(len(tokens), bool)
    at = np.searchsorted(values, tokens)
    at[at == len(values)] = 0
    return values[at] == tokens


def _least(n: np.ndarray, percent: int) -> np.ndarray:
    return -(-(n * percent) // 100)


def frequent_tokens(source: DataFrame, n: int, df: int, most: int) -> np.ndarray:
    """Tokens that ``df`` documents or more share, sorted; whole doublings of frequency, ``most`` tokens at most.

    Only the order of tokens depends on these, and so only the work, never the
    result. Each task counts its own documents and sends tokens it met twice.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, held = [], []
        size = 0

        def fold(arrays: list) -> tuple[np.ndarray, np.ndarray]:
            t, inv = np.unique(np.concatenate([a[0] for a in arrays]), return_inverse=True)
            return t, np.bincount(inv, weights=np.concatenate([a[1] for a in arrays])).astype(np.int64)

        def flush() -> None:
            nonlocal held, size
            if held:
                met, held, size = np.concatenate(held), [], 0
                met.sort()
                again = met[1:][met[1:] == met[:-1]]  # a token that was met c times, c - 1 times
                if len(again):
                    t, c = np.unique(again, return_counts=True)
                    kept.append((t, c + 1))

        for batch in batches:
            for part in slices(batch, "text", _TEXT):
                tokens, _ = ngram_sets(part.column(2), n)
                held.append(tokens)
                size += len(tokens)
                if size > 3_000_000:
                    flush()
        flush()
        if kept:
            t, c = fold(kept)
            yield pa.RecordBatch.from_arrays([pa.array(t.view(np.int64)), pa.array(c)], names=["token", "c"])

    counts = stored(in_batches(source, count, "token long, c long").groupBy("token").agg(F.sum("c").alias("c")).filter(F.col("c") >= df), "ngram-frequent")
    sizes = {r["k"]: r["n"] for r in counts.groupBy(F.floor(F.log2("c")).alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per doubling
    total, cut = 0, 64
    for k in sorted(sizes, reverse=True):
        total += sizes[k]
        if total > most:
            break
        cut = k
    return np.sort(counts.filter(F.floor(F.log2("c")) >= cut).select("token").toPandas()["token"].to_numpy(np.int64).view(np.uint64))


def profiles(source: DataFrame, n: int, percent: int, shared_tokens: int, frequent: np.ndarray) -> DataFrame:
    """Set size, fingerprint, minima and prefix of every document; ``th`` is handed on."""
    shared = source.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared.value
        for batch in batches:
            for part in slices(batch, "text", _TEXT):
                tokens, at = ngram_sets(part.column(2), n)
                size = np.diff(at)
                row = np.repeat(np.arange(len(size)), size)
                f1, f2 = np.zeros(len(size), np.uint64), np.zeros(len(size), np.uint64)
                keys = np.zeros((len(size), len(_MINIMA)), np.uint64)
                with np.errstate(over="ignore"):
                    if len(tokens):
                        full = size > 0
                        f1[full] = np.add.reduceat(mix(tokens), at[:-1][full])
                        f2[full] = np.add.reduceat(mix(tokens ^ np.uint64(0x5851F42D4C957F2D)), at[:-1][full])
                        for k, x in enumerate(_MINIMA):
                            keys[full, k] = np.minimum.reduceat(mix(tokens ^ x) if k else tokens, at[:-1][full])
                order = np.argsort(2 * row + _among(often, tokens), kind="stable")
                length = np.minimum(size - _least(size, percent) + shared_tokens, size)
                place = np.arange(len(tokens)) - np.repeat(at[:-1], size)
                taken = order[place < np.repeat(length, size)]
                offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
                prefix = pa.ListArray.from_arrays(pa.array(offsets), pa.array(tokens[taken].view(np.int64)))
                minima = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, len(_MINIMA), dtype=np.int32)), pa.array(keys.view(np.int64).ravel()))
                columns = [part.column(0), part.column(1), pa.array(size.astype(np.int64)), *(pa.array(x.view(np.int64)) for x in (f1, f2)), minima, prefix]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "th", "n", "f1", "f2", "keys", "prefix"])

    return in_batches(source, run, _PROFILE)


def _sets(texts: pd.Series, n: int) -> list[np.ndarray]:
    out = []
    for part in slices(pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"]), "text", _TEXT):
        tokens, at = ngram_sets(part.column(0), n)
        out += [tokens[a:b] for a, b in zip(at[:-1], at[1:])]
    return out


def open_groups(n: int, percent: int, inner: bool):
    """Compare a block's members with each other (``inner``) or with the queries sent to it.

    Emits a spanning set of edges: two sets that link are connected by the edges
    of this block, if not by an edge of their own. Members of a ``pure`` block are
    known to be connected.
    """

    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.drop_duplicates(["query", "node"]).sort_values(["query", "node"], kind="stable")
        members = block[~block["query"]]
        ids = members["node"].to_numpy()
        sets = _sets(members["text"], n)
        size = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(sets), dtype=np.int32), size)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        union = flat[np.diff(flat, prepend=~flat[:1]) != 0]
        sets = sets if inner else []
        del order
        parent = list(range(len(ids)))
        if len(members) and members["pure"].iloc[0]:
            parent = [0] * len(ids)

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        def partners(s: np.ndarray) -> np.ndarray:
            at = np.searchsorted(union, s)
            at[at == len(union)] = 0
            need = int(_least(np.int64(len(s)), percent))
            if not len(union) or int((union[at] == s).sum()) < need:  # the union's bound
                return np.zeros(0, np.int64)
            lo, hi = np.searchsorted(flat, s, "left"), np.searchsorted(flat, s, "right")
            both = np.bincount(owner[spread(lo, hi - lo)], minlength=len(size))
            return np.flatnonzero(100 * both >= percent * (size + len(s) - both))

        edges = []
        for i, s in enumerate(sets):
            for j in partners(s):
                a, b = root(i), root(int(j))
                if a != b:
                    parent[a] = b
                    edges.append((ids[i], ids[j]))
        queries = block[block["query"]]
        for at in range(0, len(queries), 64):
            some = queries.iloc[at : at + 64]
            for q, s in zip(some["node"], _sets(some["text"], n)):
                met = set()
                for j in partners(s):
                    if (r := root(int(j))) not in met:
                        met.add(r)
                        edges.append((q, ids[j]))
        release()
        return pd.DataFrame(edges, columns=["a", "b"]).astype("int64")

    return run


class Links:
    """Rows, classes and links of a table of documents."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, n: int, percent: int, shared: int = 4, block: int = 256, queries: int = 512, frequent_df: int = 24, most_frequent: int = 1_000_000):
        self.n, self.percent, self.shared, self.block, self.queries = n, percent, shared, block, queries
        text = F.col(text_col).cast("string")
        self.source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
        often = frequent_tokens(self.source, n, frequent_df, most_frequent)
        profile = profiles(self.source, n, percent, shared, often).withColumn("row", F.monotonically_increasing_id())
        self.profile = stored(profile, "ngram-profile")
        slim = self.profile.select("row", "doc_id", "th", "n", "f1", "f2")
        classes = slim.filter("n > 0").groupBy("f1", "f2", "n").agg(F.min("row").alias("node"))
        #: row, doc_id, th, n and node: the first row with the same set, the own row for empty sets
        self.rows = slim.join(classes, ["f1", "f2", "n"], "left").select("row", "doc_id", "th", "n", F.coalesce("node", "row").alias("node"))
        #: one row for each class
        self.names = classes.select("node")
        self.classes = self._of_classes(self.profile.drop("prefix"))
        # Most tokens of prefixes are in one class alone; they go before prefixes are moved about.
        found = self.profile.select("f1", F.explode("prefix").alias("token")).groupBy("token").agg(F.min("f1").alias("lo"), F.max("f1").alias("hi"))
        thin = filtered_lists(Bitmap(stored(found.filter("lo <> hi").select("token"), "ngram-shared"), "token"))
        whole = self.profile.select("row", "n", "keys", "prefix")

        def thinned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], thin(batch.column(3))], names=batch.schema.names)

        self.prefixes = self._of_classes(in_batches(whole, thinned, whole.schema))

    def _of_classes(self, rows: DataFrame) -> DataFrame:
        return rows.join(self.names.withColumnRenamed("node", "row"), "row", "left_semi").withColumnRenamed("row", "node")

    def opened(self, work: DataFrame, inner: bool, name: str) -> DataFrame:
        """Edges from blocks (node, key, part, share, query, pure), with the texts of their sets."""
        names = self.classes.select("node", "doc_id", "th")
        named = stored(work.join(names, "node").withColumn("at", F.xxhash64("doc_id", "th")), f"ngram-{name}")
        texts = rows_where(self.source.withColumn("at", F.xxhash64("doc_id", "th")), "at", Bitmap(named, "at"), True)
        met = texts.select("at", "text").join(named.select("at", "node", "key", "part", "share", "query", "pure"), "at").drop("at")
        return stored(met.groupBy("key", "part", "share").applyInPandas(open_groups(self.n, self.percent, inner), "a long, b long"), f"ngram-{name}-edges")

    def groups(self) -> DataFrame:
        """Each class with the minimum that most other classes share (key), and how many do (members)."""
        keyed = self.classes.select("node", F.explode("keys").alias("key"))
        counts = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
        best = keyed.join(counts, "key").groupBy("node").agg(F.max(F.struct("members", "key")).alias("best"))
        return stored(
            self.prefixes.select("node", "n", F.col("keys")[0].alias("own"), "prefix")
            .join(best, "node", "left")
            .select("node", "n", F.coalesce("best.key", "own").alias("key"), F.coalesce("best.members", F.lit(1)).alias("members"), "prefix"),
            "ngram-groups",
        )

    def _part(self, node: str, members: str):
        return F.pmod(F.xxhash64(node), F.ceil(F.col(members) / self.block)).cast("int")

    def settled(self, groups: DataFrame, levels: int = 4) -> DataFrame:
        """Edges inside blocks, and between the blocks of a group through a member of each linked cluster.

        Each level compares the clusters that the one before left of a group of
        several blocks. It ends when no such group is left or clusters don't get
        fewer; what is still apart then is the matrix's work.
        """
        level = groups.filter("members > 1").select("node", "key", "members")
        edges, last = None, None
        for k in range(levels):
            work = level.select("node", "key", self._part("node", "members").alias("part"), F.lit(0).alias("share"), F.lit(False).alias("query"), F.lit(False).alias("pure"))
            new = self.opened(work, True, f"level{k}")
            edges = new if edges is None else edges.unionByName(new)
            wide = level.filter(F.col("members") > self.block).select("node", "key")
            left = wide.count()
            if not left or (last and 2 * left > last) or k + 1 == levels:
                break
            last = left
            heads = connected_components(edges)
            level = wide.join(heads, "node", "left").filter("component IS NULL OR component = node").select("node", "key")
            sizes = level.groupBy("key").agg(F.count(F.lit(1)).alias("members"))
            level = stored(level.join(sizes, "key"), "ngram-level")
        return edges

    def edges(self) -> DataFrame:
        """Edges between nodes that connect whatever links connect."""
        block, percent = self.block, self.percent
        groups = self.groups()
        inside = connected_components(self.settled(groups))
        sizes = inside.groupBy("component").agg(F.count(F.lit(1)).alias("linked"))
        inside = stored(inside.join(sizes, "component").select("node", "component", "linked"), "ngram-inside")
        # Linked clusters are groups of their own; the rest stays in the blocks in which it was compared.
        pure = F.col("component").isNotNull()
        reps = groups.join(inside, "node", "left").select(
            "node",
            "n",
            F.when(pure, F.xxhash64("component", F.lit("linked"))).otherwise(F.col("key")).alias("key"),
            F.when(pure, self._part("node", "linked")).otherwise(self._part("node", "members")).alias("part"),
            pure.alias("pure"),
            "prefix",
        )
        reps = stored(reps.withColumn("g", F.xxhash64("key", "part")), "ngram-reps")
        # The matrix: tokens of prefixes by block, for tokens that several blocks or clusters have.
        apart = F.when(F.col("pure"), F.col("key")).otherwise(F.col("g"))
        tokens = reps.select(apart.alias("g"), F.explode("prefix").alias("token")).groupBy("token").agg(F.min("g").alias("lo"), F.max("g").alias("hi"))
        tokens = stored(tokens.filter("lo <> hi").select("token"), "ngram-tokens")
        cells = reps.select("node", "n", "key", "part", "pure", "g", F.explode("prefix").alias("token"))
        cells = stored(cells.join(tokens, "token", "left_semi"), "ngram-cells")
        to = cells.groupBy("token", F.col("key").alias("to_key"), F.col("part").alias("to_part"), F.col("pure").alias("to_pure"), F.col("g").alias("to_g")).agg(F.min("n").alias("least"), F.max("n").alias("most"))
        # one direction: from lone sets to linked clusters, else by the order of blocks; a cluster doesn't ask itself
        forward = (F.col("to_pure") & ~F.col("pure")) | ((F.col("to_pure") == F.col("pure")) & (F.col("g") < F.col("to_g")))
        other = (F.col("key") != F.col("to_key")) | ~F.col("pure")
        fits = (F.col("least") * percent <= F.col("n") * 100) & (F.col("n") * percent <= F.col("most") * 100)
        met = (
            cells.join(to, "token")
            .filter(forward & other & fits)
            .groupBy("node", "n", "to_key", "to_part")
            .agg(F.count(F.lit(1)).alias("common"))
            .filter(F.col("common") >= F.least(F.lit(self.shared), F.ceil(F.col("n") * percent / 100)))
            .select("node", F.col("to_key").alias("key"), F.col("to_part").alias("part"))
        )
        met = stored(met, "ngram-met")
        # Only blocks that a query has met are opened again. Queries come in bounded shares.
        waiting = met.groupBy("key", "part").agg(F.count(F.lit(1)).alias("waiting"))
        shares = F.ceil(F.col("waiting") / self.queries).cast("int")
        members = reps.select("node", "key", "part", "pure").join(waiting, ["key", "part"]).select("node", "key", "part", F.explode(F.sequence(F.lit(0), shares - 1)).alias("share"), F.lit(False).alias("query"), "pure")
        asked = met.join(waiting, ["key", "part"]).select("node", "key", "part", F.pmod(F.xxhash64("node"), shares).cast("int").alias("share"), F.lit(True).alias("query"), F.lit(False).alias("pure"))
        between = self.opened(members.unionByName(asked), False, "between")
        return between.unionByName(inside.select(F.col("node").alias("a"), F.col("component").alias("b")))

    def components(self) -> DataFrame:
        """row, doc_id, th, n, component (a node), component_id for every row."""
        labels = connected_components(self.edges())
        named = self.rows.join(labels, "node", "left").select("row", "doc_id", "th", "n", F.coalesce("component", "node").alias("component"))
        ids = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
        return named.join(ids, "component")


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, percent: int = 90, **bounds: int) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    Bounds: ``shared`` is the number of prefix tokens that partners must share
    (fewer for sets so small that partners may share fewer tokens in all);
    ``block`` and ``queries`` bound what one task holds at once; tokens of
    ``frequent_df`` documents or more go last, ``most_frequent`` of them at most,
    which are broadcast. None of them changes the result.
    """
    found = Links(docs, id_col, text_col, n, percent, **bounds).components()
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, percent: int = 90) -> DataFrame:
    """One row of each component, with all its columns: the one with the smallest id.

    Rows without words all stay. Of rows with that id the one with the least
    text hash stays, and of rows that repeat both any one.
    """
    found = stored(Links(docs, id_col, text_col, n, percent).components().filter("n > 0").select("row", "doc_id", "th", "component"), "ngram-found")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "th", "row")).alias("first")
    kept = found.groupBy("component").agg(first).select("first.row", F.lit(True).alias("kept"))
    decided = found.join(kept, "row", "left").groupBy("doc_id", "th").agg(F.coalesce(F.max("kept"), F.lit(False)).alias("kept"), F.count(F.lit(1)).alias("rows"))
    return keep_decided(docs, stored(decided.filter("NOT kept OR rows > 1").drop("rows"), "ngram-decided"), id_col, text_col)
