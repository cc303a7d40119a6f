"""Exact duplicate detection with an extendible-hash index on shared files.

Texts are hashed to 64-bit keys. An extendible directory over the leading bits
of the key is doubled until no bucket holds more keys than its capacity. The
directory deals consecutive ranges of keys to owner tasks; an owner receives
the texts of its buckets, compares them byte by byte, chains different texts
with one key, and writes its buckets in key order to the shared folder. A later
batch is merged into an index the same way: counts only grow, so buckets that
become overfull are split and the others keep their depth.

How it runs:

* Cells of the directory are counted from keys alone, which are folded before
  their shuffle. At most ``2 ** max_depth`` counts reach the driver; the
  directory that is broadcast has as many rows, whatever the size of the table.
* A text moves once, to its owner. Cells in which copies are more than half of
  the rows are folded by text before they are dealt, so a text that makes up a
  third of the table leaves each task once and an owner gets at most about
  twice the texts that it keeps. A bucket that is overfull at the last depth
  has pages, which are ranges of keys too and may have different owners.
* The probe side of a table against its own index carries ids, keys and digests
  but no texts. Where a key has one entry, the owner has found all texts of that
  key equal, so the key names the entry; only keys with a chain are compared by
  text again. Rows of other tables are compared by text. Adaptive
  execution may split a hot key there.

Nulls and ties: a null text counts as empty. A null id is ignored when the
largest id is taken; a group without any id has a null ``keep_id`` and all its
rows are kept as they can't be told apart. Rows that repeat both id and text
share their outcome. Other columns of the input are neither read nor returned.
``drop_exact_duplicates`` decides by id and text and leaves one row of each text:
where rows that are kept repeat both, it takes any one of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwatch.llm.shared import stored


def plan_directory(cells: dict[int, int], capacity: int, max_depth: int) -> list[tuple[int, int, int, int]]:
    """Split overfull buckets: rows (first cell, last cell, depth, pages).

    ``cells`` has the number of entries for each value of the leading
    ``max_depth`` bits of a key.
    """
    size = 1 << max_depth
    sums = [0] * (size + 1)
    for i in range(size):
        sums[i + 1] = sums[i] + cells.get(i, 0)
    out, todo = [], [(0, 0)]
    while todo:
        prefix, depth = todo.pop()
        first = prefix << (max_depth - depth)
        last = ((prefix + 1) << (max_depth - depth)) - 1
        load = sums[last + 1] - sums[first]
        if load > capacity and depth < max_depth:
            todo += [(prefix * 2 + 1, depth + 1), (prefix * 2, depth + 1)]
        else:
            out.append((first, last, depth, max(1, -(-load // capacity))))
    return sorted(out)


def _directory(rows: DataFrame, capacity: int, max_depth: int, owners: int) -> DataFrame:
    """Cells: cell, bucket, depth, pages, hot (fold before dealing), first and past (the owners of its range)."""
    cell = F.shiftrightunsigned("key", 64 - max_depth).alias("cell")
    loads = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).groupBy(cell).agg(F.count(F.lit(1)).alias("entries"), F.sum("n").alias("rows"))
    counted = {r["cell"]: (r["entries"], r["rows"]) for r in loads.collect()}  # at most 2**max_depth rows
    hot = {c: n > 2 * entries for c, (entries, n) in counted.items()}
    dealt = {c: entries if hot[c] else n for c, (entries, n) in counted.items()}
    total, before, out = max(1, sum(dealt.values())), 0, []
    for b, (first, last, depth, pages) in enumerate(plan_directory({c: e for c, (e, _) in counted.items()}, capacity, max_depth)):
        for c in range(first, last + 1):
            past = before + dealt.get(c, 0)
            out.append((c, b, depth, pages, hot.get(c, False), before * owners / total, past * owners / total))
            before = past
    return rows.sparkSession.createDataFrame(out, "cell long, bucket int, depth int, pages int, hot boolean, first double, past double")


def _place(rows: DataFrame, directory: DataFrame, max_depth: int, owners: int) -> DataFrame:
    """``rows`` with hot, owner, bucket and page; pages of a bucket are ranges of the bits behind its cell."""
    behind = F.shiftrightunsigned(F.shiftleft("key", max_depth), 32)
    page = F.shiftright(behind * F.col("pages"), 32).cast("int")
    owner = F.least(F.floor(F.col("first") + (F.col("past") - F.col("first")) * F.col("page") / F.col("pages")), F.lit(owners - 1))
    placed = rows.withColumn("cell", F.shiftrightunsigned("key", 64 - max_depth)).join(F.broadcast(directory), "cell")
    return placed.withColumn("page", page).withColumn("owner", owner.cast("int")).drop("cell", "depth", "pages", "first", "past")


def build_index(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 20_000,
    max_depth: int = 14,
    previous: DataFrame | None = None,
    hash_key: Callable[[Column], Column] = F.xxhash64,
) -> DataFrame:
    """The index of ``docs``, or ``previous`` extended by them, read from the shared folder.

    Columns: bucket, page, key, slot (place in the chain of its key, from 1),
    chain (texts with that key), text, keep_id, group_size; one row per
    distinct text. A batch must be hashed like the index that it extends.
    """
    if not 1 <= max_depth <= 20:
        raise ValueError("max_depth must be from 1 to 20")
    owners = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.lit(1).cast("long").alias("n"), text.alias("text")).withColumn("key", hash_key(F.col("text")))
    if previous is not None:
        rows = rows.unionByName(previous.select(F.col("keep_id").alias("id"), F.col("group_size").alias("n"), "text", "key"))
    directory = _directory(rows.select("key"), capacity, max_depth, owners)
    entry = ["owner", "bucket", "page", "key", "text"]
    fold = [F.max("id").alias("id"), F.sum("n").alias("n")]
    placed = _place(rows, directory, max_depth, owners).select(*entry, "id", "n", "hot")
    plain, hot = placed.filter("not hot").drop("hot"), placed.filter("hot").groupBy(*entry).agg(*fold)
    owned = plain.unionByName(hot).repartitionById(owners, F.col("owner")).groupBy(*entry).agg(*fold)
    chain = Window.partitionBy("owner", "bucket", "page", "key")
    chained = owned.withColumn("slot", F.row_number().over(chain.orderBy("text"))).withColumn("chain", F.count(F.lit(1)).over(chain))
    return stored(chained.select("bucket", "page", "key", "slot", "chain", "text", F.col("id").alias("keep_id"), F.col("n").alias("group_size")), "dedup-index")


def probe_index(docs: DataFrame, index: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_key: Callable[[Column], Column] = F.xxhash64, inside: bool = False) -> DataFrame:
    """One row per row whose text is in the index: id, keep_id, group_size, kept, text_sha256.

    A key only finds the entries to compare with: texts decide. Where all rows
    are known to be ``inside`` the index, a key with one entry has that text, so
    texts of such keys stay where they are.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), hash_key(text).alias("key"), F.sha2(text, 256).alias("text_sha256"), text.alias("text"))
    entry = ["keep_id", "group_size"]
    if not inside:
        found = rows.join(index.select("key", "text", *entry), ["key", "text"]).drop("text")
    else:
        found = rows.drop("text").join(index.filter("chain = 1").select("key", *entry), "key")
        chained = index.filter("chain > 1").select("key", "text", *entry)
        if not chained.isEmpty():
            found = found.unionByName(rows.join(chained, ["key", "text"]).drop("text"))
    kept = F.col("id").eqNullSafe(F.col("keep_id"))
    return found.select(F.col("id").alias(id_col), "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 20_000, max_depth: int = 14) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256."""
    return probe_index(docs, build_index(docs, id_col, text_col, capacity, max_depth), id_col, text_col, inside=True)


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each text, with all its columns; ids may be null or repeated."""
    found = stored(exact_duplicates(docs, id_col, text_col).select(F.col(id_col).alias("__id"), F.col("text_sha256").alias("__sha256"), "kept"), "dedup-found")
    digest = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)

    def same(d: DataFrame, other: DataFrame) -> Column:
        return d[id_col].eqNullSafe(other["__id"]) & (digest == other["__sha256"])

    gone = found.filter(~F.col("kept")).drop("kept").distinct()
    again = stored(found.filter("kept").groupBy("__id", "__sha256").count().filter("count > 1").drop("count"), "dedup-again")
    left = docs.join(gone, same(docs, gone), "left_anti")
    if again.isEmpty():
        return left
    once = left.join(again, same(left, again), "left_anti")
    several = left.join(again, same(left, again), "left_semi").withColumn("__sha256", digest).dropDuplicates([id_col, "__sha256"]).drop("__sha256")
    return once.unionByName(several)
