"""Repair of conversation structure at least cost, by Hirschberg's divide and conquer.

A conversation is in order when its roles' initials read ``(s?(ua)+)?``. The
automaton has four states: 0 nothing yet, 1 after a system row, 2 after a user
row, 3 after an assistant row; 0 and 3 may end. Every row is kept, given
another role or deleted, and rows without text may be inserted. Costs are those
of ``KEEP`` and below. Which role an insertion or a new role has follows from
the state, so the edits' initials alone tell the repair; of cheapest edits the
ASCII-least initials count.

A forward pass carries, for each state, the least cost and the rank of the
least initials that lead there; a backward pass carries costs. They meet in the
middle, the state with the least sum and then the least rank is crossed, and
both halves are solved in the same way. Initials that lead to different states
after the same row are never beginnings of each other, so a rank, once given,
stays. Space is linear: one crossing for each row.

How it runs: rows are sorted by conversation and turn in ranges, so that a
conversation with very many rows lies in many tasks, and cut into blocks of
bounded rows and bytes. A block is summed up as the costs and ranks from each
state to each state, 32 numbers. The same divide and conquer over a
conversation's blocks gives the states at their borders; then every block is
solved alone. Only summaries of one conversation meet in one task. A digest of
a whole repaired conversation, as ``repair_report`` has it, needs its rows in
order: they stream through one task, of which a block is held at a time; the
initials of a conversation are one string of its row.

Nulls and ties: a null conversation id is a conversation of its own; a null
role or text is one space. Rows go by turn, nulls first, rows of one turn by
role, then by the SHA-256 of their text. Of equal rows all but the first are
duplicates. An empty table has no conversations. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwatch.llm.bytescan import release
from loomwatch.llm.shared import stored

KEEP, REROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3  #: costs of edits; CUT is for a truncated row that stays
NEXT = (2, 2, 3, 2)  #: the state that an inserted or rerolled row leads to
ROLE = {2: "user", 3: "assistant"}
FINAL = (0, 2 * INSERT, INSERT, 0)  #: cost of ending in a state
TRAIL = ("", "II", "I", "")  #: edits that end it
_GAP = " \t\n\x0b\x0c\r"
_ENDS = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}  #: where a kept row leads
_LEGAL = {"su", "ua", "au"}
_ROWS, _BYTES = 4096, 4 << 20  # of a block

Vector = list[tuple[int, int] | None]


@lru_cache(maxsize=64)
def moves(initial: str, must_go: bool, cut: bool) -> tuple[tuple[tuple[int, int, str], ...], ...]:
    """For each state the (state after, cost, edits) over one row, with insertions before it; the best for each state after."""
    out = []
    for x in range(4):
        best: dict[int, tuple[int, str]] = {}
        z, cost, edits = x, 0, ""
        for _ in range(3):
            options = [(z, DELETE, "D")]
            if not must_go:
                options.append((NEXT[z], REROLE + CUT * cut, "R"))
                if (initial, z) in _ENDS:
                    options.append((_ENDS[initial, z], KEEP + CUT * cut, "K"))
            for y, c, e in options:
                best[y] = min(best.get(y, (1 << 60, "")), (cost + c, edits + e))
            z, cost, edits = NEXT[z], cost + INSERT, edits + "I"
        out.append(tuple((y, c, e) for y, (c, e) in sorted(best.items())))
    return tuple(out)


def step(vector: Vector, item) -> Vector:
    """Costs and ranks after one more row or block."""
    best: list[tuple | None] = [None] * 4
    for x, at in enumerate(vector):
        if at is not None:
            for y, c, e in item[x]:
                key = (at[0] + c, at[1], e)
                if best[y] is None or key < best[y]:
                    best[y] = key
    ranked = sorted((b[1:], y) for y, b in enumerate(best) if b is not None)
    out: Vector = [None] * 4
    for rank, (_, y) in enumerate(ranked):
        out[y] = (best[y][0], rank)
    return out


def crossings(items, x0: int, final) -> list[int]:
    """The states before, between and after ``items`` on the cheapest, then ASCII-least way from ``x0``.

    ``items`` has for each state the (state after, cost, key) it may lead to;
    ``final`` the cost of ending in each state, None where that's no end.
    """
    states = [x0] * (len(items) + 1)
    work = [(0, len(items), final)]
    while work:
        lo, hi, final = work.pop()
        if lo == hi:
            continue
        mid = (lo + hi + 1) // 2
        vector: Vector = [None] * 4
        vector[states[lo]] = (0, 0)
        for k in range(lo, mid):
            vector = step(vector, items[k])
        back = list(final)
        for k in range(hi - 1, mid - 1, -1):
            back = [min((c + back[y] for y, c, _ in ways if back[y] is not None), default=None) for ways in items[k]]
        _, _, states[mid] = min((v[0] + b, v[1], y) for y, (v, b) in enumerate(zip(vector, back)) if v is not None and b is not None)
        if mid < hi:
            work.append((mid, hi, final))
        if mid - lo > 1:
            work.append((lo, mid, [0 if y == states[mid] else None for y in range(4)]))
    return states


def summary(items) -> bytes:
    """Costs and ranks of a block from each state to each state; -1 where there is no way."""
    out = np.full((4, 4, 2), -1, np.int64)
    for x in range(4):
        vector: Vector = [None] * 4
        vector[x] = (0, 0)
        for item in items:
            vector = step(vector, item)
        for y, v in enumerate(vector):
            if v is not None:
                out[x, y] = v
    return out.tobytes()


class _Summaries:
    """Blocks as items for ``crossings``, unpacked as they are read."""

    def __init__(self, packed: list[bytes]):
        self.packed = packed

    def __len__(self) -> int:
        return len(self.packed)

    def __getitem__(self, k: int):
        table = np.frombuffer(self.packed[k], np.int64).reshape(4, 4, 2).tolist()
        return [[(y, c, r) for y, (c, r) in enumerate(row) if c >= 0] for row in table]


def edits_of(items, states: list[int]) -> list[str]:
    """The edits over each row, given the states around it."""
    return [next(e for y, _, e in item[a] if y == b) for item, a, b in zip(items, states, states[1:])]


def damaged(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows with faults planted by the crc32 of ``conversation:turn``: dropped, emptied, cut, repeated or given to the user."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.pmod(F.crc32(F.concat_ws(":", space(conv_col), space(turn_col)).cast("binary")), F.lit(20))
    known = rows.select(space(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), space(role_col).alias("role"), space(text_col).alias("text"), fault.alias("fault")).filter("fault <> 0")
    return known.select(
        "conv",
        "turn",
        F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )


_TAGGED = "conv string, slice int, block int, pos int, turn long, role string, text string, blank boolean, duplicate boolean, truncated boolean, summary binary"
_FLAGS = ("blank", "duplicate", "truncated")


def _item(role: str, blank: bool, duplicate: bool, truncated: bool):
    return moves(role[:1] if role[:1] in ("s", "u", "a") else "", blank or duplicate, truncated)


def tagged(rows: DataFrame, block_rows: int = _ROWS) -> DataFrame:
    """Rows (conv, turn, role, text) with their faults, in order within blocks; a block's first row has its summary. Stored."""
    spark = rows.sparkSession
    bare = F.rtrim(F.col("text"), F.lit(_GAP))
    rows = rows.select("conv", "turn", "role", "text", F.sha2("text", 256).alias("digest"), (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("cut"))
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "conversation-rows")
    # All but the first of rows with equal role and text, by their own number: no key is hot.
    first = F.min(F.struct(F.col("turn").isNotNull().alias("has"), "turn", "row")).alias("first")
    firsts = rows.groupBy("conv", "role", "digest").agg(first).select("first.row")
    again = stored(rows.select("row").join(firsts, "row", "left_anti"), "conversation-again").withColumn("again", F.lit(True))
    known = rows.join(again, "row", "left").withColumn("again", F.coalesce("again", F.lit(False)) & ~F.col("blank"))
    order = ["conv", F.col("turn").asc_nulls_first(), "role", "digest", "row"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = known.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    dealt = dealt.select("conv", F.spark_partition_id().alias("slice"), "turn", "role", "text", "blank", F.col("again").alias("duplicate"), (F.col("cut") & ~F.col("blank") & ~F.col("again")).alias("truncated"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = block = 0

        def flush() -> pa.RecordBatch:
            packed = summary([_item(r[3], *r[5:]) for r in held])
            columns = list(zip(*held))
            n = len(held)
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()), pa.array([block] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(columns[2], pa.int64())]
                + [pa.array(columns[k], pa.string()) for k in (3, 4)]
                + [pa.array(columns[k], pa.bool_()) for k in (5, 6, 7)]
                + [pa.array([packed] + [None] * (n - 1), pa.binary())],
                names=["conv", "slice", "block", "pos", "turn", "role", "text", *_FLAGS, "summary"],
            )

        out: list[pa.RecordBatch] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (row[0] != held[0][0] or len(held) >= block_rows or size + len(row[4]) > _BYTES):
                    out.append(flush())
                    held, size, block = [], 0, block + 1
                held.append(row)
                size += len(row[4])
            if out:
                yield from pa.Table.from_batches(out).combine_chunks().to_batches()
                out = []
        if held:
            yield flush()
        release()

    return stored(dealt.mapInArrow(run, _TAGGED), "conversation-tagged")


def borders(rows: DataFrame) -> DataFrame:
    """conv, slice, block, enters, leaves: the states around each block of ``tagged`` rows, and whether it's the last."""
    blocks = rows.filter("summary IS NOT NULL").select("conv", "slice", "block", "summary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        out: list[tuple] = []

        def flush() -> None:
            states = crossings(_Summaries([h[3] for h in held]), 0, FINAL)
            out.extend((*h[:3], states[k], states[k + 1], k + 1 == len(held)) for k, h in enumerate(held))

        def batch_of() -> pa.RecordBatch:
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["conv", "slice", "block", "enters", "leaves", "last"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and row[0] != held[0][0]:
                    flush()
                    held = []
                held.append(row)
            if len(out) > 10_000:
                yield batch_of()
                out = []
        if held:
            flush()
        if out:
            yield batch_of()

    ordered = blocks.repartition("conv").sortWithinPartitions("conv", "slice", "block")
    return ordered.mapInArrow(run, "conv string, slice int, block int, enters int, leaves int, last boolean")


def _with_borders(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows of each block after one row with its borders (pos -1), dealt by ``by`` and in order."""
    ends = borders(rows).withColumn("pos", F.lit(-1))
    both = rows.drop("summary").unionByName(ends, allowMissingColumns=True)
    return both.repartition(*by).sortWithinPartitions("conv", "slice", "block", "pos").select("conv", "slice", "block", "pos", "turn", "role", "text", *_FLAGS, "enters", "leaves", "last")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple]]]:
    """The borders of each block and its rows."""
    head, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[3] < 0:
                if head is not None:
                    yield head, held
                head, held = row, []
            else:
                held.append(row)
    if head is not None:
        yield head, held


def _repaired(head: tuple, held: list[tuple]) -> Iterator[tuple[str, str, str | None, tuple | None]]:
    """(edit, role, text, row) of a block in order; deleted rows have no text, inserted ones no row."""
    items = [_item(r[5], *r[7:10]) for r in held]
    state, last, trail = head[10], head[11], head[12]
    states = crossings(items, state, [0 if y == last else None for y in range(4)])
    for row, edits in zip(held, edits_of(items, states)):
        for e in edits:
            if e == "D":
                yield e, row[5], None, row
                continue
            state = _ENDS[row[5][:1], state] if e == "K" else NEXT[state]
            yield e, row[5] if e == "K" else ROLE[state], "" if e == "I" else row[6], None if e == "I" else row
    for e in TRAIL[state] if trail else "":
        state = NEXT[state]
        yield e, ROLE[state], "", None


def repaired_rows(rows: DataFrame, block_rows: int = _ROWS) -> DataFrame:
    """Every edit of every conversation: conv, slice, block, nth (order within a conversation), edit, turn, role, text.

    ``rows`` has conv, turn, role and text. Deleted rows have a null text;
    what stays, in order, is the repaired conversation. Blocks are solved apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for head, held in _blocks(batches):
            found = [(*head[:3], k, e, row and row[4], role, text) for k, (e, role, text, row) in enumerate(_repaired(head, held))]
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), kinds)], names=["conv", "slice", "block", "nth", "edit", "turn", "role", "text"])

    dealt = _with_borders(tagged(rows, block_rows), ["conv", "slice", "block"])
    return dealt.mapInArrow(run, "conv string, slice int, block int, nth int, edit string, turn long, role string, text string")


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_REPORT = "conv string, " + ", ".join(f"{c} long" for c in _COUNTS) + ", audit string, repaired_sha256 string"


class _Report:
    """Sums over one conversation's rows in order."""

    def __init__(self, conv: str):
        self.conv, self.counts, self.audit, self.digest = conv, dict.fromkeys(_COUNTS, 0), [], hashlib.sha256()
        self.turns: list[int] = []  # first, last, how many
        self.initial, self.started = None, False

    def add(self, head: tuple, held: list[tuple]) -> None:
        for row in held:
            if row[4] is not None and (not self.turns or row[4] != self.turns[1]):
                self.turns = [self.turns[0], row[4], self.turns[2] + 1] if self.turns else [row[4], row[4], 1]
            for name, flag in zip(_FLAGS, row[7:10]):
                self.counts[name] += flag
            initial = row[5][:1]
            self.counts["illegal"] += self.initial is not None and self.initial + initial not in _LEGAL
            self.initial = initial
        parts = []
        for e, role, text, row in _repaired(head, held):
            parts.append(e)
            self.counts["cost"] += {"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}[e]
            if e in "KR" and row[9]:
                self.counts["cost"] += CUT
            if text is not None:
                self.digest.update(f"{'\n' if self.started else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
                self.started = True
        self.audit.append("".join(parts))

    def row(self) -> tuple:
        if self.turns:
            self.counts["gaps"] = self.turns[1] - self.turns[0] + 1 - self.turns[2]
        return (self.conv, *self.counts.values(), "".join(self.audit), self.digest.hexdigest())


def repair_report(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", block_rows: int = _ROWS) -> DataFrame:
    """One row per conversation of the input, after damage: counts of faults, least cost, edits' initials, digest of the repaired rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        report, out = None, []

        def batch_of() -> pa.RecordBatch:
            kinds = (pa.string(), *[pa.int64()] * len(_COUNTS), pa.string(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["conv", *_COUNTS, "audit", "repaired_sha256"])

        for head, held in _blocks(batches):
            if report is None or report.conv != head[0]:
                if report is not None:
                    out.append(report.row())
                report = _Report(head[0])
            report.add(head, held)
            if len(out) >= 4096:
                yield batch_of()
                out = []
        if report is not None:
            out.append(report.row())
        if out:
            yield batch_of()
        release()

    found = _with_borders(tagged(damaged(conversations, conv_col, turn_col, role_col, text_col), block_rows), ["conv"]).mapInArrow(run, _REPORT)
    ids = conversations.select(F.col(conv_col).alias("conv_id")).distinct().withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")))
    return ids.join(found, "conv", "left").select(
        "conv_id",
        *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in _COUNTS),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
