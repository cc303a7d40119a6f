"""Match positions with built-in functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def empty_spans() -> Column:
    return F.array().cast("array<struct<kind:int,start:int,end:int>>")


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often ``then`` names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def spans_of(text: Column, pattern: str, kind: int, group: int = 0, least: int = 0, keep: Callable[[Column], Column] | None = None, test: str | None = None, block: int = 64) -> Column:
    """Leftmost non-overlapping matches as an array of (kind, start, end).

    Offsets are code points. Dropped are matches whose ``group`` is shorter
    than ``least`` or whose text fails ``keep``. ``test`` is a cheaper pattern
    without which no match is possible. Matches are added up in blocks, so that
    a text with very many of them is not copied once for each. A pattern must
    not repeat a group without bound except possessively: Java's matcher goes
    one call deeper for every other repetition.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    inner = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    gaps = F.split(text, pattern, -1)

    def measure(m: Column, g: Column) -> Column:
        good = F.length(m["inner"]) >= least
        if keep is not None:
            good = good & keep(m["whole"])
        return F.struct(F.length(g).alias("gap"), F.length(m["whole"]).alias("long"), good.alias("good"))

    def step(acc: Column, m: Column) -> Column:
        begin = acc["at"] + m["gap"]
        end = begin + m["long"]
        span = F.struct(F.lit(kind).alias("kind"), begin.alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(m["good"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    def place(matches: Column, at: Column) -> Column:
        return F.aggregate(matches, F.struct(at.alias("at"), empty_spans().alias("spans")), step)["spans"]

    def placed_by_block(blocks: Column) -> Column:
        width = lambda b: F.aggregate(b, F.lit(0), lambda n, m: n + m["gap"] + m["long"])
        begins = F.aggregate(blocks, F.array(F.lit(0)), lambda acc, b: F.concat(acc, F.array(F.element_at(acc, -1) + width(b))))
        return F.flatten(F.zip_with(blocks, F.slice(begins, 1, F.size(blocks)), place))

    def placed(matches: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(matches) - 1) / block).cast("int")), lambda i: F.slice(matches, i * block + 1, block))
        return F.when(F.size(matches) <= block, place(matches, F.lit(0))).otherwise(let(blocks, placed_by_block))

    matches = F.zip_with(F.arrays_zip(whole.alias("whole"), inner.alias("inner")), F.slice(gaps, 1, F.size(whole)), measure)
    possible = text.rlike(test if test is not None else pattern)
    return F.when(possible, let(matches, placed)).otherwise(empty_spans())


def distinct_sorted(spans: Column) -> Column:
    """Each span once, in order."""
    return let(F.array_sort(spans), lambda l: F.filter(l, lambda s, i: (i == 0) | (s != F.get(l, i - 1))))


def joined(spans: Column, names: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def count_kind(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
