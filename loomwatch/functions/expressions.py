"""Column functions over alert records. All are built-in expressions, usable in batch and streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomwatch.functions.constants import (
    ACTOR_FIELDS,
    BINARY_NAMES,
    COMMAND_PATTERNS,
    EMPTY_VALUES,
    OBJECT_FIELDS,
    SUPPRESSED_KEYS,
    TEXT_FIELDS,
    TIME_KEYS,
)

EPOCH = "TIMESTAMP_NTZ '2000-01-01 00:00:00'"
_FOLD = "18446744073709551616"


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) that depends on the given values only."""
    text = F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / 4294967296.0


def draw_key(id_col: Column, seed: int) -> Column:
    """A sort key for sampling without replacement."""
    return F.md5(F.concat_ws(":", id_col.cast("string"), F.lit(str(seed))))


def pseudonym(host: Column) -> Column:
    """A stable token for a host: domain and case don't count."""
    return F.concat(F.lit("host-"), F.substring(F.sha2(F.lower(F.substring_index(host, ".", 1)), 256), 1, 12))


def unsigned64(n: Column) -> Column:
    """Signed 64-bit values as unsigned ones; other values as they are."""
    n = n.cast("decimal(38,0)")
    return F.when((n >= F.lit("-9223372036854775808").cast("decimal(38,0)")) & (n < 0), n + F.lit(_FOLD).cast("decimal(38,0)")).otherwise(n)


def named(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that stands in the plan once, however often ``then`` names it."""
    return F.transform(F.array(value), then)[0]


def decimal_of_hex(digits: Column) -> Column:
    """A hexadecimal number of any width as a decimal one.

    Six digits are taken at a time, from the left; what has been read so far is
    held in limbs of nine decimal digits, the lowest first, which are multiplied
    and carried within one expression.
    """
    groups = F.ceil(F.length(digits) / 6).cast("int")
    padded = F.lpad(digits, groups * 6, F.lit("0"))
    values = F.transform(F.sequence(F.lit(0), groups - 1), lambda i: F.conv(F.substr(padded, i * 6 + 1, F.lit(6)), 16, 10).cast("long"))
    limb, none = F.lit(10**9).cast("long"), F.array().cast("array<bigint>")

    def one(state: Column, x: Column) -> Column:
        total = x * F.lit(1 << 24) + state["carry"]
        return F.struct((F.floor(total / limb)).cast("long").alias("carry"), F.concat(state["limbs"], F.array(total % limb)).alias("limbs"))

    def group(limbs: Column, value: Column) -> Column:
        start = F.struct(value.alias("carry"), none.alias("limbs"))
        return F.aggregate(limbs, start, one, lambda state: F.when(state["carry"] > 0, F.concat(state["limbs"], F.array(state["carry"]))).otherwise(state["limbs"]))

    limbs = F.aggregate(values, none, group)
    written = F.array_join(F.transform(F.reverse(limbs), lambda x: F.lpad(x.cast("string"), 9, "0")), "")
    return F.coalesce(F.nullif(F.ltrim(written, F.lit("0")), F.lit("")), F.lit("0"))


def canonical(value: Column, kind: Column | None = None) -> Column:
    """One spelling for values that collectors spell differently.

    Text is trimmed; decimal and hexadecimal integers of any width become
    decimals, unsigned where they are of 64 bits. ``kind`` is the type of the
    value, if known: only strings and integers change.
    """

    def of_hex(h: Column) -> Column:
        return F.when(F.length(h) > 16, decimal_of_hex(h)).otherwise(F.conv(h, 16, 10))

    def spelt(text: Column) -> Column:
        hexadecimal = F.when(text.rlike("^-?0[xX][0-9a-fA-F]+$"), F.regexp_extract(text, "^-?0[xX]0*([0-9a-fA-F]+)$", 1))
        digits = F.when(text.rlike("^[+-]?[0-9]+$"), F.regexp_extract(text, "^[+-]?0*([0-9]+)$", 1)).otherwise(named(hexadecimal, of_hex))
        return named(digits, lambda d: named(F.when(text.startswith("-") & (d != "0"), F.concat(F.lit("-"), d)).otherwise(d), lambda n: F.coalesce(folded(n), text)))

    def folded(number: Column) -> Column:
        return F.when(F.length(number) <= 20, named(number.cast("decimal(38,0)"), unsigned64).cast("string")).otherwise(number)

    out = named(F.trim(value), spelt)
    return out if kind is None else F.when(kind.isin("STRING", "BIGINT") | kind.rlike("^DECIMAL\\([0-9]+,0\\)$"), out).otherwise(value)


def canonical_type(value: Column, kind: Column) -> Column:
    """The type that ``canonical`` leaves a value with: text that is a number becomes one."""
    number = F.trim(value).rlike("^[+-]?[0-9]+$|^-?0[xX][0-9a-fA-F]+$")
    return F.when((kind == "STRING") & number, "BIGINT").otherwise(value_type(kind))


def value_type(kind: Column) -> Column:
    """Types of values as records have them: an integer is one at any width, and shapes of objects and lists don't count."""
    return (
        F.when(kind.rlike("^DECIMAL\\([0-9]+,0\\)$"), "BIGINT")
        .when(kind.rlike("^(DECIMAL|DOUBLE|FLOAT)"), "DOUBLE")
        .when(kind.startswith("OBJECT"), "OBJECT")
        .when(kind.startswith("ARRAY"), "ARRAY")
        .when(kind == "VOID", None)
        .otherwise(kind)
    )


def present(value: Column) -> Column:
    """Neither null nor a placeholder."""
    return value.isNotNull() & ~F.trim(value).isin(EMPTY_VALUES)


def context_rich(fields: Column) -> Column:
    """Whether a record tells who acted or on what."""
    return F.exists(F.array(*[F.lit(k) for k in ACTOR_FIELDS + OBJECT_FIELDS]), lambda k: F.coalesce(present(fields[k]), F.lit(False)))


def context_bucket(fields: Column) -> Column:
    return F.when(context_rich(fields), "context_rich").otherwise("context_poor")


def collapse(verdict: Column, policy: str) -> Column:
    """A verdict as a decision; null is an abstention."""
    if policy not in ("conservative", "high_precision", "abstention"):
        raise ValueError(f"unknown policy {policy!r}")
    suspicious = {"conservative": F.lit(True), "high_precision": F.lit(False), "abstention": F.lit(None).cast("boolean")}[policy]
    return F.when(verdict == "malicious", True).when(verdict == "benign", False).when(verdict == "suspicious", suspicious)


def verdict_score(verdict: Column, confidence: Column) -> Column:
    """A ranking score: a third of the range for each verdict, confidence within it."""
    rank = F.when(verdict == "benign", 0.0).when(verdict == "suspicious", 1.0).when(verdict == "malicious", 2.0)
    return F.coalesce((rank + confidence) / 3.0, F.lit(0.0))


def estimate_tokens(text: Column) -> Column:
    return F.floor(F.length(text) * 1101 / 1364).cast("long")


def text_blob(fields: Column) -> Column:
    return F.concat_ws(" ", *[F.nullif(fields[k], F.lit("")) for k in TEXT_FIELDS])


def names_binary(blob: Column) -> Column:
    lower = F.lower(blob)
    hit = F.lit(False)
    for name in BINARY_NAMES:
        hit = hit | lower.contains(name)
    return hit


def matches_command(blob: Column) -> Column:
    hit = F.lit(False)
    for pattern in COMMAND_PATTERNS:
        hit = hit | blob.rlike("(?i)" + pattern)
    return hit


def features(fields: Column, event_type: Column) -> Column:
    """The engineered feature vector of a record."""
    blob = text_blob(fields)
    filled = lambda k: F.coalesce(fields[k] != "", F.lit(False))
    return F.struct(
        event_type.alias("event_type"),
        F.coalesce(fields["EventID"], F.lit("None")).alias("event_id"),
        F.size(F.filter(F.map_keys(fields), lambda k: ~k.isin(SUPPRESSED_KEYS))).cast("long").alias("field_count"),
        F.coalesce(F.length(fields["CommandLine"]), F.lit(0)).cast("long").alias("command_line_length"),
        names_binary(blob).alias("has_binary_name"),
        matches_command(blob).alias("has_pattern"),
        filled("ParentCommandLine").alias("has_parent_command_line"),
        filled("TargetObject").alias("has_target_object"),
    )


def rebase_text(value: Column, start: Column) -> Column:
    """A time written in one of four spellings, moved so that ``start`` becomes the year 2000.

    The separator and a final Z stay, a fraction is written with six digits,
    and text in any other spelling is left alone.
    """
    bare = F.regexp_replace(value, "Z$", "")
    known = bare.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d{1,6})?$")
    moved = F.when(known, bare).try_cast("timestamp_ntz") + (F.expr(EPOCH) - start)
    day, clock = F.date_format(moved, "yyyy-MM-dd"), F.date_format(moved, "HH:mm:ss")
    fraction = F.when(bare.contains("."), F.date_format(moved, ".SSSSSS")).otherwise("")
    return F.coalesce(F.concat(day, F.substring(bare, 11, 1), clock, fraction, F.when(value.endswith("Z"), "Z").otherwise("")), value)


def rebase_fields(fields: Column, start: Column) -> Column:
    return F.transform_values(fields, lambda k, v: F.when(k.isin(TIME_KEYS), rebase_text(v, start)).otherwise(v))
