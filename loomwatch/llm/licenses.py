"""Licence detection with a positional index of rare words.

Templates are texts of licences and their notices. The corpus gives each licence
word its document frequency, and the index has a posting (template, offset) for
every one of a template's words of highest IDF. A file looks up those of its
words that the index has; every posting votes for the place where its template
would begin. Places with enough votes are verified: the template's mandatory key
phrase must stand there word for word. An identifier line (``SPDX-License-Identifier``)
is a template of one posting that is all key phrase.

How it runs: built-in functions only, row by row, in one pass for all templates
together: only the index in it grows with them. It is hashed into slots by the
CRC-32 of a word, so a look-up takes the same time however many licences there
are, and votes are counted by a sort, so a text of nothing but licence words
costs n log n. The texts may come as a table; they are gathered on the driver, a
row per licence text. A second scan gathers document
frequencies, as many rows as the templates have words; it is the only shuffle.

A word's index counts from 0 over all words of the text. Nulls and ties: null
text is empty and has no words, labels or places. Rows with a null or repeated
id each get a row of their own. Of two words of a template with the same IDF the
earlier one ranks first. A word that a template repeats has a posting at its
first place. An empty table gives an empty result. Other columns of the input
are not read.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwatch.llm.licence_texts import BASE_PHRASES, IDENTIFIERS, TEMPLATES
from loomwatch.llm.spans import let

_SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A template and the place where it begins, in one long: template * _STEP + place + _SHIFT.
_STEP, _SHIFT = 1 << 33, 1 << 20


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    key: tuple[str, ...]
    key_at: int
    base: bool
    rare: int | None = None  # how many of its words the index has; None: as many as of others


def _cut(text: str) -> tuple[str, ...]:
    return tuple("".join(c if c.isalnum() or ord(c) > 127 else " " for c in text).lower().split())


def load_templates(texts: list[tuple[str, str, str]] | DataFrame = TEMPLATES, identifiers: list[tuple[str, str]] = IDENTIFIERS) -> list[Template]:
    """Base phrases, which are their own key phrases, then ``texts`` and lines that state an identifier."""
    if isinstance(texts, DataFrame):
        texts = [tuple(r) for r in texts.select("label", "text", "key").orderBy("label", "text", "key").collect()]
    out = [Template(label, _cut(p), _cut(p), 0, True) for p, label in BASE_PHRASES]
    for label, text, key in texts:
        words, k = _cut(text), _cut(key)
        places = [i for i in range(len(words)) if words[i : i + len(k)] == k]
        if not k or not places:
            raise ValueError(f"the key phrase of {label} isn't in its text: {key!r}")
        out.append(Template(label, words, k, places[0], False))
    for name, label in identifiers:
        words = _cut(f"SPDX-License-Identifier: {name}")
        out.append(Template(label, words, words, 0, False, rare=1))
    return out


def _words(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, _UPPER, _LOWER), _SPLIT), lambda w: w != "")


def licence_idf(docs: DataFrame, templates: list[Template], text_col: str = "text") -> dict[str, float]:
    """IDF of every licence word over all documents."""
    vocab = sorted({w for t in templates for w in t.words})
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = F.array_distinct(F.filter(_words(text), lambda w: w.isin(vocab)))
    rows = docs.select(F.explode(F.concat(F.array(F.lit("")), found)).alias("w")).groupBy("w").count().collect()  # a row per licence word
    df = {r["w"]: r["count"] for r in rows}
    n = df.pop("", 0)
    return {w: math.log((1 + n) / (1 + df.get(w, 0))) for w in vocab}


def build_index(templates: list[Template], idf: dict[str, float], rare: int = 8) -> tuple[dict[str, list[tuple[int, int]]], list[int]]:
    """Postings (template, offset) of each template's rarest words, and how many words each template has there."""
    postings: dict[str, list[tuple[int, int]]] = {}
    sizes = []
    for k, t in enumerate(templates):
        first = {w: t.words.index(w) for w in t.words}
        order = sorted(first.items(), key=lambda x: (-idf.get(x[0], 0.0), x[1]))[: t.rare or rare]
        sizes.append(len(order))
        for w, at in order:
            postings.setdefault(w, []).append((k, at))
    return postings, sizes


def _longs(values: list[int]) -> Column:
    return F.array(*[F.lit(v).cast("long") for v in values])


def _slots(postings: dict[str, list[tuple[int, int]]]) -> tuple[Column, int]:
    """The index as an array of slots, each with the words of one CRC-32 remainder and their postings; and how many."""
    n = max(1, 2 * len(postings))
    slots: list[list[Column]] = [[] for _ in range(n)]
    for w, places in sorted(postings.items()):
        p = _longs([t * _STEP + _SHIFT - at for t, at in places])
        slots[zlib.crc32(w.encode()) % n].append(F.struct(F.lit(w).alias("w"), p.alias("p")))
    return F.array(*[F.array(*s).cast("array<struct<w:string,p:array<bigint>>>") for s in slots]), n


def _found(words: Column, templates: list[Template], postings: dict[str, list[tuple[int, int]]], sizes: list[int], least: float) -> Column:
    """Verified beginnings in order, as an array of (t, s, share)."""
    names = sorted(postings)
    table, slots = _slots(postings)
    need = _longs([1 if t.base else max(1, math.ceil(least * n)) for t, n in zip(templates, sizes)])
    size, key_at = _longs(sizes), _longs([t.key_at for t in templates])
    keys = F.array(*[F.array(*[F.lit(w) for w in t.key]) for t in templates])
    places = F.array_compact(F.transform(words, lambda w, i: F.when(w.isin(names), i)))
    slot = lambda w: F.filter(F.get(table, (F.crc32(w) % slots).cast("int")), lambda e: e["w"] == w)
    votes = F.array_sort(F.flatten(F.transform(places, lambda i: F.transform(F.flatten(F.transform(slot(F.get(words, i)), lambda e: e["p"])), lambda p: p + i))))
    part = lambda x: F.floor(x / F.lit(_STEP)).cast("int")

    def elected(v: Column) -> Column:
        """The first vote for each place that has as many as its template needs, and the number of them."""
        at = lambda x, i, k: F.coalesce(F.get(v, i + k) == x, F.lit(False))
        count = lambda x, i: sum((at(x, i, k).cast("int") for k in range(1, max(sizes))), F.lit(1))
        firsts = F.transform(v, lambda x, i: F.when(((i == 0) | (F.get(v, i - 1) != x)) & at(x, i, F.get(need, part(x)) - 1), F.struct(x.alias("x"), count(x, i).alias("n"))))
        return F.array_compact(firsts)

    begun = F.transform(
        let(votes, elected),
        lambda e: F.struct(
            part(e["x"]).alias("t"),
            (e["x"] - part(e["x"]) * F.lit(_STEP) - _SHIFT).cast("int").alias("s"),
            (e["n"] / F.get(size, part(e["x"]))).alias("share"),
        ),
    )
    key_start = lambda b: (b["s"] + F.get(key_at, b["t"])).cast("int")
    return F.filter(begun, lambda b: (key_start(b) >= 0) & (F.slice(words, F.greatest(key_start(b), F.lit(0)) + 1, F.size(F.get(keys, b["t"]))) == F.get(keys, b["t"])))


def license_report(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rare: int = 8, least: float = 0.6, texts: list[tuple[str, str, str]] | DataFrame = TEMPLATES
) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``texts`` are (label, text, key phrase) of the licences to find beside the
    base phrases and identifiers, a list or a table with columns label, text and key; ``least`` is the share of a template's ``rare`` words that must
    agree on a place. The score is the largest such share that was verified.
    """
    templates = load_templates(texts)
    postings, sizes = build_index(templates, licence_idf(docs, templates, text_col), rare)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), _words(F.coalesce(F.col(text_col), F.lit(""))).alias("words"))
    some = F.exists("words", lambda w: w.isin(sorted(postings)))
    none = F.array().cast("array<struct<t:int,s:int,share:double>>")
    rows = rows.select("doc_id", F.size("words").cast("long").alias("n_words"), F.when(some, _found(F.col("words"), templates, postings, sizes, least)).otherwise(none).alias("found"))
    starts = F.transform(F.filter("found", lambda b: b["t"] < len(BASE_PHRASES)), lambda b: b["s"])
    names = F.array(*[F.lit(t.label) for t in templates])

    def labels(found: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda b: F.get(names, b["t"])))), ",")

    return rows.select(
        "doc_id",
        "n_words",
        F.size(starts).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        labels(F.filter("found", lambda b: b["t"] < len(BASE_PHRASES))).alias("base_labels"),
        labels(F.col("found")).alias("labels"),
        F.coalesce(F.array_max(F.transform("found", lambda b: b["share"])), F.lit(0.0)).alias("score"),
    )
