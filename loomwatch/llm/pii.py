"""Personal data: base patterns, and candidates chosen by boosted trees.

Base spans are the leftmost non-overlapping matches of a pattern per kind that
pass a check (address parts, digit counts, Luhn). Besides them, generators of
high recall propose overlapping spans for each kind: the base patterns without
their checks, and looser spellings. Features of a candidate's format and its
context go to gradient-boosted trees, fitted on all candidates.
A candidate's label comes from rules of its kind and not from the base: the
spelling, once normalised, has the kind's format, and what stands around it does
not speak against it. The trees see neither rule, only plain measures of the
candidate and its neighbours, so a candidate may pass that no rule labels, or
fail that one does; the thresholds hold such errors down. A threshold per kind is calibrated on held-out candidates
that overlap no base span, and what passes is added unless it overlaps a base
span or a better candidate. Base spans always stay.

How it runs: built-in functions and MLlib only. The fitted trees are turned into
column expressions, so that scoring is part of the same projection as the
patterns: no shuffle, no join back, and rows with repeated ids stay apart.
Texts without digits or an at sign skip the generators. No candidate is left
out of the fit: equal ones are counted first and weigh their number; those apart
from base spans, the only ones that can be added, weigh 16 times as much.

Offsets are code points, end exclusive. Nulls and ties: null text is empty and
has no spans. Among overlapping candidates the higher score stays, then the
earlier one, then the longer one. If there are candidates of one label
only, or fewer than 100 to learn from, there is nothing to fit and the rules themselves decide. Other columns of
the input are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwatch.llm.shared import stored
from loomwatch.llm.spans import count_kind, digest, distinct_sorted, joined, let, spans_of

KINDS = ["email", "ip", "card", "phone"]

#: Fixed base patterns, by kind. Groups repeat possessively, which takes the same matches without a call for each repetition.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++"
IP = r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"

#: Candidate generators: kind, pattern, cheap test. A pattern's matches don't overlap; those of different patterns do.
GENERATORS = [
    (0, EMAIL, "@"),
    (0, r"[A-Za-z0-9._%+-]{1,64}\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]{2,63}){1,4}", r"@|\(at\)|\[at\]"),
    (0, r"(?i)[a-z0-9._%+-]{1,64}(?:@|\x20@\x20|\x20?(?:\(at\)|\[at\])\x20?)[a-z0-9-]{1,63}(?:(?:\.|\x20\.\x20|\x20?(?:\(dot\)|\[dot\])\x20?)[a-z0-9-]{2,63}){1,4}", r"(?i)@|\(at\)|\[at\]"),
    (1, IP, r"[0-9]\.[0-9]"),
    (1, r"[0-9]{1,3}(?:\.\x20?[0-9]{1,3}){3}", r"[0-9]\.\x20?[0-9]"),
    (2, r"[0-9](?:[\x20-]?[0-9]){9,24}", r"[0-9](?:[\x20-]?[0-9]){9}"),
    (2, r"[0-9]{4}(?:[\x20.-]?[0-9]{4}){2}[\x20.-]?[0-9]{1,7}", r"[0-9]{4}[\x20.-]?[0-9]{4}"),
    (3, PHONE, r"\+[0-9]"),
    (3, r"\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}", r"[0-9]{2}\)?[\x20.-][0-9]{3}"),
    (3, r"\b00[0-9][\x20().0-9-]{7,16}[0-9]", "00[0-9]"),
]
_ANY = r"@|\([aA][tT]\)|\[[aA][tT]\]|[0-9](?:[\x20().-]{0,3}[0-9]){6}|[0-9]\.\x20?[0-9]+\.\x20?[0-9]"

#: Words before a span that speak for a kind.
CUES = [
    r"(?i)mail|contact|write",
    r"(?i)\bip\b|address|host|server",
    r"(?i)card|visa|credit|payment",
    r"(?i)tel|phone|call|mobile|fax",
]
FEATURES = ["is_email", "is_ip", "is_card", "is_phone", "length", "digits", "marks", "groups", "plus", "brackets", "at", "dots", "luhn", "parts", "before", "after", "cue", "longest", "spaces", "first", "last_part"]


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    """Whether the digits of a string pass Luhn's check."""
    values = F.transform(F.split(F.reverse(_digits(m)), ""), lambda c, i: F.coalesce(c.try_cast("int"), F.lit(0)) * F.when(i % 2 == 1, 2).otherwise(1))
    total = F.aggregate(values, F.lit(0), lambda acc, v: acc + F.when(v > 9, v - 9).otherwise(v))
    return total % 10 == 0


def is_address(m: Column) -> Column:
    return m.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")


def is_card(m: Column) -> Column:
    n = F.length(_digits(m))
    return F.when((n >= 13) & (n <= 19), luhn(m)).otherwise(False)


def is_phone(m: Column) -> Column:
    n = F.length(_digits(m))
    return (n >= 9) & (n <= 15)


def base_spans(text: Column) -> Column:
    """Accepted base spans, by kind as listed, then start."""
    return F.concat(
        spans_of(text, EMAIL, 0, test="@"),
        spans_of(text, IP, 1, keep=is_address, test=r"[0-9]\.[0-9]+\.[0-9]"),
        spans_of(text, CARD, 2, keep=is_card, test=r"[0-9](?:[\x20-]?[0-9]){12}"),
        spans_of(text, PHONE, 3, keep=is_phone, test=r"\+[0-9]"),
    )


def _overlap(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def plain_email(m: Column) -> Column:
    """An address with its at sign and dots written out; uneven blanks stay."""
    m = F.regexp_replace(m, r"(?i)\x20?(?:\(at\)|\[at\])\x20?|\x20@\x20", "@")
    return F.regexp_replace(m, r"(?i)\x20?(?:\(dot\)|\[dot\])\x20?|\x20\.\x20", ".")


def plain_address(m: Column) -> Column:
    return F.regexp_replace(m, r"\.\x20", ".")


def _formats(m: Column) -> list[Column]:
    """By kind, whether a spelling has the kind's format once normalised."""
    email, digits = plain_email(m), _digits(m)
    n = F.length(digits)
    return [
        F.when(F.length(email) <= 320, email.rlike(r"^[A-Za-z0-9_%+-]+(?:\.[A-Za-z0-9_%+-]+)*+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,24}$") & ~email.rlike(r"@-|@.*(?:-\.|\.-)")).otherwise(False),
        is_address(plain_address(m)),
        is_card(m) & digits.rlike("^[2-6]"),
        F.when(m.startswith("+"), is_phone(m)).when(m.startswith("00"), digits.rlike("^00[1-9]") & (n >= 11) & (n <= 17)).otherwise((n >= 9) & (n <= 12)),
    ]


def _contexts(m: Column, before: Column, after: Column, cue: Column) -> list[Column]:
    """By kind, whether a spelling's neighbours and marks allow it; a cue allows marks that are ambiguous alone."""
    apart = ~before.rlike(r"[0-9A-Za-z_]$|[0-9][.-]$") & ~after.rlike(r"^[0-9A-Za-z_]|^[.-][0-9]")
    lone = ~m.contains(" ") | ~(before.rlike(r"[0-9]\x20$") | after.rlike(r"^\x20[0-9]"))
    cut_card = m.contains(" ") & (before.rlike(r"[0-9]{4}\x20$") | after.rlike(r"^\x20[0-9]{4}"))
    return [
        ~before.rlike("[0-9A-Za-z._%+-]$") & ~after.rlike("^[0-9A-Za-z_@-]") & (cue | ~m.rlike(r"\x20[@.]\x20")),
        apart
        & ~before.rlike(r"[0-9]\.\x20$|(?i)(?:version|\bver|\bv|release|section|chapter|clause|table|figure)\.?\x20?$")
        & ~after.rlike(r"^\.\x20[0-9]")
        & (cue | ~m.contains(" ") | m.rlike(r"^[0-9]+\.[0-9]+\.\x20[0-9]+\.[0-9]+$")),
        apart & ~cut_card & (cue | m.rlike(r"^[0-9]+$|^[0-9]{4}([\x20.-])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}$|^[0-9]{4}([\x20.-])[0-9]{6}\2[0-9]{5}$")),
        apart & lone & (cue | m.rlike(r"^\+|^00[0-9]*[\x20().-]|^[0-9]{3}([.-])[0-9]{3}\1[0-9]{4}$|^\([0-9]{2,4}\)[\x20.-]?[0-9]{3,4}[\x20.-][0-9]{3,4}$|^0[0-9]{2,3}([\x20.-])[0-9]{3,4}\2[0-9]{3,4}$")),
    ]


def _of_kind(c: Column, values: list[Column]) -> Column:
    out = F.lit(False)
    for kind, value in enumerate(values):
        out = F.when(c["kind"] == kind, value).otherwise(out)
    return out


def _cut(text: Column, c: Column) -> list[Column]:
    """A candidate's spelling and what stands around it, cut from the text once."""
    begin = F.greatest(c["start"] - 24, F.lit(0))
    return [
        F.substring(text, c["start"] + 1, c["end"] - c["start"]).alias("m"),
        F.substring(text, begin + 1, c["start"] - begin).alias("before"),
        F.substring(text, c["end"] + 1, F.lit(5)).alias("after"),
    ]


def _features(c: Column) -> Column:
    """What the trees see: plain measures of a candidate and its neighbours, none of the rules that label it."""
    m, before, after = c["m"], c["before"], c["after"]
    groups = F.filter(F.split(m, "[^0-9A-Za-z]+"), lambda g: g != "")
    cue = _of_kind(c, [before.rlike(words) for words in CUES])
    values = [
        *[(c["kind"] == k) for k in range(len(KINDS))],
        F.length(m),
        F.length(_digits(m)),
        F.length(F.regexp_replace(m, "[0-9A-Za-z]", "")),
        F.size(groups),
        m.startswith("+"),
        m.contains("("),
        m.contains("@"),
        F.length(F.regexp_replace(m, r"[^.]", "")),
        luhn(m),
        is_address(plain_address(m)),
        before.rlike("[0-9A-Za-z_]$") | before.rlike("[0-9][.-]?\\x20?$"),
        after.rlike("^[0-9A-Za-z_@]") | after.rlike("^[.-]?\\x20?[0-9]"),
        cue,
        F.coalesce(F.array_max(F.transform(groups, F.length)), F.lit(0)),
        F.length(F.regexp_replace(m, r"[^\x20]", "")),
        F.coalesce(F.regexp_extract(m, "[0-9]", 0).try_cast("int"), F.lit(-1)),
        F.length(F.regexp_extract(m, "([A-Za-z]+)$", 1)),
    ]
    return F.array(*[v.cast("int").cast("double") for v in values])


def _label(c: Column) -> Column:
    """1 where a spelling has its kind's format and nothing around it speaks against it."""
    m, before, after = c["m"], c["before"], c["after"]
    cue = _of_kind(c, [before.rlike(words) for words in CUES])
    return (_of_kind(c, _formats(m)) & _of_kind(c, _contexts(m, before, after, cue))).cast("int").cast("double")


def _blocks(spans: Column, block: int = 64) -> Column:
    """Spans by start, in blocks with the stretch that each covers."""

    def cut(ordered: Column) -> Column:
        n = F.size(ordered)
        whole = lambda b: F.struct(F.get(b, F.lit(0))["start"].alias("low"), F.array_max(F.transform(b, lambda s: s["end"])).alias("high"), b.alias("spans"))
        places = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / block).cast("int"))).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: let(F.slice(ordered, i * block + 1, block), whole))

    return let(F.array_sort(spans), cut)


def _met(blocks: Column, c: Column, also: Callable[[Column], Column] = lambda o: F.lit(True)) -> Column:
    """Whether a span of the blocks overlaps ``c``; only blocks that reach it are gone through."""
    return F.exists(blocks, lambda b: (b["low"] < c["end"]) & (c["start"] < b["high"]) & F.exists(b["spans"], lambda o: _overlap(o, c) & also(o)))


def _with_candidates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, base spans, and candidates with features, label and whether they overlap no base span."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))

    def found(t: Column) -> Column:
        spans = distinct_sorted(F.concat(*[spans_of(t, pattern, kind, test=test) for kind, pattern, test in GENERATORS]))
        return F.when(t.rlike(_ANY), spans).otherwise(F.array().cast("array<struct<kind:int,start:int,end:int>>"))

    def candidates(t: Column, base: Column, spans: Column) -> Column:
        starts = F.transform(base, lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end")))

        def described(blocks: Column) -> Column:
            cut = lambda c: F.struct(*[c[k].alias(k) for k in ("kind", "start", "end")], (~_met(blocks, c)).alias("free"), *_cut(t, c))
            told = lambda c: F.struct(*[c[k].alias(k) for k in ("kind", "start", "end", "free")], _features(c).alias("f"), _label(c).alias("label"))
            return F.transform(F.transform(spans, cut), told)

        return let(_blocks(starts), described)

    # Every part that is used more than once is a lambda's variable: a column would be worked out again for each element.
    both = lambda t: let(base_spans(t), lambda base: F.struct(base.alias("base"), candidates(t, base, found(t)).alias("found")))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), let(text, both).alias("s")).select("doc_id", "s.base", "s.found")


def _expression(tree, f: Column) -> Column:
    """A regression tree as a conditional expression over a feature array."""

    def walk(node) -> Column:
        if node.getClass().getSimpleName() == "LeafNode":
            return F.lit(float(node.prediction()))
        split = node.split()
        return F.when(F.get(f, F.lit(int(split.featureIndex()))) <= float(split.threshold()), walk(node.leftChild())).otherwise(walk(node.rightChild()))

    return walk(tree._call_java("rootNode"))


class CandidateModel:
    """Boosted trees over candidate features, with a threshold for each kind."""

    def __init__(self, trees: list, weights: list[float], thresholds: list[float]):
        self.trees, self.weights, self.thresholds = trees, weights, thresholds

    def score(self, f: Column) -> Column:
        margin = sum((F.lit(w) * _expression(t, f) for t, w in zip(self.trees, self.weights)), F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-2.0 * margin))

    def passes(self, kind: Column, score: Column) -> Column:
        return score >= F.element_at(F.array(*[F.lit(x) for x in self.thresholds]), kind + 1)


def fit_candidates(rows: DataFrame, trees: int = 16, depth: int = 4, precision: float = 0.98, seed: int = 17, free_weight: float = 16.0, least: int = 100) -> CandidateModel | None:
    """Fit on all candidates; None if they have one label only or are fewer than ``least`` without the held-out ones.

    Candidates with the same measures, label and part are one row with their
    number as weight, so every candidate counts and the trees' input is as long
    as there are distinct ones. A fifth of the candidates, by hash, is held out.
    A kind's threshold is the least one, in hundredths, above which at least
    ``precision`` of its candidates are labelled as personal data, and 2 (never)
    where there is none. It is calibrated on the held-out candidates apart from
    base spans; if those are fewer than 20, on all apart from base spans, and if
    there are none, on all of the kind.
    """
    held = F.pmod(F.xxhash64("doc_id", "c.start", "c.end", F.lit(seed)), F.lit(5)) == 0
    alike = rows.select("doc_id", F.explode("found").alias("c")).groupBy("c.kind", "c.free", held.alias("held"), "c.label", "c.f").agg(F.count(F.lit(1)).alias("n"))
    alike = stored(alike, "pii-candidates")  # read in as many partitions as its size asks for, since each level of each tree is a job
    named = alike.select("kind", "free", "held", "label", "f", "n", *[F.get("f", F.lit(i)).alias(name) for i, name in enumerate(FEATURES)])
    weight = F.col("n") * F.when(F.col("free"), free_weight).otherwise(1.0)
    data = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(named).select("kind", "free", "held", "label", "features", "f", "n", weight.alias("weight")).cache()
    try:
        learn = data.filter("NOT held")
        seen = {r["label"]: r["n"] for r in learn.groupBy("label").agg(F.sum("n").alias("n")).collect()}
        if len(seen) < 2 or sum(seen.values()) < least:
            return None
        boosted = GBTClassifier(labelCol="label", featuresCol="features", weightCol="weight", maxIter=trees, maxDepth=depth, maxBins=1024, seed=seed)  # borders come from all rows up to 2^20 distinct ones
        fitted = boosted.fit(learn.select("label", "features", "weight"))
        model = CandidateModel(fitted.trees, list(fitted.treeWeights), [2.0] * len(KINDS))
        cells = data.groupBy("kind", "free", "held", F.floor(model.score(F.col("f")) * 100).cast("int").alias("s")).agg(F.sum(F.col("label") * F.col("n")).alias("good"), F.sum("n").alias("n")).collect()  # 1616 rows at most
    finally:
        data.unpersist()
    for kind in range(len(KINDS)):
        mine = [c for c in cells if c["kind"] == kind]
        free = [c for c in mine if c["free"]]
        apart = [c for c in free if c["held"]]
        mine = apart if sum(c["n"] for c in apart) >= 20 else free or mine
        good = n = 0.0
        for s in sorted({c["s"] for c in mine}, reverse=True):
            good += sum(c["good"] for c in mine if c["s"] == s)
            n += sum(c["n"] for c in mine if c["s"] == s)
            if good >= precision * n:
                model.thresholds[kind] = max(s / 100, 0.5)
    return model


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, base and added spans (kind, start, end)."""
    rows = _with_candidates(docs, id_col, text_col)
    return chosen_spans(rows, fit_candidates(rows))


def chosen_spans(rows: DataFrame, model: CandidateModel | None) -> DataFrame:
    """doc_id, base and added spans: free candidates that the trees score above their kind's threshold, the best of those that overlap."""
    score = (lambda c: c["label"]) if model is None else (lambda c: model.score(c["f"]))
    passes = (lambda c: c["p"] > 0) if model is None else (lambda c: model.passes(c["kind"], c["p"]))
    scored = lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"), score(c).alias("p"))

    def beats(a: Column, b: Column) -> Column:
        return (a["p"] > b["p"]) | ((a["p"] == b["p"]) & ((a["start"] < b["start"]) | ((a["start"] == b["start"]) & ((a["end"] > b["end"]) | ((a["end"] == b["end"]) & (a["kind"] < b["kind"]))))))

    def best(able: Column) -> Column:
        return let(_blocks(able), lambda blocks: F.filter(able, lambda c: ~_met(blocks, c, lambda o: beats(o, c))))

    able = F.filter(F.transform(F.filter("found", lambda c: c["free"]), scored), passes)
    added = F.transform(let(able, best), lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    return rows.select("doc_id", "base", added.alias("added"))


def pii_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, counts of base kinds, base_sha256, spans."""
    names = F.array(*[F.lit(k) for k in KINDS])
    by_kind = lambda a, b: F.when(a["kind"] != b["kind"], a["kind"] - b["kind"]).otherwise(a["start"] - b["start"])
    found = find_pii(docs, id_col, text_col)
    return found.select(
        "doc_id",
        *[count_kind(F.col("base"), k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)],
        digest(joined(F.col("base"), names)).alias("base_sha256"),
        joined(F.array_sort(F.concat("base", "added"), by_kind), names).alias("spans"),
    )
