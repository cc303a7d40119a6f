"""Interpolated scores against a plain model in dictionaries, for every order."""

import math
import re
import zlib
from collections import Counter

import pytest

from loomwatch.llm.lm_score import lm_scores

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
END, BEGIN = ("end",), ("begin",)


class Counts:
    """Counts of n-grams of the documents of some splits."""

    def __init__(self, texts, order):
        self.grams = [Counter() for _ in range(order)]
        for tokens in texts:
            for k in range(order):
                self.grams[k].update(grams(tokens, k + 1))
        self.docs, self.tokens, self.types = len(texts), sum(self.grams[0].values()), len(self.grams[0])

    def estimates(self, tokens):
        """For each token the context's count and the probabilities of orders 0 to n."""
        found = [[c[g] for g in grams(tokens, k + 1)] for k, c in enumerate(self.grams)]
        for i in range(len(tokens)):
            context, p = self.tokens, [1 / (self.types + 1), found[0][i] / max(self.tokens, 1)]
            for k in range(1, len(self.grams)):
                context = found[k - 1][i - 1] if i else self.docs
                p.append(found[k][i] / max(context, 1))
            yield min(int(math.log2(context + 1)), 47), p


def grams(tokens, n):
    padded = [BEGIN] * (n - 1) + tokens
    return [tuple(padded[i : i + n]) for i in range(len(tokens))]


def weights_of(cells, order):
    """Weights by bucket from quantised probabilities, by expectation maximisation, a cell at a time."""
    flat = [1 / (order + 1)] * (order + 1)
    if not cells:
        return {}, flat
    known = [(b, [0 if q < 0 else 2 ** (-q / 4) for q in qs], n) for (b, *qs), n in cells.items()]

    def expect(weight_of):
        sums = {}
        for b, p, n in known:
            parts = [w * x for w, x in zip(weight_of(b), p)]
            total = sum(parts)
            mine = sums.setdefault(b, [0.0] * (order + 1))
            for k, x in enumerate(parts):
                mine[k] += n * x / total
        return sums

    pooled = flat
    for _ in range(60):
        sums = expect(lambda b: pooled)
        pooled = [sum(s[k] for s in sums.values()) / sum(n for _, _, n in known) for k in range(order + 1)]
    weights = {b: pooled for b in range(48)}
    for _ in range(60):
        sums = expect(lambda b: weights[b])
        for b in weights:
            raw = [x + 2 * p for x, p in zip(sums.get(b, [0.0] * (order + 1)), pooled)]
            weights[b] = [x / sum(raw) for x in raw]
    return weights, pooled


def brute(rows, order):
    tokens = {d: WORD.findall((t or "").translate(LOWER)) + [END] for d, t in rows}
    crc = {d: zlib.crc32(str(d).encode()) % 10 for d in tokens}
    fit = Counts([t for d, t in tokens.items() if crc[d] > 1], order)
    train = Counts([t for d, t in tokens.items() if crc[d] > 0], order)
    cells = Counter()
    for d, t in tokens.items():
        if crc[d] == 1:
            for bucket, p in fit.estimates(t):
                cells[bucket, *[round(-math.log2(x) * 4) if x > 0 else -1 for x in p]] += 1
    weights, _ = weights_of(cells, order)
    return {d: sum(math.log10(sum(max(w, 1e-9) * x for w, x in zip(weights[b] if weights else [1 / (order + 1)] * (order + 1), p))) for b, p in train.estimates(t)) for d, t in tokens.items()}


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_as_by_brute_force(spark, order):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    want = brute([tuple(r) for r in docs.collect()], order)
    out = lm_scores(docs.repartition(3), order=order, chunk_bytes=40_000, part_tokens=5_000).collect()
    assert {r["doc_id"] for r in out} == want.keys()
    for r in out:
        assert r["score"] == pytest.approx(want[r["doc_id"]], rel=1e-6)


def test_repeated_words_and_nothing_to_tune(spark):
    """Few documents: whichever split is empty, scores are those of the plain model."""
    rows = [(k, "a b a b c " * (k % 4)) for k in range(12)] + [(50, None), (51, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for order in (2, 3):
        for some in (rows, [r for r in rows if zlib.crc32(str(r[0]).encode()) % 10 != 1]):
            want = brute(some, order)
            got = {r["doc_id"]: r["score"] for r in lm_scores(docs.filter(docs.doc_id.isin([d for d, _ in some])), order=order).collect()}
            assert got == pytest.approx(want)
