"""Language identification against a plain model: counts, posteriors, ties and texts without letters."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from loomwatch.llm import langid

SF = "/root/testdata/sf0.001"


def brute(docs, n=3, bits=15, smoothing=0.5):
    """Predictions of all documents by a plain naive Bayes model over the same features."""
    counts, prior = {}, Counter()
    for d, text, lang in docs:
        if zlib.crc32(str(d).encode()) % 5 and lang is not None and text is not None and any(c.isalpha() for c in text):
            counts.setdefault(lang, Counter()).update(langid.features(text, n, bits).tolist())
            prior[lang] += 1
    labels = sorted(counts)
    total = {x: sum(counts[x].values()) + smoothing * (1 << bits) for x in labels}
    out = {}
    for d, text, _ in docs:
        if text is None or not any(c.isalpha() for c in text) or not labels:
            out[d] = ("und", 0.0)
            continue
        found = Counter(langid.features(text, n, bits).tolist())
        logs = [math.log(prior[x] / sum(prior.values())) + sum(k * math.log((counts[x][f] + smoothing) / total[x]) for f, k in found.items()) for x in labels]
        best = max(range(len(labels)), key=lambda i: (logs[i], -i))
        out[d] = (labels[best], 1 / sum(math.exp(v - logs[best]) for v in logs))
    return out


def test_every_document_as_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    want = brute([tuple(r) for r in docs.collect()])
    out = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(docs).collect()}
    assert {d: x for d, (x, _) in out.items()} == {d: x for d, (x, _) in want.items()}
    assert all(out[d][1] == pytest.approx(s, abs=1e-6) for d, (_, s) in want.items())


def test_texts_without_letters(spark):
    texts = ["² ½ ①", "12 34", "Ⅷ", "…", "_", "", None, "中文", "a", "é", "ª", "１２"]
    docs = spark.createDataFrame([(100 + k, t, None) for k, t in enumerate(texts)] + [(k, "plain words here", "en") for k in range(20)] + [(k, "des mots simples", "fr") for k in range(20, 40)], "doc_id long, text string, lang string")
    out = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    und = {texts[d - 100] for d, r in out.items() if d >= 100 and r["lang_pred"] == "und"}
    assert und == {"² ½ ①", "12 34", "Ⅷ", "…", "_", "", None, "１２"}
    assert all(r["score"] == 0 for r in out.values() if r["lang_pred"] == "und")


def test_ties_go_to_the_first_label(spark):
    docs = spark.createDataFrame([(k, "the very same text", x) for k in range(60) for x in ("b", "a", "c")], "doc_id long, text string, lang string")
    out = langid.identify(docs).collect()
    assert {r["lang_pred"] for r in out} == {"a"} and all(r["score"] == pytest.approx(1 / 3) for r in out)


def test_sparse_product():
    rng = np.random.default_rng(3)
    found = [rng.integers(0, 1 << 8, n).astype(np.uint32) for n in (0, 5, 300, 0, 1)]
    table = rng.normal(size=(257, 3))
    counts, columns, begin = langid._sparse_counts(found, 8)
    dense = np.array([np.bincount(f, minlength=256) for f in found])
    for cells in (1, 7, 1 << 18):
        langid._CELLS = cells
        assert langid._sparse_product(counts, columns, begin, table) == pytest.approx(dense @ table[:256])
    langid._CELLS = 1 << 18
    assert langid.has_letter("a") and not langid.has_letter("²")
