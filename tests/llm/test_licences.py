"""Licence labels and scores: whole and changed texts, places against brute force, runs of licence words."""

import random

import pytest

from loomwatch.llm import licenses
from loomwatch.llm.licence_texts import IDENTIFIERS, TEMPLATES


def report(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r for r in licenses.license_report(docs).collect()}


def brute(texts, least=0.6, rare=8):
    """Beginnings by trying every template at every place."""
    templates = licenses.load_templates()
    cut = [licenses._cut(t or "") for t in texts]
    vocab = {w for t in templates for w in t.words}
    df = {w: sum(w in c for c in map(set, cut)) for w in vocab}
    out = []
    for words in cut:
        labels, base, best = set(), [], 0.0
        for t in templates:
            ranked = sorted({w: t.words.index(w) for w in t.words}.items(), key=lambda x: (df[x[0]], x[1]))[: t.rare or rare]
            for s in range(-len(t.words), len(words)):
                share = sum(0 <= s + at < len(words) and words[s + at] == w for w, at in ranked) / len(ranked)
                k = s + t.key_at
                if k >= 0 and words[k : k + len(t.key)] == t.key and share >= (0 if t.base else least):
                    labels.add(t.label)
                    best = max(best, share)
                    base += [s] if t.base else []
        out.append((",".join(sorted(labels)), len(base), min(base, default=None), max(base, default=None), best))
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    plain = ["some other words of a file"] * 5 + [None, "", "the software is free and the license is here", "GNU GNU general public license public license"]
    whole = [f"Header {k}. {text} And more." for k, (_, text, _) in enumerate(TEMPLATES)]
    changed = []
    for _, text, _ in TEMPLATES:
        for share in (0.1, 0.3, 0.6):
            changed.append(" ".join("changed" if rng.random() < share else w for w in text.split()))
        words = text.split()
        changed += [" ".join(words[len(words) // 3 :]), " ".join(words[: len(words) // 2]), text + " " + text]
    lines = [f"# SPDX-License-Identifier: {name}-or-later\nsome code" for name, _ in IDENTIFIERS]
    return plain + whole + changed + lines + ["spdx license", "SPDX-License-Identifier: another", "spdx " * 50]


def test_against_every_place(spark, texts):
    out = report(spark, texts)
    for d, want in enumerate(brute(texts)):
        r = out[d]
        assert (r["labels"], r["n_base"], r["first_word"], r["last_word"]) == want[:4], texts[d]
        assert r["score"] == pytest.approx(want[4])
    for k, (label, _, _) in enumerate(TEMPLATES):
        assert label in out[9 + k]["labels"].split(",") and out[9 + k]["score"] == 1.0


def test_rarest_word_may_be_missing(spark):
    """A file is found by its other rare words where a template's rarest word is changed."""
    text = next(t for label, t, _ in TEMPLATES if label == "mit")
    plain = ["permission is hereby granted free of charge to any person obtaining a copy"] * 3
    assert report(spark, [*plain, text.replace("sublicense", "x").replace("merge", "y")])[3]["labels"] == "mit"


def test_long_run_and_bad_key(spark):
    r = report(spark, ["gnu general public license " * 30_000])[0]
    assert (r["n_base"], r["first_word"], r["last_word"], r["labels"]) == (30_000, 0, 4 * 29_999, "gpl")
    with pytest.raises(ValueError):
        licenses.load_templates([("x", "some words", "other words")])


def test_identifiers(spark):
    out = report(spark, [f"// SPDX-License-Identifier: {name}" for name, _ in IDENTIFIERS] + ["SPDX-License-Identifier: other"])
    for d, (name, label) in enumerate(IDENTIFIERS):
        assert label in out[d]["labels"].split(",") and out[d]["score"] == 1.0, name
    assert (out[len(IDENTIFIERS)]["labels"], out[len(IDENTIFIERS)]["score"]) == ("", 0.0)


def test_many_licences_from_a_table(spark):
    """Hundreds of texts of a table, each found by its own words alone."""
    texts = [(f"l{k}", f"alpha{k} beta{k} gamma{k} common words of licence delta{k} epsilon{k}", f"beta{k} gamma{k}") for k in range(400)]
    table = spark.createDataFrame(texts, "label string, text string, key string")
    docs = spark.createDataFrame([(k, f"some words, then {texts[k][1]} and more") for k in range(0, 400, 7)] + [(1, "common words of licence")], "doc_id long, text string")
    out = {r["doc_id"]: r["labels"] for r in licenses.license_report(docs, texts=table).collect()}
    assert out == {**{k: f"l{k}" for k in range(0, 400, 7)}, 1: ""}
