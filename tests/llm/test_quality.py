"""Quality scores: gradient against differences, held-out accuracy, edges."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomwatch.llm import quality

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def model(tables):
    return quality.train(*tables)


def test_gradient_matches_differences():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in quality.start(1).items()}
    p["W"] *= 0.2
    begin = np.array([0, 1, 4, 6])
    x = rng.normal(size=(6, quality.WIDTH)) * 0.1
    y = np.array([1.0, 0.0, 1.0])

    def loss():
        z = quality.forward(p, x, begin)["logit"]
        return float(np.mean(np.log1p(np.exp(z)) - y * z))

    grads = quality.gradient(p, x, begin, y)
    for name in p:
        flat, g = p[name].reshape(-1), np.asarray(grads[name]).reshape(-1)
        for i in rng.integers(0, len(flat), 6):
            old = flat[i]
            flat[i] = old + 1e-5
            up = loss()
            flat[i] = old - 1e-5
            down = loss()
            flat[i] = old
            assert (up - down) / 2e-5 == pytest.approx(g[i], rel=2e-3, abs=1e-8)


def test_held_out_documents(tables, model):
    docs, labels = tables
    out = quality.predict(docs, model).join(labels, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in out)
    held = [r for r in out if r["held_out"]]
    assert sum(r["predicted"] == r["quality"] for r in held) >= 0.97 * len(held)
    good, bad = ([r["score"] for r in held if r["quality"] == y] for y in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) >= 0.99
    assert all(r["predicted"] == (r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in out)


def test_one_bad_passage_counts(spark, tables, model):
    rng = random.Random(4)
    words = tables[0].filter("doc_id = 1").first()["text"].split()
    clean = [rng.choice(words).lower() for _ in range(640)]
    shout = [f"{w.upper()}!!" for w in clean[384:448]]
    rows = [(0, " ".join(clean)), (1, " ".join(clean[:384] + shout + clean[448:]))]
    out = {r["doc_id"]: r for r in quality.predict(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert out[0]["n_passages"] == out[1]["n_passages"] == 10
    assert out[0]["score"] > out[1]["score"]
    x, begin = quality.encode(pa.array([t for _, t in rows]))
    f = quality.forward(model.parameters, x, begin)
    assert np.add.reduceat(f["a"], begin[:-1]) == pytest.approx([1, 1], abs=1e-5)
    assert int(np.argmax(f["a"][10:])) == out[1]["top_passage"]


def test_sample_is_bounded_and_fit_repeats(tables):
    docs, labels = tables
    one, two = (quality.train(docs, labels.repartition(n), most=20) for n in (1, 5))
    assert all((one.parameters[k] == two.parameters[k]).all() for k in one.parameters)


def test_whole_texts_are_encoded():
    column = pa.array(["a b c", None, "x " * 200, "", "a" * 100_000])
    x, begin = quality.encode(column)
    assert begin.tolist() == [0, 1, 2, 6, 7, 8] and not x[[1, 6]].any() and x[[0, 2, 3, 4, 5, 7]].any(axis=1).all()
    again, _ = quality.encode(column.slice(2, 1))
    assert (again == x[2:6]).all()


def test_edges(spark, tables):
    docs = spark.createDataFrame([(1, "plain text", "c"), (1, "plain text", "c"), (2, None, "c"), (3, "", "c"), (None, "no id", "c"), (None, None, "c"), (4, "word " * 50_000, "c")], "doc_id long, text string, y string").withColumns({c: F.lit("clash") for c in ("shard", "bag", "h", "one", "label")})
    none = spark.createDataFrame([], "doc_id long, quality int")
    share = quality.quality_scores(docs, none).collect()
    assert len(share) == 7 and {r["score"] for r in share} == {0.5}
    ones = spark.createDataFrame([(1, 1), (2, None), (None, 1)], "doc_id long, quality int")
    assert {r["score"] for r in quality.quality_scores(docs, ones).collect()} == {2 / 3}
    odd = spark.createDataFrame([(i, i % 2) for i in range(1, 5)] + [(4, 1), (99, 0), (None, 0)], "doc_id long, quality int").withColumn("text", F.lit("clash"))
    out = quality.quality_scores(docs, odd).collect()
    assert len(out) == 7 and all(0 <= r["score"] <= 1 for r in out)
    assert len({r["score"] for r in out if r["doc_id"] == 1}) == 1
    assert quality.quality_scores(docs.limit(0), odd).count() == 0
