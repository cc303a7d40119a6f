"""The extendible-hash index: chains, pages, owners and batches against brute force."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomwatch.llm import exact_dedup


def brute(rows):
    best, size = {}, Counter()
    for d, t in rows:
        t = t or ""
        size[t] += 1
        best[t] = max((x for x in (best.get(t), d) if x is not None), default=None)
    return sorted(((d, best[t or ""], size[t or ""], d == best[t or ""], hashlib.sha256((t or "").encode()).hexdigest()) for d, t in rows), key=repr)


def rows(first, last):
    """Texts of few lengths, a third of them one text, with nulls and empty ones."""
    return [(k, "hot text" if k % 3 == 0 else None if k % 31 == 0 else "" if k % 37 == 0 else f"text {k % 53:03d} {'x' * (k % 4)}") for k in range(first, last)]


def found(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("hash_key", [F.xxhash64, lambda t: F.length(t).cast("long"), lambda t: F.shiftleft(F.length(t).cast("long"), 58)])
@pytest.mark.parametrize("capacity,max_depth", [(5, 4), (1, 1), (20_000, 14)])
def test_index(spark, hash_key, capacity, max_depth):
    """Keys that collide are chained and compared by bytes; the directory decides nothing but who works on what."""
    first, second = rows(0, 300), rows(300, 500)
    a, b = (spark.createDataFrame(r, "doc_id long, text string").repartition(3) for r in (first, second))
    index = exact_dedup.build_index(a, capacity=capacity, max_depth=max_depth, hash_key=hash_key)
    assert found(exact_dedup.probe_index(a, index, hash_key=hash_key)) == brute(first)
    more = exact_dedup.build_index(b, capacity=capacity, max_depth=max_depth, previous=index, hash_key=hash_key)
    assert found(exact_dedup.probe_index(a.unionByName(b), more, hash_key=hash_key)) == brute(first + second)
    entries = more.collect()
    assert len(entries) == len({t or "" for _, t in first + second})
    assert len({r["bucket"] for r in entries}) >= len({r["bucket"] for r in index.collect()})
    slots = Counter(r["key"] for r in entries)
    assert all(1 <= r["slot"] <= r["chain"] == slots[r["key"]] for r in entries)


def test_one_exchange_for_texts(spark):
    """Texts of cells that aren't hot are shuffled once: the grouping by owner and the chains need no exchange of their own."""
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(50)], "doc_id long, text string")
    placed = docs.select(F.xxhash64("text").alias("key"), "text").withColumn("owner", F.pmod("key", F.lit(4)).cast("int")).repartitionById(4, F.col("owner"))
    plan = placed.groupBy("owner", "key", "text").count()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_texts_outside_the_index(spark):
    """A text that only shares a key with an entry is not found; nulls count as empty."""
    by_length = lambda t: F.length(t).cast("long")
    index = exact_dedup.build_index(spark.createDataFrame([(1, "aaa"), (2, ""), (3, "cc"), (4, "dd")], "doc_id long, text string"), hash_key=by_length)
    probe = spark.createDataFrame([(7, "bbb"), (8, "aaa"), (9, None), (10, "ee"), (11, "dd"), (12, "longer")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["keep_id"]) for r in exact_dedup.probe_index(probe, index, hash_key=by_length).collect()) == [(8, 1), (9, 2), (11, 4)]
