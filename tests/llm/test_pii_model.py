"""What the trees decide about candidates, and texts of very many of them."""

import time

import pytest
from pyspark.sql import functions as F

from loomwatch.llm import pii

TEXT = "call 555-123-4567 or jane (at) mail (dot) com, order 4111 1111 1111 1112, base a@b.co"


@pytest.fixture(scope="module")
def rows(spark):
    return pii._with_candidates(spark.createDataFrame([(1, TEXT), (2, None), (3, "nothing")], "doc_id long, text string"), "doc_id", "text")


def texts(df):
    return {r["doc_id"]: [TEXT[s["start"] : s["end"]] for s in r["added"]] for r in df.collect()}


def test_spans_come_from_the_model(rows):
    """The same candidates and rules; only thresholds and trees differ."""
    rule = texts(pii.chosen_spans(rows, None))
    never = texts(pii.chosen_spans(rows, pii.CandidateModel([], [], [2.0] * 4)))
    always = texts(pii.chosen_spans(rows, pii.CandidateModel([], [], [0.0] * 4)))
    assert rule == {1: ["jane (at) mail (dot) com", "555-123-4567"], 2: [], 3: []} or sorted(rule[1]) == ["555-123-4567", "jane (at) mail (dot) com"]
    assert never == {1: [], 2: [], 3: []}
    assert any("4111" in t for t in always[1]) and set(always[1]) != set(rule[1])


def test_trees_do_not_see_the_rules(rows):
    assert not {"format", "context", "label"} & set(pii.FEATURES)
    found = rows.select(F.explode("found").alias("c")).select("c.*").collect()
    assert found and all(len(r["f"]) == len(pii.FEATURES) for r in found)
    assert {r["label"] for r in found} == {0.0, 1.0}


def test_fitted_trees_can_differ_from_the_rules(spark):
    """Dates written like phone numbers are told from them by a word that no feature holds: rules reject them, trees can't."""
    docs = spark.createDataFrame([(k, f"phone {k % 900 + 100}-555-{1000 + k} and also {'version' if k % 2 else 'from'} 10.{k % 250}. {k % 200}.{k % 250 + 1} x") for k in range(400)], "doc_id long, text string")
    candidates = pii._with_candidates(docs, "doc_id", "text")
    model = pii.fit_candidates(candidates)
    scored = candidates.select(F.explode("found").alias("c")).select("c.*").filter("free").select("label", model.passes(F.col("kind"), model.score(F.col("f"))).cast("int").alias("passes"), "kind")
    table = {(r["kind"], r["label"], r["passes"]): r["count"] for r in scored.groupBy("kind", "label", "passes").count().collect()}
    assert table.get((3, 1.0, 1), 0) >= 390
    assert any(label != passes for _, label, passes in table)


@pytest.mark.parametrize("piece", ["a@b.co ", "555-123-4567 ", "4111 1111 1111 1111 "])
def test_many_candidates_in_one_text(spark, piece):
    """Work grows with the candidates, not with their square."""
    docs = lambda n: spark.createDataFrame([(1, piece * n)], "doc_id long, text string")
    model = pii.CandidateModel([], [], [0.5] * 4)
    run = lambda n: pii.chosen_spans(pii._with_candidates(docs(n), "doc_id", "text"), model).first()
    run(100)
    at = time.time()
    small = run(500)
    middle = time.time()
    large = run(4000)
    assert len(small["base"]) * 8 == len(large["base"])
    assert time.time() - middle < 24 * max(middle - at, 0.5)


def test_every_candidate_is_learned_from(spark):
    """Candidates beyond any number count: a spelling that all hashes of a bounded sample could miss decides a threshold."""
    kind, found = "struct<kind:int,start:int,end:int,free:boolean,f:array<double>,label:double>", []
    for label, first in ((1.0, 1.0), (0.0, 9.0)):
        f = [0.0] * len(pii.FEATURES)
        f[0], f[pii.FEATURES.index("first")] = 1.0, first
        found.append((f, label))
    expr = lambda k: f"struct(0 AS kind, CAST(id AS INT) AS start, CAST(id + 1 AS INT) AS end, {k == 1 and 'true' or 'false'} AS free, array({', '.join(f'{x}D' for x in found[k][0])}) AS f, {found[k][1]}D AS label)"
    rows = spark.range(600_000).selectExpr("id AS doc_id", f"array(CAST(IF(id < 599990, {expr(1)}, {expr(0)}) AS {kind})) AS found")
    model = pii.fit_candidates(rows)
    passed = rows.select(F.explode("found").alias("c")).select("c.*").filter("label = 1").select(model.passes(F.col("kind"), model.score(F.col("f"))).alias("p"))
    assert model is not None and passed.count() == 10
