"""Every operator on nulls, empty and long texts, repeated rows, clashing columns and empty tables."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomwatch.llm import decontaminate, exact_dedup, langid, licenses, lm_score, ngram_join, packing, pii, secrets, url_filters
from loomwatch.llm.queries import tokenizer_path

LONG = "word and other words of a long text " * 4000
ROWS = [
    (1, "The first text is here and it is plain", "en", "a", 10),
    (2, "The first text is here and it is plain", "en", "a", 10),
    (3, None, "en", None, None),
    (4, "", None, "b", 0),
    (5, "   \n\t ", "fr", "b", 3),
    (None, "une ligne de texte avec des mots", "fr", "b", 3),
    (None, None, None, None, None),
    (7, LONG, "en", "a", len(LONG)),
    (8, LONG + "end", "en", "a", len(LONG)),
    (9, "1234 !!! 5678", "en", "c", 4),
    (9, "1234 !!! 5678", "en", "c", 4),
    (10, "d'accord, l'été é è ê", "fr", "c", 4),
    (11, "x", "en", "c", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["id", "t", "n", "key", "part", "rep", "bucket", "cell", "component", "base", "found", "words", "hit", "start", "length", "chunk", "split", "label", "blob", "row", "node", "th", "at", "text_sha256", "keep_id", "g", "nth", "kept"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    return df.withColumns({c: F.lit("clash") for c in CLASH})


@pytest.fixture(scope="module")
def none(spark, docs):
    return spark.createDataFrame([], docs.schema)


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "word and other words of a long text"), (2, None), (3, ""), (3, "x")], "item_id long, text string")


ONE_EACH = {
    "dedup": lambda d, b: exact_dedup.exact_duplicates(d),
    "ngram": lambda d, b: ngram_join.ngram_components(d),
    "lang": lambda d, b: langid.identify(d),
    "lm": lambda d, b: lm_score.lm_scores(d),
    "license": lambda d, b: licenses.license_report(d),
    "pii": lambda d, b: pii.pii_report(d),
    "secret": lambda d, b: secrets.secret_report(d),
}


@pytest.mark.parametrize("name", sorted(ONE_EACH))
def test_one_row_per_row(docs, none, benchmark, name):
    assert ONE_EACH[name](docs, benchmark).count() == len(ROWS)
    assert ONE_EACH[name](none, benchmark).count() == 0


def test_packing(docs, none):
    out = packing.pack_documents(docs, tokenizer_path()).toPandas()
    assert out.groupby(["sequence_id"])["length"].sum().max() <= 4096
    assert (out["start"] == 0).sum() == len(ROWS)
    assert packing.pack_documents(none, tokenizer_path()).count() == 0


def test_decontamination(spark, docs, none, benchmark):
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, benchmark).collect()}
    assert found == {(7, 1), (8, 1), (11, 3)}
    assert decontaminate.contaminated(none, benchmark).count() == 0
    assert decontaminate.contaminated(docs, benchmark.limit(0)).count() == 0
    assert decontaminate.drop_contaminated(docs, benchmark).count() == len(ROWS) - 3


def test_stages_keep_columns(docs):
    for out in (langid.keep_identified(docs), exact_dedup.drop_exact_duplicates(docs), ngram_join.keep_one_of_each(docs)):
        assert out.columns == docs.columns
    assert {r["doc_id"] for r in langid.keep_identified(docs).collect()} >= {1, 2, 7, 8}


def test_url_filters(spark):
    captures = spark.createDataFrame([(1, "http://a.b.example.org/x", 5), (2, None, 5), (3, "", 5), (4, "http://EXAMPLE.org:80", None), (5, "http://example.org./", 10), (5, "http://example.org./", 10), (6, "http://u@badexample.org/", 5)], "page_id long, url string, fetched_at int")
    captures = captures.withColumns({c: F.lit("clash") for c in ("host", "domain", "u", "at", "matches", "row")})
    changes = spark.createDataFrame(
        [("example.org", "/", "c", 1, "add"), ("example.org", "/", "c", 10, "remove"), ("example.org", "/", "c", 10, "add"), ("b.example.org", "/x", "d", 1, "add"), (None, "/", "c", 1, "add"), ("q", None, None, None, "add")],
        "domain string, path string, category string, at int, action string",
    )
    out = {r["capture"]["page_id"]: (r["matches"], r["rule"]) for r in url_filters.evaluate_captures(captures, changes).collect()}
    assert out == {1: (2, "b.example.org/x"), 2: (0, None), 3: (0, None), 4: (0, None), 5: (0, None), 6: (0, None)}
    assert url_filters.filter_captures(captures, changes).columns == captures.columns
    assert url_filters.evaluate_captures(captures.limit(0), changes).count() == 0
    assert url_filters.evaluate_captures(captures, changes.limit(0)).count() == 7


def test_deep_hosts(spark):
    deep = ".".join("abcdefghijkl") + ".example.org"
    captures = spark.createDataFrame([(1, f"http://{deep}/", 5), (2, f"http://x.{deep}/", 5), (3, "http://example.org/", 5)], "page_id long, url string, fetched_at int")
    changes = spark.createDataFrame([(deep, "/", "c", 1, "add"), (deep, "/", "c", 1, "add")], "domain string, path string, category string, at int, action string")
    out = {r["capture"]["page_id"]: r["matches"] for r in url_filters.evaluate_captures(captures, changes).collect()}
    assert out == {1: 1, 2: 1, 3: 0}


def runs(n):
    """Texts of n characters or so that repeat one thing."""
    units = ["4", "4 ", "b.", "1.", "+", "+1", "-", "password=", "5-", "ab12", "GNU ", "a@b.co ", "x", "token=abcdefgh "]
    return ["a@" + (u * (n // len(u))) + "c" if u == "b." else u * (n // len(u)) for u in units]


def test_long_runs(spark):
    """Runs of one kind of character end no executor, and base spans are those of the patterns."""
    from test_truth import PII, SECRETS, pii_spans, secret_spans

    short = runs(2_000)
    docs = spark.createDataFrame(list(enumerate(short)), "doc_id long, text string")
    for report, spans, kinds in ((pii.pii_report, pii_spans, PII), (secrets.secret_report, secret_spans, SECRETS)):
        out = {r["doc_id"]: r for r in report(docs).collect()}
        for d, text in enumerate(short):
            want = spans(text)
            assert out[d]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), (d, want[:3], out[d]["spans"][:80])
            assert [out[d][f"n_{k[0]}"] for k in kinds] == [sum(s.startswith(k[0] + ":") for s in want) for k in kinds]
    long = spark.createDataFrame(list(enumerate(runs(100_000))), "doc_id long, text string")
    for found in (pii.base_spans(long["text"]), secrets.findings(long["text"], secrets.BASE_RULES)):
        long.select(found).write.format("noop").mode("overwrite").save()
    assert licenses.license_report(long).count() == len(short)


def test_decontamination_tells_rows_apart(spark):
    """A chance candidate of one row does not replace the true window of another without an id or with the same."""
    import random

    rng = random.Random(5)
    item = [f"w{k}" for k in range(20)]
    rows = []
    for doc_id in (None, 5):
        for _ in range(60):  # the item's words in shuffled runs: they meet by chance and are too far away
            runs = [item[k : k + 4] for k in range(0, 20, 4)]
            rng.shuffle(runs)
            rows.append((doc_id, " ".join(sum(runs, []))))
        rows.append((doc_id, " ".join(item)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame([(None, " ".join(item)), (1, " ".join(item)), (1, "quite another item of some more words in a row")], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r["distance"] for r in decontaminate.contaminated(docs, bench).collect()}
    assert found == {(d, i): 0 for d in (None, 5) for i in (None, 1)}


def test_stages_decide_per_row(spark):
    """Rows without an id or with a repeated one are kept or dropped by their own text."""
    rows = [(5, "A"), (5, "B"), (9, "A"), (None, "A"), (None, "C"), (None, "C"), (6, "D"), (6, "D"), (None, "E"), (None, None), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("more", F.lit(1))
    out = exact_dedup.drop_exact_duplicates(docs)
    assert out.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr) == sorted([(9, "A"), (5, "B"), (None, "C"), (6, "D"), (None, "E"), (8, "")], key=repr)

    def words(k, n=20):
        return " ".join(f"{k}{i}" for i in range(n))

    rows = [(2, words("a")), (2, words("b")), (4, words("a") + " x"), (None, words("b") + " x"), (None, words("c")), (None, words("c") + " x"), (6, "D"), (6, "D"), (7, None), (7, None), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("th", F.lit(1))
    out = ngram_join.keep_one_of_each(docs)
    assert out.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr)
    c = next(t for d, t in got if d is None)
    assert got == sorted([(2, words("a")), (2, words("b")), (None, c), (6, "D"), (7, None), (7, None), (8, "")], key=repr) and c.startswith("c0")

    leak = "one two three four five six seven eight nine ten"
    rows = [(None, leak), (None, "clean"), (5, "so " + leak), (5, "clean too"), (6, None), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, leak)], "item_id long, text string")
    out = decontaminate.drop_contaminated(docs, bench).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in out), key=repr) == sorted([(None, "clean"), (5, "clean too"), (6, None), (None, None)], key=repr)


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Nulls, texts without letters, repeated ids, copies, a leak, a long text and clashing columns through all stages; then no rows."""
    import random

    import corpus_pipeline

    rng = random.Random(8)
    vocabulary = {"en": [f"the{chr(97 + k % 26)}th{k}" for k in range(200)], "fr": [f"é{chr(97 + k % 26)}eau{k}" for k in range(200)]}

    def text(lang):
        return " ".join(rng.choices(vocabulary[lang], k=30))

    leak = "one two three four five six seven eight nine ten"
    plain = [(k, text(lang), lang, "s", 1) for k, lang in enumerate(["en", "fr"] * 10)]
    odd = [
        (None, None, None, None, None), (30, None, "en", "s", 1), (31, "", "en", None, 0), (32, "12 34 !!", None, "s", 8),
        (0, text("en"), "en", "s", 1), (None, text("fr"), None, None, None), (33, plain[1][1], "fr", "t", 1),
        (34, plain[2][1] + " more", "en", "t", 1), (35, f"{text('en')} {leak} {text('en')}", "en", "t", 1), (36, LONG, "en", "t", len(LONG)),
    ]
    docs = spark.createDataFrame(plain + odd, SCHEMA).withColumns({c: F.lit("clash") for c in CLASH})
    bench = spark.createDataFrame([(1, leak), (2, None), (3, "")], "item_id long, text string")
    for name, rows in (("some", docs), ("none", docs.limit(0))):
        rows.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        bench.write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    out = corpus_pipeline.run(spark, f"{tmp_path}/some").toPandas()
    ids = sorted((-1 if d != d or d is None else int(d)) for d in out.loc[out["start"] == 0, "doc_id"])
    assert ids == sorted([-1, 0, 0, *range(2, 20), 33, 36])
    assert out.groupby("sequence_id")["length"].sum().max() <= 4096
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_batches_are_bounded_by_bytes(spark):
    """Spark's own bound is 64 MB; a bound that the session sets is left alone."""
    from loomwatch.llm.shared import in_batches

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.range(0, 6000, 1, 1).selectExpr("id", "repeat('words ', 800) AS text")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows], "bytes": [b.nbytes]})

    run = lambda: [(r["n"], r["bytes"]) for r in in_batches(docs, sizes, "n long, bytes long").collect()]
    before = spark.conf.get(key, None)
    try:
        spark.conf.unset(key)
        found = run()
        assert sum(n for n, _ in found) == 6000 and max(b for _, b in found) < 5 << 20
        spark.conf.set(key, str(1 << 20))
        assert max(b for _, b in run()) < 2 << 20
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def test_sets_of_long_texts_are_made_in_parts():
    import pandas as pd

    from loomwatch.llm import ngram_join

    texts = [" ".join(f"w{k * j % 997}" for k in range(60_000)) for j in range(1, 20)] + [None, "", "one two"]
    assert sum(len(t or "") for t in texts) > 2 * ngram_join._TEXT
    tokens, at = ngram_join.ngram_sets(pa.array(texts, pa.string()), 3)
    got = ngram_join._sets(pd.Series(texts), 3)
    assert [s.tolist() for s in got] == [tokens[a:b].tolist() for a, b in zip(at[:-1], at[1:])]
    often = got[0][::2]
    assert ngram_join._among(often, got[1]).tolist() == np.isin(got[1], often).tolist()
    assert not ngram_join._among(often[:0], got[1]).any()
