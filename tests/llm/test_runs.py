"""Periodic runs against a search of every period."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomwatch.llm.runs import LEAST, dictionary, find_runs, periodic_runs, run_report

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words, least=LEAST):
    """(start, length, period) of every run, by comparing the words with themselves at every distance."""
    w = np.unique(np.array(words, dtype=object), return_inverse=True)[1] if len(words) else np.zeros(0, int)
    found = {}
    for q in range(1, len(w) // 2 + 1):
        same = np.concatenate([[False], w[q:] == w[:-q], [False]])
        for a, b in zip(np.flatnonzero(~same[:-1] & same[1:]), np.flatnonzero(same[:-1] & ~same[1:])):
            if b - a >= q and b - a + q >= least:
                found.setdefault((int(a), int(b - a + q)), q)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def report(doc_id, text):
    words = WORD.findall(text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (
        len(runs),
        *(best or (None,) * 3),
        1000 * best[1] // best[2] if best else None,
        sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)),
        sha(" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


def rows(df):
    return [(r["doc_id"], tuple(r[c] for c in ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"))) for r in df.collect()]


@pytest.mark.parametrize("least", [2, 3, 12])
@settings(max_examples=300, deadline=None)
@given(docs=st.lists(st.lists(st.sampled_from("abc"), max_size=60) | st.tuples(st.lists(st.sampled_from("ab"), min_size=1, max_size=15), st.integers(1, 6)).map(lambda t: (t[0] * t[1])[:-1] + ["c"] + t[0] * t[1]), max_size=4))
def test_runs_of_small_texts(docs, least):
    words = np.array([ord(w) for d in docs for w in d], np.int64)
    first = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)
    start, end, period = find_runs(words, first, least)
    for k, d in enumerate(docs):
        mine = (start >= first[k]) & (start < first[k + 1])
        assert [*zip((start - first[k])[mine].tolist(), (end - start)[mine].tolist(), period[mine].tolist())] == brute(d, least)


def test_whole_table(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = dict(rows(run_report(spark.read.parquet(f"{SF}/documents.parquet"))))
    assert out == {d: report(d, t) for d, t in docs.items()}
    assert sum(r[0] > 0 for r in out.values()) > 5


def test_one_word_many_times():
    """One progression has one period, whatever its length; names stop at the longest repeated factor."""
    words = np.zeros(100_000, np.int64)
    start, end, period = find_runs(words, np.array([0, len(words)]))
    assert (start.tolist(), end.tolist(), period.tolist()) == ([0], [100_000], [1])
    assert len(dictionary(words, np.zeros(len(words), np.int64))) == 17
    assert len(dictionary(np.arange(1000), np.zeros(1000, np.int64))) == 0


def test_edges(spark):
    given_rows = [(1, "a b " * 400), (1, "a b " * 400), (2, None), (3, ""), (None, "x y z " * 5), (None, None), (4, " \t\x0b\n"), (5, "Été été " * 9), (40, "w " * 30), (53, "one two three"), (6, "a a " * 12)]
    df = spark.createDataFrame([(*r, "clash", 7) for r in given_rows], "doc_id long, text string, start string, crc int")
    key = lambda r: (str(r[0]), repr(r[1]))
    assert sorted(rows(run_report(df)), key=key) == sorted(((d, report(d, t)) for d, t in given_rows), key=key)
    assert run_report(df.limit(0)).count() == 0
    found = {(r["doc_id"], r["start"], r["length"], r["period"]) for r in periodic_runs(df).collect()}
    assert found == {(1, 0, 800, 2), (None, 0, 15, 3), (5, 0, 18, 2), (40, 0, 30, 1), (6, 0, 12, 1)}
