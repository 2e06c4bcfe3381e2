"""Periodic runs against brute force over all periods, and the query's digests."""

import hashlib
import random
import zlib

import pytest
from conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fringeworks.llm import periodic, queries


def slow_runs(w, least=12):
    """Every period in turn: stretches in which words a period apart are equal, less those that have a smaller period."""
    out = []
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i < len(w) - q:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            part = w[i : j + q]
            if len(part) >= max(least, 2 * q) and not any(part[r:] == part[: len(part) - r] for r in range(1, q)):
                out.append((i, len(part), q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def slow_collapse(w, found):
    return [x for i, x in enumerate(w) if not any(s + q <= i < s + n for s, n, q in found)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=60), st.sampled_from([2, 4, 12]))
def test_runs(letters, least):
    assert [tuple(r) for r in periodic.runs(letters, least).tolist()] == slow_runs(letters, least)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(1, 2), max_size=40), max_size=6))
def test_nothing_lies_outside_of_stretches(texts):
    got = periodic.runs_of([[b"%d" % x for x in t] for t in texts])
    assert [[tuple(r) for r in g.tolist()] for g in got] == [slow_runs(t) for t in texts]


def test_suffix_tree():
    rnd = random.Random(2)
    for _ in range(60):
        s = [rnd.randint(1, rnd.choice([1, 2, 9])) for _ in range(rnd.randint(1, 80))]
        tree = periodic.SuffixTree(s)
        tree.tour()
        assert tree.order == sorted(range(len(s) + 1), key=lambda i: s[i:])
        assert tree.inverse_order() == sorted(range(len(s) + 1), key=lambda i: [-x for x in s[i:]])
        pairs = [(i, j) for i in range(len(s) + 1) for j in range(len(s) + 1) if i != j]
        got = tree.common(*(periodic.np.array(x) for x in zip(*pairs)))
        for (i, j), n in zip(pairs, got.tolist()):
            assert s[i : i + n] == s[j : j + n] and s[i + n : i + n + 1] != s[j + n : j + n + 1] or max(i, j) + n == len(s)


TEXTS = [None, "", " \n\t", "one", "a b c " * 4, "a b c " * 3 + "d " + "a b c " * 5, "x " * 11, "x " * 12, "so " + "very " * 3000 + "long", "Zürich ñandú ré " * 9, "a b " * 12, "p q r s t u v " * 2, "p q r s t u v " * 2 + "p"]


def test_odd_tables(spark):
    """Nulls, empty and long texts, ids that are null or repeat, clashing names; each row by itself."""
    rows = [*enumerate(TEXTS), (None, "k l m n " * 6), (None, None), (4, "a b c " * 4), (4, "other")]
    docs = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], "doc_id bigint, text string, runs int, n_words int, collapsed int")
    got = sorted((str(r.doc_id), r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic.periodic_runs(docs).collect())
    want = []
    for i, t in rows:
        w = (t or "").encode().split()
        found = slow_runs(w) if len(w) < 500 else [(1, 3000, 1)]
        want.append((str(i), len(w), found, b" ".join(slow_collapse(w, found)).decode()))
    assert got == sorted(want)
    assert periodic.periodic_runs(docs.limit(0)).count() == 0


@pytest.fixture(scope="module")
def answer(spark):
    return {r.doc_id: r for r in queries.op11_periodic_runs(spark, SF).collect()}


def test_query(spark, answer):
    """All documents of less than 600 words by brute force, the longer ones by their planted period."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()
    assert len(answer) == len(docs)
    planted = 0
    for i, text in docs:
        w, h = text.encode().split(), zlib.crc32(str(i).encode())
        n, g, r = len(w), h // 10, answer[i]
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (k - a) % p] for k in range(a, n)]
            planted += 1
            if n - a >= max(12, 2 * p):
                assert r.n_runs and r.length >= n - a
        if n < 600:
            found = slow_runs(w)
            lines = "".join(f"{s},{k},{q}\n" for s, k, q in found)
            best = min(found, key=lambda x: (-x[1], x[0], x[2]), default=None)
            digests = (hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(slow_collapse(w, found))).hexdigest())
            assert (r.n_runs, r.runs_sha256, r.collapsed_sha256) == (len(found), *digests)
            assert (r.start, r.length, r.period, r.exponent_milli) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
    assert planted > 10
