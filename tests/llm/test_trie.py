"""The prefix trie against a plain tree, with counters so few that most prefixes look shared, and with conversations in several pieces."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from fringeworks.llm import queries, trie


def slow_nodes(conversations):
    """{id: [(role, text), ...]} to sorted rows of nodes."""
    members = defaultdict(list)
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[c] for c in children[p]) or 1
        saved[p] = (len(members[p]) - 1) * len(p[-1][1] if p else "") + sum(saved[c] for c in children[p])
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(conversations[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[0], r[1]))


def slow_rebuilt(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(t)] for c, t in turns.items()}
    out = {}
    for c, t in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = turns.get(c - c % 100, [])[:h] + t[h:]
    return turns, out


def rows_of(df):
    return sorted((tuple(r[c] for c in trie._NODES) for r in df.collect()), key=lambda r: (r[0], r[1]))


SCHEMA = "conv_id bigint, turn int, role string, text string, depth int, key1 int, part int, total int"


@pytest.fixture(scope="module")
def rows():
    """Common first turns, a long conversation and its copy, copies, null turns, roles and texts, ties, repeated rows, rows without a conversation."""
    out = [(c, k, "user" if k % 2 == 0 else None, f"text {(c * 7 + k) % 3}" if k % 4 else None) for c in range(180, 260) for k in range(c % 7 + 1)]
    out += [(c, k, "u", f"é{k % 5}") for c in (300, 301) for k in range(60)]
    out += [(400 + c, k, "u", "same") for c in range(40) for k in range(3)]
    out += [(500, None, "b", "x"), (500, 1, "b", "y"), (500, 1, "a", "z"), (500, 1, "a", "z"), (501, None, None, None), (None, 1, "u", "t"), (None, None, None, None), (700, 1, "u", ""), (701, 3, "u", "")]
    return out


@pytest.mark.parametrize(("proved", "piece", "ids"), [(1, 4096, 4096), (1, 7, 3), (2, 4096, 2), (3, 7, 4096)])
def test_nodes(spark, rows, monkeypatch, proved, piece, ids):
    """proved: of so many prefixes with one member the counters prove one only, as if they were full."""
    for name, value in (("PIECE", piece), ("IDS", ids)):
        monkeypatch.setattr(trie, name, value)
    screened = trie.screened
    some = lambda c, key: F.col(c) & (F.pmod(F.coalesce(key, F.lit(0)), F.lit(proved)) == 0)
    monkeypatch.setattr(trie, "screened", lambda x: screened(x).withColumns({"alone": some("alone", F.col("key1")), "up_alone": some("up_alone", F.col("up1")), "whole_alone": some("whole_alone", F.col("whole1"))}))
    table = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], SCHEMA).repartition(5)
    plain, rebuilt = slow_rebuilt(rows)
    assert rows_of(trie.prefix_trie(table)) == slow_nodes(plain)
    turns, conversations = queries.rebuilt_turns(table)
    assert rows_of(trie.trie_nodes(trie.prefixes(turns, conversations))) == slow_nodes(rebuilt)


def test_screening(spark, rows):
    """What the counters prove is true, and with room they prove nearly all that is."""
    prefixes = trie.prefixes(trie.numbered(spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string")), spark.createDataFrame([], "conv bigint, total bigint"))
    got = trie.screened(prefixes).withColumn("n", F.count("*").over(trie.Window.partitionBy("key1", "key2"))).groupBy("alone", F.expr("n = 1").alias("single")).count().collect()
    found = {(r.alone, r.single): r["count"] for r in got}
    assert (True, False) not in found and found[True, True] > 20 * found.get((False, True), 0)


def test_conversations_without_turns(spark):
    table = spark.createDataFrame([(1, 0, "u", "a"), (2, 0, "u", "a")], "conv_id bigint, turn int, role string, text string")
    ids = spark.createDataFrame([(1,), (2,), (9,), (9,), (None,)], "conv_id bigint")
    assert rows_of(trie.prefix_trie(table, ids)) == slow_nodes({1: [("u", "a")], 2: [("u", "a")], 9: []})
    assert rows_of(trie.prefix_trie(table.limit(0), ids.where("conv_id = 9"))) == slow_nodes({9: []})
    assert rows_of(trie.prefix_trie(table.limit(0))) == []
