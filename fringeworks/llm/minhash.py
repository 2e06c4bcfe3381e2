"""Near-duplicate documents: one-permutation MinHash with optimal densification, banded buckets, star-shaped candidate edges.

1. One pass over the texts gives each document its number of distinct shingles, a 128-bit identity of the set, and the hashes of its bands. A hash of a shingle
   chooses one of BINS bins and the bin keeps its smallest hash; an empty bin takes the value of the first filled one that its own sequence of random bins, however long, comes to.
2. Documents with equal sets are one class; its smallest id stands for it from here on, so groups of copies cost one row.
3. Representatives that share a bucket form a star: its centre is paired with each member, so a bucket of n gives n - 1 pairs. Pairs of clearly unequal set sizes
   can't reach the threshold and go. The others are confirmed on their full sets of 64-bit shingle hashes.
4. Confirmed links give components. Buckets whose members still lie in several components get another centre, drawn anew for each bucket and round, and only pairs
   across components are tried, as long as a round confirms one in YIELD of its pairs. This only joins the bulk cheaply; whatever it left is done by step 5:
5. Every pair across components that shares a bucket is tried then, unless its set sizes rule it out. Of buckets of SMALL members or fewer these are listed as pairs. Members of
   larger ones are dealt into blocks by clusters of buckets, size, component and weight; each two blocks that share a bucket meet once in a task, which compares full sets and gives links only.

Defined cases: null and empty texts, and texts of white space, have no shingles, stand alone and are kept; shorter texts than a shingle are one shingle;
repeated rows and ties fall to the smallest id; rows that repeat an id are one document of several texts, linked by any of them; a row without an id stands alone and is kept; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

BINS, ROWS = 128, 4
BANDS = BINS // ROWS
#: Another round of stars is worth its jobs while one in so many of its pairs is a link; what rounds leave is tried pair by pair.
YIELD = 10
#: Buckets of more members aren't listed as pairs. Shingles of a block, about.
SMALL, BLOCK = 32, 1 << 18
#: Blocks of a cluster of buckets, about, that all may meet one another.
CLUSTER = 32
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def _first_draws() -> np.ndarray:
    """BINS x BINS: when the endless sequence of random bins that belongs to a bin comes to another for the first time."""
    first, turn = np.full((BINS, BINS), -1), 0
    while (first < 0).any():
        to = (common.mix(np.arange(turn * BINS, (turn + 1) * BINS, dtype=np.uint64) * common._MUL) % np.uint64(BINS)).astype(np.int64)
        new = first[np.arange(BINS), to] < 0
        first[np.flatnonzero(new), to[new]] = turn
        turn += 1
    return first


_FIRST = _first_draws()


def rolled(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of width words in a row; each word is mixed into what stands before it."""
    out = common.mix(words[: len(words) - width + 1])
    for j in range(1, width):
        out = common.mix(out * common._MUL + words[j : len(words) - width + 1 + j])
    return out


def shingles(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each text (A-Z in lower case), sorted within it, and where each text's begin (one more than texts)."""
    buf = np.frombuffer((b"\n".join(texts) + b"\n").lower(), np.uint8)
    starts, ends = common.spans(buf)
    words = common.span_hashes(buf, starts, ends)
    cuts = np.searchsorted(starts, np.cumsum([0] + [len(t) + 1 for t in texts]))
    counts = np.diff(cuts)
    whole = rolled(words, width) if len(words) >= width else words[:0]
    out: list[np.ndarray] = []
    for i, n in enumerate(counts):
        if n >= width:
            out.append(np.unique(whole[cuts[i] : cuts[i + 1] - width + 1]))
        elif n:
            out.append(rolled(words[cuts[i] : cuts[i + 1]], int(n)))
        else:
            out.append(np.empty(0, np.uint64))
    return np.concatenate(out) if out else np.empty(0, np.uint64), np.cumsum([0] + [len(x) for x in out])


def signatures(hashes: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """One-permutation signatures, densified: texts x BINS. A text without shingles has only _EMPTY."""
    n = len(cuts) - 1
    owner = np.repeat(np.arange(n), np.diff(cuts))
    sig = np.full(n * BINS, _EMPTY)
    np.minimum.at(sig, owner * BINS + (hashes >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64), common.mix(hashes))
    sig = sig.reshape(n, BINS)
    for i in np.flatnonzero((sig == _EMPTY).any(axis=1) & (np.diff(cuts) > 0)):
        filled = np.flatnonzero(sig[i] != _EMPTY)
        empty = np.flatnonzero(sig[i] == _EMPTY)
        sig[i, empty] = sig[i, filled[_FIRST[empty][:, filled].argmin(axis=1)]]
    return sig


def _sketch(width: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.pieces(batches):
            texts = common.text_bytes(b.column(1))
            for lo, hi in common.slabs(texts):
                hashes, cuts = shingles(texts[lo:hi], width)
                counts = np.diff(cuts)
                sums = [np.append(np.uint64(0), np.cumsum(x, dtype=np.uint64)) for x in (common.mix(hashes), common.mix(hashes ^ common._MUL))]
                ids = [common.signed(s[cuts[1:]] - s[cuts[:-1]]) for s in sums]
                sig = signatures(hashes, cuts)
                bands = np.zeros((hi - lo, BANDS), np.uint64)
                for j in range(ROWS):
                    bands = common.mix(bands * common._MUL + sig[:, j::ROWS] + np.uint64(j))
                bands += np.arange(BANDS, dtype=np.uint64) * common._MUL
                some = np.repeat(counts > 0, BANDS)
                offsets = np.append(0, np.cumsum(np.where(counts > 0, BANDS, 0))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), pa.array(counts, pa.int64()), pa.array(ids[0]), pa.array(ids[1]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(common.signed(bands.reshape(-1)[some])))],
                    ["doc_id", "n_shingles", "set1", "set2", "bands"],
                )

    return sketch


def _sets(width: int, wanted):
    """Full sets of the documents whose ids may be wanted."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.pieces(batches):
            b = b.filter(pa.array(common.with_hits(wanted.value, common.hash_column(b.column(0)), 2)))
            texts = common.text_bytes(b.column(1))
            for lo, hi in common.slabs(texts):
                hashes, cuts = shingles(texts[lo:hi], width)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(common.signed(hashes)))], ["doc_id", "shingles"])

    return sets


def _confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach percent: 100 * intersection >= percent * union."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id"))
    wanted = pairs.sparkSession.sparkContext.broadcast(common.key_filter(ids, "doc_id", 2 * pairs.count()))
    sets = common.written(texts.mapInArrow(_sets(width, wanted), "doc_id bigint, shingles array<bigint>"), "sets")
    both = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb")), "b").join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa")), "a")
    shared = F.size(F.array_intersect("sa", "sb"))
    links = common.written(both.where(100 * shared >= percent * (F.size("sa") + F.size("sb") - shared)).select("a", "b"), "links")
    common.release(sets)
    return links


def _links_of_blocks(percent: int):
    """Links between the documents of two blocks (side 0 and 1), or within one block (side 0 only), that share a band; one link for each two components that they join."""

    def links(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        ids, c, side = (group.column(x).to_numpy() for x in ("doc_id", "c", "side"))
        c = c.copy()
        bands = np.array(group.column("bands").to_pylist(), np.int64).reshape(len(ids), BANDS)
        sets = [np.asarray(x.values) for x in group.column("shingles")]
        n = np.array([len(x) for x in sets])
        codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
        cuts = np.append(0, np.cumsum(n))
        codes = [codes[cuts[i] : cuts[i + 1]] for i in range(len(ids))]
        flag = np.zeros(max(int(x.max()) for x in codes) + 1, np.int64)
        within = not side.any()
        right = np.arange(len(ids)) if within else np.flatnonzero(side == 1)
        out: list[tuple[int, int]] = []
        for i in np.flatnonzero(side == 0):
            to = right[right > i] if within else right
            to = to[(c[to] != c[i]) & (100 * np.minimum(n[to], n[i]) >= percent * np.maximum(n[to], n[i]))]
            to = to[(bands[to] == bands[i]).any(axis=1)]
            if not len(to):
                continue
            flag[codes[i]] = 1
            shared = np.add.reduceat(flag[np.concatenate([codes[j] for j in to])], np.append(0, np.cumsum(n[to])[:-1]))
            flag[codes[i]] = 0
            good = to[100 * shared >= percent * (n[to] + n[i] - shared)]
            for j in good:
                if c[j] != c[i]:
                    out.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
                    c[c == c[j]] = c[i]
        return pa.table({"a": pa.array([int(x) for x, _ in out], pa.int64()), "b": pa.array([int(x) for _, x in out], pa.int64())})

    return links


def _block_links(hot: DataFrame, reps: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links across components among the members (bucket, doc_id, n, c, k) of large buckets of k; each two documents that share one are compared once."""
    # a similarity of percent is impossible beyond neighbouring size classes
    spread = max(float(np.log(100 / percent)), 0.01) * 1.001
    home = hot.groupBy("doc_id").agg(F.min("bucket").alias("least"), F.max_by("bucket", F.struct("k", "bucket")).alias("most"), F.first("n").alias("n"), F.first("c").alias("c"))
    home = common.written(home, "homes")
    # buckets that hang together by their members are one home, so that these are dealt into few blocks; too large a cluster has a home for each largest bucket
    edges = hot.select("doc_id", F.col("bucket").alias("v")).join(home.select("doc_id", F.col("least").alias("u")), "doc_id").select("u", "v").distinct()
    cluster = components(edges).select(F.col("node").alias("least"), F.col("component").alias("cluster"))
    home = common.split_join(home, cluster, ["least"])
    small = home.groupBy("cluster").agg(F.sum("n").alias("weight")).where(F.col("weight") <= CLUSTER * BLOCK).select("cluster", F.lit(True).alias("small"))
    home = common.split_join(home, small, ["cluster"], "left").withColumn("home", F.when(F.col("small"), F.col("cluster")).otherwise(F.col("most")))
    home = common.written(home.select("doc_id", "home", "n", "c", F.floor(F.log("n") / spread).alias("class")), "homes")
    # a component that fills a block has its own, as its documents needn't meet each other
    own = home.groupBy("home", "class", "c").agg(F.sum("n").alias("weight")).where(F.col("weight") >= BLOCK).select("home", "class", "c", F.col("c").alias("own"))
    home = common.written(common.split_join(home, own, ["home", "class", "c"], "left"), "homes")
    parts = home.groupBy("home", "class", "own").agg(F.ceil(F.sum("n") / BLOCK).alias("parts"))
    parts = parts.withColumn("own_key", F.coalesce("own", F.lit(-1))).withColumn("is_own", F.col("own").isNotNull()).drop("own")
    home = home.withColumn("own_key", F.coalesce("own", F.lit(-1))).withColumn("is_own", F.col("own").isNotNull())
    home = common.split_join(home, parts, ["home", "class", "own_key", "is_own"])
    block = F.struct("home", "class", "is_own", "own_key", F.pmod(F.xxhash64("doc_id"), F.col("parts")).alias("part"))
    home = common.written(home.select("doc_id", "c", block.alias("block")), "blocks")
    in_bucket = common.written(hot.select("bucket", "doc_id").join(home.select("doc_id", "block"), "doc_id").select("bucket", "block").distinct(), "blocks")
    x, y = in_bucket.select("bucket", F.col("block").alias("x")), in_bucket.select("bucket", F.col("block").alias("y"))
    apart = (F.abs(F.col("x.class") - F.col("y.class")) > 1) | (F.col("x.is_own") & F.col("y.is_own") & (F.col("x.own_key") == F.col("y.own_key")))
    meet = common.written(x.join(y, "bucket").where((F.col("x") <= F.col("y")) & ~apart).select("x", "y").distinct(), "meetings")
    sides = meet.select(F.col("x").alias("block"), "x", "y", F.lit(0).alias("side")).unionByName(meet.where("x <> y").select(F.col("y").alias("block"), "x", "y", F.lit(1).alias("side")))
    wanted = hot.sparkSession.sparkContext.broadcast(common.key_filter(home, "doc_id", home.count()))
    sets = texts.mapInArrow(_sets(width, wanted), "doc_id bigint, shingles array<bigint>")
    # a repeated id has several sets, as in the list of pairs
    full = common.written(home.join(reps.select("doc_id", "bands"), "doc_id").join(sets, "doc_id"), "sets")
    return full.join(sides, "block").select("x", "y", "side", "doc_id", "c", "bands", "shingles").groupBy("x", "y").applyInArrow(_links_of_blocks(percent), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row: components of documents linked at percent similarity of their sets of width-word shingles."""
    every = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    texts = every.where("doc_id is not null")
    sketched = common.written(every.mapInArrow(_sketch(width), "doc_id bigint, n_shingles bigint, set1 bigint, set2 bigint, bands array<bigint>"), "sketches")
    some = sketched.where("n_shingles > 0 and doc_id is not null")
    best = F.min(F.struct("doc_id", "n_shingles", "bands"))
    classes = common.written(some.groupBy("set1", "set2").agg(best.alias("r")).select("set1", "set2", F.col("r.doc_id").alias("rep"), F.col("r.n_shingles").alias("n_shingles"), F.col("r.bands").alias("bands")), "classes")
    reps = classes.select(F.col("rep").alias("doc_id"), "n_shingles", "bands")

    member = reps.select(F.explode("bands").alias("bucket"), "doc_id", F.col("n_shingles").alias("n"))
    shared = member.groupBy("bucket").agg(F.min(F.struct("doc_id", "n")).alias("centre"), F.max("doc_id").alias("last")).where("centre.doc_id < last").drop("last")
    member = common.written(common.split_join(member, shared, ["bucket"]), "buckets")

    def pairs(centred: DataFrame) -> DataFrame:
        near = centred.where(f"doc_id <> centre.doc_id and 100 * least(n, centre.n) >= {percent} * greatest(n, centre.n)")
        return near.select(F.least("doc_id", "centre.doc_id").alias("a"), F.greatest("doc_id", "centre.doc_id").alias("b")).distinct()

    tried = common.written(pairs(member), "pairs")
    links = _confirmed(tried, texts, width, percent)
    found = common.written(components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))), "components")

    def placed_in(found: DataFrame) -> DataFrame:
        return member.select("bucket", "doc_id", "n").join(found, F.col("doc_id") == F.col("node"), "left").select("bucket", "doc_id", "n", F.coalesce("component", "doc_id").alias("c"))

    turn, good = 0, True
    while good:
        placed = placed_in(found)
        mixed = placed.groupBy("bucket").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.min_by(F.struct("doc_id", "n", "c"), F.xxhash64("doc_id", "bucket", F.lit(turn))).alias("centre")).where("lo < hi").drop("lo", "hi")
        fresh = common.written(pairs(common.split_join(placed, mixed, ["bucket"]).where("c <> centre.c")).join(tried, ["a", "b"], "left_anti"), "pairs")
        if not (n_fresh := fresh.count()):
            break
        more = _confirmed(fresh, texts, width, percent)
        tried, n_more, turn = tried.unionByName(fresh), more.count(), turn + 1
        good = n_more * YIELD >= n_fresh
        if n_more:
            links = links.unionByName(more)
            found = common.written(components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))), "components")

    placed = placed_in(found)
    mixed = placed.groupBy("bucket").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("k")).where("lo < hi").select("bucket", "k")
    left = common.written(common.split_join(placed, mixed, ["bucket"]), "left")
    few, hot = left.where(F.col("k") <= SMALL).drop("k"), left.where(F.col("k") > SMALL)
    other = few.select("bucket", F.col("doc_id").alias("b"), F.col("n").alias("m"), F.col("c").alias("d"))
    fresh = few.join(other, "bucket").where(f"doc_id < b and c <> d and 100 * least(n, m) >= {percent} * greatest(n, m)").select(F.col("doc_id").alias("a"), "b").distinct()
    fresh = common.written(fresh.join(tried, ["a", "b"], "left_anti"), "pairs")
    more = [_confirmed(fresh, texts, width, percent)] if not fresh.isEmpty() else []
    if not hot.isEmpty():
        more.append(common.written(_block_links(hot, reps, texts, width, percent), "links"))
    if more:
        for x in more:
            links = links.unionByName(x)
        found = common.written(components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))), "components")
    common.release(member, left)

    rep = common.split_join(some.select("doc_id", "n_shingles", "set1", "set2"), classes.select("set1", "set2", "rep"), ["set1", "set2"]).drop("set1", "set2")
    done = rep.join(found, F.col("rep") == F.col("node"), "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    none = sketched.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return done.unionByName(none).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
