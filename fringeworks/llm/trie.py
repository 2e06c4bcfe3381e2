"""Prefix trie of conversations: every distinct sequence of first turns is a node, with its members and sums over its subtree.

1. Turns are sorted by (conversation, turn) across tasks, and numbered by task and conversation; only the few conversations that lie in several tasks need the counts of others, so a
   conversation may hold any share of all rows. The digest of a prefix is the exclusive or of two 64-bit hashes of (number, role, text) of its turns: 128 bits. Texts move no further.
2. Count-min screening: tasks count digests in HASHES rows of saturating two-bit counters (once, again). The sum over tasks over-estimates, never under-estimates: an estimate of one proves that no
   other conversation has the prefix. Such nodes are emitted where they stand: one member, one leaf, nothing saved. Only prefixes that may be shared shuffle, and are grouped exactly, by digest.
3. Sums over subtrees: a node belongs to its smallest member. So the sum over a node's subtree is the sum over its members of what belongs to them from its depth on: suffix sums by
   conversation (in pieces of PIECE depths, whose totals are added up first), then one sum a node. No rounds over depths.
4. The ids that end in a node are sorted across tasks, joined to pieces of texts there, and only these pieces come together to be hashed one after another.

Counters have at most 3 x 2^COUNTERS bits (48 MiB) in a task, whatever the input; fuller ones let more prefixes shuffle, and results stay exact.

Defined cases: a null role or text is the empty one; turns stand by turn, null first, those that tie by role and text; turns of no conversation (null id) are left out; conversations without turns
belong to the root only; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

HASHES, COUNTERS = 3, 27
#: Depths of a piece of a conversation, and ids of a piece of text.
PIECE, IDS = 4096, 4096
_KEY = ("key1", "key2", "depth")
_PAIR = "segment int, bits0 binary, bits1 binary"
_NODES = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def numbered(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", also: tuple[str, ...] = ()) -> DataFrame:
    """(conv, place, total, role, text, ...): each turn's place in its conversation, from 0, and how many turns that has; nulls and ties as said above."""
    empty = F.lit("")
    rows = turns.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("bigint").alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col("role"), empty).alias("role"), F.coalesce(F.col("text"), empty).alias("text"), *also)
    # rows that are equal otherwise still go to different tasks; they are interchangeable
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("tie")]
    rows = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    # the upper bits of the running number are the task's
    rows = common.written(rows.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)).drop("turn", "tie"), "turns")
    counts = rows.groupBy("conv", "part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    whole = Window.partitionBy("conv")
    counts = counts.withColumns({"total": F.sum("n").over(whole), "before": F.sum("n").over(whole.orderBy("part")) - F.col("n")})
    return rows.join(counts, ["conv", "part"]).select("conv", (F.col("before") + F.col("at") - F.col("first")).alias("place"), "total", "role", "text", *also)


def prefixes(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """(conv, depth, total, key, parent and whole digests (two columns each), size): a row for each prefix of each conversation, the empty one too; size: code points of the last text.
    turns as numbered() gives them; conversations (conv, total): all of them."""
    content = turns.select("conv", F.floor(F.col("place") / PIECE).alias("part"), "total", (F.col("place") + 1).alias("depth"), F.xxhash64(F.lit(1), "place", "role", "text").alias("e1"), F.xxhash64(F.lit(2), "text", "place", "role").alias("e2"), F.char_length("text").cast("bigint").alias("size"))
    content = common.written(content, "contents")
    parts = content.groupBy("conv", "part").agg(F.bit_xor("e1").alias("x1"), F.bit_xor("e2").alias("x2"), F.min("depth").alias("from"))
    earlier, whole = Window.partitionBy("conv").orderBy("from").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("conv")
    parts = parts.withColumns({f"{c}{i}": F.coalesce(F.bit_xor(f"x{i}").over(w), F.lit(0).cast("bigint")) for c, w in (("o", earlier), ("w", whole)) for i in (1, 2)}).drop("x1", "x2", "from")
    within = Window.partitionBy("conv", "part").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    rows = content.join(parts, ["conv", "part"])
    rows = rows.withColumns({f"key{i}": F.bit_xor(f"e{i}").over(within).bitwiseXOR(F.col(f"o{i}")) for i in (1, 2)})
    rows = rows.select("conv", "depth", "total", "key1", "key2", *[F.col(f"key{i}").bitwiseXOR(F.col(f"e{i}")).alias(f"up{i}") for i in (1, 2)], *[F.col(f"w{i}").alias(f"whole{i}") for i in (1, 2)], "size")
    zero = F.lit(0).cast("bigint")
    ends = rows.where("depth = total").select("conv", F.col("whole1").alias("w1"), F.col("whole2").alias("w2"))
    roots = conversations.join(ends, "conv", "left").select("conv", zero.alias("depth"), "total", zero.alias("key1"), zero.alias("key2"), F.lit(None).cast("bigint").alias("up1"), F.lit(None).cast("bigint").alias("up2"), F.coalesce("w1", zero).alias("whole1"), F.coalesce("w2", zero).alias("whole2"), zero.alias("size"))
    return rows.unionByName(roots)


# ---------------------------------------------------------------- screening


def _width(rows: int) -> int:
    """Counters of a row: a power of two."""
    return min(1 << COUNTERS, max(common.SEGMENT_BITS, 1 << int(np.ceil(np.log2(max(1, 4 * rows))))))


def _places(keys: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """The counter of each key in each row of counters, as a number among all."""
    for k, s in enumerate(common.slots(keys, width, HASHES)):
        yield s + k * width


def _counted(width: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, again = np.zeros(HASHES * width // 8, np.uint8), np.zeros(HASHES * width // 8, np.uint8)
        for b in batches:
            for s in _places(common.hash_column(b.column(0)), width):
                s.sort()
                common.set_slots(again, s[1:][s[1:] == s[:-1]])
                s = np.unique(s)
                common.set_slots(again, s[(once[s >> 3] >> (s & 7).astype(np.uint8)) & 1 == 1])
                common.set_slots(once, s)
        yield from common.segments(once, again)

    return count


def _added(group: pa.Table) -> pa.Table:
    """Saturating sums of a segment's counters."""
    once = again = np.zeros(common.SEGMENT_BITS // 8, np.uint8)
    for a, b in zip(group.column("bits0").to_pylist(), group.column("bits1").to_pylist(), strict=True):
        a, b = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
        once, again = once | a, again | b | (once & a)
    return pa.table({"segment": pa.array([group.column("segment")[0].as_py()], pa.int32()), "bits0": pa.array([once.tobytes()], pa.binary()), "bits1": pa.array([again.tobytes()], pa.binary())})


def screened(rows: DataFrame) -> DataFrame:
    """prefixes() with alone, up_alone and whole_alone: whether the estimates of the prefix, of its parent and of the whole conversation prove that they have one member."""
    width = _width(rows.count())
    parts = rows.select("key1").mapInArrow(_counted(width), _PAIR).groupBy("segment").applyInArrow(_added, _PAIR)
    again = rows.sparkSession.sparkContext.broadcast(common.gathered(parts, HASHES * width, "bits1"))

    def one(keys: pa.Array) -> pa.Array:
        """Keys of which some counter didn't go beyond one."""
        have, k = again.value, common.hash_column(keys.fill_null(0))
        least = np.zeros(len(k), bool)
        for s in _places(k, width):
            least |= (have[s >> 3] >> (s & 7).astype(np.uint8)) & 1 == 0
        return pa.array(least)

    proved = F.arrow_udf(one, "boolean")
    return rows.withColumns({"alone": proved("key1"), "up_alone": F.col("up1").isNotNull() & proved("up1"), "whole_alone": proved("whole1")})


# ---------------------------------------------------------------- nodes


def _ends(rows: DataFrame) -> DataFrame:
    """(key1, key2, depth, ends): the SHA-256 of the conversations that end in each node, as numbers in ascending order, joined by commas."""
    order = [*_KEY, "conv"]
    pieces = "key1 bigint, key2 bigint, depth bigint, first bigint, ids string"

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pieces of the ids of a node that follow one another."""
        key, ids = None, []
        for b in batches:
            out = []
            for *k, conv in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if ids and (k != key or len(ids) == IDS):
                    out.append((*key, ids[0], ",".join(map(str, ids))))
                    ids = []
                key = k
                ids.append(conv)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.string() if i == 4 else pa.int64()) for i in range(5)], [c.split()[0] for c in pieces.split(", ")])
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.string() if i == 4 else pa.int64()) for i, x in enumerate((*key, ids[0], ",".join(map(str, ids))))], [c.split()[0] for c in pieces.split(", ")])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pieces of a node, which follow one another, through its hash."""
        key = sha = None
        for b in batches:
            out = []
            for *k, _, ids in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if k != key:
                    if key:
                        out.append((*key, sha.hexdigest()))
                    key, sha = k, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.string() if i == 3 else pa.int64()) for i in range(4)], [*_KEY, "ends"])
        if key:
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.string() if i == 3 else pa.int64()) for i, x in enumerate((*key, sha.hexdigest()))], [*_KEY, "ends"])

    sorted_ids = rows.where("depth = total").select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    texts = sorted_ids.mapInArrow(joined, pieces)
    return texts.repartition(*_KEY).sortWithinPartitions(*_KEY, "first").mapInArrow(hashed, "key1 bigint, key2 bigint, depth bigint, ends string")


def _suffix_sums(rows: DataFrame) -> DataFrame:
    """rows (conv, depth, ..., saved, leaf) with saved and leaf summed over a conversation's depths from each on."""
    rows = rows.withColumn("piece", F.floor(F.col("depth") / PIECE))
    totals = rows.groupBy("conv", "piece").agg(F.sum("saved").alias("s"), F.sum("leaf").alias("l"))
    later = Window.partitionBy("conv").orderBy(F.desc("piece")).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("conv", "piece", F.sum("s").over(later).alias("more_saved"), F.sum("l").over(later).alias("more_leaf")).where("more_leaf is not null")
    within = Window.partitionBy("conv", "piece").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"saved": F.sum("saved").over(within), "leaf": F.sum("leaf").over(within)}).join(totals, ["conv", "piece"], "left")
    return rows.withColumns({"saved": F.col("saved") + F.coalesce("more_saved", F.lit(0)), "leaf": F.col("leaf") + F.coalesce("more_leaf", F.lit(0))}).drop("piece", "more_saved", "more_leaf")


def trie_nodes(rows: DataFrame) -> DataFrame:
    """The nodes of prefixes()."""
    rows = common.written(screened(rows), "prefixes")
    nothing = hashlib.sha256(b"").hexdigest()
    one = F.lit(1).cast("bigint")
    zero = F.lit(0).cast("bigint")
    last: Column = F.col("depth") == F.col("total")

    shared = rows.where("not alone")
    groups = shared.groupBy(*_KEY).agg(F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.sum(last.cast("bigint")).alias("n_ends"), F.min("size").alias("size"), F.min("up1").alias("up1"), F.min("up2").alias("up2"), F.bool_or("up_alone").alias("up_alone"))
    groups = common.written(groups, "groups")
    # what a node adds to sums over subtrees belongs to its smallest member, and so does the leaf at the end of a tail that was emitted alone
    own = groups.select(F.col("conv_id").alias("conv"), "depth", ((F.col("n_convs") - 1) * F.col("size")).alias("saved"), (F.col("n_ends") == F.col("n_convs")).cast("bigint").alias("leaf"))
    members = shared.select("conv", "depth", "key1", "key2", "whole_alone").join(own, ["conv", "depth"], "left").select("conv", *_KEY, "whole_alone", F.coalesce("saved", zero).alias("saved"), F.coalesce("leaf", zero).alias("leaf"))
    members = _suffix_sums(members)
    sums = members.groupBy(*_KEY).agg(F.sum("saved").alias("saved_tokens"), F.sum(F.col("leaf") + F.col("whole_alone").cast("bigint")).alias("n_leaves"))
    # children of shared nodes: other shared ones, and the beginnings of tails
    heads = rows.where("alone and depth > 0 and not up_alone").select("up1", "up2", "depth", F.col("conv").alias("conv_id"))
    below = groups.where("depth > 0 and not up_alone").select("up1", "up2", "depth").unionByName(heads.drop("conv_id"))
    children = below.groupBy(F.col("up1").alias("key1"), F.col("up2").alias("key2"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))
    keys = list(_KEY)
    nodes = groups.join(sums, keys).join(children, keys, "left").join(_ends(shared), keys, "left")
    upper = groups.select(F.col("key1").alias("up1"), F.col("key2").alias("up2"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"))
    up = ["up1", "up2", "depth"]
    nodes = common.split_join(nodes, upper, up, "left")
    parent = F.when(F.col("up_alone"), F.col("conv_id")).otherwise(F.col("parent_conv_id"))
    nodes = nodes.select("conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", F.coalesce("n_children", zero).alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(nothing)).alias("ends_sha256"))

    ends = F.when(last, F.sha2(F.col("conv").cast("string").cast("binary"), 256)).otherwise(nothing)
    tails = rows.where("alone").select(F.col("conv").alias("conv_id"), "depth", "up1", "up2", "up_alone", one.alias("n_convs"), (~last).cast("bigint").alias("n_children"), one.alias("n_leaves"), zero.alias("saved_tokens"), ends.alias("ends_sha256"))
    inner = tails.where("up_alone or depth = 0").withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.col("conv_id")))
    first = common.split_join(tails.where("not up_alone and depth > 0"), upper, up)
    return nodes.unionByName(inner.select(*_NODES)).unionByName(first.select(*_NODES))


def prefix_trie(turns: DataFrame, conversations: DataFrame | None = None, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """Of turns (conversation, turn, role, text): conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of every node. conversations: a table
    whose ids may also have no turns."""
    rows = numbered(turns, conv_col, turn_col)
    own = rows.where("place = 0").select("conv", "total")
    if conversations is not None:
        others = conversations.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("bigint").alias("conv")).distinct()
        own = others.join(own, "conv", "full").select("conv", F.coalesce("total", F.lit(0).cast("bigint")).alias("total"))
    return trie_nodes(prefixes(rows, own))
