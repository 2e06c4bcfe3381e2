"""Mixing sources to target weights: Sainte-Lague apportionment of equal-token blocks, then seeded selection of blocks.

The catalogue of sources (name, rows, words) is all that reaches the driver: one row per source, and more than MAX_SOURCES is an error. There,
targets are set by filling up to the caps, and the mix's blocks of BLOCK words go to the sources by the highest quotients target / (2 k + 1).
A source's documents are dealt by a seeded hash into shards of about SHARD_ROWS rows, and shards into about as many divisions as a division has shards. A source's blocks go to its
divisions, and a division's to its shards, by the highest quotients of their words, none above its cap: a source with a third of all rows has as many more shards, and no task sees more
than the square root of their number. In a shard, documents stand in a seeded order and form a row of words, cut into blocks (the last may be short). Of the words of a quota, all
of the row are taken as often as they fit in, and for the rest blocks by their seeded hashes, the smallest first; the last of these as far as the quota goes. A document takes what falls on
it, at most cap times its size.

Defined cases: a null text has no words and takes none; a null source is a source of its own, last in order; null ids stand first in a shard; an empty table gives an
empty result; ties in quotients go to the earlier source, division or shard; rows equal in id and size are interchangeable; names of the mix's own columns are changed where the
input has them. Reruns agree: everything hangs on ids, sizes and the seed. Rows that are equal in id, size and source are numbered, across tasks, and the number has a part in their hashes, so they are
dealt to all shards. Time is linear in a text's length.
"""

from __future__ import annotations

import heapq
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3
BLOCK = 32
SHARD_ROWS = 500
MAX_SOURCES = 100_000
WORD = r"[^\x20\x09-\x0D]+"
SEED = 17


def targets(sizes: list[int], weights: list[float], total: float, cap: float = CAP) -> list[float]:
    """Shares of the total by weight; a share over cap times its size stops there and the excess is dealt again, until none is above."""
    out, full = [0.0] * len(sizes), [False] * len(sizes)
    while True:
        left = total - sum(cap * s for s, f in zip(sizes, full, strict=True) if f)
        weight = sum(w for w, f in zip(weights, full, strict=True) if not f)
        over = False
        for i, (s, w) in enumerate(zip(sizes, weights, strict=True)):
            if full[i]:
                out[i] = float(cap * s)
            elif (share := left * w / weight) > cap * s:
                full[i] = over = True
            else:
                out[i] = share
        if not over:
            return out


def apportion(votes: list[float] | np.ndarray, seats: int, most: np.ndarray | None = None) -> np.ndarray:
    """Sainte-Lague: seats by the highest quotients votes / (2 k + 1), ties to the earlier, none above most. Starts from a divisor that gives at most the seats."""
    votes = np.asarray(votes, float)
    total = votes.sum()
    most = np.full(len(votes), max(seats, 0)) if most is None else np.asarray(most)
    if seats <= 0 or total <= 0:
        return np.zeros(len(votes), np.int64)
    # a little above the mean votes of a seat the rounded shares can't exceed the seats; the rest go one by one
    got = np.maximum(0, np.ceil(votes * max(0.0, seats - 0.5 * len(votes)) / total - 0.5)).astype(np.int64)
    got = np.minimum(got, most)
    heap = [(-v / (2 * k + 1), i) for i, (v, k) in enumerate(zip(votes, got, strict=True)) if v > 0 and k < most[i]]
    heapq.heapify(heap)
    for _ in range(seats - int(got.sum())):
        if not heap:
            break
        _, i = heap[0]
        got[i] += 1
        if got[i] < most[i]:
            heapq.heapreplace(heap, (-votes[i] / (2 * got[i] + 1), i))
        else:
            heapq.heappop(heap)
    return got


def _dealt(parts: DataFrame, group: list[str], part: str) -> DataFrame:
    """The quota of a group's blocks dealt to its parts: rows of (group..., part, words, most, quota), where quota came in as the group's."""

    def deal(g: pa.Table) -> pa.Table:
        g = g.sort_by(part)
        words, most = (g.column(c).to_numpy() for c in ("words", "most"))
        return g.set_column(g.column_names.index("quota"), "quota", pa.array(apportion(words, g.column("quota")[0].as_py(), most), pa.int64()))

    return parts.groupBy(*group).applyInArrow(deal, parts.schema)


def _words(text_col: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("bigint")


def _shards(sized: DataFrame, weights: tuple[float, ...], cap: int, block: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Of (source, size, turn): the plan of sources (broadcast: bounded), and for each shard (sid, shard) how often all its words are taken (turns), the hash up to which blocks are once more, and
    the block (part) of which some words (left) are."""
    catalogue = sized.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")).limit(MAX_SOURCES + 1).collect()
    if len(catalogue) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    catalogue.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["size"] for r in catalogue]
    aims = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], float(sum(sizes)), cap) if sizes else []
    quotas = apportion(aims, round(sum(aims) / block))
    rows = [(r["source"], i, r["size"], float(t), int(q), -(-r["n"] // SHARD_ROWS)) for i, (r, t, q) in enumerate(zip(catalogue, aims, quotas, strict=True))]
    rows = [(*r, isqrt(max(r[-1] - 1, 0)) + 1) for r in rows]
    plan = F.broadcast(sized.sparkSession.createDataFrame(rows, "source string, sid int, source_size bigint, target double, quota bigint, shards int, per_division int"))

    placed = in_shards(sized, plan, seed)
    shards = placed.groupBy("sid", "shard", "per_division", "quota").agg(F.sum("size").alias("words"))
    shards = shards.select("sid", F.floor(F.col("shard") / F.col("per_division")).alias("division"), "shard", "words", F.ceil(F.col("words") / block).alias("blocks"), F.floor(F.col("words") * cap / block).alias("most"), "quota")
    shards = common.written(shards, "shards")
    divisions = _dealt(shards.groupBy("sid", "division", "quota").agg(F.sum("words").alias("words"), F.sum("most").alias("most")), ["sid"], "division")
    dealt = _dealt(shards.drop("quota").join(divisions.select("sid", "division", "quota"), ["sid", "division"]), ["sid", "division"], "shard")
    some = F.when(F.col("words") > 0, F.col("words"))
    turns = F.coalesce(F.floor(F.col("quota") * block / some), F.lit(0).cast("bigint"))
    drawn = F.array_sort(F.transform(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("blocks"), F.lit(1)) - 1), lambda j: F.struct(_draw(j, seed).alias("draw"), j.alias("j"))))
    dealt = dealt.select("sid", "shard", "blocks", turns.alias("turns"), (F.col("quota") * block - turns * F.col("words")).alias("rest"), drawn.alias("drawn"), (F.col("words") - (F.col("blocks") - 1) * block).alias("short"))
    # whole blocks of the rest, and words of the next one: the short block, by its rank, counts for what it has
    dealt = dealt.withColumns({"m": F.floor(F.col("rest") / block), "at_short": F.array_position(F.transform("drawn", lambda d: d["j"]), F.col("blocks") - 1) - 1})
    within = F.col("at_short") < F.col("m")
    dealt = dealt.withColumn("left", F.col("rest") - F.col("m") * block + F.when(within, block - F.col("short")).otherwise(0))
    following = F.when(within | (F.col("at_short") > F.col("m")), block).otherwise(F.col("short"))
    more = F.col("left") >= following
    dealt = dealt.withColumns({"m": F.col("m") + more.cast("bigint"), "left": F.col("left") - F.when(more, following).otherwise(0)})
    at = lambda k, c: F.get("drawn", k.cast("int"))[c]
    dealt = dealt.select("sid", "shard", "turns", F.when(F.col("m") > 0, at(F.col("m") - 1, "draw")).alias("up_to"), F.when(F.col("left") > 0, at(F.col("m"), "j")).alias("part"), "left")
    return plan, common.written(dealt, "quotas")


def _draw(block: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed + 2), F.col("sid"), F.col("shard"), block)


def _numbered(sized: DataFrame) -> DataFrame:
    """sized (a table; at: a number of each row) with copy: 0 for rows alone with their id, size and source, and for others their number among them, from 1. Tasks number their own, after those of other tasks."""
    key = F.xxhash64("doc_id", "size", "source")
    several = sized.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    rows = common.split_join(sized.select(key.alias("key"), "at"), several, ["key"]).withColumn("part", F.shiftright("at", 33))
    rows = common.written(rows, "copies")
    counts = rows.groupBy("key", "part").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("before", F.sum("n").over(Window.partitionBy("key").orderBy("part")) - F.col("n")).drop("n")
    number = F.row_number().over(Window.partitionBy("key", "part").orderBy("at"))
    rows = rows.withColumn("number", number).join(counts, ["key", "part"]).select("at", (F.col("before") + F.col("number")).alias("copy"))
    return common.written(sized.join(rows, "at", "left").withColumn("copy", F.coalesce("copy", F.lit(0).cast("bigint"))), "sizes")


def in_shards(sized: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """sized with the columns of plan, shard and turn (a row's place in the order of its shard)."""
    placed = sized.join(plan.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    return placed.withColumns({"shard": F.pmod(F.xxhash64("doc_id", "size", "copy", F.lit(seed + 1)), F.col("shards").cast("bigint")), "turn": F.xxhash64("doc_id", "size", "copy", F.lit(seed))})


def _runs(piece: Column) -> Column:
    """Pieces (from, n) that follow one another joined: where the piece before doesn't end, a run begins, and it ends where the piece before the next beginning does."""
    end = lambda p: p["from"] + p["n"]

    def joined(p: Column) -> Column:
        first = F.transform(p, lambda x, k: F.struct(k.alias("k"), x["from"].alias("from"), F.coalesce(end(F.get(p, k - 1)) != x["from"], F.lit(True)).alias("begins")))

        def ended(b: Column) -> Column:
            return F.transform(b, lambda x, i: F.struct(x["from"].alias("from"), (end(F.get(p, F.coalesce(F.get(b, i + 1)["k"], F.size(p)) - 1)) - x["from"]).alias("n")))

        return F.get(F.transform(F.array(F.filter(first, lambda x: x["begins"])), ended), F.lit(0))

    # arrays are bound as elements, so that they are built once
    return F.get(F.transform(F.array(piece), joined), F.lit(0))


def _taken(sized: DataFrame, plan: DataFrame, quotas: DataFrame, block: int, seed: int) -> DataFrame:
    """sized with turns (how often the whole text is taken) and runs (array of (from, n): the words that are taken once more)."""
    before = Window.partitionBy("sid", "shard").orderBy("turn", "doc_id", "size", "copy").rowsBetween(Window.unboundedPreceding, -1)
    laid = in_shards(sized, plan, seed).withColumn("first", F.coalesce(F.sum("size").over(before), F.lit(0)))
    laid = laid.join(quotas, ["sid", "shard"])
    first = F.col("first")
    end = first + F.col("size")
    blocks = F.filter(F.sequence(F.floor(first / block), F.floor((end - 1) / block)), lambda j: F.coalesce(_draw(j, seed) <= F.col("up_to"), F.lit(False)) | F.coalesce(j == F.col("part"), F.lit(False)))
    stop = lambda j: F.least(j * block + F.when(F.coalesce(_draw(j, seed) <= F.col("up_to"), F.lit(False)), block).otherwise(F.col("left")), end)
    piece = F.transform(blocks, lambda j: F.struct((F.greatest(j * block, first) - first).alias("from"), (stop(j) - F.greatest(j * block, first)).alias("n")))
    piece = F.filter(piece, lambda p: p["n"] > 0)
    none = F.array().cast("array<struct<from:bigint,n:bigint>>")
    return laid.withColumn("runs", F.when((F.col("size") > 0) & (F.col("up_to").isNotNull() | F.col("part").isNotNull()), _runs(piece)).otherwise(none))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, cap: int = CAP, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """For every document: doc_id, source, size, source_size, target and taken (words), which is made of turns (full copies) and runs (array of (from, n) of words)."""
    sized = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(source_col).cast("string").alias("source"), _words(text_col).alias("size"), F.monotonically_increasing_id().alias("at"))
    sized = _numbered(common.written(sized, "sizes"))
    plan, quotas = _shards(sized, weights, cap, block, seed)
    taken = F.col("turns") * F.col("size") + F.aggregate("runs", F.lit(0).cast("bigint"), lambda a, x: a + x["n"])
    return _taken(sized, plan, quotas, block, seed).select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "turns", "runs")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, cap: int = CAP, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """The mix as documents with the input's columns: a row per full copy, and one for each run of words that is taken besides."""
    own = [F.col(id_col).cast("bigint").alias("doc_id"), F.col(source_col).cast("string").alias("source"), _words(text_col).alias("size"), F.monotonically_increasing_id().alias("at")]
    # the documents' own columns lie in a struct, so no name can clash; the mix is made of sizes alone, and then texts move once, by the number of their row
    rows = common.written(docs.select(*own, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")), "rows")
    sizes = _numbered(rows.drop("row"))
    plan, quotas = _shards(sizes, weights, cap, block, seed)
    taken = _taken(sizes, plan, quotas, block, seed).select("at", F.when(F.col("size") > 0, F.col("turns")).otherwise(0).cast("int").alias("turns"), "runs").where("turns > 0 or size(runs) > 0")
    laid = rows.select("at", "row").join(taken, "at")
    text = F.col("row")[text_col]
    # a text's words are bound once for all its runs
    cut = F.transform(F.array(F.array_remove(F.split(text, common.SPACE), "")), lambda w: F.transform("runs", lambda r: F.array_join(F.slice(w, r["from"].cast("int") + 1, r["n"].cast("int")), " ")))
    parts = F.when(F.size("runs") > 0, F.get(cut, F.lit(0))).otherwise(F.array().cast("array<string>"))
    laid = laid.select("row", F.explode(F.concat(F.array_repeat(text, F.col("turns")), parts)).alias("text"))
    out = {c: F.col("row")[c] for c in docs.columns} | {text_col: F.col("text")}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return laid.select(*[x.alias(c) for c, x in out.items()])
