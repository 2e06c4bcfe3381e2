"""Exact dedup by two passes over Bloom filters.

Pass one puts a hash of every text into a pair of bit filters: bits that were set once, and bits that were set again. Tasks fill
their own pair; pairs merge by (once | once', again | again' | once & once'), so the order doesn't matter. Pass two tests each hash against the
second filter: a hash whose bits were never set again belongs to no other row, and its row passes straight through. Only the rest
shuffle, as (digest, id) without the text. The filter has at most MAX_FILTER_BITS bits; a fuller one lets more rows shuffle, and the
result stays exact, as groups are formed on the SHA-256 digest.

Defined cases: a null text is the empty text; equal texts are one group, however large (counts are combined before the shuffle, the join is
one that adaptive execution can split); of rows equal in id and text one stays; a null id stays only where no other row has the text; with no rows the
result has none; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

HASHES = 2
_PAIR = "segment int, bits0 binary, bits1 binary"


def _fill(bits: int):
    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, again = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for b in batches:
            for s in common.slots(common.hash_column(b.column(0)), bits, HASHES):
                s.sort()
                common.set_slots(again, s[1:][s[1:] == s[:-1]])
                s = s[np.append(True, s[1:] != s[:-1])] if len(s) else s
                common.set_slots(again, s[(once[s >> 3] >> (s & 7).astype(np.uint8)) & 1 == 1])
                common.set_slots(once, s)
        yield from common.segments(once, again)

    return fill


def _merge(group: pa.Table) -> pa.Table:
    once = again = np.zeros(common.SEGMENT_BITS // 8, np.uint8)
    for a, b in zip(group.column("bits0").to_pylist(), group.column("bits1").to_pylist(), strict=True):
        a, b = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
        once, again = once | a, again | b | (once & a)
    return pa.table({"segment": pa.array([group.column("segment")[0].as_py()], pa.int32()), "bits0": pa.array([once.tobytes()], pa.binary()), "bits1": pa.array([again.tobytes()], pa.binary())})


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row; keep says which id of equal texts stays: max or min."""
    if keep not in ("max", "min"):
        raise ValueError("keep: max or min")
    spark = docs.sparkSession
    text: Column = F.coalesce(F.col(text_col), F.lit(""))
    bits = common.filter_bits(docs.count())
    hashed = docs.select(F.xxhash64(text).alias("h"))
    again = common.gathered(hashed.mapInArrow(_fill(bits), _PAIR).groupBy("segment").applyInArrow(_merge, _PAIR), bits, "bits1")
    sent = spark.sparkContext.broadcast(again)

    def maybe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hit = common.with_hits(sent.value, common.hash_column(b.column(1)), HASHES)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(hit)], ["doc_id", "text_sha256", "maybe"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("h"), F.sha2(text.cast("binary"), 256).alias("text_sha256"))
    rows = common.written(rows.mapInArrow(maybe, "doc_id bigint, text_sha256 string, maybe boolean"), "exact")
    alone = rows.where(~F.col("maybe")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    # rows equal in id and text are counted as one, and dealt out again at the end: one of them stays
    some = rows.where("maybe").groupBy("text_sha256", "doc_id").agg(F.count(F.lit(1)).alias("times"))
    best = F.max("doc_id") if keep == "max" else F.min("doc_id")
    groups = some.groupBy("text_sha256").agg(best.alias("keep_id"), F.sum("times").alias("group_size"))
    together = common.split_join(some, groups, ["text_sha256"]).withColumn("turn", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("times"))))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("turn") == 1)
    return alone.unionByName(together.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256"))
