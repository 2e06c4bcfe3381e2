"""What the operators share: reading, intermediate tables that survive lost executors, 64-bit text hashes and bit filters."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators between words, as Java/RE2 character class: the ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"
#: Bytes of text that the numpy passes handle at a time, so that their temporaries stay in cache and memory is bounded.
SLAB = 1 << 18
#: Largest bit filter that is sent to the tasks (bits): 32 MiB, whatever the input. A fuller filter lets more rows through, never fewer.
MAX_FILTER_BITS = 1 << 28
SEGMENT_BITS = 1 << 16
#: Rows of an Arrow batch of whole texts.
BATCH_ROWS = 1000

_MUL = np.uint64(0x9E3779B97F4A7C15)
_MASK = (1 << 64) - 1


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where it names none (local tests), a new local one, then kept in the session."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("fringeworks.shared.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("fringeworks.shared.dir", at)
    return at


#: Folders of intermediate tables of this process.
_tables: list[str] = []


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a table in the shared folder, read again: it cuts the lineage and outlives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _tables.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.table_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes tables of written() that no plan reads any more."""
    for t in tables:
        _delete(t.sparkSession, t.table_path)


def release_all(spark: SparkSession) -> None:
    """Deletes every table of written() in this process: for callers that have stored their results."""
    for path in list(_tables):
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _tables.remove(path)


def internal(df: DataFrame, *names: str) -> list[str]:
    """Names for columns of an operator's own that df doesn't have: underscores are put before until they differ (Spark compares without case)."""
    have, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in have:
            name = "_" + name
        out.append(name)
    return out


def split_join(rows: DataFrame, totals: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """rows.join(totals, keys): totals has a row a key, aggregated by these keys, and rows may have very many for one. A redundant key, a hash of the keys, makes the
    join deal out both sides itself, after the aggregate; only such an exchange does adaptive execution split where a key is skewed."""
    more = F.xxhash64(*keys)
    return rows.withColumn("_split", more).join(totals.withColumn("_split", more), [*keys, "_split"], how).drop("_split")


# ---------------------------------------------------------------- hashes


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in UTF-8 bytes; words are parted by ASCII white space."""
    word = np.empty(len(buf) + 2, np.int8)
    word[0] = word[-1] = 0
    np.logical_not((buf == 32) | ((buf >= 9) & (buf <= 13)), out=word[1:-1].view(np.bool_))
    edge = np.diff(word)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes or characters: the sum over its places of a mixed pair of place and value, so no arithmetic rule holds between places. Equal
    spans, equal hashes, wherever they stand. Some SLAB values are taken at a time, also within a long span."""
    out = np.zeros(len(starts), np.uint64)
    size = np.cumsum(ends - starts)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(size, size[at] + SLAB)))
        lo, hi = int(starts[at]), int(ends[to - 1])
        if to == at + 1 and hi - lo > SLAB:
            for cut in range(lo, hi, SLAB):
                out[at] += placed(buf[cut : min(hi, cut + SLAB)], np.arange(cut - lo, min(hi, cut + SLAB) - lo)).sum(dtype=np.uint64)
        else:
            s = starts[at:to] - lo
            values = placed(buf[lo:hi], np.arange(hi - lo) - np.repeat(s, np.diff(np.append(s, hi - lo))))
            edges = np.stack([s, ends[at:to] - lo], axis=1).reshape(-1)[:-1]
            out[at:to] = np.add.reduceat(values, edges)[::2]
        at = to
    return mix(out ^ (ends - starts).astype(np.uint64) * _MUL)


def placed(values: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each pair of value and place."""
    return mix((place.astype(np.uint64) + np.uint64(1)) * _MUL ^ values.astype(np.uint64))


def slabs(texts: list[bytes] | list[str], size: int = SLAB) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about size bytes or characters; a longer text stands alone."""
    at = total = 0
    for i, t in enumerate(texts):
        if i > at and total + len(t) > size:
            yield at, i
            at, total = i, 0
        total += len(t) + 1
    if at < len(texts):
        yield at, len(texts)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_ROWS rows for the session, whose owner calls this: whole texts may be long, and a batch is held by the JVM and by Python."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


#: What modules keep within a process, such as tables of a vocabulary.
caches: list[dict] = []


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 512, keep: dict | None = None) -> Iterator[pa.RecordBatch]:
    """Batches cut into short ones, so that few texts at a time are Python objects. A worker serves one stage after another: caches of other operators go, and memory of batches that are
    done goes back to the system."""
    for cache in caches:
        if cache is not keep:
            cache.clear()
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
        del b
        pa.default_memory_pool().release_unused()


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is the empty text."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


# ---------------------------------------------------------------- bit filters


def filter_bits(rows: int, per_row: int = 16) -> int:
    """Bits of a filter for so many rows: a power of two, at most MAX_FILTER_BITS."""
    return min(MAX_FILTER_BITS, max(SEGMENT_BITS, 1 << int(np.ceil(np.log2(max(1, rows * per_row))))))


def slots(hashes: np.ndarray, bits: int, k: int) -> Iterator[np.ndarray]:
    """k slots of each hash."""
    for i in range(k):
        yield (mix(hashes + np.uint64((i + 1) * int(_MUL) & _MASK)) & np.uint64(bits - 1)).astype(np.int64)


def with_hits(have: np.ndarray, hashes: np.ndarray, k: int) -> np.ndarray:
    """Which hashes have all their slots set in the packed filter."""
    hit = np.ones(len(hashes), bool)
    for s in slots(hashes, len(have) * 8, k):
        hit &= (have[s >> 3] >> (s & 7).astype(np.uint8)) & 1 == 1
    return hit


def set_slots(have: np.ndarray, s: np.ndarray) -> None:
    np.bitwise_or.at(have, s >> 3, np.uint8(1) << (s & 7).astype(np.uint8))


def segments(*filters: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The segments of packed filters in which a bit is set, as rows (segment, bits0, bits1 ...)."""
    shape = (-1, SEGMENT_BITS // 8)
    used = np.flatnonzero(filters[0].reshape(shape).any(axis=1))
    if len(used):
        columns = {f"bits{i}": pa.array([x.tobytes() for x in f.reshape(shape)[used]], pa.binary()) for i, f in enumerate(filters)}
        yield pa.RecordBatch.from_pydict({"segment": pa.array(used, pa.int32()), **columns})


def gathered(parts: DataFrame, bits: int, column: str = "bits0") -> np.ndarray:
    """A packed filter on the driver from its segments: MAX_FILTER_BITS / 8 bytes at most, whatever the input."""
    have = np.zeros(bits // 8, np.uint8)
    size = SEGMENT_BITS // 8
    for segment, packed in parts.select("segment", column).collect():
        have[segment * size : (segment + 1) * size] = np.frombuffer(packed, np.uint8)
    return have


def key_filter(keys: DataFrame, column: str, rows: int, k: int = 2) -> np.ndarray:
    """A Bloom filter of a bigint column: each task packs the segments that it touches, the executors OR them."""
    bits = filter_bits(rows)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = np.zeros(bits // 8, np.uint8)
        for b in batches:
            for s in slots(hash_column(b.column(0)), bits, k):
                set_slots(have, s)
        yield from segments(have)

    def either(group: pa.Table) -> pa.Table:
        have = np.zeros(SEGMENT_BITS // 8, np.uint8)
        for x in group.column("bits0").to_pylist():
            have |= np.frombuffer(x, np.uint8)
        return pa.table({"segment": pa.array([group.column("segment")[0].as_py()], pa.int32()), "bits0": pa.array([have.tobytes()], pa.binary())})

    parts = keys.select(F.col(column).cast("bigint")).mapInArrow(pack, "segment int, bits0 binary")
    return gathered(parts.groupBy("segment").applyInArrow(either, "segment int, bits0 binary"), bits)


def hash_column(column: pa.Array) -> np.ndarray:
    """A bigint column without nulls as unsigned hashes."""
    return column.to_numpy(zero_copy_only=False).astype(np.int64, copy=False).view(np.uint64)


def hash_threshold(rows: int, sample: int) -> int:
    """A signed 64-bit value that sample of so many uniform hashes, and hardly more, lie below: eight standard deviations more."""
    share = (sample + 8 * sample**0.5) / max(1, rows)
    return (1 << 63) - 1 if share >= 1 else int(share * 2.0**64) - (1 << 63)


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)
