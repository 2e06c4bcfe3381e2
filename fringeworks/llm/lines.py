"""Line dedup by a deletion-neighbourhood join: lines that equal an earlier one, or lie within one edit of it, go.

A line is its sequence of words (parted by ASCII white space). Its place is (document id, hash of the text, line number), and "earlier" means a smaller place.
The edit bound is a function of the longer line of a pair, with two parameters: one word where it has `words` words or more; with fewer words, one character where it has `chars` characters or
more (words joined by blanks); else none. With chars = 0 every line has a bound of at least one character, with words = 0 of one word. Words and characters are the units of two levels, which
run alike.
1. One pass over the texts hashes every line. Equal lines form one class (by two 64-bit hashes), whose first place stays.
2. By the pigeonhole principle one half of the longer line is unchanged, so a line none of whose half keys occurs with another line has no partner. The keys
   that two different lines have fill a bit filter of bounded size.
3. A second pass emits for the lines that pass it the deletion neighbourhood as hashed keys: the line itself, and the line less each unit of the half that isn't shared. Variants that are
   equal with the unit at the same place taken out differ in that unit alone; a variant that equals a whole line lacks one unit of it. So the earliest partner of a line is a
   minimum per key: no pairs are formed, however many lines share a key.
4. The edit distance of each line and its partner is verified on their words. A line with an earlier partner goes; it needn't have stayed itself.

Defined cases: null and empty texts have no lines to drop and stay as they are; lines without words stay; a text whose lines are all dropped becomes empty; a null id is a value of its
own, before all others; rows that repeat an id are told apart by their texts, and rows equal in both have the same places, so the same lines of both stay; an empty table gives an empty
result; other columns are left alone, and names of count columns get further underscores where the input has them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: The usual parameters of the edit bound.
WORDS, CHARS = 6, 20
_PLACE = ("doc_id", "copy", "line")


class _Units:
    """Units of lines, one line after another (lo..hi of each), as sums of hashes of (unit, place in its line), and of (unit, place less one) for what stands behind a unit that is taken out."""

    def __init__(self, level: int, least: int, of: np.ndarray, hashes: np.ndarray, counts: np.ndarray):
        self.level, self.least, self.of, self.n = level, least, of, counts
        self.hi = np.cumsum(counts)
        self.lo = self.hi - counts
        place = np.arange(len(hashes)) - np.repeat(self.lo, counts)
        self.sums, self.moved = (np.append(np.uint64(0), np.cumsum(common.placed(hashes, p), dtype=np.uint64)) for p in (place, place - 1))

    def key(self, total: np.ndarray, kind: int, n: np.ndarray) -> np.ndarray:
        return common.mix(total ^ common.mix(n.astype(np.uint64) * common._MUL + np.uint64(8 * self.level + kind)))

    def part(self, sums: np.ndarray, a: np.ndarray, b: np.ndarray, kind: int, n: np.ndarray) -> np.ndarray:
        return self.key(sums[b] - sums[a], kind, n)

    def halves(self) -> tuple[np.ndarray, np.ndarray]:
        """Five keys a line, and which of them count: head, tail beside an equally long line, tail beside a shorter one; head and tail as the shorter line of a pair."""
        lo, hi, n = self.lo, self.hi, self.n
        head, more = lo + n // 2, (n + 1) // 2
        keys = [
            self.part(self.sums, lo, head, 1, n), self.part(self.sums, head, hi, 2, n), self.part(self.moved, head, hi, 3, n),
            self.part(self.sums, lo, lo + more, 1, n + 1), self.part(self.sums, lo + more - 1, hi, 3, n + 1),
        ]
        own, shorter = n >= self.least, n >= self.least - 1
        return np.stack(keys, axis=1), np.stack([own, own, own, shorter, shorter], axis=1)

    def whole(self) -> np.ndarray:
        return self.part(self.sums, self.lo, self.hi, 4, self.n)

    def without(self, which: np.ndarray, in_head: np.ndarray, in_tail: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of lines which: keys of the line less each unit of its head or tail, the places of those units, and the line of each."""
        lo, hi, n = self.lo[which], self.hi[which], self.n[which]
        half = lo + n // 2
        first = np.where(in_head, lo, half)
        size = np.where(in_tail, hi, half) - first
        k = np.repeat(np.arange(len(which)), size)
        at = np.arange(len(k)) - np.repeat(np.cumsum(size) - size, size) + first[k]
        total = (self.sums[at] - self.sums[lo[k]]) + (self.moved[hi[k]] - self.moved[at + 1])
        return self.key(total, 4, n[k] - 1), at - lo[k], which[k]


class _Lines:
    """The lines of a slab of texts that have words: owner (index of the text), number, two hashes, and units of both levels."""

    def __init__(self, texts: list[bytes], least_words: int, least_chars: int):
        self.buf = buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        self.starts, self.ends = common.spans(buf)
        words = common.span_hashes(buf, self.starts, self.ends)
        stop = np.flatnonzero(buf == 10)
        lo, hi = np.searchsorted(self.starts, np.append(0, stop[:-1] + 1)), np.searchsorted(self.starts, stop)
        owner = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]) - 1, stop)
        first = np.searchsorted(owner, np.arange(len(texts)))
        some = np.flatnonzero(hi > lo)
        self.lo, self.hi, self.owner, self.number = lo[some], hi[some], owner[some], (np.arange(len(stop)) - first[owner])[some]
        n = self.hi - self.lo
        self.words = _Units(0, least_words, np.arange(len(n)), words, n)
        self.hash = self.words.whole()
        again = common.placed(common.mix(words + common._MUL), np.arange(len(words)) - np.repeat(self.words.lo, n))
        self.hash2 = common.signed(common.mix(np.add.reduceat(again, self.words.lo) if len(n) else again[:0]))
        short = np.flatnonzero(n < least_words)
        text = [self.text(i) for i in short]
        long = np.array([len(t) >= least_chars - 1 for t in text], bool)
        chars = "".join(t for t, x in zip(text, long, strict=True) if x)
        units = common.mix(np.frombuffer(chars.encode("utf-32-le"), np.uint32).astype(np.uint64))
        self.chars = _Units(1, least_chars, short[long], units, np.array([len(t) for t, x in zip(text, long, strict=True) if x], np.int64))

    def text(self, i: int) -> str:
        """The words of line i, joined by blanks."""
        return b" ".join(self.buf[self.starts[self.lo[i]] : self.ends[self.hi[i] - 1]].tobytes().split()).decode()


def _rows(batches: Iterator[pa.RecordBatch], bound: tuple[int, int]) -> Iterator[tuple[_Lines, pa.RecordBatch]]:
    """Slabs of texts (doc_id, copy, text)."""
    for b in common.pieces(batches):
        texts = common.text_bytes(b.column(2))
        for lo, hi in common.slabs(texts):
            yield _Lines(texts[lo:hi], *bound), b.slice(lo, hi - lo)


def _first_pass(bound: tuple[int, int]):
    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, b in _rows(batches, bound):
            keys, line = [], []
            for u in (x.words, x.chars):
                k, use = u.halves()
                keys.append(k[use])
                line.append(np.repeat(u.of, use.sum(axis=1)))
            line = np.concatenate(line)
            keys = np.concatenate(keys)[np.argsort(line, kind="stable")]
            offsets = np.append(0, np.cumsum(np.bincount(line, minlength=len(x.hash)))).astype(np.int32)
            owner = pa.array(x.owner)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(owner), b.column(1).take(owner), pa.array(x.number, pa.int32()), pa.array(common.signed(x.hash)), pa.array(x.hash2), pa.ListArray.from_arrays(pa.array(offsets), pa.array(common.signed(keys)))],
                ["doc_id", "copy", "line", "hash", "hash2", "halves"],
            )

    return first_pass


def _variants(wanted, bound: tuple[int, int]):
    def variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, b in _rows(batches, bound):
            copy, ids = (b.column(i).fill_null(-(1 << 63)).to_numpy(zero_copy_only=False) for i in (1, 0))
            # of equal lines of the slab the earliest is enough, whatever the order of rows
            order = np.lexsort((x.number, copy[x.owner], ids[x.owner]))
            earliest = np.zeros(len(order), bool)
            earliest[order[np.unique(x.hash[order], return_index=True)[1]]] = True
            out = []
            for u in (x.words, x.chars):
                k, use = u.halves()
                hit = np.zeros(use.shape, bool)
                hit[use] = common.with_hits(wanted.value, k[use], 2)
                hit &= earliest[u.of][:, None]
                some = np.flatnonzero(hit.any(axis=1))
                out.append((u.whole()[some], np.full(len(some), -1), u.of[some]))
                own = np.flatnonzero(hit[:, :3].any(axis=1))
                # where the head is shared the edit is in the tail, and the other way round; a shorter line is met as it is
                key, at, which = u.without(own, (hit[:, 1] | hit[:, 2])[own], hit[own, 0])
                out.append((key, at, u.of[which]))
            keys, at, k = (np.concatenate([o[j] for o in out]) for j in range(3))
            owner = pa.array(x.owner[k])
            yield pa.RecordBatch.from_arrays(
                [pa.array(common.signed(keys)), pa.array(at, pa.int32()), pa.array(common.signed(x.hash)[k]), pa.array(x.hash2[k]), b.column(0).take(owner), b.column(1).take(owner), pa.array(x.number[k], pa.int32()), pa.array([x.text(i) if j < 0 else None for j, i in zip(at, k, strict=True)], pa.string())],
                ["key", "at", "hash", "hash2", "doc_id", "copy", "line", "words"],
            )

    return variants


def _one_edit(x: Sequence, y: Sequence) -> bool:
    """Whether two sequences have an edit distance of one at most."""
    if abs(len(x) - len(y)) > 1:
        return False
    i = 0
    while i < min(len(x), len(y)) and x[i] == y[i]:
        i += 1
    return x[i + (len(x) >= len(y)) :] == y[i + (len(y) >= len(x)) :]


def near_lines(a: str, b: str, words: int = WORDS, chars: int = CHARS) -> bool:
    """Whether two lines, as words joined by blanks, lie within the edit bound."""
    x, y = a.split(" "), b.split(" ")
    if max(len(x), len(y)) >= words:
        return _one_edit(x, y)
    return max(len(a), len(b)) >= chars and _one_edit(a, b)


def _verified(bound: tuple[int, int]):
    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = [near_lines(x, y, *bound) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield b.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return verified


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, chars: int = CHARS) -> DataFrame:
    """doc_id, copy (xxhash64 of the text), line (from 0) and why (exact or near) for every line that goes."""
    bound = (words, chars)
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text_col).alias("copy"), F.col(text_col).alias("text"))
    places = common.written(texts.mapInArrow(_first_pass(bound), "doc_id bigint, copy bigint, line int, hash bigint, hash2 bigint, halves array<bigint>"), "lines")
    lines = places.groupBy("hash", "hash2").agg(F.min(F.struct(*_PLACE)).alias("first"))

    keys = places.select(F.explode("halves").alias("key"), "hash").groupBy("key").agg(F.min("hash").alias("a"), F.max("hash").alias("b")).where("a <> b").select("key")
    keys = common.written(keys, "halves")
    wanted = docs.sparkSession.sparkContext.broadcast(common.key_filter(keys, "key", keys.count()))
    common.release(keys)
    variants = texts.mapInArrow(_variants(wanted, bound), "key bigint, at int, hash bigint, hash2 bigint, doc_id bigint, copy bigint, line int, words string")
    variants = common.written(variants.select("key", "at", F.struct("hash", "hash2").alias("id"), F.struct(*_PLACE).alias("place"), "words"), "variants")
    # most variants are of one line only; the few that several lines have go on
    several = variants.groupBy("key").agg(F.min("id.hash").alias("a"), F.max("id.hash").alias("b")).where("a <> b").select("key")
    several = common.written(several, "several")
    near = docs.sparkSession.sparkContext.broadcast(common.key_filter(several, "key", several.count()))

    def shared(keys: pa.Array) -> pa.Array:
        return pa.array(common.with_hits(near.value, common.hash_column(keys), 2))

    # a filter of these keys, of bounded size, keeps nearly all other variants where they are
    kept = variants.where(F.arrow_udf(shared, "boolean")("key")).select("key", "at", "id", "place")
    # a class is emitted once a slab, at its earliest place there; the class is its earliest
    entry = common.split_join(kept, several, ["key"]).groupBy("key", "at", "id").agg(F.min("place").alias("place"))
    entry = common.written(entry, "entries")
    cut, whole, best = entry.where("at >= 0"), entry.where("at < 0"), F.min(F.struct("place", "id")).alias("best")
    swap = cut.groupBy("key", "at").agg(best, F.max("id").alias("hi"), F.min("id").alias("lo")).where("lo <> hi").select("key", "at", "best")
    one = common.split_join(cut, swap, ["key", "at"])
    two = common.split_join(cut, whole.groupBy("key").agg(best), ["key"])
    three = whole.join(cut.groupBy("key").agg(best), "key")
    partner = one.select("id", "place", "best").unionByName(two.select("id", "place", "best")).unionByName(three.select("id", "place", "best"))
    # a line may have partners by several keys; each is verified, one good one is enough
    partner = common.written(partner.where("best.place < place").select("id", F.col("best.id").alias("partner")).distinct(), "partners")
    own = variants.where("at < 0").groupBy("id").agg(F.first("words").alias("words"))
    both = common.split_join(partner, own.select(F.col("id").alias("partner"), F.col("words").alias("other")), ["partner"])
    both = common.split_join(both, own, ["id"]).select("id.hash", "id.hash2", "words", "other")
    near = both.mapInArrow(_verified(bound), "hash bigint, hash2 bigint").distinct().withColumn("near", F.lit(True))

    judged = common.split_join(places.select(*_PLACE, "hash", "hash2"), lines.join(near, ["hash", "hash2"], "left"), ["hash", "hash2"])
    first = F.struct(*_PLACE) == F.col("first")
    return judged.where(~first | F.coalesce("near", F.lit(False))).select(*_PLACE, F.when(first, "near").otherwise("exact").alias("why"))


def _cut(texts: pa.Array, gone: pa.Array) -> pa.Array:
    """Texts less the lines whose numbers are gone; no numbers: as it is."""
    out = []
    for text, numbers in zip(texts.to_pylist(), gone.to_pylist(), strict=True):
        if numbers is not None:
            without = set(numbers)
            text = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in without)
        out.append(text)
    return pa.array(out, pa.string())


def count_columns(docs: DataFrame) -> list[str]:
    """Names of the columns that dedup_lines() adds: lines, those that equal an earlier one, those near one."""
    return common.internal(docs, "_n_lines", "_n_exact", "_n_near")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, chars: int = CHARS) -> DataFrame:
    """Every row with the lines that go taken out of its text, and counts by the names of count_columns()."""
    total, exact, near = count_columns(docs)
    key, copy, gone = common.internal(docs, "_id", "_copy", "_gone")
    cut = dropped_lines(docs, id_col, text_col, words, chars).groupBy(F.col("doc_id").alias(key), F.col("copy").alias(copy)).agg(F.collect_set(F.struct("line", "why")).alias(gone))
    joined = docs.join(cut, F.col(id_col).cast("bigint").eqNullSafe(F.col(key)) & (F.xxhash64(text_col) == F.col(copy)), "left")
    lines = F.when(F.col(text_col).isNull(), 0).otherwise(F.size(F.split(text_col, "\n")))

    def many(why: str) -> Column:
        return F.when(F.col(gone).isNull(), 0).otherwise(F.size(F.filter(gone, lambda g: g["why"] == F.lit(why))))

    # one branch for all rows, so that texts move once
    out = joined.withColumns({total: lines, exact: many("exact"), near: many("near"), text_col: F.arrow_udf(_cut, "string")(F.col(text_col), F.transform(gone, lambda g: g["line"]))})
    return out.drop(gone, key, copy)
