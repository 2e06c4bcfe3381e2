"""Periodic runs of words by suffix trees: maximal stretches that repeat with a period at least twice.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) and length >= max(LEAST, 2 q) that no neighbouring word extends keeping its period.
1. Every run of that length has, for each of its words, a gram of LEAST / 2 words that covers it and occurs in the run a period before or after. So words that no repeated gram covers part the
   text, within the stretches that are left grams are counted again, and so on; stretches of fewer than LEAST words have no run. This drops plain prose before any tree is built and loses nothing.
2. A stretch and its reversal get suffix trees by Ukkonen's algorithm. An Euler tour of the string depths with range minima (a sparse table over blocks) gives the lowest common ancestor of two
   leaves, and so the longest common extension of two places, forward and backward, in constant time.
3. By the runs theorem the root of each run starts a longest Lyndon word, for the order of words or its inverse. These are next smaller suffixes; the trees' leaves in order rank the suffixes.
   Each Lyndon word and the place behind it are extended in both directions; where the extensions reach a period, that is a run.
Memory is linear in a text; a stretch that needs trees takes some hundreds of bytes a word.

Defined cases: null and empty texts and texts without words have no runs and collapse to the empty text; every row gets its own result, whether its id is null or repeated, and equal texts get
equal ones; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LEAST = 12
#: Passes that count grams within ever shorter stretches; each only saves work.
PASSES = 8
_BLOCK = 16
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
_SCHEMA = "doc_id bigint, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"


class _Minima:
    """Minima of ranges of an array in constant time and linear memory: within blocks from both ends, between blocks by a sparse table."""

    def __init__(self, a: np.ndarray):
        padded = np.full(-(-len(a) // _BLOCK) * _BLOCK, np.iinfo(np.int32).max, np.int32)
        padded[: len(a)] = a
        blocks = padded.reshape(-1, _BLOCK)
        self.a = padded
        self.fore = np.minimum.accumulate(blocks, axis=1).reshape(-1)
        self.back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        self.levels = [blocks.min(axis=1)]
        while 2 ** len(self.levels) <= len(blocks):
            low, half = self.levels[-1], 2 ** (len(self.levels) - 1)
            self.levels.append(np.minimum(low[:-half], low[half:]))

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Minima over lo..hi, both included."""
        first, last = lo // _BLOCK, hi // _BLOCK
        out = np.minimum(self.back[lo], self.fore[hi])
        between = last - first - 1
        level = np.frexp(np.maximum(between, 1))[1] - 1
        for k in np.unique(level[between > 0]):
            at = np.flatnonzero((level == k) & (between > 0))
            table = self.levels[k]
            out[at] = np.minimum(out[at], np.minimum(table[first[at] + 1], table[last[at] - 2**k]))
        at = np.flatnonzero(first == last)
        if len(at):
            out[at] = self.a[np.minimum(lo[at][:, None] + np.arange(_BLOCK), hi[at][:, None])].min(axis=1)
        return out


class SuffixTree:
    """Ukkonen's tree of a sequence of letters from 1 on; a letter 0 ends it, so each suffix is a leaf, the empty one too."""

    def __init__(self, letters: list[int]):
        s = [*letters, 0]
        self.size = n = len(s)
        base = max(s) + 1
        start, end, link, child = [0], [0], [0], {}
        node = edge = length = left = 0
        for i in range(n):
            c, before = s[i], 0
            left += 1
            while left:
                if not length:
                    edge = i
                key = node * base + s[edge]
                below = child.get(key)
                if below is None:
                    child[key] = len(start)
                    start.append(i)
                    end.append(n)
                    link.append(0)
                    if before:
                        link[before] = node
                        before = 0
                else:
                    at = start[below]
                    long = end[below] - at
                    if length >= long:
                        edge += long
                        length -= long
                        node = below
                        continue
                    if s[at + length] == c:
                        if before:
                            link[before] = node
                        length += 1
                        break
                    middle = len(start)
                    child[key] = middle
                    start += (at, i)
                    end += (at + length, n)
                    link += (0, 0)
                    child[middle * base + c] = middle + 1
                    start[below] = at + length
                    child[middle * base + s[at + length]] = below
                    if before:
                        link[before] = middle
                    before = middle
                left -= 1
                if not node and length:
                    length -= 1
                    edge = i - left + 1
                else:
                    node = link[node]
        keys = np.fromiter(child.keys(), np.int64, len(child))
        order = np.argsort(keys)
        self.below = np.fromiter(child.values(), np.int64, len(child))[order].tolist()
        self.ending = (keys[order] % base == 0).tolist()
        self.first = np.searchsorted(keys[order], np.arange(len(start) + 1) * base).tolist()
        self.edge = (np.array(end) - np.array(start)).tolist()

    def tour(self) -> None:
        """The Euler tour: string depths as they are met, the place of each leaf, and the leaves' order."""
        below, first, edge, n = self.below, self.first, self.edge, self.size
        depths, place, order = [], [0] * n, []
        stack, depth = [0], [0] * len(edge)
        while stack:
            x = stack.pop()
            if x < 0:
                depths.append(~x)
                continue
            d = depth[x]
            lo, hi = first[x], first[x + 1]
            if lo == hi:
                place[n - d] = len(depths)
                order.append(n - d)
            else:
                again = ~d
                for k in range(hi - 1, lo - 1, -1):
                    y = below[k]
                    depth[y] = d + edge[y]
                    stack += (again, y)
            depths.append(d)
        self.depth, self.order = depth, order
        self.place, self.minima = np.array(place), _Minima(np.array(depths, np.int32))

    def inverse_order(self) -> list[int]:
        """Suffixes in the order of inverted letters, where the end of a sequence still comes first. After tour()."""
        below, first, depth, n = self.below, self.first, self.depth, self.size
        order, stack = [], [0]
        while stack:
            x = stack.pop()
            lo, hi = first[x], first[x + 1]
            if lo == hi:
                order.append(n - depth[x])
            elif self.ending[lo]:
                stack += below[lo + 1 : hi]
                stack.append(below[lo])
            else:
                stack += below[lo:hi]
        return order

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Lengths of the longest common beginnings of suffixes i and j, i <> j."""
        a, b = self.place[i], self.place[j]
        return self.minima.of(np.minimum(a, b), np.maximum(a, b)).astype(np.int64)


def lyndon_ends(order: list[int], m: int) -> np.ndarray:
    """Where the longest Lyndon word from each of m places ends: the next smaller suffix. order: the suffixes, ranked."""
    rank = [0] * (m + 1)
    for r, i in enumerate(order):
        rank[i] = r
    ends = [m] * m
    for i in range(m - 1, -1, -1):
        j, r = i + 1, rank[i]
        while j < m and rank[j] > r:
            j = ends[j]
        ends[i] = j
    return np.array(ends, np.int64)


def runs(letters: list[int], least: int = LEAST) -> np.ndarray:
    """(start, length, period) of the runs of a sequence of letters from 1 on, by start, then period."""
    m = len(letters)
    if m < least:
        return np.zeros((0, 3), np.int64)
    tree, back = SuffixTree(letters), SuffixTree(letters[::-1])
    tree.tour()
    back.tour()
    i = np.tile(np.arange(m), 2)
    j = np.concatenate([lyndon_ends(tree.order, m), lyndon_ends(tree.inverse_order(), m)])
    period = j - i
    right, left = tree.common(i, j), back.common(m - i, m - j)
    found = np.stack([i - left, period, right + left + period], axis=1)
    found = found[(left + right >= period) & (found[:, 2] >= np.maximum(least, 2 * period))]
    return np.unique(found, axis=0)[:, [0, 2, 1]]


def stretches(hashes: np.ndarray, owner: np.ndarray, least: int = LEAST) -> list[tuple[int, int]]:
    """Ranges of words (hashes; owner: the text of each, ascending) outside which no run lies."""
    gram = max(1, least // 2)
    mixed = common.mix(hashes)
    sums = np.zeros(max(0, len(mixed) - gram + 1), np.uint64)
    for k in range(gram):
        sums += common.mix(mixed[k : k + len(sums)] + np.uint64((k + 1) * int(common._MUL) & common._MASK))
    word, part = np.arange(len(hashes)), owner
    for _ in range(PASSES):
        if len(word) < least:
            return []
        starts = np.flatnonzero(part[: len(part) - gram + 1] == part[gram - 1 :])
        keys = common.mix(sums[word[starts]] ^ common.mix(part[starts].astype(np.uint64)))
        order = np.argsort(keys)
        same = keys[order][1:] == keys[order][:-1]
        again = np.zeros(len(starts), bool)
        again[order[1:][same]] = again[order[:-1][same]] = True
        change = np.zeros(len(word) + 1, np.int64)
        change[starts[again]] += 1
        change[starts[again] + gram] -= 1
        covered = np.cumsum(change)[:-1] > 0
        goes_on = np.append(False, covered[:-1] & (part[1:] == part[:-1]))
        number = np.cumsum(covered & ~goes_on)[covered]
        long = np.bincount(number, minlength=1)[number] >= least
        done = long.sum() == len(word)
        word, part = word[covered][long], number[long]
        if done:
            break
    if not len(word):
        return []
    cut = np.flatnonzero(np.diff(part)) + 1
    lo, hi = np.append(0, cut), np.append(cut, len(part)) - 1
    return list(zip(word[lo].tolist(), (word[hi] + 1).tolist(), strict=True))


def runs_of(texts: list[list[bytes]], least: int = LEAST) -> list[np.ndarray]:
    """Runs of each of some texts, given as words."""
    sizes = [len(t) for t in texts]
    ends = np.cumsum(sizes)
    # hashes of a process only say where it's worth to look
    hashes = np.fromiter((hash(w) for t in texts for w in t), np.int64, int(ends[-1]) if len(ends) else 0).view(np.uint64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    found: list[list[np.ndarray]] = [[] for _ in texts]
    for lo, hi in stretches(hashes, owner, least):
        k = int(owner[lo])
        first = lo - (int(ends[k]) - sizes[k])
        letters: dict[bytes, int] = {}
        part = runs([letters.setdefault(w, len(letters) + 1) for w in texts[k][first : first + hi - lo]], least)
        part[:, 0] += first
        found[k].append(part)
    return [np.concatenate(f) if f else np.zeros((0, 3), np.int64) for f in found]


def _collapsed(words: list[bytes], found: np.ndarray) -> str:
    """The words less those that a run repeats: all of a run behind its first period."""
    if len(found):
        change = np.zeros(len(words) + 1, np.int64)
        np.add.at(change, found[:, 0] + found[:, 2], 1)
        np.add.at(change, found[:, 0] + found[:, 1], -1)
        words = [words[i] for i in np.flatnonzero(np.cumsum(change)[:-1] == 0)]
    return b" ".join(words).decode()


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """doc_id, n_words, runs (array of (start, length, period), by start, then period) and collapsed (the text's words, parted by blanks, each run cut to its first period) for every row."""

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.pieces(batches):
            texts = common.text_bytes(part.column(1))
            for lo, hi in common.slabs(texts):
                words = [t.split() for t in texts[lo:hi]]  # bytes part at ASCII white space only
                found = runs_of(words, least)
                size = pa.array([len(w) for w in words], pa.int64())
                flat = np.concatenate(found)
                offsets = pa.array(np.append(0, np.cumsum([len(f) for f in found])), pa.int32())
                listed = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=list(_RUNS.value_type)))
                collapsed = pa.array([_collapsed(w, f) for w, f in zip(words, found, strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0).slice(lo, hi - lo), size, listed, collapsed], ["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(judged, _SCHEMA)
