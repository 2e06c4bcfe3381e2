"""Byte-level BPE encoding and decoding: speculate and verify.

A word (a piece that the pre-tokeniser cuts) is first cut greedily into the longest tokens. Such a cut is the merge order's result exactly if each adjacent pair
of tokens is compatible: undoing the two tokens' merges from the boundary outwards, the later merge first, never meets two parts that would have
merged with one another before they merged otherwise. That test runs over all pairs of a batch at once on numpy arrays; only words that fail it are merged step by step. Results are
kept per word within a task, up to a bound.

Vocabularies are tokenizers JSON files with a byte-level BPE model; the driver reads the file, whose size bounds what is broadcast.

Equal words of a batch are brought together by hashes and then compared character by character.

Defined cases: null and empty texts have no tokens and decode to the empty text; null and repeated ids stay as they are; special tokens in a text become their ids, as in the library by default; bytes
that aren't UTF-8 after decoding of foreign ids become U+FFFD; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import filterfalse

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

# the pre-tokeniser's pattern (fixed value of the vocabulary), with white space spelled out
_SPACES = r"\t-\r \x85\xa0  -     　"
_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACES}\p{{L}}\p{{N}}]+|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+"
_ANY = regex.compile(_PATTERN)
# the same where all characters are ASCII or Latin letters: the standard module is faster, and letters may come first, as no other branch begins with them
_LATIN = re.compile(r"[\x00-\x7f\xc0-\xd6\xd8-\xf6\xf8-ɏ]*")
_L = r"A-Za-z\xc0-\xd6\xd8-\xf6\xf8-ɏ"
_QUICK = re.compile(rf" ?[{_L}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[0-9]+| ?[^\t-\r {_L}0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
_NEVER = np.int64(1 << 40)
KEPT_WORDS = 100_000
#: Characters that are encoded together: equal words among them are looked up once.
TOGETHER = 1 << 20


def _byte_chars() -> dict[str, int]:
    """Characters that stand for bytes in byte-level vocabularies: printable Latin-1 stands for itself, the others follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """The bytes of each token, from the text of a vocabulary's file: all that decoding needs."""

    def __init__(self, text: str):
        self.spec = spec = json.loads(text)
        if spec["model"]["type"] != "BPE" or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space") or spec.get("normalizer") or spec["model"].get("ignore_merges"):
            raise ValueError("a byte-level BPE vocabulary without normaliser and prefix space is asked for")
        chars = _byte_chars()
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes: list[bytes] = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for t, i in vocab.items():
            self.bytes[i] = bytes(chars[c] for c in t) if all(c in chars for c in t) else t.encode()
        for t, i in self.special.items():
            self.bytes[i] = t.encode()
        self.size = np.array([len(x) for x in self.bytes], np.int64)
        self.offset = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)

    def decode(self, ids: np.ndarray) -> str:
        return ragged(self.flat, self.offset, self.size, ids.astype(np.int64)).tobytes().decode("utf-8", errors="replace")


class Decoder(Vocabulary):
    """Keeps the bytes of the tokens only."""

    def __init__(self, text: str):
        super().__init__(text)
        del self.spec, self.bytes, self.special


class Codec(Vocabulary):
    """Tables for both ways."""

    def __init__(self, text: str):
        super().__init__(text)
        spec, chars, size = self.spec, _byte_chars(), len(self.bytes)
        vocab: dict[str, int] = spec["model"]["vocab"]
        del self.spec
        self.rank = np.full(size, -1, np.int64)
        self.left, self.right = np.zeros(size, np.int64), np.zeros(size, np.int64)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for r, m in enumerate(spec["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            a, b, c = vocab[a], vocab[b], vocab[a + b]
            self.merges[a, b] = (r, c)
            if self.rank[c] >= 0 or max(self.rank[a], self.rank[b]) >= r:
                raise ValueError("each merge must make a new token of earlier ones")
            self.rank[c], self.left[c], self.right[c] = r, a, b
        pair = np.array([(a << 32) | b for a, b in self.merges], np.int64)
        order = np.argsort(pair)
        self.pair, self.pair_rank = pair[order], np.array([r for r, _ in self.merges.values()], np.int64)[order]
        self.byte = [0] * 256
        for c, b in chars.items():
            self.byte[b] = vocab[c]
        #: Tokens that merging makes of their own bytes.
        whole = np.flatnonzero(self.rank >= 0)
        good = np.ones(size, bool)
        good[whole] = self.compatible_parts(whole)
        self.by_bytes = {self.bytes[i]: i for i in [*self.byte, *whole[good[whole]].tolist()]}
        #: Tokens and their beginnings; -1 for those that are no token.
        self.begins = {t[:n]: -1 for t in self.by_bytes for n in range(1, len(t))} | self.by_bytes
        self.cut = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.known = self.specials()
        self.last = (1 << 60, -1)

    def specials(self) -> dict[str, bytes]:
        return {f"\0 {t}": np.array([i], "<u4").tobytes() for t, i in self.special.items()}

    def compatible_parts(self, tokens: np.ndarray) -> np.ndarray:
        """Whether merging a token's bytes gives the token: its parts, and theirs, hold against each other until its own merge comes."""
        good = np.ones(len(self.rank), bool)
        held = self.compatible(self.left[tokens], self.right[tokens], self.rank[tokens])
        order = np.argsort(self.rank[tokens])
        for t, ok in zip(tokens[order].tolist(), held[order].tolist(), strict=True):
            good[t] = ok and good[self.left[t]] and good[self.right[t]]
        return good[tokens]

    def compatible(self, a: np.ndarray, b: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """For each pair of adjacent tokens, whether the boundary between them lasts (or lasts until the given rank)."""
        x, y = a.copy(), b.copy()
        absorbed_x, absorbed_y = (np.full(len(a), _NEVER) if until is None else until.copy() for _ in range(2))
        good, live = np.ones(len(a), bool), np.arange(len(a))
        while len(live):
            p, q = x[live], y[live]
            key = (p << np.int64(32)) | q
            at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
            merge = np.where(self.pair[at] == key, self.pair_rank[at], _NEVER)
            # of equal merges the leftmost comes first
            bad = (merge < absorbed_x[live]) & (merge <= absorbed_y[live]) & (merge < _NEVER)
            if until is not None:
                bad &= merge != until[live]
            good[live[bad]] = False
            live = live[~bad]
            p, q = x[live], y[live]
            on_left = self.rank[p] > self.rank[q]
            some = np.maximum(self.rank[p], self.rank[q]) >= 0
            i, j = live[some & on_left], live[some & ~on_left]
            absorbed_x[i] = self.rank[x[i]]
            x[i] = self.right[x[i]]
            absorbed_y[j] = self.rank[y[j]]
            y[j] = self.left[y[j]]
            live = live[some]
        return good

    def greedy(self, word: bytes) -> list[int]:
        """Longest tokens from the left; a step goes on while some token begins like this."""
        out, at, n, get = [], 0, len(word), self.begins.get
        while at < n:
            stop, end = at + 1, at + 1
            found = best = get(word[at:stop])
            while stop < n:
                stop += 1
                if (found := get(word[at:stop])) is None:
                    break
                if found >= 0:
                    best, end = found, stop
            out.append(best)
            at = end
        return out

    def merged(self, word: bytes) -> list[int]:
        """Merges step by step: the lowest rank first, of equal ones the leftmost."""
        ids = [self.byte[b] for b in word]
        if len(ids) > 64:
            return self._merged_long(ids)
        get, last = self.merges.get, self.last
        ranks = [get(p, last) for p in zip(ids, ids[1:])]
        while ranks and (best := min(ranks)) is not last:
            at = ranks.index(best)
            ids[at : at + 2] = [best[1]]
            del ranks[at]
            if at:
                ranks[at - 1] = get((ids[at - 1], best[1]), last)
            if at < len(ranks):
                ranks[at] = get((best[1], ids[at + 1]), last)
        return ids

    def _merged_long(self, ids: list[int]) -> list[int]:
        """The same on a linked list with a heap, for long words."""
        import heapq

        n = len(ids)
        after, before, alive = [*range(1, n), -1], [*range(-1, n - 1)], [True] * n
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := self.merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, c = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = c, False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
                if m := self.merges.get((c, ids[after[i]])):
                    heapq.heappush(heap, (m[0], i, c, ids[after[i]], m[1]))
            if before[i] >= 0 and (m := self.merges.get((ids[before[i]], c))):
                heapq.heappush(heap, (m[0], before[i], ids[before[i]], c, m[1]))
        return [t for t, ok in zip(ids, alive, strict=True) if ok]

    def learn(self, words: Iterable[str]) -> None:
        """Encodes unseen words together."""
        words = list(words)
        raw = [w.encode() for w in words]
        ids = [self.greedy(w) for w in raw]
        flat = np.array([t for x in ids for t in x], np.int64)
        counts = np.array([len(x) for x in ids], np.int64)
        owner = np.repeat(np.arange(len(ids)), counts)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        pair, back = np.unique((flat[inner] << np.int64(32)) | flat[inner + 1], return_inverse=True)
        failed = owner[inner[~self.compatible(pair >> np.int64(32), pair & np.int64(0xFFFFFFFF))[back]]]
        for i in np.unique(failed):
            ids[i] = self.merged(raw[i])
        for w, x in zip(words, ids, strict=True):
            self.known[w] = array("I", x).tobytes()

    def pieces(self, text: str) -> list[str]:
        return (_QUICK if _LATIN.fullmatch(text) else _ANY).findall(text)

    def parts(self, text: str) -> list[str]:
        """Words of a text; special tokens stand between them with a NUL and a blank before, which no word has."""
        if not self.cut or not self.cut.search(text):
            return self.pieces(text)
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += [*self.pieces(text[at : m.start()]), f"\0 {m[0]}"]
            at = m.end()
        return out + self.pieces(text[at:])

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        plain = [i for i, t in enumerate(texts) if _LATIN.fullmatch(t) and not (self.cut and self.cut.search(t))]
        out: list[bytes] = [b""] * len(texts)
        for i in set(range(len(texts))).difference(plain):
            out[i] = self._by_word(texts[i])
        if plain:
            for i, ids in zip(plain, self._plain([texts[i] for i in plain]), strict=True):
                out[i] = ids
        return out

    def ready(self, words: list[str]) -> None:
        """Makes all the words known."""
        fresh = set(filterfalse(self.known.__contains__, words))
        if fresh:
            if len(self.known) + len(fresh) > KEPT_WORDS:
                self.known = self.specials()
                fresh = {w for w in words if w not in self.known}
            self.learn(fresh)

    def _by_word(self, text: str) -> bytes:
        p = self.parts(text)
        self.ready(p)
        return b"".join(map(self.known.__getitem__, p))

    def _plain(self, texts: list[str]) -> list[bytes]:
        """Texts of ASCII and Latin letters: words are found, and equal words brought together, on arrays of characters."""
        text = "".join(texts)
        chars = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        edges = np.cumsum([0] + [len(t) for t in texts])
        starts = word_starts(chars, edges)
        ends = np.append(starts[1:], len(chars))
        _, first, back = np.unique(common.span_hashes(chars, starts, ends), return_index=True, return_inverse=True)
        if not same_words(chars, starts, ends, first[back]):
            return [self._by_word(t) for t in texts]
        words = [text[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        ids = list(map(self.known.get, words))
        if None in ids:
            self.ready([w for w, x in zip(words, ids, strict=True) if x is None])
            ids = [self.known[w] if x is None else x for w, x in zip(words, ids, strict=True)]
        flat = np.frombuffer(b"".join(ids), "<u4")
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        whole = ragged(flat, np.cumsum(size) - size, size, back)
        stop = np.append(0, np.cumsum(size[back]))[np.searchsorted(starts, edges)]
        return [whole[a:b].tobytes() for a, b in zip(stop[:-1], stop[1:], strict=True)]


def ragged(flat: np.ndarray, offset: np.ndarray, size: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The pieces flat[offset : offset + size] of which, one after another."""
    n = size[which]
    end = np.cumsum(n)
    return flat[np.repeat(offset[which] - end + n, n) + np.arange(end[-1] if len(end) else 0)]


def same_words(chars: np.ndarray, starts: np.ndarray, ends: np.ndarray, as_word: np.ndarray) -> bool:
    """Whether each word has the characters of the word that as_word names: equal hashes are not taken on trust. Words stand side by side and fill chars."""
    size, words = ends - starts, max(1, TOGETHER // 8)
    if not np.array_equal(size[as_word], size):
        return False
    parts = ((i, min(len(starts), i + words)) for i in range(0, len(starts), words))
    return all(np.array_equal(ragged(chars, starts, size, as_word[a:b]), chars[starts[a] : ends[b - 1]]) for a, b in parts)


def word_starts(chars: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Where the pre-tokeniser's words begin in texts of ASCII and Latin letters; edges: where texts begin, and the end."""
    kind = _KIND[chars]
    n = len(kind)
    if not n:
        return np.empty(0, np.int64)
    new = np.append(True, kind[1:] != kind[:-1])
    new[edges[:-1][edges[:-1] < n]] = True
    first = np.zeros(n + 1, bool)
    first[edges] = True
    run = np.flatnonzero(new)
    end = np.append(run[1:], n)
    space = kind[run] == 0
    # a blank before letters, digits or signs is part of their word
    behind = np.append(0, chars[:-1])[run]
    joined = ~space & (behind == 32) & ~first[run]
    # of white space before a word only the last character stands apart
    last = end[space & (end - run > 1) & ~first[end]] - 1
    starts = np.zeros(n + 1, bool)
    starts[run[~joined]] = True
    starts[last] = True
    # 's 't 're 've 'm 'll 'd
    mark = np.flatnonzero((chars[run] == 39) & (end - run == 1) & ~joined & ~first[end])
    mark = mark[(mark + 1 < len(run))]
    mark = mark[kind[run[mark + 1]] == 1]
    letters, size = run[mark + 1], end[mark + 1] - run[mark + 1]
    a, b = chars[letters], np.append(chars, 0)[letters + 1] * (size > 1)
    one = np.isin(a, [115, 116, 109, 100])
    two = ((a == 108) & (b == 108)) | (((a == 114) | (a == 118)) & (b == 101))
    starts[letters[one | two]] = False
    over = np.where(one, 1, 2)
    rest = (one | two) & (size > over)
    starts[(letters + over)[rest]] = True
    return np.flatnonzero(starts[:n])


#: White space 0, letters 1, digits 2, others 3, of ASCII and Latin letters.
_KIND = np.full(0x250, 3, np.int8)
for _c in range(0x250):
    _KIND[_c] = 0 if 9 <= _c <= 13 or _c == 32 else 1 if chr(_c).isalpha() else 2 if 48 <= _c <= 57 else 3


_made: dict[type[Vocabulary], tuple[str, Vocabulary]] = {}
common.caches.append(_made)


def _kept[T: Vocabulary](kind: type[T], text: str) -> T:
    """One of a kind per process: that of the last vocabulary."""
    key = hashlib.sha256(text.encode()).hexdigest()
    if kind not in _made or _made[kind][0] != key:
        _made[kind] = (key, kind(text))
    return _made[kind][1]


def _encoded(codec: Codec, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[bytes]]]:
    for part in common.pieces(batches, keep=_made):
        texts = [t or "" for t in part.column(1).to_pylist()]
        for lo, hi in common.slabs(texts, TOGETHER):
            yield part.column(0).slice(lo, hi - lo), codec.encode_batch(texts[lo:hi])
    # the worker goes on to other tasks, which may be another stage's
    codec.known = codec.specials()


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (binary: little-endian unsigned 32-bit) for every row."""
    with open(path, encoding="utf-8") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_id, ids in _encoded(_kept(Codec, sent.value), batches):
            yield pa.RecordBatch.from_arrays([doc_id, pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return _texts(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, ids binary")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """decode(encode(docs)) in one pass: a task has one Python worker, and ids cross over to the JVM once."""
    with open(path, encoding="utf-8") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _kept(Codec, sent.value)
        for doc_id, ids in _encoded(codec, batches):
            decoded = [codec.decode(np.frombuffer(x, "<u4")) for x in ids]
            yield pa.RecordBatch.from_arrays([doc_id, pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])

    return _texts(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, ids binary, decoded string")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and decoded (string) for every row of encode()."""
    with open(path, encoding="utf-8") as f:
        sent = encoded.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _kept(Decoder, sent.value)
        for part in common.pieces(batches, keep=_made):
            ids = part.column(1)
            yield pa.RecordBatch.from_arrays([part.column(0), ids, pa.array([decoder.decode(np.frombuffer(x, "<u4")) for x in ids.to_pylist()], pa.string())], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, ids binary, decoded string")
