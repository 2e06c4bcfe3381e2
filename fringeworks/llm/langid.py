"""Language identification by a byte convolutional network, trained and applied in numpy.

Bytes are embedded, filters of several widths slide over windows of WINDOW bytes, each filter keeps its maximum, and a softmax gives the languages.
A document's score is the mean of its windows' probabilities, weighted by their bytes; all windows of the whole text count.

Training takes at most SAMPLE labelled documents (the smallest seeded hashes of id and text) and from each PIECES windows at hashed places of the whole text.
Labelled rows are counted first; executors keep rows below a threshold of the hash, and of rows with equal ids and texts one. So about SAMPLE + 8 sqrt(SAMPLE) rows reach the driver at most,
however many rows repeat an id and however many partitions there are; it cuts these to SAMPLE.

Defined cases: null texts and texts without a letter are "und" with score 0; with no labelled row every document is "und"; null and repeated ids stay as they are; rows that repeat an id and a text enter the
sample once; texts shorter than a window are padded with byte 0; equal texts get equal results; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW, EMBED, WIDTHS, FILTERS = 256, 8, (2, 3, 4), 16
SAMPLE, PIECES = 3000, 3
EPOCHS, BATCH, RATE, SEED = 4, 128, 0.01, 5
#: Windows that the network takes at a time.
STEP = 64
_LETTER = re.compile(r"[^\W\d_]")
_SPAN = max(WIDTHS)


class Network:
    """emb: 256 x EMBED; w: (_SPAN * EMBED) x filters, zero beyond a filter's width; b: filters; v: filters x classes; c: classes."""

    def __init__(self, classes: list[str], seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.classes = classes
        n = FILTERS * len(WIDTHS)
        self.emb = rng.normal(0, 0.5, (256, EMBED)).astype(np.float32)
        self.emb[0] = 0
        self.mask = np.repeat(np.stack([np.arange(_SPAN * EMBED) < k * EMBED for k in WIDTHS], axis=1), FILTERS, axis=1).astype(np.float32)
        self.w = (rng.normal(0, 0.25, (_SPAN * EMBED, n)) * self.mask).astype(np.float32)
        self.b = np.zeros(n, np.float32)
        self.v = rng.normal(0, 0.2, (n, len(classes))).astype(np.float32)
        self.c = np.zeros(len(classes), np.float32)

    def columns(self, x: np.ndarray) -> np.ndarray:
        """windows x places x (_SPAN * EMBED)"""
        e = self.emb[np.pad(x, ((0, 0), (0, _SPAN - 1)))].reshape(len(x), -1)
        s = e.strides
        return np.lib.stride_tricks.as_strided(e, (len(x), WINDOW, _SPAN * EMBED), (s[0], s[1] * EMBED, s[1]))

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        cols = np.ascontiguousarray(self.columns(x))
        out = (cols.reshape(-1, _SPAN * EMBED) @ self.w).reshape(len(x), WINDOW, -1)
        return cols, out, out.max(axis=1) + self.b

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(self.classes)), np.float32)
        for i in range(0, len(x), STEP):
            z = np.maximum(self.pooled(x[i : i + STEP])[2], 0) @ self.v + self.c
            z = np.exp(z - z.max(axis=1, keepdims=True))
            out[i : i + STEP] = z / z.sum(axis=1, keepdims=True)
        return out

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        names = ("emb", "w", "b", "v", "c")
        first = {k: np.zeros_like(getattr(self, k)) for k in names}
        second = {k: np.zeros_like(getattr(self, k)) for k in names}
        step = 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(x))
            for lo in range(0, len(x), BATCH):
                xs, ys = x[order[lo : lo + BATCH]], y[order[lo : lo + BATCH]]
                cols, out, z = self.pooled(xs)
                at = out.argmax(axis=1)
                h = np.maximum(z, 0)
                p = h @ self.v + self.c
                p = np.exp(p - p.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(ys)), ys] -= 1
                p /= len(ys)
                dz = (p @ self.v.T) * (z > 0)
                # each filter's gradient flows to the place of its maximum only
                picked = cols[np.arange(len(xs))[:, None], at]
                g = {"v": h.T @ p, "c": p.sum(axis=0), "b": dz.sum(axis=0), "w": np.einsum("nfd,nf->df", picked, dz) * self.mask}
                back = np.einsum("nf,df->nfd", dz, self.w * self.mask).reshape(len(xs), -1, _SPAN, EMBED)
                padded = np.pad(xs, ((0, 0), (0, _SPAN - 1)))
                chars = padded[np.arange(len(xs))[:, None, None], at[:, :, None] + np.arange(_SPAN)]
                g["emb"] = np.zeros_like(self.emb)
                np.add.at(g["emb"], chars.reshape(-1), back.reshape(-1, EMBED))
                g["emb"][0] = 0
                step += 1
                for k in names:
                    first[k] = 0.9 * first[k] + 0.1 * g[k]
                    second[k] = 0.999 * second[k] + 0.001 * g[k] ** 2
                    setattr(self, k, (getattr(self, k) - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32))


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of all texts, the text that each belongs to and its bytes; an empty text has one empty window."""
    counts = np.array([max(1, -(-len(t) // WINDOW)) for t in texts], np.int64)
    flat = np.zeros(int(counts.sum()) * WINDOW, np.uint8)
    size = np.full(int(counts.sum()), WINDOW, np.float32)
    at = 0
    for t, n in zip(texts, counts, strict=True):
        flat[at * WINDOW : at * WINDOW + len(t)] = np.frombuffer(t, np.uint8)
        at += n
        size[at - 1] = len(t) - (n - 1) * WINDOW
    return flat.reshape(-1, WINDOW), np.repeat(np.arange(len(texts)), counts), size


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Network | None:
    """Fits on at most sample rows with text and language; None where there are none."""
    text = F.col(text_col)
    places = [F.pmod(F.xxhash64(F.col(id_col), F.lit(SEED + i)), F.greatest(F.length(text) - WINDOW // 2, F.lit(1))).cast("int") + 1 for i in range(PIECES)]
    known = labelled.where(F.col(lang_col).isNotNull() & text.isNotNull())
    pieces = known.select(F.col(lang_col).alias("lang"), F.array(*[F.substring(text, p, F.lit(WINDOW)) for p in places]).alias("pieces"), F.xxhash64(F.col(id_col), text, F.lit(SEED)).alias("turn"))
    pieces = pieces.where(F.col("turn") <= common.hash_threshold(known.count(), sample)).groupBy("turn").agg(F.min(F.struct("lang", "pieces")).alias("x"))
    rows = sorted(pieces.select("turn", "x.lang", "x.pieces").collect(), key=lambda r: r["turn"])[:sample]
    cut = [(r["lang"], p.encode()[:WINDOW]) for r in rows for p in dict.fromkeys(r["pieces"]) if _LETTER.search(p)]
    if not cut:
        return None
    net = Network(sorted({lang for lang, _ in cut}))
    x, _, _ = windows([p for _, p in cut])
    net.fit(x, np.array([net.classes.index(lang) for lang, _ in cut]))
    return net


def identify(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score for every row."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.pieces(batches):
            raw = part.column(1).to_pylist()
            lang, score = ["und"] * len(raw), np.zeros(len(raw))
            good = [i for i, t in enumerate(raw) if t and _LETTER.search(t)]
            texts = [raw[i].encode() for i in good]
            for lo, hi in common.slabs(texts) if net else ():
                x, owner, size = windows(texts[lo:hi])
                p = net.predict(x) * size[:, None]
                total = np.add.reduceat(p, np.searchsorted(owner, np.arange(hi - lo)), axis=0)
                total /= total.sum(axis=1, keepdims=True)
                for k, j in enumerate(total.argmax(axis=1)):
                    lang[good[lo + k]] = net.classes[j]
                    score[good[lo + k]] = min(1.0, float(total[k, j]))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(judge, "doc_id bigint, lang_pred string, score double")
