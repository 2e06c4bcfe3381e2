"""Toxicity by a weighted finite-state pattern grammar.

Words and clause marks are symbols; a transducer reads a symbol in a state and writes one, with a weight. Five of them form a cascade, each reading what the one before it wrote:
negation and reported speech rewrite insults and threat verbs in their scope (to the clause's end, or to "but"), target marks insults behind a person that is spoken of or to, insult
writes a match for insults (more if aimed, most behind "you are") and for idioms of several words, and threat for intent and verb ("will hurt"), verb and target ("hurt you"), or all three. compose() makes one
machine of the five, a table of states x symbols that is built once and sent to the tasks. Its matches are summed by clause and channel; these sums, never words by themselves, make a
document's features, and a logistic function of the features is its score. A word of neither list has no symbol of its own.

Word lists of the grammar are fixed. Insults are those of a list and learned ones: words, and beginnings of words (as inflected languages need), that at least SHARE of the toxic rows
of the sample have, with log odds above ODDS; odds are the weights. A beginning of which a longer entry accounts for nearly all toxic rows is left to that entry. Learning takes at most
SAMPLE labelled rows (the smallest seeded hashes of their ids); at most LEXICON entries and a row of numbers for each sampled document reach the driver.

Defined cases: null and empty texts have no clauses and get the score of a text without matches; with no labelled rows, or labels of one kind only, every score
is the share of toxic labels (0 with none); null and repeated ids stay as they are, equal texts get equal scores; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SAMPLE, LEXICON, SEED = 8000, 600, 23
SHARE, ODDS, LEAST, BEGINNINGS = 0.05, 2.0, 5, (4, 5, 6, 7, 8)
#: Words whose symbols a task keeps.
KEPT = 200_000
#: Words of the grammar by symbol.
WORDS = {
    "neg": "not no never isn aren wasn don doesn didn nicht kein keine nie pas jamais ne nunca jamás",
    "turn": "but however aber sondern mais pero sino",
    "report": "said says told wrote claimed called quoted sagte schrieb nannte dit écrit appelé dijo escribió llamó",
    "target": "you your yours u he she they him her them people all du dein ihr euch sie tu te toi ton vous votre tú tus usted ustedes vosotros",
    "copula": "are is were was be bist ist seid sind es est êtes sont eres son sois",
    "intent": "will gonna going shall should werde wirst wird vais va vas voy vamos",
    "verb": "kill hurt destroy beat shoot stab burn hang töten schlagen umbringen tuer frapper matar golpear",
    "insult": "idiot moron stupid loser scum trash worthless pathetic disgusting clown dumbass bastard vermin imbecile dumm dummkopf trottel abschaum versager widerlich wertlos imbécile crétin débile ordure minable idiota estúpido imbécil basura escoria patético",
}
#: Insults of several words that follow one another.
IDIOMS = ("piece of garbage", "waste of space", "good for nothing", "drop dead", "go to hell", "stück dreck", "fahr zur hölle", "va en enfer", "vete al infierno")
MARKS = ".!?;:\n"
_TOKEN = re.compile(r"[^\W\d_]+|[.!?;:\n]")
CHANNELS = ("plain", "aimed", "threat", "negated", "reported")
FEATURES = len(CHANNELS) + 3


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


# ---------------------------------------------------------------- transducers

#: What a transducer does with a symbol in a state: next state, symbol written, weight (0: no match).
Step = Callable[[object, str], tuple[object, str, float]]


@dataclass(frozen=True)
class Transducer:
    start: object
    step: Step


def _scope(opens: str, mark: str, also: tuple[str, ...] = ()) -> Transducer:
    """From the symbol opens to the clause's end, or a turn, insults and verbs (and their rewritten forms in also) get the mark."""

    def step(state: object, s: str) -> tuple[object, str, float]:
        if s in ("end", "turn"):
            return False, s, 0.0
        if state and s in ("insult", "verb", *also):
            return True, s.split(".")[0] + mark, 0.0
        return state or s == opens, s, 0.0

    return Transducer(False, step)


def _target_step(state: object, s: str) -> tuple[object, str, float]:
    if s == "insult" and state:
        return state, "insult.aimed", 0.0
    return (False if s == "end" else state or s == "target"), s, 0.0


def _insult_step(state: object, s: str) -> tuple[object, str, float]:
    """States: whether a target has stood in the clause (1), and a copula behind it (2), and the idiom words so far."""
    place, idiom = state
    if s in ("insult", "insult.aimed", "insult.neg", "insult.rep"):
        channel = {"insult": "plain", "insult.aimed": "aimed", "insult.neg": "negated", "insult.rep": "reported"}[s]
        return (place, ()), channel, 1.5 if channel == "aimed" and place == 2 else 1.25 if channel == "aimed" else 1.0
    place = 0 if s == "end" else 2 if s == "copula" and place else max(place, 1) if s == "target" else place
    # the longest idiom beginning that ends here
    words = (*idiom, s)
    while words and not any(i[: len(words)] == words for i in _IDIOMS):
        words = words[1:]
    if words in _IDIOMS:
        return (place, ()), "aimed" if place else "plain", 1.25 if place else 1.0
    return (place, words), s, 0.0


def _threat_step(state: object, s: str) -> tuple[object, str, float]:
    """States: nothing, intent, verb (and of which kind), threat (a verb behind intent)."""
    if s == "end":
        return "", s, 0.0
    if s == "intent":
        return "intent", s, 0.0
    if s.startswith("verb"):
        kind = {"verb": "threat", "verb.neg": "negated", "verb.rep": "reported"}[s]
        return (f"done {kind}", kind, 1.0) if state == "intent" else (f"verb {kind}", s, 0.0)
    if s == "target" and state.startswith(("verb", "done")):
        return "", state[5:], 1.0
    return state, s, 0.0


def _symbol(word: str) -> str:
    return _BY_WORD.get(word, f"idiom {word}")


_BY_WORD = {w: s for s, words in WORDS.items() for w in words.split()} | {m: "end" for m in MARKS}
_IDIOMS = frozenset(tuple(map(_symbol, i.split())) for i in IDIOMS)
#: Word by symbol: those of the lists, and those of idioms, which are symbols by themselves.
SYMBOL = _BY_WORD | {w: _symbol(w) for i in IDIOMS for w in i.split()}
#: "other" stands for words without a symbol.
ALPHABET = ("other", *sorted(set(SYMBOL.values()) - {"other"}))
CASCADE = (_scope("neg", ".neg"), _scope("report", ".rep", ("insult.neg", "verb.neg")), Transducer(False, _target_step), Transducer((0, ()), _insult_step), Transducer("", _threat_step))


def compose(a: Transducer, b: Transducer) -> Transducer:
    """The machine that gives b what a writes; a match of a is written through."""

    def step(state: object, s: str) -> tuple[object, str, float]:
        x, y = state
        x, out, weight = a.step(x, s)
        if weight:
            # b sees no symbol of a match
            return (x, y), out, weight
        y, out, weight = b.step(y, out)
        return (x, y), out, weight

    return Transducer((a.start, b.start), step)


class Machine:
    """A transducer as tables over numbered states and symbols: next, channel (-1: no match) and weight."""

    def __init__(self, t: Transducer):
        number, queue, rows = {t.start: 0}, [t.start], []
        while len(rows) < len(queue):
            row = []
            for s in ALPHABET:
                to, out, weight = t.step(queue[len(rows)], s)
                if to not in number:
                    number[to] = len(queue)
                    queue.append(to)
                row.append((number[to], CHANNELS.index(out) if weight else -1, weight))
            rows.append(row)
        self.rows = rows


MACHINE = Machine(reduce(compose, CASCADE))


def entries(word: str) -> list[str]:
    """What a word may be found under, the longest first: itself, and its beginnings, which end in *."""
    return [word, *(word[:n] + "*" for n in reversed(BEGINNINGS) if len(word) > n)]


class _Symbols(dict):
    """(symbol, weight, whether it can lead to a match) of words, None for words without a symbol; beginnings are looked up once a word."""

    def __missing__(self, word: str) -> tuple[int, float, bool] | None:
        got = next((self[e] for e in entries(word)[1:] if e in self), None)
        if len(self) < KEPT:
            self[word] = got
        return got


class Grammar:
    """weights: of the insults, words or beginnings; other words of the grammar weigh 1."""

    def __init__(self, weights: dict[str, float]):
        numbers = {s: i for i, s in enumerate(ALPHABET)}
        hot = {s for s in ALPHABET if s in ("insult", "verb") or s.startswith("idiom")}
        self.symbol = _Symbols({w: (numbers[s], weights.get(w, 1.0), s in hot) for w, s in SYMBOL.items()})
        self.symbol.update({w: (numbers["insult"], x, True) for w, x in weights.items() if w not in SYMBOL})
        self.rows = MACHINE.rows

    def clause(self, words: list[str]) -> list[float]:
        """Weights of a clause's matches by channel."""
        return self._run([self.symbol[w] for w in words])

    def _run(self, symbols: list[tuple[int, float, bool] | None]) -> list[float]:
        """Runs of words without a symbol count as one: the machine stays where one took it."""
        out, state, rows, gap = [0.0] * len(CHANNELS), 0, self.rows, False
        for got in symbols:
            if got is None:
                gap = True
                continue
            if gap:
                state, gap = rows[state][0][0], False
            state, channel, weight = rows[state][got[0]]
            if channel >= 0:
                out[channel] += weight * got[1]
        return out

    def features(self, text: str) -> list[float]:
        """Sums by channel, matched clauses, the heaviest clause, and the share of clauses matched."""
        symbols, end = list(map(self.symbol.__getitem__, tokens(text))), self.symbol["."]
        hot, done, sums, matched, most = [i for i, x in enumerate(symbols) if x and x[2]], -1, [0.0] * len(CHANNELS), 0, 0.0
        for i in hot:
            if i < done:
                continue
            lo, done = i, i
            while lo > 0 and symbols[lo - 1] != end:
                lo -= 1
            while done < len(symbols) and symbols[done] != end:
                done += 1
            got = self._run(symbols[lo:done])
            if any(got):
                matched += 1
                most = max(most, got[0] + got[1] + got[2])
                sums = [a + b for a, b in zip(sums, got, strict=True)]
        clauses = 1 + symbols.count(end) if matched else 1
        return [*(float(np.log1p(x)) for x in sums), float(np.log1p(matched)), most, matched / clauses]


# ---------------------------------------------------------------- learning


class Model:
    def __init__(self, grammar: Grammar, mean: np.ndarray, scale: np.ndarray, w: np.ndarray, b: float):
        self.grammar, self.mean, self.scale, self.w, self.b = grammar, mean, scale, w, b

    def scores(self, texts: list[str | None]) -> np.ndarray:
        x = np.array([self.grammar.features(t or "") for t in texts], float).reshape(-1, FEATURES)
        return 1 / (1 + np.exp(-np.clip((x - self.mean) / self.scale @ self.w + self.b, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> tuple[np.ndarray, float]:
    """Newton's method with a ridge penalty; both kinds of labels count alike in total."""
    x1 = np.c_[x, np.ones(len(x))]
    weight = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
    w, ridge = np.zeros(x1.shape[1]), np.diag([penalty] * x.shape[1] + [1e-6])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        h = (x1 * (weight * p * (1 - p))[:, None]).T @ x1 + ridge
        step = np.linalg.solve(h, x1.T @ (weight * (y - p)) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def _distinct_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out, label = [], []
        for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            have = {e for w in set(tokens(text or "")) - set(MARKS) for e in entries(w)}
            out += have
            label += [y] * len(have)
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), pa.array(label, pa.int64())], ["entry", "toxic"])


def specific(found: dict[str, tuple[int, float]]) -> dict[str, float]:
    """Weights of entries (toxic rows, weight) less the beginnings of which a longer entry has nine tenths of the toxic rows."""
    return {e: x for e, (a, x) in found.items() if not any(len(o) >= len(e) and o != e and o.startswith(e[:-1]) and 10 * m >= 9 * a for o, (m, _) in found.items()) or e[-1] != "*"}


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """Learns from at most sample labelled rows. Ids of at most sample labels are sent to the tasks, so texts of other rows don't move; an id may have any number of rows, so these are sampled
    once more, by the hash of id and text, and rows that are equal in both count once."""
    chosen = labels.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label_col).cast("bigint").alias("toxic"))
    turn = F.xxhash64("_id", F.lit(SEED))
    # below the threshold of the hash there is little more than the sample, however many partitions there are, once equal ids are one
    chosen = chosen.where(turn <= common.hash_threshold(chosen.count(), sample)).groupBy("_id").agg(F.max("toxic").alias("toxic")).orderBy(turn, "_id").limit(sample)
    found = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("text")).join(F.broadcast(chosen), F.col("_doc") == F.col("_id"))
    found = common.written(found.select("text", "toxic", F.xxhash64("_doc", "text", F.lit(SEED)).alias("turn")), "labelled")
    rows = found.where(F.col("turn") <= common.hash_threshold(found.count(), sample)).groupBy("turn").agg(F.first("text").alias("text"), F.max("toxic").alias("toxic"))
    rows = common.written(rows.orderBy("turn").limit(sample).select("text", "toxic"), "sample")
    common.release(found)
    totals = rows.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    n, bad = int(totals[0]), int(totals[1] or 0)
    nothing = np.zeros(FEATURES)
    if not bad or bad == n:
        return Model(Grammar({}), nothing, nothing + 1, nothing, 30.0 if bad else -30.0)
    counts = rows.mapInArrow(_distinct_entries, "entry string, toxic bigint").groupBy("entry").agg(F.sum("toxic").alias("a"), (F.count(F.lit(1)) - F.sum("toxic")).alias("b"))
    rate = (F.col("a") + 0.25) / (bad + 0.5) / ((F.col("b") + 0.25) / (n - bad + 0.5))
    best = counts.where(F.col("a") >= max(LEAST, SHARE * bad)).withColumn("odds", F.log(rate)).where(F.col("odds") > ODDS).orderBy(F.desc(F.col("odds") * F.sqrt("a")), "entry").limit(LEXICON)
    top = float(np.log(n))
    grammar = Grammar(specific({r["entry"]: (r["a"], min(1.0, r["odds"] / top)) for r in best.collect()}))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [grammar.features(t or "") for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b.column(1)], ["x", "toxic"])

    got = rows.mapInArrow(measured, "x array<double>, toxic bigint").collect()
    common.release(rows)
    got.sort(key=lambda r: (r["toxic"], r["x"]))
    x, y = np.array([r["x"] for r in got]), np.array([r["toxic"] for r in got], float)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    w, b = _logistic((x - mean) / scale, y)
    return Model(grammar, mean, scale, w, b)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score for every row."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.pieces(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.scores(b.column(1).to_pylist()))], ["doc_id", "score"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(judge, "doc_id bigint, score double")
