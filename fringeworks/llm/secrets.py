"""Secret scans by a battery of randomness tests; DataFrame functions only.

Candidates are long runs of characters that keys are written in and that no span of a fixed form covers. For each, an encoding is inferred (hex, base32, base64 or letters and digits) with its
alphabet, and three tests ask whether the characters look drawn at random from it: chi-squared uniformity of the alphabet's cells, the number of runs above and below its middle
(Wald-Wolfowitz), and lag-one serial correlation. Fisher's method combines their p-values into one that is small for text and uniform for keys.
Reported is what passes both ways. It looks random: the battery doesn't reject it at level LEVEL. And it doesn't look like text, by false-discovery control that is aware of length: the null
hypothesis is text, and every text gives a piece of its own words for each PIECE characters, joined as identifiers, paths and numbered names are (JOINTS) and as long as some class of lengths asks
for; the same battery measures these pieces. A candidate's evidence is the share of its class's pieces that look at least as random as it does (GRID steps of log p; one more piece is counted, so
that it is never 0). In each class the Benjamini-Hochberg step-up over distinct candidates reports those whose evidence holds at rate FDR. What is counted is a table of classes x steps, whatever
the input. Reported candidates have digits beside letters: without these the tests have no power at such lengths.
Kinds with a fixed form (assignments, access keys, hex) are found by pattern.

Defined cases: null and empty texts have no spans; spans count code points; every row gets its own result, whether its id is null or repeated, and equal texts get equal spans; without
any text to compare with nothing random is reported; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

#: (kind, pattern, group whose length counts, least length): fixed by the query's contract, in its order.
KINDS = (
    ("assign", r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
)
#: Runs of fewer characters can't be missed by a pattern that asks for more at once, where shorter matches hide no longer ones.
_FOUND = {"access": r"AKIA[A-Z0-9]{14,}", "hex": r"[0-9a-f]{16,}"}
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
#: Classes of lengths by their least; pieces of text have lengths from there on, up to half as much again.
CLASSES = (20, 28, 40, 64)
GRID, FDR, LEVEL, PIECE = 1000, 0.05, 0.005, 4096
#: What stands between the words of a piece of text.
JOINTS = ("", "-", "_", "/", "2", "-1-", "_v3_", "/4/")
#: Items of an array that a scan takes at a time.
BLOCK = 256
_NONE = "array<struct<start:bigint,end:bigint,kind:string,match:string>>"


def _scanned(items: Column, kind: str, state: Column, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """What step(state, item) puts out, item by item, an array of the type kind: it gives the next state and an array. Blocks of items grow an array each, so time is linear in the items."""

    def over(items_: Column, state_: Column, put: Callable[[Column, Column], Column], kind_: str) -> Column:
        start = F.struct(state_.alias("state"), F.array().cast(kind_).alias("out"))
        return F.aggregate(items_, start, put)

    def one(acc: Column, x: Column) -> Column:
        after, out = step(acc["state"], x)
        return F.struct(after.alias("state"), F.concat(acc["out"], out).alias("out"))

    def block(acc: Column, part: Column) -> Column:
        # the state is carried over once more by itself: what is bound to a name is copied, and so would be all blocks before
        after = F.aggregate(part, acc["state"], lambda state_, x: step(state_, x)[0])
        return F.struct(after.alias("state"), F.concat(acc["out"], F.array(over(part, acc["state"], one, kind)["out"])).alias("out"))

    def whole(bound: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(bound) - 1) / BLOCK).cast("int")), lambda i: F.slice(bound, i * BLOCK + 1, F.lit(BLOCK)))
        return F.when(F.size(bound) > 0, F.flatten(over(parts, state, block, f"array<{kind}>")["out"])).otherwise(F.array().cast(kind))

    return F.get(F.transform(F.array(items), whole), F.lit(0))


def _spans(text: Column, pattern: str, kind: str, group: int = 0, least: int = 0) -> Column:
    """(start, end, kind, match) of each match, from what lies between matches: the pieces that split() leaves, one more than matches."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    matches = F.transform(whole, lambda m: F.struct(m.alias("m"), F.length(m).alias("n")))
    if group:
        matches = F.zip_with(whole, F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda m, g: F.struct(m.alias("m"), F.length(g).alias("n")))

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        lo = at + F.length(x["gap"])
        hi = (lo + F.coalesce(F.length(x["m"]["m"]), F.lit(0))).cast("bigint")
        span = F.struct(lo.cast("bigint").alias("start"), hi.alias("end"), F.lit(kind).alias("kind"), x["m"]["m"].alias("match"))
        return hi, F.when(x["m"]["n"] >= least, F.array(span)).otherwise(F.array().cast(_NONE))

    return _scanned(F.zip_with(F.split(text, pattern), matches, lambda gap, m: F.struct(gap.alias("gap"), m.alias("m"))), _NONE, F.lit(0).cast("bigint"), step)


def pattern_spans(text: Column) -> list[Column]:
    """A column of spans for each kind; a cheap test keeps the patterns from texts that can't match."""
    low = F.lower(text)
    none = F.array().cast(_NONE)
    words = [F.contains(low, F.lit(w)) for w in ("passw", "secret", "token", "api")]
    hint = {"assign": words[0] | words[1] | words[2] | words[3], "access": F.contains(text, F.lit("AKIA")), "hex": text.rlike(_FOUND["hex"])}
    return [F.when(hint[kind], _spans(text, _FOUND.get(kind, pattern), kind, group, least)).otherwise(none) for kind, pattern, group, least in KINDS]


# ---------------------------------------------------------------- the battery


def _normal_tail(z: Column) -> Column:
    """P(|Z| >= z) for a normal Z and z >= 0 (Abramowitz and Stegun 7.1.26: error below 2e-7)."""
    x = z / F.lit(2.0**0.5)
    t = 1 / (1 + 0.3275911 * x)
    poly = ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t
    return F.least(F.lit(1.0), F.greatest(F.lit(1e-12), poly * F.exp(-x * x)))


def battery(token: str = "token") -> dict[str, Column]:
    """Columns over a token of a candidate: encoding, cells of its alphabet, and the combined p-value of the three tests; to be added one after another."""
    t = F.col(token)
    encoding = F.when(t.rlike("^([0-9a-f]+|[0-9A-F]+)$"), "hex").when(t.rlike("^[A-Z2-7]+=*$"), "base32").when(t.rlike("[+/=_-]"), "base64").otherwise("alnum")
    cells = F.when(F.col("encoding") == "hex", 16).when(F.col("encoding") == "base32", 32).when(F.col("encoding") == "base64", 64).otherwise(62)
    alphabet = F.when(F.col("encoding") == "hex", F.lit("0123456789abcdef")).when(F.col("encoding") == "base32", F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")).otherwise(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"))
    plain = F.translate(F.rtrim(t, F.lit("=")), "-_", "+/")
    plain = F.when(F.col("encoding") == "hex", F.lower(plain)).otherwise(plain)
    # characters as numbers of the alphabet, from 0
    numbers = F.expr("transform(filter(split(plain, ''), c -> c <> ''), c -> cast(locate(c, alphabet) - 1 as double))")
    counts = F.expr("aggregate(array_distinct(v), 0D, (s, x) -> s + pow(size(filter(v, y -> y = x)), 2))")
    n = F.size("v").cast("double")
    chi = F.greatest(F.lit(0.0), F.col("cells") / n * F.col("squares") - n)
    df = (F.col("cells") - 1).cast("double")
    # Wilson-Hilferty: the cube root of chi-squared over its degrees is nearly normal
    z1 = (F.pow(chi / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
    one_sided = F.when(z1 > 0, _normal_tail(F.abs(z1)) / 2).otherwise(1 - _normal_tail(F.abs(z1)) / 2)
    above = F.expr("cast(size(filter(v, x -> x >= cells / 2)) as double)")
    runs = F.expr("cast(1 + size(filter(sequence(1, greatest(size(v) - 1, 1)), i -> size(v) > 1 and (v[least(i, size(v) - 1)] >= cells / 2) <> (v[i - 1] >= cells / 2))) as double)")
    mean = 2 * F.col("above") * (n - F.col("above")) / n + 1
    spread = (mean - 1) * (mean - 2) / F.greatest(n - 1, F.lit(1.0))
    z2 = F.when(spread > 0, F.abs(F.col("runs") - mean) / F.sqrt(spread)).otherwise(F.sqrt(n))
    centre = F.expr("aggregate(v, 0D, (s, x) -> s + x) / size(v)")
    square = F.expr("aggregate(v, 0D, (s, x) -> s + (x - centre) * (x - centre))")
    cross = F.expr("aggregate(sequence(1, greatest(size(v) - 1, 1)), 0D, (s, i) -> s + (v[least(i, size(v) - 1)] - centre) * (v[i - 1] - centre))")
    z3 = F.when(F.col("square") > 0, F.abs(F.col("cross") / F.col("square")) * F.sqrt(n)).otherwise(F.sqrt(n))
    # Fisher: -2 sum ln p is chi-squared with 6 degrees; its tail is exp(-x/2) (1 + x/2 + x*x/8)
    x = -2 * (F.log("p_uniform") + F.log("p_runs") + F.log("p_serial"))
    fisher = F.exp(-F.col("fisher") / 2) * (1 + F.col("fisher") / 2 + F.col("fisher") * F.col("fisher") / 8)
    return {
        "encoding": encoding, "cells": cells, "alphabet": alphabet, "plain": plain, "v": numbers, "squares": counts, "p_uniform": F.greatest(one_sided, F.lit(1e-12)), "above": above, "runs": runs, "p_runs": _normal_tail(z2), "centre": centre,
        "square": square, "cross": cross, "p_serial": _normal_tail(z3), "fisher": x, "p": F.least(F.lit(1.0), F.greatest(F.lit(1e-12), fisher)),
    }


def candidate_spans(text: Column, base: Column) -> Column:
    """Candidates that lie in no span of a fixed form: of all spans by their starts, those that the farthest end of fixed forms before them doesn't reach."""
    found = F.when(text.rlike(CANDIDATE), _spans(text, CANDIDATE, "random")).otherwise(F.array().cast(_NONE))
    fixed = F.transform(base, lambda b: F.struct(b["start"].alias("start"), F.lit(0).alias("own"), b["end"].alias("end"), F.lit(None).cast("string").alias("match")))
    both = F.array_sort(F.concat(fixed, F.transform(found, lambda c: F.struct(c["start"].alias("start"), F.lit(1).alias("own"), c["end"].alias("end"), c["match"].alias("match")))))

    def step(reach: Column, x: Column) -> tuple[Column, Column]:
        span = F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit("random").alias("kind"), x["match"].alias("match"))
        return F.when(x["own"] == 0, F.greatest(reach, x["end"])).otherwise(reach), F.when((x["own"] == 1) & (reach < x["end"]), F.array(span)).otherwise(F.array().cast(_NONE))

    return F.when(F.size(found) > 0, _scanned(both, _NONE, F.lit(-1).cast("bigint"), step)).otherwise(F.array().cast(_NONE))


def text_pieces(text: Column) -> Column:
    """Pieces of a text as identifiers: a stretch of words at a hashed place in each PIECE characters, joined by one of JOINTS, at a hashed length of some class."""

    def piece(i: Column) -> Column:
        draw = F.pmod(F.xxhash64(text, i), F.lit(1 << 20))
        low = F.element_at(F.array(*map(F.lit, CLASSES)), (F.pmod(draw, F.lit(len(CLASSES))) + 1).cast("int"))
        size = low + F.pmod(F.floor(draw / 16), F.floor(low / 2))
        room = F.least(F.lit(PIECE // 2), F.length(text) - i * PIECE - 2 * size)
        at = i * PIECE + F.pmod(F.floor(draw / 64), F.greatest(room, F.lit(1)))
        sign = F.element_at(F.array(*map(F.lit, JOINTS)), (F.pmod(F.floor(draw / 4), F.lit(len(JOINTS))) + 1).cast("int"))
        words = F.regexp_replace(F.substring(text, (at + 1).cast("int"), 2 * size.cast("int")), F.lit("[^A-Za-z0-9]+"), sign)
        return F.when(F.length(words) >= size, F.substring(words, F.lit(1), size.cast("int")))

    return F.filter(F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / PIECE).cast("int")), piece), lambda p: p.isNotNull())


def _measured(tokens: DataFrame) -> DataFrame:
    """(token, ...) with its class of lengths and its step of log p."""
    for name, column in battery().items():
        tokens = tokens.withColumn(name, column)
    n = F.length("token")
    klass = F.lit(0)
    for k, least in enumerate(CLASSES):
        klass = F.when(n >= least, k).otherwise(klass)
    return tokens.withColumns({"class": klass, "step": F.floor(F.log10("p") * (GRID / 12))})


def cuts(pieces: DataFrame, tested: DataFrame) -> DataFrame:
    """Of measured pieces of text and distinct candidates: by class the least step that is reported (from_step), by the step-up over their evidence among steps that look random."""
    # classes x GRID rows at most
    text = pieces.groupBy("class", "step").agg(F.count(F.lit(1)).alias("texts")).withColumn("tokens", F.lit(0).cast("bigint"))
    asked = tested.groupBy("class", "step").agg(F.count(F.lit(1)).alias("tokens")).withColumn("texts", F.lit(0).cast("bigint"))
    counts = text.unionByName(asked).groupBy("class", "step").agg(F.sum("texts").alias("texts"), F.sum("tokens").alias("tokens"))
    whole = Window.partitionBy("class")
    above = whole.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)
    evidence = (1 + F.sum("texts").over(above)) / (1 + F.sum("texts").over(whole))
    holds = evidence * F.sum("tokens").over(whole) <= FDR * F.sum("tokens").over(above)
    looks_random = F.col("step") >= F.floor(F.log10(F.lit(LEVEL)) * (GRID / 12))
    return counts.withColumn("holds", holds).where(looks_random & F.expr("holds and tokens > 0")).groupBy("class").agg(F.min("step").alias("from_step"))


def random_spans(candidates: DataFrame, pieces: DataFrame) -> DataFrame:
    """Of candidates (row..., match): those that the step-up reports against pieces (token) of text."""
    mixed = F.col("token").rlike("[0-9]") & F.col("token").rlike("[A-Za-z]")
    tested = common.written(_measured(candidates.select(F.col("match").alias("token")).distinct()).select("token", "class", "step", mixed.alias("mixed")), "tested")
    cut = cuts(_measured(pieces.select("token")), tested)
    judged = tested.where("mixed").join(F.broadcast(cut), "class").where("step >= from_step").select(F.col("token").alias("match"))
    return common.split_join(candidates, judged, ["match"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans for every row: array of (start, order, end, kind) sorted so, order being the kind's place in KINDS, and the last for the battery's kind, random."""
    text = F.col("text")
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def ordered(spans: Column, order: int) -> Column:
        return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(order).alias("order"), x["end"].alias("end"), x["kind"].alias("kind")))

    base = F.concat(*[ordered(s, i) for i, s in enumerate(pattern_spans(text))])
    found = texts.select("doc_id", F.xxhash64("text").alias("copy"), base.alias("base"), text_pieces(text).alias("pieces"), text.alias("text"))
    found = common.written(found.select("doc_id", "copy", "base", "pieces", candidate_spans(text, F.col("base")).alias("candidates")), "spans")
    # equal rows have equal candidates; they are judged once
    candidates = found.where(F.size("candidates") > 0).select("doc_id", "copy", F.explode("candidates").alias("c")).select("doc_id", "copy", "c.start", "c.end", "c.match").distinct()
    random = random_spans(candidates, found.select(F.explode("pieces").alias("token")))
    random = random.groupBy("doc_id", "copy").agg(F.collect_list(F.struct("start", F.lit(len(KINDS)).alias("order"), "end", F.lit("random").alias("kind"))).alias("random"))
    random = random.select(F.col("doc_id").alias("_id"), F.col("copy").alias("_copy"), "random")
    both = found.select("doc_id", "copy", "base").join(random, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("copy") == F.col("_copy")), "left")
    return both.select("doc_id", F.array_sort(F.when(F.col("random").isNull(), F.col("base")).otherwise(F.concat("base", "random"))).alias("spans"))
