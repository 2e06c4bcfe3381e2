"""The queries opN_<name>: each applies its operator with production parameters to the whole table, and derives the columns that are asked for."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, common, exact, gif, langid, licenses, lines, lm, minhash, mixing, periodic, secrets, toxicity, trie


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    return common.documents(spark, sf_dir)


def _remainder(n: int) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(documents(spark, sf_dir))
    starts = F.transform("places", lambda p: p["start"])
    base, own = F.transform("places", lambda p: p["label"]), F.transform("met", lambda m: m["label"])
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    best = F.coalesce(F.array_max(F.transform("met", lambda m: m["containment"])), F.lit(0.0))
    return found.select(
        "doc_id", "n_words", F.size("places").cast("bigint").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, own)).alias("labels"), F.when(F.size("places") > 0, F.lit(1.0)).otherwise(best).alias("score"),
    )


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir), width=4, percent=80)


_MEDIA = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def _media_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each file, from its frames, which follow one another."""
    types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
    names = [c.split()[0] for c in _MEDIA.split(", ")]
    file = done = None

    def closed() -> tuple:
        bins = ",".join(f"{i}:{k}" for i, k in enumerate(file["bins"]) if k)
        feature = f"frames={file['frames']};own={file['own']};ms={file['ms']};{bins}"
        return (file["id"], file["n_bytes"], file["size"], file["sha"].hexdigest(), zlib.crc32(file["tail"]), file["media_bytes"], file["media_sha256"], feature)

    for b in batches:
        done = []
        for i, frame, start, delay, own, histogram, pixels, n_bytes, media_bytes, media_sha256 in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if frame == 0:
                if file:
                    done.append(closed())
                file = {"id": i, "n_bytes": n_bytes, "media_bytes": media_bytes, "media_sha256": media_sha256, "sha": hashlib.sha256(), "size": 0, "frames": 0, "own": 0, "bins": np.zeros(gif.BINS, np.int64)}
            file["sha"].update(pixels)
            file |= {"size": file["size"] + len(pixels), "tail": pixels[-16:], "frames": frame + 1, "own": file["own"] + (own is not None), "ms": start + delay, "bins": file["bins"] + np.array(histogram)}
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], t) for i, t in enumerate(types)], names)
    if file:
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(closed(), types, strict=True)], names)


def op3_media_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = gif.texts_as_media(documents(spark, sf_dir)).withColumns({"media_bytes": F.length("media").cast("bigint"), "media_sha256": F.sha2("media", 256)})
    kept = ("n_bytes", "media_bytes", "media_sha256")
    frames = gif.frames(media, also=kept, grey=True)
    return frames.select("id", "frame", "start_ms", "delay_ms", "own_palette", "histogram", "pixels", *kept).mapInArrow(_media_digests, _MEDIA)


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(documents(spark, sf_dir))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["order"] < len(secrets.KINDS))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == F.lit(kind))).cast("bigint").alias(f"n_{kind}")

    counts = [count(kind) for kind, *_ in secrets.KINDS]
    return found.select("doc_id", *counts, F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text("spans").alias("spans"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels.where(_remainder(5) != 0))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (_remainder(5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def bpe_digests(docs: DataFrame, path: str) -> DataFrame:
    coded = bpe.round_trip(docs, path)
    return coded.select("doc_id", (F.length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(documents(spark, sf_dir), str(public_tokenizers.path("byte_bpe_50k.json")))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = lines.dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return done.select("doc_id", F.col("_n_lines").cast("bigint").alias("n_lines"), F.col("_n_exact").cast("bigint").alias("n_exact"), F.col("_n_near").cast("bigint").alias("n_near"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    net = langid.train(docs.where(_remainder(4) != 2))
    return langid.identify(docs, net).select("doc_id", (_remainder(4) == 2).alias("held_out"), "lang_pred", "score")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(documents(spark, sf_dir))


def planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text, where in the texts of a tenth of the ids each word from a hashed place on is replaced by the one a period or more before: the input of op11."""
    text = F.coalesce("text", F.lit(""))
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def periodic_text(w: Column) -> Column:
        n = F.size(w).cast("bigint")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        again = F.array_repeat(F.slice(w, (a + 1).cast("int"), p.cast("int")), F.ceil((n - a) / p).cast("int"))
        return F.when(n > 0, F.array_join(F.concat(F.slice(w, F.lit(1), a.cast("int")), F.slice(F.flatten(again), F.lit(1), (n - a).cast("int"))), " ")).otherwise("")

    # the words are bound once, as the element of an array
    words = F.array(F.array_remove(F.split(text, common.SPACE), ""))
    return docs.select("doc_id", F.when(h % 10 == 0, F.get(F.transform(words, periodic_text), F.lit(0))).otherwise(text).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(planted_runs(documents(spark, sf_dir)))
    lines_of_runs = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    # the greatest length, then the smallest start, then the smallest period
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    found = found.withColumn("best", best)
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), F.col("best.start").alias("start"), (-F.col("best.less")).alias("length"), F.col("best.period").alias("period"),
        F.floor(-1000 * F.col("best.less") / F.col("best.period")).alias("exponent_milli"), F.sha2(F.when(F.size("runs") > 0, F.concat(lines_of_runs, F.lit("\n"))).otherwise("").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def rebuilt_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns and conversations of the input of op12, as trie.prefixes() takes them: each conversation's first h turns are those of the first one of its hundred."""
    turns = common.written(trie.numbered(conversations), "numbered")
    own = turns.where("place = 0").select("conv", "total")
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % 6
    sizes = own.withColumns({"h": h, "base": F.col("conv") - F.col("conv") % 100}).join(own.select(F.col("conv").alias("base"), F.col("total").alias("n_base")), "base", "left")
    head = F.least(F.col("h"), F.coalesce("n_base", F.lit(0).cast("bigint")))
    sizes = common.written(sizes.select("conv", "base", "h", head.alias("head"), (head + F.greatest(F.col("total") - F.col("h"), F.lit(0))).alias("total")), "sizes")
    later = common.split_join(turns.drop("total").where(F.col("place") >= h), sizes, ["conv"])
    later = later.select("conv", (F.col("head") + F.col("place") - F.col("h")).alias("place"), "total", "role", "text")
    first = turns.where((F.col("conv") % 100 == 0) & (F.col("place") < 6)).select(F.col("conv").alias("base"), "place", "role", "text").join(sizes, "base").where("place < h")
    return later.unionByName(first.select("conv", "place", "total", "role", "text")), sizes.select("conv", "total")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    turns, conversations = rebuilt_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return trie.trie_nodes(trie.prefixes(turns, conversations))


def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = F.coalesce(_remainder(7) == 2, F.lit(False))
    model, counts = lm.train(docs.where(~held_out))
    scored = lm.score(docs, model, counts)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("bigint").alias("train_tokens"), "base_score", "score")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_license_scan, op2_minhash_near_dedup, op3_media_gif, op4_source_mixing, op5_secret_scan, op6_toxicity, op7_bpe, op8_line_dedup, op9_language_id, op10_exact_dedup, op11_periodic_runs, op12_prefix_trie, op13_lm_scoring)
    return {f.__name__: f for f in found}


# ---------------------------------------------------------------- the same in SQL, where SQL can express it


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _list(words: list[str]) -> str:
    return "[" + ", ".join(map(_text, words)) + "]"


def _license_sql() -> str:
    capitals = "".join(map(chr, range(65, 91)))
    base = ", ".join(f"({_text(label)}, {_list(licenses.split_words(t))})" for t, label in licenses.PHRASES)
    rows, step = [], licenses.step_of()
    for t, label, must in licenses.TEMPLATES:
        words = sorted(set(licenses.split_words(t)))
        rows.append(f"({_text(label)}, {_list(words)}, {ceil(licenses.CONTAINMENT * len(words) - 1e-9)}, {_list([f' {m} ' for m in must])})")
    return f"""
with w as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{capitals}', '{capitals.lower()}'), '{licenses.SEPARATOR}'), lambda x: x <> '') as w from documents),
phrase(label, seq) as (values {base}),
template(label, words, need, must) as (values {", ".join(rows)}),
place as (select doc_id, label, s from (select doc_id, w, unnest(range(len(w))) as s from w) p, phrase where p.w[s + 1] = seq[1] and p.w[s + 1 : s + len(seq)] = seq),
block as (select doc_id, w[s + 1 : s + {2 * step}] as b from (select doc_id, w, unnest(range(0, len(w), {step})) as s from w)),
met as (select distinct doc_id, label, len(list_intersect(list_distinct(b), words))::double / len(words) as c from block, template
  where len(list_intersect(list_distinct(b), words)) >= need and len(list_filter(must, lambda m: not contains(' ' || array_to_string(b, ' ') || ' ', m))) = 0),
p as (select doc_id, count(*) as n, min(s) as lo, max(s) as hi, list(distinct label) as labels from place group by doc_id),
m as (select doc_id, max(c) as c, list(distinct label) as labels from met group by doc_id)
select w.doc_id, len(w.w)::bigint as n_words, coalesce(p.n, 0)::bigint as n_base, p.lo::bigint as first_word, p.hi::bigint as last_word,
  array_to_string(list_sort(coalesce(p.labels, [])), ',') as base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(p.labels, []), coalesce(m.labels, [])))), ',') as labels,
  case when p.n > 0 then 1.0::double else coalesce(m.c, 0.0::double) end as score
from w left join p using (doc_id) left join m using (doc_id)"""


_NEAR_SQL = r"""
with recursive w as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
s as (select distinct doc_id, array_to_string(w[i : i + 3], chr(31)) as sh from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) as i from w where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
pair as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.sh = b.sh and a.doc_id < b.doc_id group by 1, 2),
link as (select a, b from pair join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 80 * (x.n + y.n - k)),
edge as (select a, b from link union all select b, a from link),
reach as (select doc_id, doc_id as r from w union select reach.doc_id, edge.b from reach join edge on edge.a = reach.r)
select w.doc_id, coalesce(n.n, 0)::bigint as n_shingles, c.component_id, w.doc_id = c.component_id as kept
from w left join n using (doc_id) join (select doc_id, min(r) as component_id from reach group by doc_id) c using (doc_id)"""

_EXACT_SQL = """
select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size, row_number() over (partition by coalesce(text, '') order by doc_id desc) = 1 as kept, sha256(coalesce(text, '')) as text_sha256
from documents window g as (partition by coalesce(text, ''))"""

_TRIE_SQL = """
with t as (select conv_id as c, {'role': coalesce(role, ''), 'text': coalesce(text, '')} as x, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as k from conversations where conv_id is not null),
o as (select c, list(x order by k) as s from t group by c),
hashed as (select c, s, c - c % 100 as base, xor(list_reduce(list_transform(string_split(c::varchar, ''), lambda x: ascii(x)::ubigint), lambda crc, b:
  list_reduce(range(8)::ubigint[], lambda a, i: case when a % 2 = 1 then xor(a >> 1, 3988292384::ubigint) else a >> 1 end, xor(crc, b)), 4294967295::ubigint), 4294967295::ubigint)::bigint % 6 as h from o),
r as (select a.c, list_concat(coalesce(b.s, [])[1 : a.h], a.s[a.h + 1 :]) as s from hashed a left join o b on b.c = a.base),
m as (select c, d, s[1 : d] as p, len(s) = d as ends, coalesce(length(s[d].text), 0) as size from (select c, s, unnest(range(0, len(s) + 1)) as d from r)),
node as (select p, d, min(c) as conv_id, count(*) as n, any_value(size) as size, sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (ends), '')) as ends from m group by p, d),
child as (select p[1 : d - 1] as p, d - 1 as d, count(*) as n from node where d > 0 group by 1, 2),
leaf as (select node.*, coalesce(child.n, 0) as n_children from node left join child using (p, d)),
up as (select p[1 : a] as p, a as d, sum(case when n_children = 0 then 1 else 0 end) as n_leaves, sum((n - 1) * size) as saved from (select *, unnest(range(0, d + 1)) as a from leaf) group by 1, 2)
select leaf.conv_id, leaf.d as depth, parent.conv_id as parent_conv_id, leaf.n as n_convs, leaf.n_children, up.n_leaves::bigint as n_leaves, up.saved::bigint as saved_tokens, leaf.ends as ends_sha256
from leaf join up using (p, d) left join node parent on parent.d = leaf.d - 1 and parent.p = leaf.p[1 : leaf.d - 1]"""


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": _license_sql(), "op2_minhash_near_dedup": _NEAR_SQL, "op10_exact_dedup": _EXACT_SQL, "op12_prefix_trie": _TRIE_SQL}
