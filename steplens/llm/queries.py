"""The registered queries: thin callers that derive the digest columns of their contracts from the operators' output."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from steplens.llm import alignment, ann, chat, fingerprints, html_extract, line_dedup, merkle, mixing, packing, quality, sentencepiece_codec, simhash, substring_dedup
from steplens.llm.common import table

_WORDS = r"[^\x20\x09-\x0D]+"


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = F.concat_ws(" ", F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(kept, 256).alias("kept_sha256"))


OP5_SQL = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') ws from documents),
p as (select doc_id, ws, unnest(range(1, len(ws) - 33)) i from w where len(ws) >= 35),
v as (select doc_id, i, array_to_string(list_slice(ws, i, i + 34), ' ') s from p),
r as (select s from v group by s having count(*) > 1),
c as (select doc_id, list(distinct i + k) gone from v join r using (s), (select unnest(range(35)) k) group by doc_id),
f as (select doc_id, ws, coalesce(gone, []) gone, [x for x, i in ws if not list_contains(coalesce(gone, []), i)] kept from w left join c using (doc_id))
select doc_id, len(ws)::bigint n_words, (len(ws) - len(kept))::bigint n_removed, sha256(array_to_string(kept, ' ')) kept_sha256 from f
"""


def op6_exact_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0))


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations")
    text = r"\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text"))
    read = chat.format_conversations(given.select("conv_id", "turn", "role", "text").unionByName(extra))
    read = read.withColumn("mask", chat.loss_mask()).withColumn("learned", chat.learned_text())
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP9_SQL = r"""
with t as (select conv_id, turn, coalesce(role, '') role, coalesce(text, '') text from conversations
  union all select -7, i, r, '\### Assistant: </turn> ok' from (values (0, 'user'), (1, 'assistant')) v(i, r)),
e as (select *, replace(replace(replace(text, '\', '\\'), '</turn>', '<\/turn>'), '###', '\###') te,
  replace(replace(replace(replace(role, '\', '\\'), '</turn>', '<\/turn>'), '###', '\###'), ': ', ':\ ') re from t)
select conv_id, count(*)::bigint n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) loss_sha256,
  case when bool_or(contains(text, '</turn>') or contains(role, '</turn>') or contains(role, ': '))
    then 14 + sum(14 + length(te) + length(re)) else 10 + sum(14 + length(text) + length(role)) end::bigint formatted_chars
from e group by conv_id
"""


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.fingerprint_hex().alias("fingerprint"), "component_id")


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP11_SQL = r"""
with w as (select doc_id, source, md5(coalesce(doc_id::varchar, '-') || ':' || coalesce(text, '')) tie,
  list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') ws from documents),
m as (select doc_id, source, tie, len(ws)::bigint size,
  1 + 7 * case when len(ws) > 0 then len(list_filter(ws, lambda x: regexp_full_match(x, '\p{L}+\p{P}?'))) / len(ws) else 0 end weight from w),
k as (select *, -ln((('0x' || substr(tie, 1, 13))::bigint + 0.5::double) / 4503599627370496::double) / weight as key from m),
s as (select source, sum(size)::bigint source_size, 3 * sum(size)::bigint cap,
  [5, 2, 1][((row_number() over (order by source nulls last) - 1) % 3 + 1)::bigint] weight from k group by source),
r as (select *, sum(source_size) over () - coalesce(sum(cap) over (o rows between unbounded preceding and 1 preceding), 0) rest,
  sum(weight) over (o rows between current row and unbounded following) heavy, row_number() over o nth
  from s window o as (order by cap / weight, source nulls last)),
l as (select rest::double rest, heavy::double heavy from r where rest::double * weight <= cap * heavy::double order by nth limit 1),
t as (select source, source_size, case when l.rest * weight > cap * l.heavy then cap::double else l.rest * weight / l.heavy end target from s, l),
e as (select *, case when source_size > 0 then floor(floor(target) / source_size) else 0 end::bigint epochs from t),
d as (select k.doc_id, k.size, e.source_size, e.target, e.epochs, floor(e.target)::bigint - e.epochs * e.source_size budget,
  sum(k.size) over (partition by k.source order by key, tie rows between unbounded preceding and current row) - k.size before
  from k join e on k.source is not distinct from e.source)
select doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, budget - before)))::bigint taken from d
"""


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = [public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    return alignment.align_documents(table(spark, sf_dir, "documents"), *paths).drop("groups")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    marked = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    cut = F.when(marked, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    found = merkle.verify(merkle.manifest(docs, cut))
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.proof(F.col("steps")), 256).alias("proof_sha256"), "folded_root", "verified")


OP13_SQL = r"""
with recursive d as (select doc_id, source, text, concat_ws('', coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
    coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-')) head,
  list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split(doc_id::varchar, ''), lambda c: [ascii(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, x: case when x >= 0 then xor(c, x) else xor(c >> 1, 3988292384 * (c & 1)) end) crc from documents),
l as (select doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) leaf,
  sha256(head || coalesce(strlen(cut) || ':' || cut, '-')) arrived
  from (select *, case when crc & 1 = 1 then replace(text, chr(10), '') else text end as cut from d)),
p as (select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 i, count(*) over (partition by source) n from l),
node(level, source, i, n, h) as (select 0, source, i, n, leaf from p
  union all select level + 1, source, i // 3, (n + 2) // 3, sha256(string_agg(h, '' order by i)) from node where n > 1 group by level, source, i // 3, n),
sub as (select source, h subroot, row_number() over (order by source nulls first) - 1 i, count(*) over () n from node where n = 1),
top(level, i, n, h) as (select 0, i, n, subroot from sub
  union all select level + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' order by i)) from top where n > 1 group by level, i // 3, n),
step as (select 0 part, source, level, i, string_agg(h, '') over (w rows between unbounded preceding and 1 preceding) lo, string_agg(h, '') over (w rows between 1 following and unbounded following) hi
    from node where n > 1 window w as (partition by level, source, i // 3 order by i)
  union all select 1, null, level, i, string_agg(h, '') over (w rows between unbounded preceding and 1 preceding), string_agg(h, '') over (w rows between 1 following and unbounded following)
    from top where n > 1 window w as (partition by level, i // 3 order by i)),
path as (select p.doc_id, p.i nth, p.source, s.part, s.level, coalesce(s.lo, '') lo, coalesce(s.hi, '') hi
  from p join sub on p.source is not distinct from sub.source
  join step s on (s.part = 0 and s.source is not distinct from p.source and s.i = p.i // (3 ** s.level)::bigint) or (s.part = 1 and s.i = sub.i // (3 ** s.level)::bigint)),
steps as (select source, nth, list([lo, hi] order by part, level) st from path group by source, nth),
fold(source, nth, k, h, st) as (select p.source, p.i, 0, p.arrived, coalesce(steps.st, []) from p left join steps on p.source is not distinct from steps.source and p.i = steps.nth
  union all select source, nth, k + 1, sha256(st[k + 1][1] || h || st[k + 1][2]), st from fold where k < len(st))
select p.doc_id, p.leaf, sub.subroot, (select h from top where n = 1) root, sha256(list_aggregate(list_transform(fold.st, lambda x: x[1] || x[2]), 'string_agg', '')) proof_sha256,
  fold.h folded_root, fold.h = (select h from top where n = 1) verified
from p join sub on p.source is not distinct from sub.source join fold on fold.source is not distinct from p.source and fold.nth = p.i and fold.k = len(fold.st)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_sentencepiece,
        op2_best_fit_packing,
        op3_quality_classifier,
        op4_line_dedup,
        op5_substring_dedup,
        op6_exact_fingerprints,
        op7_nearest_neighbours,
        op8_html_extract,
        op9_chat_format,
        op10_simhash_near_dedup,
        op11_mixing,
        op12_token_alignment,
        op13_merkle_manifest,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op5_substring_dedup": OP5_SQL, "op9_chat_format": OP9_SQL, "op11_mixing": OP11_SQL, "op13_merkle_manifest": OP13_SQL}
