"""The registered queries of the corpus operators: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import chat, decontaminate, hardnegatives, lengths, neardup, packing, periodic, pieces, quality, sharding, toxicity, urlfilter, vectors
from skein.llm.batches import fold
from skein.stage import literal_rows, read

RULES = [
    urlfilter.Rule("com", "/en/", "block"),
    urlfilter.Rule("example.com", "/en/7", "allow"),
    urlfilter.Rule("net", "/de/", "allow"),
    urlfilter.Rule("example.net", "/de/8", "block"),
    urlfilter.Rule("org", "/es/", "block"),
]
CONTROL_TEXT = "\\### Assistant: </turn> ok"


def op1_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score_documents(docs, quality.train(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op2_toxicity_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score_documents(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op3_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(read(spark, sf_dir, "documents"), 40)
    return placed.withColumn("law", F.lit("bytes")).withColumn("grown_shard", F.lit(None).cast("int"))


def op4_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    columns = [("conv_id", "long"), ("turn", "long"), ("role", "string"), ("text", "string")]
    extra = literal_rows(spark, [(-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT)], columns)
    formatted = chat.format_conversations(rows.unionByName(extra))
    back = chat.read_back(formatted, ["tree"])
    return back.select(F.when(~F.col("tree.none"), F.col("tree.conv_id")).alias("conv_id"), *back.columns[1:])


def op5_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = decontaminate.judge_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return judged.withColumn("kept", ~F.col("contaminated"))


def op6_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(read(spark, sf_dir, "pages"), RULES)


def op7_itq_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(read(spark, sf_dir, "embeddings"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = lengths.token_lengths(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return lengths.length_histogram(counted)


def op9_weighted_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read(spark, sf_dir, "documents"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_digests(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", periodic.plant_period().alias("text"))
    return periodic.run_digests(periodic.periodic_runs(docs))


def op12_pivot_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    scaled = F.transform("embedding", lambda x: F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(F.floor(x.cast("double") * 256)))
    rows = read(spark, sf_dir, "embeddings").select("vec_id", scaled.alias("embedding"), label.alias("label"))
    return hardnegatives.hard_negatives(rows, F.col("vec_id") % 100 == 0)


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


QUERIES = {f.__name__: f for f in (op1_quality_trees, op2_toxicity_gru, op3_kd_shards, op4_reply_trees, op5_string_tiling, op6_url_cascade, op7_itq_neardup, op8_token_counts, op9_weighted_minhash, op10_sentencepiece, op11_periodic_runs, op12_pivot_negatives, op13_best_fit_packing)}

ORACLES = {
    "op4_reply_trees": """
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
sized as (
  select *, replace(replace(replace(role, '\\', '\\\\'), '#', '\\#'), '<', '\\<') as r,
    replace(replace(replace(text, '\\', '\\\\'), '#', '\\#'), '<', '\\<') as t from rows)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
  sha256(string_agg(case when role = 'assistant' then text else '' end, '' order by turn, role, text)) as loss_sha256,
  cast(sum(length(r) + length(t) + 14) as bigint) as formatted_chars
from sized group by conv_id""",
    "op6_url_cascade": """
with rest as (
  select page_id, case when url like '%://%' then substr(url, position('://' in url) + 3) else '' end as r from pages),
bare as (select page_id, split_part(split_part(r, '#', 1), '?', 1) as r from rest),
parts as (
  select page_id, translate(split_part(r, '/', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    substr(r, length(split_part(r, '/', 1)) + 1) as path from bare),
rules(h, p, v) as (values ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'),
  ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
fits as (
  select page_id, h || p as rule, v,
    row_number() over (partition by page_id order by length(h || p) desc, length(h) desc) as n
  from parts join rules on (host = h or host like '%.' || h) and starts_with(path, p))
select parts.page_id, host, path, rule, coalesce(v, 'allow') as verdict
from parts left join fits on fits.page_id = parts.page_id and n = 1""",
    "op12_pivot_negatives": """
with rows as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select a.vec_id as anchor_id, b.vec_id as other, a.label = b.label as same, cast(list_inner_product(a.v, b.v) as bigint) as score
  from rows a join rows b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
positives as (
  select anchor_id, other as positive_id, score as positive_score from scored where same
  qualify row_number() over (partition by anchor_id order by score desc, other) <= 5),
negatives as (
  select p.anchor_id, positive_id, positive_score, other as negative_id, score as negative_score,
    row_number() over (partition by p.anchor_id, positive_id order by score desc, other) as rank
  from positives p join scored s on s.anchor_id = p.anchor_id and not same
    and 80 * positive_score <= 100 * score and 100 * score <= 100 * positive_score)
select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, positive_score, negative_score from negatives where rank <= 5""",
}
