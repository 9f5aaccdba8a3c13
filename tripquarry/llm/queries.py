"""Registered queries of the training-data operators, and their SQL where SQL can state them.

Each callable takes (spark, folder) and applies its operator, with production parameters, to the
whole of its tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, chat_format, decontaminate, license_scan, lm_scoring, near_dedup, quality_knn, quality_rules, token_counts, toxicity
from .labelled import held_out


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    marked = decontaminate.mark_contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"), keep=["doc_id"])
    return marked.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op2_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = quality_knn.fit_quality(docs, table(spark, folder, "labels"))
    return quality_knn.score_quality(docs, model, keep=["doc_id"]).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.fit_toxicity(docs, table(spark, folder, "labels"))
    return toxicity.score_toxicity(docs, model, keep=["doc_id"]).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "terms")


def op4_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    trial = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", trial), (-1, 1, "assistant", trial)], turns.schema)
    return chat_format.read_back(chat_format.format_chats(turns.unionByName(extra)))


def tokenizer() -> byte_bpe.Tokenizer:
    return byte_bpe.Tokenizer.from_tiktoken(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op5_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return byte_bpe.encode(docs, tokenizer(), outputs=("n_tokens", "ids_sha256", "decoded_sha256"), keep=["doc_id"])


def op6_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each document with the id of its class."""
    return near_dedup.near_classes(table(spark, folder, "documents")).select("doc_id", "class_id")


def op7_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of each text, attributed to its lines."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    counted = token_counts.count_section_tokens(docs, tokenizer(), rule="most", keep=["doc_id"])
    per_line = F.transform("section_tokens", lambda x: x.cast("long").cast("string"))
    return counted.select(
        "doc_id",
        "n_tokens",
        "n_crossing",
        F.size("section_tokens").cast("long").alias("n_sections"),
        F.array_max("section_tokens").cast("long").alias("most_tokens"),
        F.sha2(F.array_join(per_line, ","), 256).alias("section_tokens_sha256"),
    )


def op8_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality_rules.quality_rules(table(spark, folder, "documents"), keep=["doc_id"])
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_upper", "p_good")


def op9_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = license_scan.scan_licenses(table(spark, folder, "documents").select("doc_id", "text"), keep=["doc_id"])
    m = F.col("matches")
    return found.select(
        "doc_id",
        F.size(m).cast("long").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct(m["license"])), ",").alias("licenses"),
        F.round(F.coalesce(F.array_max(m["coverage"]), F.lit(0.0)), 6).alias("best_coverage"),
        F.array_join(F.transform(m, lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string"))), ",").alias("spans"),
    )


def op10_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return lm_scoring.lm_scores(table(spark, folder, "documents").select("doc_id", "text"), keep=["doc_id"])


def quality_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """The base columns of operator 8, which SQL can state."""
    stats = quality_rules.with_statistics(table(spark, folder, "documents").select("doc_id", "text"))
    return stats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", quality_rules.base_failed().alias("base_failed"))


def chat_typed_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Operator 4 on typed parts: by the turn's number, an image, an audio clip, or a document and
    a part of an unknown type stand beside the text of the conversation's turn."""
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    none = {f.name: F.lit(None).cast(f.dataType) for f in chat_format.PART}
    part = lambda **x: F.struct(*((x[f.name].cast(f.dataType) if f.name in x else none[f.name]).alias(f.name) for f in chat_format.PART))
    number, ref = F.col("turn").cast("double"), F.concat(F.lit("ref"), F.col("turn").cast("string"))
    text = part(type=F.lit("text"), text=F.col("text"))
    image = part(type=F.lit("image"), ref=ref, width=(number + 1) * 100, height=F.lit(50.0))
    audio = part(type=F.lit("audio"), ref=ref, seconds=number * 1.5)
    document, other = part(type=F.lit("document"), ref=ref, pages=number), part(type=F.lit("video"), ref=ref)
    kind = F.col("turn") % 4
    parts = F.when(kind == 1, F.array(image, text)).when(kind == 2, F.array(text, audio)).when(kind == 3, F.array(document, other, text)).otherwise(F.array(text))
    chats = chat_format.format_chats(turns.withColumn("parts", parts), parts_col="parts")
    told = F.transform("attachments", lambda a: F.concat_ws(":", a["turn"].cast("string"), a["kind"], a["number"].cast("string"), a["ref"], a["tokens"].cast("string")))
    return chats.select(
        "conv_id",
        "n_turns",
        F.size("attachments").cast("long").alias("n_attachments"),
        "attachment_tokens",
        F.sha2(F.array_join(told, ","), 256).alias("attachments_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_decontamination,
        op2_quality_classifier,
        op3_toxicity,
        op4_chat_format,
        op5_byte_bpe,
        op6_near_dedup,
        op7_token_counts,
        op8_quality_rules,
        op9_license_scan,
        op10_lm_scoring,
        quality_statistics,
        chat_typed_parts,
    )
}

OP1_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS win FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT r, k, i, array_to_string(w[i : i + k - 1], ' ') AS win FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
hits AS (SELECT DISTINCT dw.r, dw.i, dw.k, bw.item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.win = bw.win),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM hits) GROUP BY r),
items AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hits GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""

OP4_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, role AS r, text AS x, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]', 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]', 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, len(regexp_extract_all(role || chr(10) || text, '\\|<[|]|</?s>|\[/?INST\]|<</?SYS>>')) AS n_escapes FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r NULLS FIRST, x NULLS FIRST)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, r NULLS FIRST, x NULLS FIRST)) AS loss_sha256,
  CAST(sum(length('<|turn|><|says|><|end|>') + 1 + length(role) + length(text) + n_escapes) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

QUALITY_STATISTICS_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
windows AS (SELECT r, i, array_to_string(w[i : i + 2], ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS c FROM windows) WHERE c > 1),
covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 3)) AS p FROM twice) GROUP BY r),
lines AS (SELECT r, count(*) - count(DISTINCT l) AS n FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r),
s AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(coalesce(lines.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN lines USING (r) LEFT JOIN covered USING (r))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s
"""

CHAT_TYPED_PARTS_SQL = r"""
WITH t AS (SELECT conv_id, turn, turn % 4 AS k, 'ref' || CAST(turn AS VARCHAR) AS ref, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1 AS place FROM conversations),
e AS (SELECT *, CASE WHEN k IN (1, 2) THEN 1 WHEN k = 3 THEN 2 ELSE 0 END AS n, len(regexp_extract_all(role || chr(10) || text, '\\|<[|]|</?s>|\[/?INST\]|<</?SYS>>')) AS n_escapes FROM t),
b AS (SELECT *, CAST(sum(n) OVER (PARTITION BY conv_id ORDER BY place) - n AS BIGINT) AS was FROM e),
a AS (
  SELECT conv_id, place, was AS number, CASE k WHEN 1 THEN 'image' WHEN 2 THEN 'audio' ELSE 'document' END AS kind, ref,
    CAST(CASE k WHEN 1 THEN ceil((turn + 1) * 100 / 28.0) * 2 WHEN 2 THEN ceil(turn * 1.5 * 25) ELSE turn * 512 END AS BIGINT) AS tokens FROM b WHERE n > 0
  UNION ALL SELECT conv_id, place, was + 1, 'unknown', ref, 256 FROM b WHERE n = 2),
g AS (SELECT conv_id, count(*) AS n_attachments, CAST(sum(tokens) AS BIGINT) AS attachment_tokens, CAST(sum(length('<|' || kind || ':' || CAST(number AS VARCHAR) || '|>')) AS BIGINT) AS chars,
    string_agg(CAST(place AS VARCHAR) || ':' || kind || ':' || CAST(number AS VARCHAR) || ':' || ref || ':' || CAST(tokens AS VARCHAR), ',' ORDER BY number) AS told FROM a GROUP BY conv_id),
f AS (SELECT conv_id, count(*) AS n_turns, CAST(sum(length('<|turn|><|says|><|end|>') + 1 + length(role) + length(text) + n_escapes) AS BIGINT) AS chars FROM e GROUP BY conv_id)
SELECT f.conv_id, n_turns, CAST(coalesce(n_attachments, 0) AS BIGINT) AS n_attachments, coalesce(attachment_tokens, 0) AS attachment_tokens, sha256(coalesce(told, '')) AS attachments_sha256, CAST(f.chars + coalesce(g.chars, 0) AS BIGINT) AS formatted_chars
FROM f LEFT JOIN g ON f.conv_id IS NOT DISTINCT FROM g.conv_id
"""

ORACLE_SQL = {"op1_decontamination": OP1_SQL, "op4_chat_format": OP4_SQL, "quality_statistics": QUALITY_STATISTICS_SQL, "chat_typed_parts": CHAT_TYPED_PARTS_SQL}
