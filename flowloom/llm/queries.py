"""Registered queries of the training-data operators and their check SQL."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm import (
    alignment, chat, decontamination, fim, language, minhash, mixing, mtree, neighbours, quality, substring, suffixes, webtext)

#: Folder of the public tokenizers' files; read by the driver only.
TOKENIZERS = "/opt/tokenizers"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reach(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reach(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package from where the driver found it."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def op1_nb_svm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    labels = _table(spark, sf_dir, "labels").where(~quality.held_out())
    scored = quality.classify(docs.select("doc_id", "text"), quality.train(docs, labels))
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score",
                         F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op2_entropy_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op3_debruijn_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring.remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_suffix_sorted_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffixes.remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"))


def op5_cross_parsing_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held = quality.held_out(3, 1)
    profile = language.learn(docs.where(~held))
    return language.predict(docs.select("doc_id", "text"), profile).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op6_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_event_sourced_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                  F.lit("</s>[INST] ok [/INST]").alias("text"))
    log = rows.unionByName(extra).select("*", F.col("turn").alias("seq"), F.lit("message").alias("kind"))
    back = chat.read_back(chat.render(chat.messages(log)))
    every = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    loss = F.concat_ws("", F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]))
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(every, 256).alias("turns_sha256"),
                       F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))


def op8_tree_scored_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return webtext.main_text(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op9_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size")


def op10_block_matrix_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(_table(spark, sf_dir, "embeddings"))


def op11_mtree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.nearest(_table(spark, sf_dir, "embeddings"))


def op12_wavelet_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.transform(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select("doc_id", "fim.n", "fim.form", "fim.prefix_chars", "fim.middle_chars", F.sha2("fim.output", 256).alias("output_sha256"),
                       F.sha2("fim.restored", 256).alias("restored_sha256"))


def op13_interval_alignment(spark: SparkSession, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    made = alignment.align(docs, f"{tokenizers}/byte_bpe_50k.json", f"{tokenizers}/piece_bpe_32k.model")
    return made.select("doc_id", *(f"aligned.{c}" for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")))


QUERIES = {f.__name__: f for f in (
    op1_nb_svm_quality, op2_entropy_mixing, op3_debruijn_substrings, op4_suffix_sorted_bytes, op5_cross_parsing_language, op6_template_decontamination,
    op7_event_sourced_chat, op8_tree_scored_pages, op9_bagminhash, op10_block_matrix_neighbours, op11_mtree_search, op12_wavelet_fim,
    op13_interval_alignment)}

_FINE = """vec_id IS NOT NULL AND len(embedding) > 0 AND list_bool_or([x <> 0 FOR x IN embedding])
  AND list_bool_and([x IS NOT NULL AND isfinite(x) FOR x IN embedding])"""
_ESCAPED = "replace(coalesce(text, ''), chr(92), chr(92) || 'b')"
for _word in chat.CONTROL:
    _ESCAPED = f"replace({_ESCAPED}, '{_word}', '{_word[0]}' || chr(92) || 'i{_word[1:]}')"
_TURN = "coalesce(role, '') || chr(10) || coalesce(text, '') || chr(10)"
_LEARNED = "string_agg(CASE WHEN role = 'assistant' THEN coalesce(text, '') ELSE '' END, '' ORDER BY turn, role, text)"

ORACLES: dict[str, str] = {
    "op7_event_sourced_chat": f"""
WITH rows AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg({_TURN}, '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(length({_LEARNED}) AS BIGINT) AS loss_chars, sha256({_LEARNED}) AS loss_sha256,
  CAST(sum(length(coalesce(role, '')) + length({_ESCAPED}) + {len(chat.START) + len(chat.END) + 2}) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id""",
    "op10_block_matrix_neighbours": f"""
WITH fine AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE {_FINE}),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v) AS score
  FROM fine q JOIN fine c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM pairs)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 20""",
    "op11_mtree_search": """
WITH fine AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND list_bool_and([x IS NOT NULL AND isfinite(x) FOR x IN embedding])),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([q.v[i] * c.v[i] FOR i IN range(1, len(q.v) + 1)]) AS BIGINT) AS score
  FROM fine q JOIN fine c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM pairs)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 10""",
    "op12_wavelet_fim": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || doc_id) AS s FROM documents),
h AS (
  SELECT *, CAST('0x' || s[1:8] AS BIGINT) AS h1, CAST('0x' || s[9:16] AS BIGINT) AS h2, CAST('0x' || s[17:24] AS BIGINT) AS h3,
    CAST('0x' || s[25:32] AS BIGINT) AS h4, string_split(t, chr(10)) AS pieces FROM d),
u AS (SELECT *, CAST(len(pieces) - CASE WHEN pieces[-1] = '' THEN 1 ELSE 0 END AS BIGINT) AS n FROM h),
c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain'
         WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (
  SELECT *, CASE WHEN a = n THEN t WHEN a = 0 THEN '' ELSE array_to_string(pieces[1:a], chr(10)) || chr(10) END AS head,
    CASE WHEN b = n THEN t WHEN b = 0 THEN '' ELSE array_to_string(pieces[1:b], chr(10)) || chr(10) END AS upto FROM c),
q AS (SELECT *, substr(upto, length(head) + 1) AS mid, substr(t, length(upto) + 1) AS tail FROM p)
SELECT doc_id, n, form, CAST(CASE WHEN form <> 'plain' THEN length(head) END AS BIGINT) AS prefix_chars,
  CAST(CASE WHEN form <> 'plain' THEN length(mid) END AS BIGINT) AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || head || '<S>' || tail || '<M>' || mid
                   ELSE '<S>' || tail || '<P>' || head || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256
FROM q""",
}
