"""The operators on the driver tables, with DuckDB twins where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from tessera.llm import (bpe_tree, dedup, fim, jaccard, lm, mixing, nra, packing, quality, secrets, shard, token_count,
                         token_file)
from tessera.llm.common import materialise, text_or_empty
from tessera.plans.common import table
from tessera.session import scratch_path

BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"
TOKEN_LIMIT = 2048


def op1_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    q = quality.quality(docs)
    return q.select("doc_id", *[F.col("quality")[c].alias(c) for c in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "n_stop_words", "n_marks", "n_lines")])


def op2_token_file(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = scratch_path(spark, "token-ids")
    token_file.write_ids(docs, path, public_tokenizers.path(BYTE_BPE))
    return token_file.read_ids(spark, path).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_token_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn(
        "n_bytes", F.octet_length(text_or_empty()).cast("long"))
    counted = token_count.count_tokens(docs, public_tokenizers.path(WORD_BPE), keep_text=False)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op4_lm_scores(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lm.score_texts(docs)


def op5_jaccard_join(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard.near_classes(docs).select("doc_id", "class_id", "class_size", "n_links", "kept")


def op6_exact_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup.exact_groups(docs).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op7_secret_scan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.find_secrets(docs).select("doc_id", "secrets")

    def count(kind):
        return F.size(F.filter(F.col("secrets")["base"], lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(secrets.spans_text(F.col("secrets")["base"]), 256).alias("base_sha256"),
        secrets.spans_text(F.col("secrets")["all"]).alias("spans"))


def op8_sharding(spark, sf_dir):
    text = F.col("text").cast("string")
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(text_or_empty().cast("binary")).alias("text_crc32"))
    rows = shard.shard_rows(materialise(docs, "shard-rows"), ["doc_id", "text_crc32"], "size", 16,
                            order_cols=["doc_id", "text_crc32"])
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                       "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_bpe_tree(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = public_tokenizers.path(BYTE_BPE)
    back = bpe_tree.decode(bpe_tree.encode(docs, path, keep_text=False), path)
    return back.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_packing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, public_tokenizers.path(WORD_BPE))


def op11_mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", "source", mixing.n_words(F.col("text")).alias("size"))
    return mixing.mix(rows).select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", mixing.taken(F.col("pieces")).alias("taken"))


def op12_fill_in_middle(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = fim.fill_in_middle(docs).select("doc_id", "fim.*")
    return out.select(
        "doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fim.restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


def op13_ranked_search(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return nra.search(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_token_file": op2_token_file,
    "op3_token_counts": op3_token_counts,
    "op4_lm_scores": op4_lm_scores,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_secret_scan": op7_secret_scan,
    "op8_sharding": op8_sharding,
    "op9_bpe_tree": op9_bpe_tree,
    "op10_packing": op10_packing,
    "op11_mixing": op11_mixing,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_ranked_search": op13_ranked_search,
}

ORACLE = {
    "op1_quality_rules": quality.ORACLE,
    "op6_exact_dedup": dedup.ORACLE,
    "op11_mixing": mixing.ORACLE,
    "op12_fill_in_middle": fim.ORACLE,
    "op13_ranked_search": nra.ORACLE,
}
