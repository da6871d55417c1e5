"""Corpus preparation in five stages, from ``documents`` to packed training sequences.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; the first four return the columns of ``documents``, the last one the
pieces of the packed sequences. Between stages the rows are written as Parquet
to the shared checkpoint folder and read again.

Null or empty texts fail the quality rules; ties and repeated rows are settled
in the copy stages (the largest identifier stays); an empty table passes through
all stages. Columns besides ``doc_id`` and ``text`` are carried along.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from tessera.llm import dedup, jaccard, packing, quality, secrets
from tessera.llm.common import materialise
from tessera.plans.common import table


def quality_rules(spark, docs, sf_dir):
    """Documents that pass every rule of the threshold table."""
    return quality.keep_good(docs)


def exact_dedup(spark, docs, sf_dir):
    """Of equal texts, the row with the largest doc_id."""
    return dedup.drop_copies(docs)


def near_dedup(spark, docs, sf_dir):
    """One document of each class of near copies."""
    return jaccard.keep_one(docs)


def secret_scan(spark, docs, sf_dir):
    """Secrets masked in place; ``n_chars`` follows the text."""
    out = secrets.redact(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))
    return out.select(*docs.columns)


def pack(spark, docs, sf_dir):
    """Pieces of all documents in sequences of at most 4096 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_dedup),
    ("n-gram Jaccard join", near_dedup),
    ("secret scans", secret_scan),
    ("packing", pack),
]

#: Streaming state, LSH forest and tokenizer have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs, "pipeline-" + name.replace(" ", "-"))
    return docs
