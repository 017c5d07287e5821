"""From raw documents to tokens: five operators, each on all rows that its predecessor kept.

1. toxicity: documents that the classifier chain calls toxic go.
2. near_duplicates: of each group of documents that links of 0.8 or more of their five-word shingles
   join, candidates found by SimHash, the document with the smallest doc_id stays.
3. substring_dedup: words of passages that a document with a smaller doc_id already has go; a document
   that loses all its words stays, with an empty text.
4. decontamination: documents that hold a benchmark item go.
5. byte_bpe: every text becomes token ids, which are decoded again.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``.  Documents with a null doc_id or text pass the
filters that find nothing in them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import byte_bpe, common, decontamination, simhash, substring_dedup, toxicity


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, common.table(spark, sf_dir, "labels"))


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def stage_substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = substring_dedup.without_repeats(docs)
    if "n_chars" not in out.columns:
        return out
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def stage_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.without_contaminated(docs, common.table(spark, sf_dir, "benchmark"))


def stage_byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return byte_bpe.tokenize_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", stage_toxicity),
    ("near_duplicates", stage_near_duplicates),
    ("substring_dedup", stage_substring_dedup),
    ("decontamination", stage_decontamination),
    ("byte_bpe", stage_byte_bpe),
]

#: SQL expresses neither the classifier nor the retrieval nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result but the last is written and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, common.finished(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name)
        common.discard(spark, before)  # only what the stage before wrote
    return STAGES[-1][1](spark, docs, sf_dir)
