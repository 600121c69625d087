"""Documents to token ids: the stages of a training-data pipeline, each over all that the one before kept.

Each stage takes (spark, docs, sf_dir) and gives the columns of docs, the last one token ids. Columns that
a stage doesn't need go through it as they are, whatever their names. Null texts count as empty, and are
kept or dropped as such; an empty table goes through all stages as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontamination, near_dedup, pii, quality
from tidemark.llm.common import packed, recounted, stored, table, unpacked


def good_only(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    judged = quality.classify(packed(docs), "_key", "_text", keep=["_doc"])
    return unpacked(judged.where("good"), docs)


def first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: that of the least id."""
    return near_dedup.first_of_classes(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less the passages that they share with the benchmark; what has no words left goes."""
    found = decontamination.search(packed(docs), table(spark, sf_dir, "benchmark"), "_key", "_text", keep=["_doc"])

    @F.pandas_udf("string")
    def cut(texts, spans):
        return texts.combine(spans, lambda x, s: decontamination.without(x, list(s)))

    kept = found.where((F.size("spans") == 0) | (decontamination.hit_words() < F.col("n_words")))
    return recounted(unpacked(kept.withColumn("_text", F.when(F.size("spans") > 0, cut("_text", "spans")).otherwise(F.col("_text"))), docs))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data, and the terms that disclose it, replaced."""
    return recounted(pii.sanitise(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, offsets, n_tokens): token ids, and where they start in the bytes of the text."""
    return bpe.encode(docs).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("quality classifier", good_only),
    ("near-duplicates", first_copies),
    ("benchmark decontamination", without_benchmark),
    ("personal data", without_personal_data),
    ("byte-level BPE", tokens),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
    return docs
