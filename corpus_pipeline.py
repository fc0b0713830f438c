"""The corpus pipeline: five stages over documents, each written and read again.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but the
last return the columns of documents; where a stage rewrites texts, n_chars follows. Rows with a
null doc_id pass the stages that compare documents unchanged.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperlume.llm import bpe, decontamination, ngram_join, quality, substring_dedup
from paperlume.llm._spark import columns_named, shared_folder, table, unused


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the attention classifier does not reject."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    score = unused(docs.columns, "score")
    return quality.with_score(docs, model, out=score).where(F.col(score) >= 0.5).select(*columns_named(docs.columns))


def one_per_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity of 0.8 or more."""
    return ngram_join.keep_one_per_group(docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the paragraphs that another document has already."""
    rewritten = substring_dedup.remove_repeats(docs)
    return rewritten.withColumn("n_chars", F.length("text").cast("long")).select(*columns_named(docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids (little-endian 32 bits), how many, and whether they decode to the text.

    These columns replace ones of the same names.
    """
    kept = [c for c in docs.columns if c.lower() not in ("ids_le", "n_tokens", "lossless")]
    made = unused(docs.columns, "encoded")
    encoded = bpe.encode_checked(docs.select(*columns_named(kept)), out=made)
    ids = F.col(made)["ids_le"]
    return encoded.select(*columns_named(kept), ids.alias("ids_le"), (F.octet_length(ids) / 4).cast("long").alias("n_tokens"), F.col(made)["lossless"].alias("lossless"))


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", one_per_group),
    ("substring_dedup", drop_repeats),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

#: Trained models and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stage's rows written to the shared folder and read back."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
