"""Recall of substring dedup on the given documents: no run of 50 words stays in two of them."""

import os

import pytest
from pyspark.sql import functions as F

from paperlume.llm import substring_dedup

TABLES = "/root/testdata/sf0.01"
WORDS = 50


def runs(texts):
    """The documents that hold each run of 50 words."""
    held = {}
    for doc, text in texts.items():
        words = (text or "").encode().lower().split()
        for k in range(len(words) - WORDS + 1):
            held.setdefault(hash(tuple(words[k : k + WORDS])), set()).add(doc)
    return held


@pytest.mark.skipif(not os.path.exists(TABLES), reason="needs the given tables")
def test_no_run_of_fifty_words_stays_in_two_documents(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet").select("doc_id", "text")
    before = dict(docs.where("doc_id IS NOT NULL").collect())
    after = dict(substring_dedup.remove_repeats(docs).where(F.col("doc_id").isNotNull()).collect())
    assert after.keys() == before.keys()
    repeated = {key for key, held in runs(before).items() if len(held) > 1}
    left = {key for key, held in runs(after).items() if len(held) > 1}
    assert repeated
    assert not left & repeated
