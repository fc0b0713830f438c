"""Nulls, empty tables, very long texts, ties and clashing names for operators whose edges had no test."""

import pytest
from pyspark.sql import functions as F

from paperlume.llm import ann_scan, bpe, chat_format, decontamination, gated_lm, quality, substring_dedup, token_count, toxicity

TURNS = "conv_id long, turn long, role string, text string"


def test_segments_joined_are_the_formatted_text(spark):
    rows = [(1, 0, "user", "a <|im_end|> b"), (1, 1, "assistant", r"<\|im_end|> <|"), (2, 0, "us\ner", None), (3, None, "assistant", ""), (None, 1, None, "x"), (4, 0, "assistant", "long " * 400_000 + "<|im_start|>")]
    clashing = spark.createDataFrame([(*r, "p", [1]) for r in rows], TURNS + ", formatted string, segments array<int>")
    made = chat_format.format_conversations(clashing)
    assert made.where(F.array_join("segments.content", "") != F.col("formatted")).count() == 0
    read = {r["conv_id"]: r for r in chat_format.digest(made).collect()}
    assert read.keys() == {1, 2, 3, 4, None} and read[4]["loss_chars"] == 2_000_012 and read[3]["n_turns"] == 1
    assert made.where("NOT round_trip").count() == 0
    assert chat_format.digest(chat_format.format_conversations(spark.createDataFrame([], TURNS))).count() == 0


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "word_bpe_49k.json", "byte_bpe_50k.json"])
def test_counts_are_those_of_the_library(spark, name):
    texts = ["", None, "Hello  world \n ñandú <s> </s> <|endoftext|>", "x" * 3000, "word " * 60_000]
    if name.endswith(".model"):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=token_count.tokenizer_path(name))
        expected = [len(library.encode(t or "")) for t in texts]
    else:
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(token_count.tokenizer_path(name))
        library.no_truncation()
        expected = [len(library.encode(t or "", add_special_tokens=False).ids) for t in texts]
    rows = spark.createDataFrame([(k, t, "n") for k, t in enumerate(texts)] + [(0, "", "n"), (None, None, "n")], "doc_id long, text string, n_tokens string")
    found = token_count.count_tokens(rows, name).collect()
    assert sorted((r["doc_id"], r["n_tokens"]) for r in found if r["doc_id"] is not None) == sorted([*enumerate(expected), (0, 0)])


def test_repeats_in_very_long_texts_and_versions(spark):
    passage = " ".join(f"p{k}" for k in range(60))
    long = " ".join(f"u{k}" for k in range(60_000))
    rows = [(1, f"{long} {passage} end"), (2, f"start {passage}"), (3, "other text"), (3, f"x {passage} y"), (None, passage)]
    frame = spark.createDataFrame([(i, t, 1, "q") for i, t in rows], "doc_id long, text string, line int, key string")
    found = [(r["doc_id"], r["n_words"], r["removed"], r["kept_id"]) for r in substring_dedup.repeats(frame).collect()]
    # The lines of 2 and 3 are near copies, so that of 3 goes as a whole; then the passage of 2 repeats that of 1.
    assert sorted(found) == [(1, 60, False, 1), (2, 60, True, 1), (2, 61, False, 2), (3, 62, True, 2)]
    kept = sorted((r["doc_id"], r["text"]) for r in substring_dedup.remove_repeats(frame).where("doc_id > 1").collect())
    assert kept == [(2, "start "), (3, ""), (3, "other text")]


def test_very_long_texts_take_any_operator(spark):
    rows = spark.createDataFrame([(1, "Word %d said. " * 150_000), (2, ""), (3, None), (None, "a"), (1, "again")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "never here at all so there")], "item_id long, text string")
    assert decontamination.report(rows, bench).where("contaminated").count() == 0
    assert bpe.round_trip(rows).where("NOT lossless").count() == 0
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int").withColumn("toxic", F.col("quality"))
    for module in (quality, toxicity):
        assert module.score(rows, module.train(rows, labels)).count() == 5
    scored = gated_lm.score_documents(rows).collect()
    assert len(scored) == 5 and all(r["score"] < 0 for r in scored)


def test_search_in_blocks_of_ties(spark):
    rows = spark.range(300).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"), F.lit(0).alias("score"))
    found: dict[int, list[int]] = {}
    for r in ann_scan.search(rows).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    assert len(found) == 15 and all(own == [k for k in range(21) if k != q][:20] for q, own in found.items())
