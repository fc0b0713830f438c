"""Hybrid retrieval for a table of questions: lexical and vector candidates, rank fusion, boosts, budget.

All operators work on many questions at once, keyed by question_id; windows are partitioned by
it and hold at most the candidate pool.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import estimate_tokens, is_complex
from ..plans.registry import query
from ..sources.tables import table
from .search import POOL, lexical_search, semantic_search, top_per_question

#: Fusion constants and boosts, (chunks, tokens) of plain and complex questions, and the most chunks of any. Fixed values.
RANK_OFFSET, LEXICAL_WEIGHT, SEMANTIC_WEIGHT = 60, 1.0, 1.15
SAME_FILE, NEAR_PAGE = 1.15, 1.25
BUDGETS = {False: (8, 10_000), True: (14, 16_000)}
MOST_CHUNKS = 24
#: One in ``ASKED`` ids asks.
ASKED = 100


def fuse(lexical: DataFrame, semantic: DataFrame) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists."""
    left = lexical.select("question_id", "chunk_id", F.col("rank").alias("lexical_rank"))
    right = semantic.select("question_id", "chunk_id", F.col("rank").alias("semantic_rank"))
    share = lambda rank, weight: F.coalesce(F.lit(weight) / (RANK_OFFSET + F.col(rank)), F.lit(0.0))
    both = left.join(right, ["question_id", "chunk_id"], "full_outer")
    return both.withColumn("score", F.round(share("lexical_rank", LEXICAL_WEIGHT) + share("semantic_rank", SEMANTIC_WEIGHT), 9)).withColumn("agreement", F.col("lexical_rank").isNotNull() & F.col("semantic_rank").isNotNull())


def context_boost(score: Column, file: Column, page: Column, active_file: Column, active_page: Column) -> Column:
    """Chunks of the open file and of pages next to the open one count more."""
    near = F.when(F.abs(page - active_page) <= 1, NEAR_PAGE).otherwise(1.0)
    return F.when(active_file.isNull(), score).otherwise(score * F.when(file == active_file, SAME_FILE).otherwise(1.0) * near)


def diversify(ranked: DataFrame, limit: Column | int, per_file: Column | int) -> DataFrame:
    """At most ``per_file`` chunks of a file first, others behind them, as far as ``limit``; by column pos."""
    by_file = Window.partitionBy("question_id", "file_id").orderBy("pos")
    over = ranked.withColumn("over", F.row_number().over(by_file) > per_file)
    order = Window.partitionBy("question_id").orderBy("over", "pos")
    return over.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= limit).drop("over")


def fit_budget(ranked: DataFrame, budget: Column | int) -> DataFrame:
    """The prefix whose tokens fit the budget, the first chunk always."""
    running = F.sum("tokens").over(Window.partitionBy("question_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("running_tokens", running).where((F.col("running_tokens") <= budget) | (F.col("pos") == 1))


def retrieve(chunks: DataFrame, questions: DataFrame) -> DataFrame:
    """Kept chunks of each question in order, with the question's best score and number of candidates.

    Chunks have chunk_id, file_id, page, text, embedding; questions question_id, question, embedding,
    active_file, active_page and file_count, the files that they may be answered from.
    """
    fused = fuse(lexical_search(chunks, questions), semantic_search(chunks, questions))
    facts = chunks.select("chunk_id", "file_id", "page", estimate_tokens(F.col("text")).alias("tokens"))
    asked = questions.select("question_id", "active_file", "active_page", "file_count", is_complex(F.col("question"), F.col("file_count")).alias("complex"))
    pool = fused.join(facts, "chunk_id").join(asked, "question_id")
    boosted = pool.withColumn("score", F.round(context_boost(F.col("score"), F.col("file_id"), F.col("page"), F.col("active_file"), F.col("active_page")), 9))
    of_question = Window.partitionBy("question_id")
    ranked = boosted.withColumn("pos", F.row_number().over(of_question.orderBy(F.desc("score"), "chunk_id"))).withColumn("candidates", F.count(F.lit(1)).over(of_question))
    limit, budget = (F.when(F.col("complex"), BUDGETS[True][k]).otherwise(BUDGETS[False][k]) for k in (0, 1))
    limit = F.least(limit, F.lit(MOST_CHUNKS))
    per_file = F.when(F.col("file_count") > 1, F.greatest(F.lit(2), F.ceil(limit / 2))).otherwise(limit)
    kept = fit_budget(diversify(ranked, limit, per_file), budget)
    top = F.first("score").over(of_question.orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return kept.withColumn("top_score", top).select("question_id", F.col("pos").alias("rank"), "chunk_id", "file_id", "score", "agreement", "tokens", "running_tokens", "complex", "top_score", "candidates")


def demo_chunks(spark, sf_dir) -> DataFrame:
    """All documents as chunks; one without a vector is found by its words only and is a file of its own."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("file_id"), "embedding")
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    chunks = texts.join(vectors, "chunk_id", "left").withColumn("file_id", F.coalesce("file_id", -1 - F.col("chunk_id")))
    return chunks.withColumn("page", (F.col("chunk_id") % 40).cast("int"))


def demo_questions(spark, sf_dir) -> DataFrame:
    """Vectors and opening words of every chunk whose id is divisible by ``ASKED``, asked as questions about the others."""
    words = F.array_join(F.slice(F.split("text", r"\s+"), 1, 8), " ")
    asked = demo_chunks(spark, sf_dir).where(F.col("chunk_id") % ASKED == 0)
    return asked.select(F.col("chunk_id").alias("question_id"), words.alias("question"), "embedding", F.when(F.col("chunk_id") % 2 == 0, F.col("file_id")).alias("active_file"), F.col("page").alias("active_page"), F.lit(2).alias("file_count"))


@query("hybrid_retrieval")
def hybrid_retrieval(spark, sf_dir):
    return retrieve(demo_chunks(spark, sf_dir), demo_questions(spark, sf_dir))


@query("semantic_search", f"""SELECT question_id, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT q.vec_id AS question_id, c.vec_id AS chunk_id, round(list_inner_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) / sqrt(list_inner_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]) * list_inner_product(c.embedding::DOUBLE[], c.embedding::DOUBLE[])), 9) AS score,
row_number() OVER (PARTITION BY q.vec_id ORDER BY score DESC, c.vec_id) AS rank FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id WHERE q.vec_id % {ASKED} = 0) WHERE rank <= 40""")
def _semantic(spark, sf_dir):
    """Every id divisible by ``ASKED`` against all."""
    rows = table(spark, sf_dir, "embeddings")
    return semantic_search(rows.select(F.col("vec_id").alias("chunk_id"), "embedding"), rows.where(F.col("vec_id") % ASKED == 0).select(F.col("vec_id").alias("question_id"), "embedding"))


@query("rrf", """WITH l AS (SELECT vec_id AS chunk_id, row_number() OVER (ORDER BY embedding[1] DESC, vec_id) AS r FROM embeddings), s AS (SELECT vec_id AS chunk_id, row_number() OVER (ORDER BY embedding[2] DESC, vec_id) AS r FROM embeddings)
SELECT CAST(0 AS BIGINT) AS question_id, chunk_id, CAST(l.r AS INTEGER) AS lexical_rank, CAST(s.r AS INTEGER) AS semantic_rank, round(coalesce(1.0::DOUBLE / (60 + l.r), 0) + coalesce(1.15::DOUBLE / (60 + s.r), 0), 9) AS score, l.r IS NOT NULL AND s.r IS NOT NULL AS agreement
FROM (SELECT * FROM l WHERE r <= 40) l FULL JOIN (SELECT * FROM s WHERE r <= 40) s USING (chunk_id)""")
def _rrf(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    # The best rows come from each task's best; only these are ranked.
    best = lambda k: rows.select(F.lit(0).cast("long").alias("question_id"), F.col("vec_id").alias("chunk_id"), F.col("embedding")[k].alias("score")).orderBy(F.desc("score"), "chunk_id").limit(POOL)
    ranked = lambda k: top_per_question(best(k))
    return fuse(ranked(0), ranked(1))


@query("lexical_search")
def _lexical(spark, sf_dir):
    """The opening words of every document whose id is divisible by ``ASKED``, searched in all documents."""
    rows = table(spark, sf_dir, "documents")
    words = F.array_join(F.slice(F.split("text", r"\s+"), 1, 8), " ")
    return lexical_search(rows.select(F.col("doc_id").alias("chunk_id"), "text"), rows.where(F.col("doc_id") % ASKED == 0).select(F.col("doc_id").alias("question_id"), words.alias("question")))
