"""Retrieval queries against brute force."""

import numpy as np
import pytest

from paperlume.operators import retrieval
from paperlume.plans import registry

SF = "/root/testdata/sf0.001"


def nearest(vectors, asked, k=40):
    out = {}
    for q in asked:
        scores = {c: round(float(np.dot(v, vectors[q]) / np.sqrt(np.dot(v, v) * np.dot(vectors[q], vectors[q]))), 9) for c, v in vectors.items() if c != q}
        out[q] = sorted(scores, key=lambda c: (-scores[c], c))[:k]
    return out


def ranked(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: r["rank"]):
        out.setdefault(r["question_id"], []).append(r["chunk_id"])
    return out


def test_every_hundredth_vector_asks(spark):
    vectors = {r["vec_id"]: np.array(r["embedding"], float) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    asked = [q for q in vectors if q % 100 == 0]
    assert len(asked) > 1
    assert ranked(registry.QUERIES["semantic_search"](spark, SF)) == nearest(vectors, asked)


@pytest.mark.parametrize("block", [3, 10_000])
def test_questions_are_asked_in_blocks(spark, block):
    r = np.random.default_rng(2)
    vectors = {k: r.standard_normal(6) for k in range(30)}
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in vectors.items()] + [(99, None)], "chunk_id long, embedding array<double>")
    found = retrieval.semantic_search(rows, rows.where("chunk_id < 10 OR chunk_id = 99").withColumnRenamed("chunk_id", "question_id"), 5, block)
    assert ranked(found) == nearest(vectors, range(10), 5)


def test_all_documents_are_searched_by_words(spark, tmp_path):
    """Hybrid retrieval of 300 documents, 60 of them with vectors, against the same steps over plain lists."""
    r = np.random.default_rng(4)
    texts = {k: " ".join(f"word{w}" for w in r.integers(0, 60, 12)) for k in range(300)}
    vectors = {k: r.standard_normal(6) for k in range(60)}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, k % 7, v.tolist()) for k, v in vectors.items()], "vec_id long, label long, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    meaning = nearest(vectors, [0])
    file = {k: k % 7 if k in vectors else -1 - k for k in texts}
    expected = {}
    for q in (0, 100, 200):
        terms = list(dict.fromkeys(texts[q].split()[:8]))
        words = {k: [w for w in text.split() if w in terms] for k, text in texts.items()}
        scores = {k: round(0.1 * len(found) * (2 if len(set(found)) == len(terms) else 1), 6) for k, found in words.items() if found}
        lexical = sorted(scores, key=lambda k: (-scores[k], k))[:40]
        fused = {}
        for order, weight in ((lexical, 1.0), (meaning.get(q, []), 1.15)):
            for at, k in enumerate(order, 1):
                fused[k] = fused.get(k, 0.0) + weight / (60 + at)
        boost = lambda k: round(round(fused[k], 9) * (1.15 if file[k] == file[q] else 1.0) * (1.25 if abs(k % 40 - q % 40) <= 1 else 1.0), 9)
        pool = sorted(fused, key=lambda k: (-boost(k), k))
        first, over = [], []
        for k in pool:
            (over if sum(file[x] == file[k] for x in first) >= 4 else first).append(k)
        expected[q] = (first + over)[:8]
    found = registry.QUERIES["hybrid_retrieval"](spark, str(tmp_path))
    assert ranked(found) == expected
    assert any(k >= 60 for kept in expected.values() for k in kept)
