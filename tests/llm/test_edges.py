"""Cases that once were lost, and the pipeline's stages against their own inputs."""

import glob
import os
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from paperlume.llm import _spark, _training, ann_scan, bpe, decontamination, gated_lm, linking, ngram_join, queries, token_count

SF = "/root/testdata/sf0.001"


def test_one_large_text_does_not_end_the_sample(spark):
    rows = [(k, "x" * (3000 if k % 5 == 0 else 10)) for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(30)] + [(None, 1), (3, None)], "doc_id long, quality int")
    found = {r["id"] for r in _training.labelled_sample(docs, labels, "quality", F.lit(True), 100, 1000).collect()}
    assert found == {k for k in range(30) if k % 5}
    assert _training.labelled_sample(docs, labels.limit(0), "quality", F.lit(True), 100, 1000).count() == 0


def test_links_run_through_rows_without_an_id(spark):
    words = [f"w{k}" for k in range(60)]
    near = words[:-2] + ["y1", "y2"]
    far = near[2:] and ["x1", "x2"] + words[2:-2] + ["y1", "y2"]
    docs = spark.createDataFrame([(5, " ".join(words)), (None, " ".join(near)), (9, " ".join(far)), (None, "z " * 9)], "doc_id long, text string")
    found = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in ngram_join.join_groups(docs).collect()}
    assert found[(5, 57)] == 5 and found[(9, 57)] == 5 and found[(None, 57)] == 5


@pytest.mark.parametrize("rows", [0, 1 << 40])
def test_joins_by_shuffle_and_by_broadcast_agree(spark, monkeypatch, rows):
    monkeypatch.setattr(_spark, "BROADCAST_ROWS", rows)
    monkeypatch.setattr(linking, "FEW", 0 if rows else 10**9)
    r = random.Random(2)
    texts = []
    for k in range(60):
        own = r.choice(texts).split() if texts and k % 3 else [f"v{r.randrange(300)}" for _ in range(40)]
        own[r.randrange(len(own))] = f"v{r.randrange(300)}"
        texts.append(" ".join(own))
    found = {x["doc_id"]: x["component_id"] for x in ngram_join.join_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 5, 80).collect()}
    sets = [{tuple(t.split()[a : a + 5]) for a in range(36)} for t in texts]
    root = list(range(60))
    for _ in range(60):
        for a in range(60):
            for b in range(60):
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    assert found == dict(enumerate(root))


def test_wide_bound_never_excludes_a_link():
    r = np.random.default_rng(4)
    for n in (1, 7, 300, 2000):
        base = r.integers(0, 2**63, n, dtype=np.uint64)
        other = np.r_[base[: n - n // 10], r.integers(0, 2**63, n // 12, dtype=np.uint64)]
        a, b = np.unique(base), np.unique(other)
        shared = linking.overlap(a, b)
        percent = 100 * shared // (len(a) + len(b) - shared)
        columns = [linking.list_column([linking.wide_bits(x)]) for x in (a, b)]
        assert linking.within_bound(*columns, np.array([len(a) + len(b)]), percent).all()


def test_long_unbroken_words_encode_as_the_library_does():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(token_count.tokenizer_path("byte_bpe_50k.json"))
    own, r = bpe.load("byte_bpe_50k.json"), random.Random(9)
    for alphabet in ("abcdefghijklmnopqrstuvwxyz", "aab", "ÃÂ", "äöü日", "=-"):
        for n in (511, 513, 5000):
            word = "".join(r.choice(alphabet) * r.choice([1, 1, 1, 30]) for _ in range(n))
            assert np.frombuffer(next(iter(own.encode_batch([word]))), "<u4").tolist() == library.encode(word, add_special_tokens=False).ids


def test_registered_digests_are_those_of_the_library(spark):
    import hashlib

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(token_count.tokenizer_path("byte_bpe_50k.json"))
    texts = {r["doc_id"]: r["text"] or "" for r in _spark.table(spark, SF, "documents").collect()}
    for r in queries.op10_bpe(spark, SF).collect():
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def plain(text):
    return re.findall(r"[0-9a-z\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_decontamination_equals_brute_force(spark):
    docs, benchmark = _spark.table(spark, SF, "documents").limit(120), _spark.table(spark, SF, "benchmark")
    extra = spark.createDataFrame([(900, "one two"), (901, "one two"), (None, "three four five"), (902, ""), (903, None)], "item_id long, text string")
    texts = spark.createDataFrame([(10**6, "so one two go"), (10**6 + 1, "x three four five y"), (10**6 + 2, None), (10**6 + 3, "one two")], "doc_id long, text string")
    docs, benchmark = docs.select("doc_id", "text").unionByName(texts), benchmark.select("item_id", "text").unionByName(extra)
    items = [(r["item_id"], plain(r["text"])) for r in benchmark.collect() if plain(r["text"])]
    runs = lambda w: [tuple(w[k : k + 5]) for k in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] * bool(w)
    count = {}
    for _, w in items:
        for x in set(runs(w)):
            count[x] = count.get(x, 0) + 1
    weigh = lambda s: sum(np.log1p(len(items) / count.get(x, 1)) if x in count else np.log1p(len(items)) for x in s)
    expected = {}
    for r in docs.collect():
        own, found = plain(r["text"]), []
        for i, w in items:
            if len(w) < 5:
                hit = any(own[k : k + len(w)] == w for k in range(len(own) - len(w) + 1))
            else:
                shingles, size, want = runs(own), len(runs(w)), set(runs(w))
                hit = len(own) >= 5 and bool(want & set(shingles)) and any(
                    weigh(want & set(shingles[k : k + size])) >= 0.8 * weigh(want | set(shingles[k : k + size])) - 1e-9 for k in range(max(1, len(shingles) - size + 1))
                )
            if hit:
                found.append(i)
        expected[r["doc_id"]] = sorted(found, key=str)
    similar = []
    for item_bytes in (decontamination.ITEM_BYTES, 4000, 1500, 400):
        rows = decontamination.find_matches(docs, benchmark, item_bytes=item_bytes).collect()
        assert {r["doc_id"]: sorted((m["item_id"] for m in r["matches"]), key=str) for r in rows} == expected
        similar.append({(r["doc_id"], m["item_id"]): (round(m["similarity"], 12), m["first_word"], m["n_words"]) for r in rows for m in r["matches"]})
    # One index of all items and an index for each of many blocks of them give the same similarities and places.
    assert all(found == similar[0] for found in similar)


def test_search_counts_equal_rows_once_and_breaks_ties_by_id(spark):
    rows = [(k, [1.0, float(k % 3)]) for k in range(12)] * 2 + [(50, None), (51, [0.0, 0.0]), (52, [float("nan"), 1.0]), (53, [1.0])]
    found = ann_scan.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=5, query_every=6).collect()
    for q in (0, 6):
        own = sorted((r["rank"], r["vec_id"]) for r in found if r["query_id"] == q)
        expected = sorted((k for k in range(12) if k != q), key=lambda k: (-(1 + (k % 3) * (q % 3)), k))[:5]
        assert own == list(enumerate(expected, 1))
    few = ann_scan.search(spark.createDataFrame(rows[:4], "vec_id long, embedding array<double>"), k=5, query_every=6).collect()
    assert sorted(r["vec_id"] for r in few) == [1, 2, 3]


def test_very_long_documents_are_scored_without_padding():
    unit = gated_lm.GatedUnit(np.ones(gated_lm.SYMBOLS))
    docs = [np.r_[np.full(200_000, 5), 0], np.array([3, 0]), np.array([0])]
    scores = unit.score(docs)
    assert np.isfinite(scores).all() and scores[0] < scores[1] < 0
    alone = [unit.score([d])[0] for d in docs]
    assert np.allclose(scores, alone, rtol=1e-4)


def test_chat_format_sql(spark):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    result = con.execute(queries.ORACLE_SQL["op1_chat_format"])
    names = [c[0] for c in result.description]
    found = queries.op1_chat_format(spark, SF)
    assert sorted(tuple(r[n] for n in names) for r in found.collect()) == sorted(result.fetchall())


def test_pipeline_stages(spark):
    docs = _spark.table(spark, SF, "documents").withColumn("score", F.lit(1)).withColumn("matches", F.lit("m")).withColumn("gone", F.lit(2))
    names = docs.columns
    kept = corpus_pipeline.keep_quality(spark, docs, SF)
    assert kept.columns == names
    sets = {r["doc_id"]: r["text"] for r in docs.collect()}
    single = {r["doc_id"] for r in corpus_pipeline.one_per_group(spark, docs, SF).collect()}
    shingles = {k: {tuple(w[a : a + 5]) for a in range(max(1, len(w) - 4))} for k, w in ((k, re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for k, t in sets.items()) if w}
    linked = {k: {o for o in shingles if 100 * len(shingles[k] & shingles[o]) >= 80 * len(shingles[k] | shingles[o])} for k in shingles}
    group = dict.fromkeys(shingles)
    for k in sorted(shingles):
        if group[k] is None:
            todo = [k]
            while todo:
                x = todo.pop()
                if group[x] is None:
                    group[x] = k
                    todo += linked[x]
    assert single == set(group.values()) | (sets.keys() - shingles.keys())
    rewritten = corpus_pipeline.drop_repeats(spark, docs, SF)
    assert rewritten.columns == names and rewritten.count() == docs.count()
    clean = corpus_pipeline.drop_contaminated(spark, docs, SF)
    dirty = {r["doc_id"] for r in decontamination.report(docs, _spark.table(spark, SF, "benchmark")).where("contaminated").collect()}
    assert {r["doc_id"] for r in clean.collect()} == sets.keys() - dirty and clean.columns == names
    encoded = corpus_pipeline.encode(spark, docs.withColumn("n_tokens", F.lit(0)), SF)
    assert encoded.columns == [*names, "ids_le", "n_tokens", "lossless"] and encoded.where("NOT lossless").count() == 0
    assert corpus_pipeline.encode(spark, docs.limit(0), SF).count() == 0
