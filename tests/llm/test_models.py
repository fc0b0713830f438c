"""Encoders, models, search, chat format and decontamination on small inputs."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from paperlume.llm import ann_scan, bpe, chat_format, decontamination, gated_lm, quality, token_count, toxicity

TEXTS = ["", None, "Hello  world\n\n x", " lead", "tail ", "don't <|endoftext|> 12345 ñandú 日本語 🙂🙂", "a" * 3000, "aaa aa aaaa", "\t \n", "x y" * 500]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(k, t, k, "s") for k, t in enumerate(TEXTS)], "doc_id long, text string, id long, source string")


def test_encoding_equals_the_library(docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(token_count.tokenizer_path("byte_bpe_50k.json"))
    ids = {k: library.encode(t or "", add_special_tokens=False).ids for k, t in enumerate(TEXTS)}
    encoded = bpe.decode(bpe.encode(docs), ids_col="ids_le", out="back").collect()
    assert {r["doc_id"]: np.frombuffer(r["ids_le"], "<u4").tolist() for r in encoded} == ids
    assert {r["doc_id"]: r["back"] for r in encoded} == {k: library.decode(v, skip_special_tokens=False) for k, v in ids.items()}
    counted = token_count.count_tokens(docs).collect()
    assert {r["doc_id"]: (r["n_tokens"], r["n_bytes"], r["over_limit"]) for r in counted} == {k: (len(v), len((TEXTS[k] or "").encode()), len(v) > 512) for k, v in ids.items()}


def test_empty_tables(docs):
    none = docs.limit(0)
    for made in (bpe.round_trip(none), token_count.count_tokens(none), gated_lm.score_documents(none), ann_scan.search(none.select(F.col("doc_id").alias("vec_id"), F.array(F.lit(1.0)).alias("embedding")))):
        assert made.count() == 0


def test_chat_format_reads_back(spark):
    rows = [(1, 0, "user", "a <|im_end|> b"), (1, 1, "assistant", r"<\|im_end|> <|"), (2, 0, "user\n", None), (None, 0, None, "x"), (3, 0, "assistant", "plain"), (3, 0, "assistant", "plain")]
    out = chat_format.format_conversations(spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, conv string")).collect()
    assert len(out) == 4 and all(r["round_trip"] for r in out)


def test_language_model_counts(spark):
    texts = [" ".join(f"W{(k * j) % 7}" for j in range(k % 9)) for k in range(60)]
    found = {r["doc_id"]: r for r in gated_lm.score_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    tokens = {k: [*t.lower().split(), "\0"] for k, t in enumerate(texts)}
    known: dict[str, int] = {}
    for k, own in tokens.items():
        if zlib.crc32(str(k).encode()) % 5 != 1:
            for t in own:
                known[t] = known.get(t, 0) + 1
    n, v = sum(known.values()), len(known)
    for k, own in tokens.items():
        assert found[k]["n_tokens"] == len(own) and found[k]["train_tokens"] == n
        assert found[k]["base_score"] == pytest.approx(sum(np.log10((known.get(t, 0) + 0.5) / (n + 0.5 * (v + 1))) for t in own))
        assert found[k]["score"] < 0


def test_language_model_state_runs_through_a_document():
    unit = gated_lm.GatedUnit(np.ones(gated_lm.SYMBOLS))
    r = np.random.default_rng(0)
    documents = [np.append(r.integers(2, 1000, k), gated_lm.END) for k in (0, 5, 200, 71)]
    alone = [unit.score([d])[0] for d in documents]
    assert unit.score(documents) == pytest.approx(alone, rel=1e-4)


def test_search_finds_neighbours(spark):
    r = np.random.default_rng(2)
    x = r.standard_normal((600, 16))
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(1000, None), (1020, [0.0] * 16), (1040, [float("nan")] * 16), (None, [1.0] * 16)]
    found: dict[int, list[int]] = {}
    for row in ann_scan.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("query_id", "rank").collect():
        found.setdefault(row["query_id"], []).append(row["vec_id"])
    assert sorted(found) == list(range(0, 600, 20))
    scores = x @ x.T
    np.fill_diagonal(scores, -np.inf)
    hits = sum(len(set(own) & set(np.argsort(-scores[q])[:20].tolist())) for q, own in found.items())
    assert all(len(own) == 20 for own in found.values()) and hits >= 0.9 * 20 * len(found)


def test_classifiers_learn_and_take_anything(spark, docs):
    small = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id < 3000")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    for module, label, least in ((quality, "quality", 0.75), (toxicity, "toxic", 0.8)):
        model = module.train(small, labels)
        scored = module.score(small, model).where("held_out").join(labels, "doc_id")
        right = scored.agg(F.avg((F.col("predicted") == F.col(label)).cast("double"))).first()[0]
        assert right >= least
        assert module.score(docs, model).where("score BETWEEN 0 AND 1").count() == len(TEXTS)
        assert module.score(docs.limit(0), model).count() == 0


def test_contaminated_documents_are_found(spark):
    item = " ".join(f"item{k}" for k in range(40))
    near, far = item.replace("item39", "changed"), item.replace("item20", "changed")  # similarity 35/37 and 31/41
    rows = [(1, "before " + item + " after"), (2, "x " * 30 + near), (6, far), (3, "other words " * 40), (4, None), (5, "")]
    bench = spark.createDataFrame([(7, item), (8, None), (9, "")], "item_id long, text string")
    found = {r["doc_id"]: r["item_ids"] for r in decontamination.report(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert found == {1: [7], 2: [7], 3: [], 4: [], 5: [], 6: []}
    assert decontamination.remove_contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench.limit(0)).count() == 6


def test_words_of_sliced_columns():
    from paperlume.llm.words import words_of

    column = pa.array(["x", "A b", None, "c"]).slice(1)
    assert words_of(column).counts.tolist() == [2, 0, 1]


def test_unit_learns_from_every_training_row(spark):
    rows = spark.range(3000).selectExpr("id", "concat_ws(' ', transform(sequence(1, 200), k -> concat('word', (id * k) % 701))) AS text")
    corpus = gated_lm.describe(gated_lm.word_counts(rows))
    assert gated_lm.train(rows, corpus).seen == corpus.total == 3000 * 201


def test_scores_do_not_depend_on_the_cut_of_the_files(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 150").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(None, "no id"), (7, "again"), (7, "again"), (8, None)], docs.schema))
    found = []
    for parts in (1, 9):
        docs.repartition(parts).write.parquet(f"{tmp_path}/{parts}")
        rows = gated_lm.score_documents(spark.read.option("maxPartitionBytes", 1 << 30).parquet(f"{tmp_path}/{parts}")).collect()
        found.append(sorted((str(r["doc_id"]), r["n_tokens"], r["score"]) for r in rows))
    assert [x[:2] for x in found[0]] == [x[:2] for x in found[1]]
    assert [x[2] for x in found[0]] == pytest.approx([x[2] for x in found[1]], rel=1e-4)


def test_language_model_without_training_rows(spark):
    ids = [k for k in range(100) if zlib.crc32(str(k).encode()) % 5 == 1]
    rows = gated_lm.score_documents(spark.createDataFrame([(k, "a b") for k in ids], "doc_id long, text string")).collect()
    assert len(rows) == len(ids) and all(r["n_known"] == 0 and r["train_tokens"] == 0 and r["held_out"] for r in rows)


def plain_log10(unit, symbols):
    """The log10 probability of one document by loops over its tokens and units."""
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    p = {k: v.astype(np.float64) for k, v in unit.p.items()}
    n, h, last, total = gated_lm.HIDDEN, np.zeros(gated_lm.HIDDEN), gated_lm.END, 0.0
    for symbol in symbols:
        if last == gated_lm.END:
            h = np.zeros(n)
        new = np.zeros(n)
        for k in range(n):
            into = [p["G"][last, k + part * n] for part in range(3)]
            past = [sum(h[j] * p["U"][j, k + part * n] for j in range(n)) for part in range(3)]
            z, r = sigmoid(into[0] + past[0]), sigmoid(into[1] + past[1])
            new[k] = (1 - z) * np.tanh(into[2] + r * past[2]) + z * h[k]
        h = new
        cls, member = divmod(symbol, gated_lm.PER_CLASS)
        by_class, within = h @ p["Wc"] + p["bc"], h @ p["Ww"][cls] + p["bw"][cls]
        total += by_class[cls] - np.log(np.exp(by_class).sum()) + within[member] - np.log(np.exp(within).sum())
        last = symbol
    return total / np.log(10)


def test_scores_equal_a_plain_loop():
    r = np.random.default_rng(1)
    unit = gated_lm.GatedUnit(r.integers(1, 100, gated_lm.SYMBOLS).astype(float))
    unit.train(r.integers(2, 1000, 3000), 1)
    documents = [np.append(r.integers(1, 1000, k), gated_lm.END) for k in (0, 3, 90)]
    assert unit.score(documents) == pytest.approx([plain_log10(unit, d.tolist()) for d in documents], rel=1e-4)


def test_gradients_equal_differences():
    r = np.random.default_rng(4)
    unit = gated_lm.GatedUnit(np.ones(gated_lm.SYMBOLS))
    unit.p = {k: (v + r.standard_normal(v.shape) * 0.3).astype(np.float64) for k, v in unit.p.items()}
    x, y = r.integers(0, 6, (5, 3)), r.integers(0, 40, (5, 3))

    def loss():
        h = np.zeros((3, gated_lm.HIDDEN))
        return unit.log_probs(unit.states(x, h).reshape(-1, gated_lm.HIDDEN).astype(np.float64), y.ravel())[0].sum()

    grads, kept = {k: np.zeros_like(v) for k, v in unit.p.items()}, []
    states = unit.states(x, np.zeros((3, gated_lm.HIDDEN)), kept)
    _, dh = unit.log_probs(states.reshape(-1, gated_lm.HIDDEN).astype(np.float64), y.ravel(), grads)
    unit.backward(x, kept, dh.reshape(states.shape), grads)
    for name, p in unit.p.items():
        flat, found = p.reshape(-1), grads[name].reshape(-1)
        for k in np.argsort(-np.abs(found))[:6]:
            held = flat[k]
            ends = []
            for step in (1e-2, -1e-2):
                flat[k] = held + step
                ends.append(loss())
            flat[k] = held
            assert found[k] == pytest.approx((ends[0] - ends[1]) / 2e-2, rel=0.02, abs=2e-3)


def plain_attention(p, x):
    """The probability of one document from its scaled passages, one passage and one unit at a time."""
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    encoded, weights = [], []
    for row in x:
        h = [max(0.0, sum(row[j] * p["We"][j, k] for j in range(len(row))) + p["be"][k]) for k in range(quality.HIDDEN)]
        gated = 0.0
        for k in range(quality.ATTENTION):
            gated += p["w"][k] * np.tanh(sum(h[j] * p["V"][j, k] for j in range(len(h)))) * sigmoid(sum(h[j] * p["U"][j, k] for j in range(len(h))))
        encoded.append(h)
        weights.append(np.exp(gated))
    z = [sum(w * h[k] for w, h in zip(weights, encoded)) / sum(weights) for k in range(quality.HIDDEN)]
    return sigmoid(sum(z[k] * p["c"][k] for k in range(quality.HIDDEN)) + p["d"][0])


def test_attention_gradients_equal_differences():
    r = np.random.default_rng(3)
    model = quality.AttentionModel()
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    x, bounds, labels = r.standard_normal((9, quality.FEATURES)), np.array([0, 1, 5, 9]), np.array([1.0, 0.0, 1.0])

    def loss():
        y = model.forward(x, bounds)["y"]
        return -(labels * np.log(y) + (1 - labels) * np.log(1 - y)).mean()

    grads = model.gradients(model.forward(x, bounds), labels)
    for name, p in model.p.items():
        flat, found = p.reshape(-1), np.asarray(grads[name]).reshape(-1)
        for k in np.argsort(-np.abs(found))[:5]:
            held, ends = flat[k], []
            for step in (1e-5, -1e-5):
                flat[k] = held + step
                ends.append(loss())
            flat[k] = held
            assert found[k] == pytest.approx((ends[0] - ends[1]) / 2e-5, rel=1e-3, abs=1e-6)


def test_attention_scores_equal_plain_loops():
    r = np.random.default_rng(8)
    texts = pa.array([" ".join(f"w{r.integers(50)}" for _ in range(n)) for n in (3, 40, 700, 2000)] + ["", None], pa.large_string())
    model = quality.fit_attention(texts, np.array([1, 0, 1, 0, 0, 1], np.int32))
    x, bounds = quality.passages(texts)
    p = {k: v.astype(np.float64) for k, v in model.p.items()}
    assert model.score(texts) == pytest.approx([plain_attention(p, (x[a:b].astype(np.float64) - model.mean) / model.scale) for a, b in zip(bounds[:-1], bounds[1:])], abs=1e-4)


def test_ftrl_equals_a_dictionary_of_coordinates():
    r = np.random.default_rng(6)
    texts = [" ".join(["bad" if k % 3 == 0 else "good", *(f"w{r.integers(30)}" for _ in range(6))]) for k in range(80)] + ["", "!"]
    labels = np.array([k % 3 == 0 for k in range(80)] + [False, True], np.int32)
    column = pa.array(texts, pa.large_string())
    model = toxicity.fit_ftrl(column, labels)
    examples: list[list[int]] = [[] for _ in texts]
    for (first, _), row, bucket in toxicity._per_row(column):
        for at, b in zip(row.tolist(), bucket.tolist()):
            examples[first + at].append(b)
    z: dict[int, float] = {}
    n: dict[int, float] = {}
    bias, bias_n, order = 0.0, 0.0, np.random.default_rng(7)
    weigh = lambda b: 0.0 if abs(z.get(b, 0.0)) <= toxicity.L1 else -(z[b] - np.sign(z[b]) * toxicity.L1) / ((toxicity.BETA + n[b] ** 0.5) / toxicity.ALPHA + toxicity.L2)
    for _ in range(toxicity.EPOCHS):
        for k in order.permutation(len(texts)):
            own = sorted(set(examples[k]))
            w = {b: weigh(b) for b in own}
            g = 1 / (1 + np.exp(-(sum(w.values()) + bias))) - labels[k]
            for b in own:
                before = n.get(b, 0.0)
                n[b] = before + g * g
                z[b] = z.get(b, 0.0) + g - (n[b] ** 0.5 - before**0.5) / toxicity.ALPHA * w[b]
            bias_n += g * g
            bias -= toxicity.ALPHA / (toxicity.BETA + bias_n**0.5) * g
    expected = {b: weigh(b) for b in z if abs(z[b]) > toxicity.L1}
    assert dict(zip(model.index.tolist(), model.weight.tolist())) == pytest.approx(expected)
    assert expected and model.bias == pytest.approx(bias)
    by_hand = [1 / (1 + np.exp(-(sum(expected.get(b, 0.0) for b in set(own)) + bias))) for own in examples]
    assert toxicity.score_texts(column, model) == pytest.approx(by_hand)


def test_classifiers_without_labels_and_with_one_class(spark):
    docs = spark.createDataFrame([(k, f"text number {k} " * 5) for k in range(30)] + [(None, "x"), (3, "text again"), (4, "long " * 200_000)], "doc_id long, text string")
    for module, label in ((quality, "quality"), (toxicity, "toxic")):
        for rows in ([], [(k, 1) for k in range(30)], [(None, 1), (3, None), (3, 0), (3, 1)]):
            model = module.train(docs, spark.createDataFrame(rows, f"doc_id long, {label} int"))
            scored = module.score(docs, model).collect()
            assert len(scored) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in scored)
