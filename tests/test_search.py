"""Word search against a plain scorer, stems against the published sample, spans against all intervals."""

import random
import re

import pytest
from pyspark.sql import functions as F

from paperlume.functions.stems import STOPS, stem
from paperlume.functions.text import STOP_WORDS
from paperlume.operators import search

SF = "/root/testdata/sf0.001"
STEMS = """consigned consign consistency consist consolation consol consolatory consolatori consolidating consolid conspicuously conspicu conspiracy
conspiraci conspirators conspir constables constabl constancy constanc knackeries knackeri knightly knight kneeling kneel knives knive
terminated termin notices notic generously generous flies fli dies die gas gas hopping hop hoping hope agreed agre relational relat skies sky
proceeded proceed news news happily happili apology apolog y y by by sensational sensat colonizer colon"""


def test_stems():
    pairs = STEMS.split()
    assert {w: stem(w) for w in pairs[::2]} == dict(zip(pairs[::2], pairs[1::2]))


def plain_places(words, item):
    return [k for k in range(len(words)) if all(k + d < len(words) and words[k + d] == s for s, d in item)]


def plain_item(words):
    found = [(stem(w), k) for k, w in enumerate(re.findall(r"[^\W_]+", words)) if w not in STOPS]
    return [(s, k - found[0][1]) for s, k in found]


def plain_spans(words, items):
    """Least intervals that hold all items, by trying all."""
    held = [[(p, p + i[-1][1]) for p in plain_places(words, i)] for i in items]
    full = lambda a, b: all(any(a <= p and e <= b for p, e in own) for own in held)
    sought = {p + d for i in items for p in range(len(words)) for s, d in i if p + d < len(words) and words[p + d] == s}
    total = 0.0
    for a in range(len(words)):
        b = next((b for b in range(a, len(words)) if full(a, b)), None)
        if b is not None and not full(a + 1, b):
            total += 0.1 / (1 + sum(k not in sought for k in range(a, b + 1)))
    return total


def plain_score(text, question):
    words = [stem(w) for w in re.findall(r"[^\W_]+", text.lower())]
    flat = re.sub(r"[?!.]+$", "", " ".join(question.split())).lower()
    terms = [t for t in re.split(r"[^\w-]+", flat) if len(t) > 1 and t not in STOP_WORDS][:24]
    loose = [i for i in map(plain_item, dict.fromkeys(terms)) if i]
    groups, own = [], []
    for no, quoted, word in re.findall(r'(-?)(?:"([^"]*)"|([^\s"]+))', flat):
        if word == "or" and not no:
            groups.append(own)
            own = []
        elif plain_item(quoted or word):
            own.append((plain_item(quoted or word), bool(no)))
    groups = [g for g in [*groups, own] if any(not no for _, no in g)]
    fits = [g for g in groups if all(bool(plain_places(words, i)) != no for i, no in g)]
    if loose:
        single = {i[0][0] for i in loose if len(i) == 1}
        score = 0.1 * sum(w in single for w in words) + 0.1 * sum(len(plain_places(words, i)) for i in loose if len(i) > 1)
    else:
        score = sum(plain_spans(words, [i for i, no in g if not no]) for g in fits)
    return score * (2 if fits else 1)


QUESTIONS = [
    "what is the termination notice period?", '"notice period" -cats', "terminate or notices", "sub-clause payments", "to be or not to be", "", "?!", "-payment", "him himself over",
    '"the notice of payment"', "PAYMENT payments paying", "zebra", None, "9 days", "x", "is 9", 'now "in -out"',
]


def ranked(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r["question_id"], r["rank"])):
        out.setdefault(r["question_id"], []).append((r["chunk_id"], r["score"]))
    return out


@pytest.mark.parametrize("block", [4, 10_000])
def test_words_equal_a_plain_scorer(spark, block):
    r = random.Random(3)
    vocabulary = "notice notices noticed period periods payment pay paying terminate termination of the in sub clause cats cat day days 9 x over him zebra, and".split()
    texts = {k: " ".join(r.choice(vocabulary) + r.choice(["", "", ".", "-", "\n"]) for _ in range(r.randrange(0, 60))) for k in range(700)}
    chunks = spark.createDataFrame([*texts.items(), (9999, None)], "chunk_id long, text string").repartition(3)
    questions = spark.createDataFrame(list(enumerate(QUESTIONS)), "question_id long, question string")
    found = ranked(search.lexical_search(chunks, questions, 25, block))
    for q, question in enumerate(QUESTIONS):
        scores = {k: plain_score(text, question or "") for k, text in texts.items()}
        expected = sorted(((k, round(s, 6)) for k, s in scores.items() if s > 0), key=lambda x: (-x[1], x[0]))[:25]
        assert [k for k, _ in found.get(q, [])] == [k for k, _ in expected], question
        assert [s for _, s in found.get(q, [])] == pytest.approx([s for _, s in expected], abs=2e-6)
    assert sum(map(bool, found.values())) > 8


def test_all_documents_equal_a_plain_scorer(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if r["text"] is not None}
    asked = {k: " ".join(t.split()[3:7]) for k, t in docs.items() if k % 20 == 0}
    chunks = spark.createDataFrame(list(docs.items()), "chunk_id long, text string")
    found = ranked(search.lexical_search(chunks, spark.createDataFrame(list(asked.items()), "question_id long, question string")))
    for q, question in asked.items():
        scores = {k: round(plain_score(text, question), 6) for k, text in docs.items()}
        expected = sorted((k for k, s in scores.items() if s > 0), key=lambda k: (-scores[k], k))[:40]
        assert [k for k, _ in found.get(q, [])] == expected


def test_spans_equal_all_intervals():
    r = random.Random(5)
    for _ in range(300):
        words = [r.choice("abcdz") for _ in range(r.randrange(1, 14))]
        items = [search.Item([(r.choice("abc"), 0)] + ([(r.choice("abc"), 1)] if r.random() < 0.3 else [])) for _ in range(r.randrange(1, 4))]
        held = {s: search.np.array([k for k, w in enumerate(words) if w == s], "int64") for i in items for s, _ in i.stems}
        assert search.covers(items, held) == pytest.approx(plain_spans(words, [i.stems for i in items]))


def test_vectors_that_take_no_part(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0]), (4, None), (5, [float("nan"), 1.0]), (6, [1.0, 1.0]), (7, [1.0, 0.0])]
    chunks = spark.createDataFrame(rows, "chunk_id long, embedding array<double>")
    found = ranked(search.semantic_search(chunks, chunks.withColumnRenamed("chunk_id", "question_id"), 2))
    assert {q: [c for c, _ in own] for q, own in found.items()} == {1: [7, 6], 6: [1, 7], 7: [1, 6]}
    assert search.semantic_search(chunks.limit(0), chunks.withColumnRenamed("chunk_id", "question_id")).count() == 0
    assert search.lexical_search(chunks.select("chunk_id", F.lit("a b").alias("text")), chunks.select(F.col("chunk_id").alias("question_id"), F.lit("b").alias("question")).limit(0)).count() == 0


def test_chunks_below_the_best_are_not_selected():
    scorer = search._Scorer([(7, search.understood("payment notice", ["payment", "notice"]))], 1)
    names = {s: n for n, s in enumerate(sorted(scorer.names))}
    scorer.bind(names)
    add = lambda ids, texts: scorer.add(search.np.array(ids), *search._positions(search.pa.array(texts), names))
    add([5], ["payment notice payment"])
    taken, scorer.best.add = [], lambda ids, *rest: taken.extend(ids.tolist())
    add([6, 8, 9], ["payment", "notice of payment payment", "other"])
    assert not taken
    add([4, 10, 11], ["notice payment payment", "payment notice notice notice", "payment"])
    assert taken == [4, 10]
