"""Joins, substring dedup and components against brute force, and their edge cases."""

import random
import re

import pytest

from paperlume.llm import ngram_join, substring_dedup
from paperlume.llm.components import components


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(w, size):
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def groups(sets, percent):
    parent = {k: k for k in sets}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                shared = len(sets[a] & sets[b])
                if 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
                    x, y = root(a), root(b)
                    parent[max(x, y)] = min(x, y)
    return {k: root(k) for k in sets}


def corpus(seed=1, n=160):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    texts = []
    for _ in range(n):
        if texts and r.random() < 0.6:
            own = r.choice(texts).split()
            for _ in range(r.choice([0, 1, 1, 2, 3])):
                if own:
                    own[r.randrange(len(own))] = r.choice(vocabulary)
            if r.random() < 0.2:
                own = own[: r.randrange(len(own) + 1)]
        else:
            own = [r.choice(vocabulary) for _ in range(r.choice([0, 1, 3, 6, 7, 9, 12, 40, 90, 200]))]
        texts.append(" ".join(own))
    return texts


@pytest.mark.parametrize(("size", "percent"), [(4, 85), (5, 80)])
def test_join_equals_brute_force(spark, size, percent):
    rows = list(enumerate(corpus(size))) + [(1000, None), (1001, ""), (1002, " \n\t"), (1003, "A b"), (1004, "a B")]
    docs = spark.createDataFrame([(i, t, 7, "x") for i, t in rows], "doc_id long, text string, n long, node string")
    sets = {i: shingles(words(t), size) for i, t in rows}
    expected = groups(sets, percent)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join_groups(docs, size, percent).collect()}
    assert found == {i: (len(sets[i]), expected[i]) for i in sets}


def test_join_edges(spark):
    schema = "doc_id long, text string"
    assert ngram_join.join_groups(spark.createDataFrame([], schema)).count() == 0
    docs = spark.createDataFrame([(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (None, "q"), (6, None)], schema)
    found = sorted(((r["doc_id"], r["component_id"]) for r in ngram_join.join_groups(docs).collect()), key=str)
    assert found == sorted([(None, 5), (5, 5), (5, 5), (None, None), (6, 6)], key=str)
    assert ngram_join.keep_one_per_group(docs).count() == 5


def test_size_bands_meet():
    for percent in (80, 85):
        bands = ngram_join.SizeBands(percent)
        for n in range(1, 3000):
            assert bands.band(n * 100 // percent) - bands.band(n) in (0, 1)


@pytest.mark.parametrize("one_task", [0, 1000])
def test_components(spark, one_task):
    edges = [(k, k + 1) for k in range(0, 30)] + [(100, k) for k in range(101, 140)] + [(7, 7), (200, 201), (201, 200), (None, 3)]
    df = spark.createDataFrame(edges, "a long, b long").where("a IS NOT NULL")
    found = {r["node"]: r["component"] for r in components(df, one_task).collect()}
    expected = {k: 0 for k in range(31)} | {k: 100 for k in range(100, 140)} | {200: 200, 201: 200}
    assert found == expected


def test_repeats_are_removed_once(spark):
    r = random.Random(3)
    passage = " ".join(f"p{r.randrange(900)}" for _ in range(60))
    near = passage.replace(passage.split()[30], "other", 1)
    own = [" ".join(f"q{r.randrange(9000)}" for _ in range(50)) for _ in range(4)]
    docs = spark.createDataFrame(
        [(3, f"{own[0]}\n{passage}\nshort line", "en"), (1, f"{passage}", "en"), (2, f"short line\n{near}\n{own[1]}", "en"), (4, own[2], "en"), (5, None, "en"), (6, "", "en"), (None, passage, "en")],
        "doc_id long, text string, line string",
    )
    rows = {(x["doc_id"], x["line"], x["removed"], x["kept_id"]) for x in substring_dedup.repeats(docs).collect()}
    assert rows == {(1, 0, False, 1), (2, 1, True, 1), (3, 1, True, 1)}
    kept = {x["doc_id"]: x["text"] for x in substring_dedup.remove_repeats(docs).collect()}
    assert kept == {1: passage, 2: f"short line\n{own[1]}", 3: f"{own[0]}\nshort line", 4: own[2], 5: None, 6: "", None: passage}
    assert substring_dedup.repeats(docs.limit(0)).count() == 0


def test_running_text_that_repeats_is_removed(spark):
    r = random.Random(5)
    text = lambda n: [f"ü{r.randrange(9000)}" for _ in range(n)]
    passage, other = text(51), text(55)
    long = [" ".join(text(30) + passage + text(60)) for _ in range(2)]
    broken = "\n".join(" ".join(passage[k : k + 9]) for k in range(0, 51, 9))
    twice = f"{' '.join(other)}\n{' '.join(text(6) + other)}"
    rows = [(4, long[1]), (2, long[0]), (6, f"a b\n{broken}\nc d"), (7, " ".join(text(39))), (8, twice), (9, " ".join("x" for _ in range(300)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(x["doc_id"], x["n_words"], x["kept_id"], x["removed"]) for x in substring_dedup.repeats(docs).collect() if x["start"] is not None}
    assert found == {(2, 51, 2, False), (4, 51, 2, True), (6, 51, 2, True), (9, 40, 9, False), (9, 260, 9, True)}
    kept = {x["doc_id"]: x["text"] for x in substring_dedup.remove_repeats(docs).collect()}
    own = long[1].split()
    first = twice.split("\n")[0]
    assert kept == dict(rows) | {4: f"{' '.join(own[:30])}  {' '.join(own[81:])}", 6: "a b\n\nc d", 8: first, 9: "x " * 40}


def test_windows_equal_brute_force(spark):
    r = random.Random(11)
    texts = []
    for _ in range(60):
        own = [f"v{r.randrange(5000)}" for _ in range(r.randrange(5, 120))]
        if texts and r.random() < 0.7:
            source, at = r.choice(texts), r.randrange(0, len(own))
            begin = r.randrange(0, len(source))
            own[at:at] = source[begin : begin + r.randrange(30, 80)]
        texts.append(own)
    joined = [" ".join(w + ("\n" if k % 30 == 29 or r.random() < 0.1 else "") for k, w in enumerate(own)) for own in texts]
    docs = spark.createDataFrame(list(enumerate(joined)), "doc_id long, text string")
    seen, left = set(), {}
    for k, own in enumerate(texts):
        windows = [tuple(own[a : a + 40]) for a in range(len(own) - 39)]
        cut = {a + d for a, w in enumerate(windows) if w in seen for d in range(40)}
        seen |= set(windows)
        left[k] = [w for a, w in enumerate(own) if a not in cut]
    assert any(len(left[k]) < len(own) for k, own in enumerate(texts))
    # No line has 40 words here, so only running text is compared.
    assert all(len(line.split()) < 40 for text in joined for line in text.split("\n"))
    assert {x["doc_id"]: x["text"].split() for x in substring_dedup.remove_repeats(docs).collect()} == left
