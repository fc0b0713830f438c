"""Filter audit, Merkle manifest and MinHash groups against brute force, and their edge cases."""

import glob
import hashlib
import os
import random
import re
import zlib
from itertools import permutations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from paperlume.llm import filter_audit, merkle, minhash_dedup, queries
from paperlume.llm._spark import table

SF = "/root/testdata/sf0.001"


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_merkle_manifest"])
def test_sql(spark, duck, name):
    result = duck.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in result.description]
    found = queries.QUERIES[name](spark, SF)
    assert sorted(names) == sorted(found.columns)
    assert sorted((tuple(r[n] for n in names) for r in found.collect()), key=str) == sorted(result.fetchall(), key=str)


def plain_audit(docs, labels):
    """Documents (id, lang, text) and labels (id, quality, toxic), one order and one document at a time."""
    good, toxic = ({i for i, *flags in labels if flags[k] == 1 and i is not None} for k in (0, 1))
    fails, out = [], {}
    for i, lang, text in docs:
        own, text = words(text), text or ""
        smaller = i is not None and any(j is not None and j < i and (t or "") == text for j, _, t in docs)
        tests = {
            "A": len(own) < 100,
            "B": 100 * len(set(own)) < 80 * len(own),
            "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            "D": bool(re.search("[#$%&*|]", text)),
            "E": smaller,
        }
        fails.append((lang or "", i, {k for k, failed in tests.items() if failed}))
    for part in {p for p, _, _ in fails}:
        total = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = [(i, f) for p, i, f in fails if p == part]
            gone = []
            for step, name in enumerate(order, 1):
                now = [(i, f) for i, f in left if name in f]
                redundant = sum(name in f for _, f in gone)
                left = [(i, f) for i, f in left if name not in f]
                total[name] += len(now)
                unique = sum(f == {name} for p, _, f in fails if p == part)
                out[part, order, step] = [len(left), len(now), redundant, unique, sum(i in good for i, _ in now), sum(i in toxic for i, _ in now)]
                gone += now
        for (p, order, step), row in out.items():
            if p == part:
                row.append(total[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def test_audit_equals_brute_force(spark):
    r = random.Random(7)
    long = " ".join(f"w{k}" for k in range(120))
    docs = [(k, r.choice(["de", "en", None]), r.choice([long, long + " $", "AB " * 130, "ü É", "", None, f"{long} {k}", "A B c"])) for k in range(70)]
    docs += [(3, "de", long), (3, "de", long), (None, "en", long), (None, None, None), (-4, "fr", long)]
    labels = [(k, r.choice([0, 1, None]), r.choice([0, 1])) for k in range(0, 70, 2)] + [(3, 1, 0), (3, 0, 1), (None, 1, 1), (999, 1, 1)]
    frame = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, lang string, text string, mask int, part string")
    rows = filter_audit.audit(filter_audit.cells(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))).collect()
    found = {(x["part"], x["filter_order"], x["step"]): tuple(x)[3:] for x in rows}
    assert len(found) == len(rows) and found == plain_audit(docs, labels)


def test_audit_edges(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    empty = spark.createDataFrame([], "doc_id long, lang string, text string")
    assert filter_audit.audit(filter_audit.cells(empty, labels)).count() == 0
    huge = "word %d " * 400_000
    counted = filter_audit.cells(spark.createDataFrame([(1, "en", huge), (2, "en", huge)], empty.schema), labels).collect()
    assert sorted((c["mask"], c["n"]) for c in counted) == [(2 + 8, 1), (2 + 8 + 16, 1)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def plain_tree(nodes):
    """The root of these nodes, and for each what stands left and right of it level by level."""
    sides, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        for k, place in enumerate(at):
            begin = place // 16 * 16
            sides[k].append(("".join(level[begin:place]), "".join(level[place + 1 : begin + 16])))
        level, at = [sha("".join(level[k : k + 16])) for k in range(0, len(level), 16)], [k // 16 for k in at]
    return level[0], sides


def plain_manifest(docs):
    leaves = [(*d, sha("".join(map(field, d)))) for d in docs]
    groups, out = {}, []
    for row in sorted(leaves, key=lambda x: (x[0] is not None, x[0] or 0, x[-1])):
        groups.setdefault(row[1], []).append(row)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_tree([x[-1] for x in groups[s]]) for s in names}
    root, over = plain_tree([trees[s][0] for s in names])
    for s, upper in zip(names, over):
        for row, sides in zip(groups[s], trees[s][1]):
            tampered = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0
            text = row[4]
            if tampered and text is not None:
                text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
            node = sha("".join(map(field, (*row[:4], text))))
            for left, right in sides + upper:
                node = sha(left + node + right)
            proof = sha("".join(a + b for a, b in sides + upper))
            out.append((row[0], row[-1], trees[s][0], root, proof, node, node == root))
    return out


MANIFEST = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("height", [1, 2, 3])
def test_manifest_equals_brute_force(spark, height):
    r = random.Random(height)
    sources = ["hot", None, "", "é", "Z", "a", *[f"s{k}" for k in range(30)]]
    docs = [(k if r.random() < 0.97 else None, sources[min(r.choice([0, 0, r.randrange(40)]), 35)], r.choice(["de", None]), r.choice([k, None]), r.choice([f"Text {k}", "ÄB C", "", None])) for k in range(700)]
    docs += docs[:9] + [(5, "hot", None, 1, "other"), (10**12, "hot", "en", 2, "X" * 300_000)]
    frame = spark.createDataFrame([(*d, "c", 1) for d in docs], MANIFEST + ", leaf string, i int").repartition(5)
    found = [tuple(x) for x in merkle.manifest(frame, merkle.tampered_text(), height=height).collect()]
    assert sorted(found, key=str) == sorted(plain_manifest(docs), key=str)
    assert {x[-1] for x in found} == {True, False}


def test_manifest_over_several_blocks(spark):
    docs = [(k, "hot", "en", 1, f"T{k}") for k in range(4500)] + [(k, "b", "en", 1, "t") for k in range(4096)] + [(7, "one", None, None, "only")]
    found = [tuple(x) for x in merkle.manifest(spark.createDataFrame(docs, MANIFEST), merkle.tampered_text()).collect()]
    assert sorted(found) == sorted(plain_manifest(docs))


def test_manifest_edges(spark):
    empty = spark.createDataFrame([], MANIFEST)
    assert merkle.manifest(empty, merkle.tampered_text()).count() == 0
    (row,) = merkle.manifest(spark.createDataFrame([(None, None, None, None, None)], MANIFEST)).collect()
    assert row["leaf"] == row["subroot"] == row["root"] == row["folded_root"] == sha("-----") and row["proof_sha256"] == sha("") and row["verified"]


def test_traversal_holds_few_nodes():
    leaves = [sha(str(k)) for k in range(4096)]
    root, sides = plain_tree(leaves)
    walk, most = merkle.Traversal(leaves, 3), 0
    assert walk.root == root
    for k in range(4096):
        if k % 97 == 0:
            assert walk.path() == sides[k]
        most = max(most, sum(map(len, walk.existing)) + sum(len(row) for made in walk.desired for row in made.rows))
        walk.step()
    assert most <= 3 * 2 * 16 + 3 * 16


def shingles(text, size=3):
    own = [w.lower() for w in words(text)]
    return {tuple(own[k : k + size]) for k in range(len(own) - size + 1)} if len(own) >= size else {tuple(own)} if own else set()


def plain_groups(docs):
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(docs)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                root[top(a)] = top(b)
    ids = {}
    for k, (i, _) in enumerate(docs):
        ids.setdefault(top(k), []).append(i)
    out = []
    for k, (i, _) in enumerate(docs):
        known = [x for x in ids[top(k)] if x is not None]
        least = min(known) if known else None
        out.append((i, len(sets[k]), least, i == least))
    return out


def test_groups_equal_brute_force(spark):
    r = random.Random(13)
    texts = []
    for _ in range(260):
        if texts and r.random() < 0.7:
            own = r.choice(texts).split()
            for _ in range(r.choice([0, 1, 1, 2])):
                if own:
                    own[r.randrange(len(own))] = f"w{r.randrange(500)}"
            own += [f"w{r.randrange(500)}"] * r.choice([0, 0, 1])
        else:
            own = [f"w{r.randrange(500)}" for _ in range(r.choice([0, 1, 2, 3, 5, 20, 50, 120, 400]))]
        texts.append(" ".join(own))
    docs = list(enumerate(texts)) + [(1000, None), (1001, " \n"), (None, texts[0]), (None, "only here , twice"), (None, "Only HERE , twice"), (4, texts[4]), (4, "quite another text of its own"), (2000, "é x " * 50_000)]
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, node int, key string")
    found = [tuple(x)[:4] for x in minhash_dedup.dedup(frame).collect()]
    assert sorted(found, key=str) == sorted(plain_groups(docs), key=str)


def test_groups_of_the_given_documents_equal_brute_force(spark):
    docs = [(x["doc_id"], x["text"]) for x in table(spark, SF, "documents").collect()]
    found = [(x["doc_id"], x["n_shingles"], x["component_id"], x["kept"]) for x in queries.op13_minhash_dedup(spark, SF).collect()]
    assert sorted(found) == sorted(plain_groups(docs))
    assert minhash_dedup.dedup(table(spark, SF, "documents").limit(0)).count() == 0


def test_bins_agree_as_often_as_sets_do():
    hashing, r = minhash_dedup.OnePermutation(), np.random.default_rng(2)
    for n in (4, 30, 2000):
        agreed, expected = [], []
        for _ in range(60):
            a = r.integers(0, 2**63, n, dtype=np.uint64)
            b = np.r_[a[: n - max(1, n // 8)], r.integers(0, 2**63, max(1, n // 8), dtype=np.uint64)]
            agreed.append((hashing.values(np.sort(a)) == hashing.values(np.sort(b))).mean())
            expected.append(len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
        assert abs(np.mean(agreed) - np.mean(expected)) < 0.05
    one = np.array([5], np.uint64)
    assert (hashing.values(one) == hashing.values(one)[0]).all()


def test_long_texts_of_a_third_of_all_rows(spark):
    frame = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("one text " * 20)).otherwise(F.concat_ws(" ", *(F.xxhash64("id", F.lit(k)).cast("string") for k in range(12)))).alias("text"))
    found = minhash_dedup.dedup(frame).groupBy("component_id").count().where("count > 1").collect()
    assert [tuple(x) for x in found] == [(0, 1000)]
