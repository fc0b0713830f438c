"""Chunks of units and coverage against plain loops over all documents, and their edge cases."""

import math
import random
import re

import pytest

from paperlume.operators import documents

SF = "/root/testdata/sf0.001"


def tokens(text):
    return math.ceil(len(text) / 3.6)


def plain_pieces(text, target, most, overlap):
    if tokens(text) <= most:
        return [text]
    out, held = [], ""
    for part in re.split("\n\n+", text):
        if not part.strip():
            continue
        if tokens(part) > most:
            if held.strip():
                out.append(held.strip())
            held, run = "", ""
            for sentence in re.findall(r"[^.!?]+[.!?]+\s*|[^.!?]+$", part) or [part]:
                if run and tokens(run + sentence) > target:
                    out.append(run.strip())
                    run = sentence
                else:
                    run += sentence
                while tokens(run) > most:
                    cut = math.floor(most * 3.6)
                    out.append(run[:cut].strip())
                    run = run[cut:]
            if run.strip():
                out.append(run.strip())
            continue
        both = held + "\n\n" + part if held else part
        if held and tokens(both) > target:
            out.append(held.strip())
            end = out[-1][-math.floor(overlap * 3.6) :] if overlap else ""
            at = re.search(r"[.!?]\s", end)
            clean = (end[at.start() + 2 :] if at else end).strip()
            held = clean + "\n\n" + part if clean else part
        else:
            held = both
    if held.strip():
        out.append(held.strip())
    return out or [text]


def plain_chunks(units):
    """Chunks (unit, text) of one document's units (unit, kind, title, text)."""
    sizes = {"SLIDES": (220, 450, 12, 0), "SPREADSHEET": (420, 800, 20, 0), "IMAGE": (320, 600, 8, 0)}
    out, carry = [], None
    for n, (unit, kind, title, text) in enumerate(units):
        target, most, least, overlap = sizes.get(kind, (320, 600, 40, 48))
        pieces = plain_pieces(text, target, most, overlap) if text else []
        for k, piece in enumerate(pieces):
            if carry:
                piece, carry = carry[2] + "\n\n" + piece, None
            if tokens(piece) < least and k == len(pieces) - 1 and n < len(units) - 1:
                carry = (unit, title, piece)
                continue
            out.append((unit, title, piece))
    if carry:
        out.append(carry)
    return [(unit, f"{title}\n{piece}" if title and not piece.startswith(title) else piece) for unit, title, piece in out]


def words(r, n):
    return " ".join("".join(r.choice("abcdefg") for _ in range(r.randrange(1, 9))) + r.choice(["", "", "", ".", "!", "?"]) for _ in range(n))


def test_chunks_equal_a_plain_loop(spark):
    r, rows = random.Random(2), []
    for doc in range(60):
        for unit in range(r.randrange(1, 7)):
            text = "\n\n".join(words(r, r.choice([1, 3, 8, 60, 300, 900])) for _ in range(r.choice([0, 1, 1, 2, 9])))
            rows.append((doc, unit, r.choice([None, "SLIDES", "SPREADSHEET", "IMAGE", "PDF"]), r.choice([None, "Title", "a"]), text))
    rows.append((99, 0, None, None, "x" * 9000))
    rows += [(100, 0, None, "T", "tail"), (100, 1, None, None, None), (100, 2, None, None, "end"), (101, 0, None, "Only", "short"), (101, 1, None, None, "")]
    shuffled = rows[:]
    r.shuffle(shuffled)
    found: dict[int, list] = {}
    for c in documents.chunk_units(spark.createDataFrame(shuffled, "id long, unit int, kind string, title string, text string")).orderBy("id", "chunk").collect():
        found.setdefault(c["id"], []).append((c["unit"], c["text"]))
        assert c["chunk"] == len(found[c["id"]]) - 1 and c["tokens"] == tokens(c["text"])
    clean = lambda t: re.sub(" {2,}", " ", t or "").strip()
    for doc in {x[0] for x in rows}:
        assert found.get(doc, []) == plain_chunks([(u, k, t, clean(text)) for d, u, k, t, text in sorted(rows, key=lambda x: x[:2]) if d == doc])
    # A short tail rides with the next unit; one that no unit follows stands alone.
    assert found[100] == [(2, "tail\n\nend")] and found[101] == [(0, "Only\nshort")]


def test_chunks_of_all_documents_equal_a_plain_loop(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    units: dict[int, list] = {}
    for s in documents.split_sections(docs).orderBy("doc_id", "section").collect():
        units.setdefault(s["doc_id"], []).append((s["section"], None, s["title"], re.sub("\n{3,}", "\n\n", s["text"]).strip()))
    found: dict[int, list] = {}
    for c in documents.chunk_documents(docs).orderBy("doc_id", "chunk").collect():
        found.setdefault(c["doc_id"], []).append((c["unit"], c["text"]))
    assert found == {k: plain_chunks(v) for k, v in units.items()}


def plain_coverage(units, chunks):
    flat = lambda t: re.sub(r"\s+", " ", t or "").strip()
    hay, total, covered, gaps = "\n".join(map(flat, chunks)), 0, 0, []
    for unit, text in units:
        text, gap = flat(text), None
        total += len(text)
        for m in re.finditer(r"[^.!?\n]+[.!?\n]*", text):
            if not m[0].strip():
                covered += len(m[0])
            elif m[0].strip() in hay:
                covered += len(m[0])
                gaps, gap = gaps + [gap] * bool(gap), None
            else:
                gap = (gap[0], gap[1], gap[2] + len(m[0])) if gap else (unit, m.start(), len(m[0]))
        gaps, gap = gaps + [gap] * bool(gap), None
    gaps = sorted((g for g in gaps if g[2] >= 120), key=lambda g: -g[2])[:20]
    return total, min(covered, total), gaps


def test_coverage_equals_substring_search(spark):
    r, units, chunks = random.Random(6), [], []
    for doc in range(40):
        for unit in range(r.randrange(0, 4)):
            text = " \n".join(words(r, r.choice([3, 30, 200])) for _ in range(r.randrange(0, 8)))
            units.append((doc, unit, r.choice([text, "... .", "", None, text])))
            cut = r.randrange(0, len(text) + 1)
            chunks += [(doc, len(chunks), part) for part in (text[:cut].upper() if r.random() < 0.2 else text[:cut], text[cut + r.randrange(0, 300) :]) if r.random() < 0.8]
    kept = "The parties agree to the following terms and conditions in full. " * 6
    dropped = "The indemnity in clause nine survives termination of this agreement. " * 6
    units += [(100, 0, kept + dropped), (101, 0, "Same. " * 50_000)]
    chunks += [(100, 0, kept), (101, 0, "Same. " * 40_000), (102, 0, "no units")]
    found = {x["id"]: x for x in documents.coverage(spark.createDataFrame(units, "id long, unit int, text string"), spark.createDataFrame(chunks, "id long, chunk int, text string")).collect()}
    assert found.keys() == {u[0] for u in units}
    for doc, row in found.items():
        total, covered, gaps = plain_coverage([u[1:] for u in units if u[0] == doc], [c[2] for c in sorted(chunks) if c[0] == doc])
        assert (row["eligible"], row["covered"]) == (total, covered) and row["coverage"] == pytest.approx(covered / total if total else 1.0)
        assert [(g["unit"], g["start"], g["length"]) for g in row["gaps"]] == gaps
    assert found[100]["coverage"] < 0.995 and "indemnity" in found[100]["gaps"][0]["excerpt"] and found[101]["coverage"] == 1.0
    assert len({row["coverage"] for row in found.values()}) > 5


def test_index_of_windows():
    index = documents.TextIndex("the cat sat on the mat by the cat" + chr(0x1F600))
    for probe in ("t", "the cat", "cat" + chr(0x1F600), "the cat sat on the mat by the cat", "x", "the dog", "by the catt", "a" * 60):
        assert index.has(probe) == (probe in index.text)
    assert not documents.TextIndex("").has("a")


def test_probes_in_order_of_a_long_text_need_no_hashes(spark):
    sentences = [f"Sentence {k} of the long text says {k * k}." for k in range(2000)]
    held = documents.TextIndex(" ".join(sentences))
    assert all(held.has(s) for s in sentences) and not held.tables
    assert held.has(sentences[7]) and not held.has("Sentence 7 is not of this text.") and held.tables
    short = documents.TextIndex("b a")
    assert short.has("a") and short.has("b") and not short.has("c") and not short.tables


def test_arrow_batches_of_documents_are_bounded(spark):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    docs = spark.createDataFrame([(1, "One text.")], "doc_id long, text string")
    documents.coverage(docs.selectExpr("doc_id AS id", "0 AS unit", "text"), docs.selectExpr("doc_id AS id", "0 AS chunk", "text"))
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "1m"
