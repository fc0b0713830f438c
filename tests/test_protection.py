"""Quotes within budgets, against a plain loop over all sessions and on hand-made ones; golden cases by brute force."""

import random
import re

import pytest

from paperlume.operators import golden, protection

SF = "/root/testdata/sf0.001"
CITED = "session long, seq long, answer string, place long, source long, quote string, relevance double"
SOURCES = "answer string, source long, text string, unit string"


def plain_cut(quote, room):
    if room <= 0:
        return None
    if len(quote) <= room:
        return quote
    if room == 1:
        return None
    part = quote[: room - 1]
    at = part.rfind(" ")
    return (part[:at] if at > (room - 1) * 0.6 else part).rstrip() + "…"


def plain_fold(cited, sources, answer_most, session_most):
    """(session, answer, source, rank, verdict, quote, used before) by loops over answers and citations."""
    texts = {(a, s): t for a, s, t, _ in sources}
    form = lambda t: re.sub(r"\s+", " ", t).strip().lower()
    out = []
    for session in sorted({c[0] for c in cited}):
        used = 0
        for seq, answer in sorted({(c[1], c[2]) for c in cited if c[0] == session}):
            best = {}
            for c in sorted((c for c in cited if c[:3] == (session, seq, answer) and (answer, c[4]) in texts), key=lambda c: (-(c[6] or 0), c[3])):
                best.setdefault(c[4], c)
            taken = 0
            for rank, c in enumerate(best.values(), 1):
                quote = verdict = None
                if c[5] is not None:
                    verdict = "short" if len(form(c[5])) < 8 else "verified" if form(c[5]) in form(texts[answer, c[4]]) else "absent"
                if verdict == "verified":
                    quote = plain_cut(c[5].strip(), min(session_most - used, answer_most - taken))
                    taken += len(quote or "")
                out.append((session, answer, c[4], rank, verdict, quote, used))
            used += taken
    return out


def resolved(spark, cited, sources, mode="STRICT"):
    rows = protection.resolve_citations(spark.createDataFrame(cited, CITED), spark.createDataFrame(sources, SOURCES), mode).collect()
    return sorted(((r["session"], r["answer"], r["source"], r["rank"], r["verdict"], r["quote"], r["session_used"]) for r in rows), key=str)


def test_fold_equals_a_plain_loop(spark):
    r = random.Random(4)
    cited, sources = [], []
    for session in range(3):
        for seq in range(70):
            answer = f"{session}:{seq}"
            for source in range(3):
                text = " ".join(r.choice(["alpha", "be", "gammadelta" * r.choice([1, 9])]) for _ in range(90))
                sources.append((answer, source, text, f"u{session}{source}"))
                for k in range(r.randrange(0, 3)):
                    begin = r.randrange(0, 100)
                    quote = r.choice([text[begin : begin + r.choice([3, 30, 300, 600])].upper(), "not in any source at all", None])
                    cited.append((session, seq, answer, len(cited), r.choice([source, source, 7]), quote, r.choice([None, 0.1, 0.5, 0.5])))
    r.shuffle(cited)
    found = resolved(spark, cited, sources)
    assert found == sorted(plain_fold(cited, sources, 500, 6000), key=str)
    by_answer, by_session = {}, {}
    for session, answer, _, _, _, quote, _ in found:
        by_answer[answer] = by_answer.get(answer, 0) + len(quote or "")
        by_session[session] = by_session.get(session, 0) + len(quote or "")
    assert max(by_answer.values()) <= 500 and max(by_session.values()) <= 6000 and max(by_session.values()) > 5900
    assert any(q is None and v == "verified" for *_, v, q, _ in found)


def test_all_sessions_equal_a_plain_loop(spark):
    cited, sources = protection.session_citations(spark, SF)
    cited = [tuple(r[c.split()[0]] for c in CITED.split(", ")) for r in cited.collect()]
    sources = [tuple(r[c.split()[0]] for c in SOURCES.split(", ")) for r in sources.collect()]
    rows = protection.resolve_citations_query(spark, SF).collect()
    found = sorted(((r["session"], r["answer"], r["source"], r["rank"], r["verdict"], r["quote"], r["session_used"]) for r in rows), key=str)
    assert found == sorted(plain_fold(cited, sources, 500, 6000), key=str)
    assert any(r["truncated"] for r in rows)
    state = {r["session"]: r for r in protection.extraction_state_query(spark, SF).collect()}
    for session, row in state.items():
        own = [r for r in rows if r["session"] == session]
        assert row["quoted_chars"] == sum(len(r["quote"] or "") for r in own) and row["units"] == len({r["unit"] for r in own})


@pytest.mark.parametrize(("quote", "room", "shown"), [("one two three", None, "one two three"), ("one two three", 13, "one two three"), ("one two three", 12, "one two…"), ("x" * 50, 11, "x" * 10 + "…"), ("abc", 1, None), ("abc", 0, None), ("abc", -5, None), ("a bcdefghijkl", 8, "a bcdef…"), ("", 0, None)])
def test_cuts(quote, room, shown):
    assert protection.cut_quote(quote, room) == shown


def test_no_budget_and_no_citations(spark):
    long = "word " * 2000
    assert [x[5] for x in resolved(spark, [(1, 1, "a", 1, 1, long, None)], [("a", 1, long, None)], "OFF")] == [long.strip()]
    assert protection.resolve_citations(spark.createDataFrame([], CITED), spark.createDataFrame([], SOURCES), "STANDARD").count() == 0
    state = protection.extraction_state(protection.resolve_citations(spark.createDataFrame([], CITED), spark.createDataFrame([], SOURCES), "STRICT"), spark.createDataFrame([(1, True, None), (1, None, True)], "session long, attempt boolean, delivered boolean"))
    assert [tuple(r) for r in state.collect()] == [(1, 1, 0, 0, 1)]


RESULTS = "release int, case long, rank int, file string, page int, sheet string, text string"
EVIDENCE = "case long, expectation int, file string, page int, sheet string, quote string"


def test_expectations_equal_brute_force(spark):
    r = random.Random(9)
    results = [(y, c, k, r.choice("ab"), r.choice([1, 2, None]), r.choice(["S", "T", None]), r.choice(["The  Fee is 5", "other", None])) for y in (1, 2, 4) for c in range(12) for k in range(1, 9) if not (y == 2 and c == 3)]
    evidence = [(c, e, r.choice("abc"), r.choice([1, None, None]), r.choice(["S", None, None]), r.choice([None, "fee IS", "", "absent"])) for c in range(12) for e in range(1, 5)]
    flat = lambda t: re.sub(r"\s+", " ", t).strip().lower()

    def meets(x, v):
        return x[3] == v[2] and v[3] in (None, x[4]) and v[4] in (None, x[5]) and (not v[5] or x[6] is not None and flat(v[5]) in flat(x[6]))

    expected = {}
    for x in results:
        own = [v[1] for v in evidence if v[0] == x[1] and meets(x, v)]
        if own:
            expected[x[:3]] = min(own)
    frame, wanted = spark.createDataFrame(results, RESULTS), spark.createDataFrame(evidence, EVIDENCE)
    met = golden.satisfied(frame, wanted)
    assert {(x["release"], x["case"], x["rank"]): x["expectation"] for x in met.collect()} == expected
    cases = frame.select("release", "case").distinct().join(wanted.groupBy("case").count().withColumnRenamed("count", "wanted"), "case")
    compared = {(x["release"], x["case"]): x for x in golden.against_previous(golden.case_outcomes(cases, met)).collect()}
    for (year, case), row in compared.items():
        ranks = [k for (y, c, k) in expected if (y, c) == (year, case)]
        assert row["first_rank"] == (min(ranks) if ranks else None) and row["hit_at_5"] == bool(ranks and min(ranks) <= 5)
        assert row["precision"] == pytest.approx(sum(k <= 5 for k in ranks) / 5)
        before = max((y for (y, c) in compared if c == case and y < year), default=None)
        assert row["previous_release"] == before and row["previous_hit"] == (None if before is None else compared[before, case]["hit_at_5"])
        assert row["regressed"] == bool(row["previous_hit"] and not row["hit_at_5"])
    assert compared[4, 3]["previous_release"] == 1
    assert golden.satisfied(frame.limit(0), wanted).count() == 0
