"""Figures, sentences, quotes and rates of answers on hand-made cases and against plain loops over all conversations."""

import math
import random
import re
import unicodedata

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from paperlume.functions.numbers import number_rows, numbers_in
from paperlume.operators import claims
from paperlume.plans import registry

SF = "/root/testdata/sf0.001"
CHECKS = [
    ("The annual licence costs €50,000.", "Fees. The annual licence fee is €50,000, payable in advance.", []),
    ("The annual licence costs €500,000.", "The annual licence fee is €50,000, payable in advance.", [("magnitude", 10.0)]),
    ("There were 4,812 incidents.", "The report gives no count.", [("absent", None)]),
    ("The cap is $2,000,000.", "The liability cap is €2,000,000.", [("currency", 1.0)]),
    ("roughly 61.8% of revenue", "margin was 61.9%", []),
    ("See clause 4 on page 7.", "Clause text with no numbers.", []),
    ("growth of 12%", "12 units", [("absent", None)]),
    ("about 1.5 million and 0 USD", "1500000 then 0", []),
    ("70 or 90", "80 and 60", [("absent", 0.875), ("absent", 1.125)]),
    ("75", "80 and 70", [("absent", 0.9375)]),
    ("75", "70 and 80", [("absent", 75 / 70)]),
    ("20 EUR", "20 USD, 20 EUR", [("currency", 1.0)]),
    (None, "5", []),
]


def checked(spark, cases):
    said = spark.createDataFrame([(k, 0, a) for k, (a, _, _) in enumerate(cases)], "answer long, claim int, text string")
    held = spark.createDataFrame([(k, e) for k, (_, e, _) in enumerate(cases)], "answer long, text string")
    return claims.numeric_check(number_rows(said), number_rows(held))


def test_figures_against_evidence(spark):
    found = {}
    for r in checked(spark, CHECKS).where("reason IS NOT NULL").orderBy("answer", "place").collect():
        found.setdefault(r["answer"], []).append((r["reason"], r["ratio"]))
    for k, (_, _, expected) in enumerate(CHECKS):
        assert [x[0] for x in found.get(k, [])] == [x[0] for x in expected], CHECKS[k]
        assert [x[1] for x in found.get(k, [])] == pytest.approx([x[1] for x in expected])


def plain_check(answer, evidence):
    """Reasons of an answer's material numbers, one pair of numbers at a time."""
    held, out = numbers_in(evidence), []
    for _, value, code, percent, factor in numbers_in(answer):
        if not (code or percent or factor > 1 or value >= 10):
            continue
        own = [h for h in held if h[3] == percent]
        same = [h for h in own if h[1] == value or abs(h[1] - value) / max(h[1], value) <= 0.005]
        if same:
            out.append("currency" if code and same[0][2] and code != same[0][2] else None)
            continue
        best = min(own, key=lambda h: abs(h[1] - value), default=None)
        power = math.log10(value / best[1]) if best and best[1] and value else 0.0
        out.append("magnitude" if abs(power - round(power)) < 0.02 and round(power) else "absent")
    return out


def test_figures_equal_a_loop_over_pairs(spark):
    cases, seed = [], 1
    for _ in range(150):
        values = []
        for _ in range(14):
            seed = seed * 48271 % 2147483647
            unit = ["", "%", " EUR", " USD", "k", " million"][seed % 6]
            values.append(f"{(seed // 7 % 40) * [1, 1, 10, 0.999, 100][seed % 5]:.2f}{unit}")
        cases.append((" and ".join(values[:5]), " or ".join(values[5:]), None))
    found = {}
    for r in checked(spark, cases).collect():
        found.setdefault(r["answer"], {})[r["place"]] = r["reason"]
    for k, (a, e, _) in enumerate(cases):
        assert [x for _, x in sorted(found.get(k, {}).items())] == plain_check(a, e), (a, e)


def test_numbers_with_other_blanks(spark):
    blank = chr(0xA0)
    assert [(n[1], n[2]) for n in numbers_in(f"€{blank}50,000 and 4.2{blank}million")] == [(50000.0, "EUR"), (4.2e6, None)]
    assert numbers_in("9" * 400) == []
    rows = number_rows(spark.createDataFrame([(1, "a 5 b 6%"), (2, None), (3, "none")], "id long, text string")).collect()
    assert [(r["id"], r["place"], r["value"], r["percentage"]) for r in rows] == [(1, 0, 5.0, False), (1, 1, 6.0, True)]
    assert number_rows(spark.createDataFrame([], "id long, text string")).count() == 0


UPTIME = "The service level agreement guarantees ninety-nine point nine percent monthly uptime. Credits are issued automatically when the monthly uptime falls below that threshold."
SENTENCES = [
    ("The agreement guarantees monthly uptime, and credits are issued automatically when uptime falls below the threshold.", UPTIME, ["SUPPORTED"]),
    ("The vendor also indemnifies the customer against third-party patent litigation worldwide.", UPTIME, ["UNSUPPORTED"]),
    ("The service level agreement guarantees 99.9% monthly uptime for €500,000 per year.", "The service level agreement guarantees 99.9% monthly uptime for €50,000 per year.", ["UNSUPPORTED"]),
    ("I could not find that in the shared material. Try asking about the uptime guarantee.", UPTIME, []),
    ("Clause 4.2 grants uptime credits monthly. Too short. Exact crédits are issued! \"Quoted uptime falls\"", UPTIME, ["SUPPORTED"] * 3),
    ("", UPTIME, []),
    (None, UPTIME, []),
    ("To be or not to be, this is it.", UPTIME, ["SUPPORTED"]),
]


def test_sentences_against_evidence(spark):
    answers = spark.createDataFrame([(k, a) for k, (a, _, _) in enumerate(SENTENCES)], "answer long, text string")
    # The evidence comes in two passages; words and figures of both count.
    evidence = spark.createDataFrame([(k, p, part) for k, (_, e, _) in enumerate(SENTENCES) for p, part in enumerate(e.split(". ", 1))], "answer long, passage int, text string")
    found = {}
    for r in claims.groundedness(answers, evidence).orderBy("answer", "claim").collect():
        found.setdefault(r["answer"], []).append(r["support"])
    assert found == {k: s for k, (_, _, s) in enumerate(SENTENCES) if s}


def plain_sentences(text):
    flat = re.sub(r"\s+", " ", text)
    return [s for s in (p.strip(" ") for p in re.split("(?<![A-Z0-9])[.!?]+(?= +[A-Z" + chr(0x201C) + "\"']| *\\Z)", flat)) if s]


def plain_words(text):
    bare = "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not 0x300 <= ord(c) <= 0x36F)
    return [w for w in re.split(r"[^\w%€$£]+|_", bare) if len(w) > 2 and w not in claims.COMMON]


def plain_support(answer, evidence):
    out, held = [], set(w for e in evidence for w in plain_words(e))
    for k, s in enumerate(plain_sentences(answer)):
        if len(s) <= 15 or re.match(claims.NON_FACTUAL, s):
            continue
        own = plain_words(s)
        overlap = sum(w in held for w in own) / len(own) if own else 1.0
        agree = not any(plain_check(s, " | ".join(evidence)))
        out.append((k, round(overlap + 1e-12, 3), agree, "UNSUPPORTED" if not agree or overlap < 0.3 else "INFERRED" if overlap < 0.6 else "SUPPORTED"))
    return out


@pytest.fixture(scope="module")
def turns(spark):
    answers, evidence = claims.turns_with_evidence(spark, SF)
    held = {}
    for r in evidence.orderBy("answer", "passage").collect():
        held.setdefault(r["answer"], {})[r["passage"]] = r["text"]
    return {r["answer"]: (r["text"], held.get(r["answer"], {})) for r in answers.collect()}


def test_support_equals_plain_loops_on_all_conversations(spark, turns):
    found = {}
    for r in claims.claim_support_query(spark, SF).collect():
        found.setdefault(r["answer"], []).append((r["claim"], r["overlap"], r["figures_agree"], r["support"]))
    expected = {k: plain_support(text, list(held.values())) for k, (text, held) in turns.items()}
    assert {k: sorted(v) for k, v in found.items()} == {k: v for k, v in expected.items() if v}
    assert len({x[3] for v in expected.values() for x in v}) > 1


def test_rates_equal_plain_loops_on_all_conversations(spark, turns):
    found = {r["answer"]: r for r in claims.verify_answer(spark, SF).collect()}
    assert found.keys() == turns.keys()
    form = lambda s: re.sub(r"\s+", " ", s).strip().lower()
    for k, (text, held) in turns.items():
        first, own = held.get(1), text.split(" ")[2:6]
        quotes = [("  ".join(first.split(" ")[1:7]) if first is not None else None, held.get(1)), (" ".join(own), held.get(2)), (None, held.get(3))]
        offered = [(q, s) for q, s in quotes if q is not None and s is not None]
        verified = sum(len(form(q)) >= 8 and form(q) in form(s) for q, s in offered)
        r = found[k]
        assert r["cited"] == 3 and r["citation_validity"] == pytest.approx(sum(s is not None for _, s in quotes) / 3, abs=1e-6)
        assert (r["quotes"], r["quote_fidelity"]) == (len(offered), pytest.approx(verified / len(offered) if offered else 1.0, abs=1e-6))
        support = plain_support(text, list(held.values()))
        assert r["claims"] == len(support) and r["unsupported_rate"] == pytest.approx(sum(s[3] == "UNSUPPORTED" for s in support) / len(support) if support else 0.0, abs=1e-6)
    assert len({r["quote_fidelity"] for r in found.values()}) > 1 and len({r["citation_validity"] for r in found.values()}) > 1


def test_rates_of_refusals_and_bare_answers(spark):
    answers = spark.createDataFrame([(1, "I could not find that in the shared material. It costs €9,000 though."), (2, "It costs €9,000 in total a year."), (3, None)], "answer long, text string")
    evidence = spark.createDataFrame([(2, 1, "The total cost is €9,000.")], "answer long, passage int, text string")
    cited = spark.createDataFrame([(2, 1, "total  COST is"), (2, 7, "anything at all"), (2, 1, "cost is")], "answer long, source int, quote string")
    found = {r["answer"]: tuple(r)[1:] for r in claims.answer_rates(answers, evidence, cited).collect()}
    assert found[1] == (0, 1.0, 0, 1.0, 0, 1.0, 0, 0.0) and found[3] == (0, 1.0, 0, 1.0, 0, 1.0, 0, 0.0)
    assert found[2] == (3, 0.666667, 2, 0.5, 1, 1.0, 1, 0.0)


@pytest.mark.parametrize(("quote", "source", "verdict"), [("it’s “so” – then", 'It\'s  "SO" -\nthen it ends', "verified"), ("short", "short", "short"), ("not in here", "elsewhere", "absent"), (None, "x", None), ("eight ch", None, "absent")])
def test_quotes(spark, quote, source, verdict):
    row = spark.createDataFrame([(quote, source)], "q string, s string").select(claims.verify_quote(F.col("q"), F.col("s")).alias("v")).first()
    assert row["v"] == verdict


def test_figures_are_not_broadcast_and_read_once(spark):
    plan = registry.QUERIES["numeric_consistency"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("MapInArrow") == 3


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_figures_across_batches_equal_all_pairs(size):
    r = random.Random(size)
    tested = 0
    for _ in range(60):
        rows = []
        for k in range(r.choice([1, 20, 200])):
            value = r.choice([0.0, 100.0, round(100 * 1.002 ** r.randrange(-9, 9), 4), float(r.randrange(40)), 100.5, 99.5, 100.50251256281407])
            rows.append((r.choice("ab"), r.random() < 0.3, value, k if r.random() < 0.6 else None, r.choice([None, "EUR", "USD"]), k))
        rows.sort(key=lambda x: (x[0], x[1], x[2], x[3] is not None, x[3] or 0))
        names = ["answer", "percentage", "value", "at", "currency", "place"]
        table = pa.table([pa.array([x[k] for x in rows], t) for k, t in enumerate([pa.string(), pa.bool_(), pa.float64(), pa.int64(), pa.string(), pa.int64()])], names=names)
        table = table.append_column("claim", pa.array([0] * len(rows), pa.int32())).append_column("raw", table["answer"])
        found = {x["place"]: (x["nearest"], x["agreed"], x["held_currency"]) for b in claims._compared(iter(table.to_batches(max_chunksize=size))) for x in b.to_pylist()}
        expected = {}
        for answer, percentage, v, at, _, place in rows:
            if at is None:
                held = [(x[3], x[2], x[4]) for x in rows if x[3] is not None and x[:2] == (answer, percentage)]
                exact = min((x for x in held if x[1] == v or abs(v - x[1]) / max(v, x[1]) <= 0.005), default=None, key=lambda x: x[0])
                near = exact or min(held, default=(None, None, None), key=lambda x: (abs(x[1] - v), x[0]))
                expected[place] = (near[1], exact is not None, exact[2] if exact else None)
        assert found == expected
        tested += len(found)
    assert tested > 500
