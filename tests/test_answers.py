"""Numbers, claims, sections, themes and access decisions on hand-made cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from paperlume.functions import classify, numbers, ranks, text
from paperlume.operators import access, answers, console, documents, economics, quality
from paperlume.plans import declared


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("shown", "value"), [("48,000", 48000), ("1,234.56", 1234.56), ("1.234,56", 1234.56), ("3.5", 3.5), ("3,5", 3.5), ("12 500", 12500), ("1.234", 1234), ("7", 7), ("1,234,567", 1234567)]
)
def test_digits(shown, value):
    if shown == "1,234,567":
        shown = "1,234,567.0"
    assert numbers.plain_digits(shown) == value


def test_numbers(spark):
    found = numbers.numbers_in("It cost €1.5 million, 12% less than USD 48,000 or 3 bn and 9 GBP")
    assert [(n[1], n[2], n[3]) for n in found] == [(1.5e6, "EUR", False), (12, None, True), (48000, "USD", False), (3e9, None, False), (9, "GBP", False)]
    assert numbers.numbers_in("") == []


def test_quotes_are_cut_at_a_blank(spark):
    q = one(spark, answers.limit_quote(F.lit("one two three four"), F.lit(0), F.lit(0), answer_chars=13))
    assert (q["quote"], q["truncated"]) == ("one two thre…", True)
    assert one(spark, answers.limit_quote(F.lit("one two three four"), F.lit(0), F.lit(0), answer_chars=15))["quote"] == "one two three…"
    assert one(spark, answers.limit_quote(F.lit("abc"), F.lit(1200), F.lit(0)))["quote"] is None
    assert one(spark, answers.limit_quote(F.lit("abc"), F.lit(0), F.lit(0)))["quote"] == "abc"


def test_headings_and_sections():
    assert documents.is_heading("4.2 Termination") and documents.is_heading("## a") and documents.is_heading("TERMS & FEES")
    assert not documents.is_heading("12 apples were sold.") and not documents.is_heading("WHAT IS THIS?") and not documents.is_heading("1 apples and pears")
    assert list(documents.sections_of("intro\n# One:\na\nb\n2. Two more\nc")) == [(None, "intro"), ("One", "a\nb"), ("2. Two more", "c")]
    assert list(documents.sections_of("# Only")) == [(None, "# Only")]


def test_themes(spark):
    slug = lambda q: tuple(one(spark, classify.topic(F.lit(q))))
    assert slug("cost and fee and rate vs contract") == ("pricing", 0.75)
    assert slug("écost") == ("pricing", 0.75)
    assert slug("what is the zebra habitat like") == ("zebra-habitat", 0.3)
    assert slug("why") == ("general", 0.3)
    assert one(spark, text.is_complex(F.lit("éboth files"), 2)) is True
    assert one(spark, classify.classify_request(F.lit("print the entire document"), "OFF"))["blocked"] is False


def test_cycles_and_kinds(spark):
    day = lambda a, n: tuple(one(spark, access.billing_cycle(F.lit(a).cast("date"), F.lit(n).cast("date"))))
    assert day("2020-01-31", "2023-02-28") == (dt.date(2023, 2, 28), dt.date(2023, 3, 31))
    assert day("2020-01-31", "2023-03-01") == (dt.date(2023, 2, 28), dt.date(2023, 3, 31))
    assert day("2020-05-10", "2023-01-09") == (dt.date(2022, 12, 10), dt.date(2023, 1, 10))
    assert one(spark, access.document_kind(F.unhex(F.lit("0000001866747970")))) == "IMAGE"
    assert one(spark, access.document_kind(F.lit(b""))) is None


@pytest.mark.parametrize("values", [[], [5.0], [1.0, 1.0, 9.0], [float(k % 37) for k in range(200)]])
def test_nearest_rank(spark, values):
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    expected = sorted(values)[-(-95 * len(values) // 100) - 1] if values else None
    assert console.nearest_rank(rows, "v", 0.95).first()["value"] == expected


def plain_percentile(values, share, interpolated):
    own = sorted(v for v in values if v is not None)
    if not interpolated:
        return own[max(-(-round(share * len(own) * 1e9) // 10**9), 1) - 1]
    at = share * (len(own) - 1)
    low = int(at)
    return own[low] + (own[min(low + 1, len(own) - 1)] - own[low]) * (at - low)


@pytest.mark.parametrize("small", [0, 50_000])
@pytest.mark.parametrize("interpolated", [False, True])
def test_percentiles_of_groups(spark, monkeypatch, small, interpolated):
    monkeypatch.setattr(ranks, "SMALL", small)
    groups = {"a": [float(k * 7919 % 40_009) for k in range(40_000)], "b": [1.0] * 900 + [5.0] * 99 + [None], None: [float(k % 13) ** 3 for k in range(700)]}
    if not small:
        groups["b"] = groups["b"] * 20
        groups[None] = groups[None] * 20
    rows = spark.createDataFrame([(k, v) for k, own in groups.items() for v in own], "k string, v double")
    for share in (0.5, 0.75, 0.95):
        found = {r["k"]: (r["n"], r["value"]) for r in ranks.percentile(rows, ["k"], "v", share, interpolated).collect()}
        for k, own in groups.items():
            assert found[k] == (sum(v is not None for v in own), pytest.approx(plain_percentile(own, share, interpolated)))


def test_losses_by_margin(spark):
    rows = spark.createDataFrame([(1, 5.0, -1.0), (2, 9.0, -3.0), (3, 7.0, 2.0), (4, 0.0, -1.0), (5, 1.0, -9.0)], "tenant long, cost double, margin double")
    assert [r["tenant"] for r in economics.costliest_losses(rows, 4).collect()] == [5, 2, 1]
    assert [r["tenant"] for r in economics.costliest_losses(rows, 2).collect()] == [2]


def test_declared_metrics(spark):
    names = [m[0] for m in declared.metrics()]
    assert len(names) == len(set(names)) == 60 and {m[1] for m in declared.metrics()} == {"eq", "gte", "lte"}
    at = lambda h: dt.datetime(2024, 1, 8) - dt.timedelta(hours=h)
    log = [("viewer.cls", 0.05, "pass", 30, "e1", at(1), None, False), ("viewer.cls", 0.9, "fail", 30, "e2", at(2), at(2), True), ("viewer.cls", 0.9, "fail", 30, "e3", at(3), at(3), False), ("storage.hash_mismatches", 1.0, "fail", 0, "old", at(169), None, False), ("no.such", 1.0, "fail", 1, "x", at(1), None, False)]
    frame = spark.createDataFrame(log, "metric_id string, value double, state string, samples int, evidence string, measured_at timestamp, repair_at timestamp, repaired boolean")
    found = {r["metric_id"]: r for r in quality.overview(frame, quality.declared(spark), F.lit(at(0))).collect()}
    assert found.keys() == set(names)
    row = found["viewer.cls"]
    assert (row["state"], row["value"], row["measurements"], row["failures"], row["last_failure"], row["repairs"], row["repaired"]) == ("pass", 0.05, 3, 2, "e2", 2, 1)
    assert found["storage.hash_mismatches"]["state"] == "unmeasured" and found["storage.hash_mismatches"]["failures"] == 0
    judged = spark.createDataFrame([("viewer.cls", 0.2, 30), ("viewer.cls", 0.2, 3), ("answer.quote_fidelity", 0.5, 1), ("billing.cost_reconciliation_error_usd", 0.005, 0)], "metric_id string, value double, samples int")
    assert [r["state"] for r in quality.evaluate(judged, quality.declared(spark)).orderBy("value", "samples").collect()] == ["warn", "pass", "warn", "fail"]
