"""What answers claim against their evidence: figures, sentences, citations and quotes, and four rates of an answer.

Answers are rows (answer, text), their evidence rows (answer, passage, text). Numbers and words are
taken out of the texts once; after that everything is joins and groupings keyed by the answer and
by what is compared, so an answer with much evidence never meets it all in one row.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classify import is_refusal
from ..functions.numbers import BLANK, CODES, number_rows
from ..plans.registry import query
from ..sources.tables import table

#: Relative difference up to which figures are equal, and how near to a power of ten a ratio is a slip of the scale. Fixed values.
TOLERANCE, SCALE_SLIP = 0.005, 0.02
#: How much wider a range of values is looked up than the tolerance, before each end is compared.
SLACK = 1e-9
#: Shares of a sentence's words that evidence must hold; shorter sentences claim nothing. Fixed values.
SUPPORTED, INFERRED, LEAST_CHARS = 0.6, 0.3, 15
#: Openings of sentences that claim nothing. Fixed value.
NON_FACTUAL = r"(?i)^(i (?:could not|couldn't|cannot|can't)|the (?:shared )?(?:material|documents?) (?:do(?:es)?n't|do not)|try asking|would you like|which (?:of|file)|let me know|i can (?:explain|summarise|summarize)|that information)"
#: Words that carry no claim. Fixed values.
COMMON = frozenset(
    """a about after all also an and any are as at be been before being both but by can could did do does each either
    for from had has have if in into is it its may must no not of on one only or other per shall should so such than
    that the their them then there these they this those to under until upon was were when where which while who will
    with within would you your""".split()
)
_WORD_END = re.compile(r"[^\w%€$£]+|_")
_MARKS = re.compile(r"[\u0300-\u036f]")


def _material(n: DataFrame) -> DataFrame:
    """Numbers that are claims: not the small plain ones of pages, clauses and lists."""
    return n.where(F.col("currency").isNotNull() | F.col("percentage") | (F.col("factor") > 1) | (F.abs("value") >= 10))


def numeric_check(stated: DataFrame, evidence: DataFrame) -> DataFrame:
    """Per material number of answers: the evidence number that it agrees with or is nearest to, and the reason of a mismatch.

    ``stated`` has answer, claim, place and the columns of a number, ``evidence`` answer, place and
    those of a number (``functions.numbers``). Of the answer's evidence, percentages are
    compared with percentages alone. The first that is equal within ``TOLERANCE`` agrees, or is a
    mismatch of currency; else the nearest is shown, with reason magnitude where the ratio is a power
    of ten, and absent otherwise. Agreeing numbers have no reason.

    Figures of both are shuffled once by (answer, percentage) and sorted by value; a task streams
    them and finds what lies within the tolerance and the nearest on each side as ranges of sorted
    arrays. No figure meets another one as a row, and nothing is broadcast.
    """
    own = _material(stated).select("answer", "percentage", "value", F.lit(None).cast("long").alias("at"), "claim", "place", "raw", "currency")
    held = evidence.select("answer", "percentage", "value", F.col("place").cast("long").alias("at"), "currency")
    line = own.unionByName(held, allowMissingColumns=True).repartition("answer", "percentage").sortWithinPartitions("answer", "percentage", "value", "at")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema if f.name not in ("percentage", "at"))
    line = line.mapInArrow(_compared, f"{schema}, nearest double, agreed boolean, held_currency string")
    ratio = F.when(F.col("agreed"), F.lit(1.0)).when(F.col("nearest") != 0, F.col("value") / F.col("nearest"))
    power = F.log10(ratio)
    slip = (F.abs(power - F.round(power)) < SCALE_SLIP) & (F.round(power) != 0)
    reason = F.when(F.col("agreed"), F.when(F.col("currency") != F.col("held_currency"), "currency")).when(slip, "magnitude").otherwise("absent")
    return line.select("answer", "claim", "place", "raw", "value", "nearest", reason.alias("reason"), ratio.alias("ratio"))


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every stated figure of sorted rows (answer, percentage, value, at, ...) with the evidence figure that it agrees with or is nearest to.

    ``at`` is null for stated figures. What a later row may still decide is kept for the next batch: of the
    last answer, the figures that wait, and the evidence within the tolerance of the least of them.
    """
    kept: pa.RecordBatch | None = None
    waiting: list[pa.RecordBatch] = []
    for batch in chain(batches, [None]):
        waiting += [batch] if batch is not None and len(batch) else []
        # What is kept is gone through again only when as many rows have come.
        if batch is not None and sum(map(len, waiting)) < (len(kept) if kept is not None else 1):
            continue
        rows = [*([kept] if kept is not None else []), *waiting]
        if rows:
            found, kept = _settled(pa.concat_batches(rows), batch is None)
            waiting = []
            yield found


def _settled(rows: pa.RecordBatch, last: bool) -> tuple[pa.RecordBatch, pa.RecordBatch]:
    """The stated figures that these rows decide, and the rows that are still needed."""
    column = {name: rows.column(k) for k, name in enumerate(rows.schema.names)}
    answer = pc.fill_null(column["answer"].dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
    percentage = column["percentage"].to_numpy(zero_copy_only=False).astype(bool)
    value, is_held = column["value"].to_numpy(zero_copy_only=False), column["at"].is_valid().to_numpy(zero_copy_only=False)
    group = np.cumsum(np.r_[False, (answer[1:] != answer[:-1]) | (percentage[1:] != percentage[:-1])])
    evidence, own = np.flatnonzero(is_held), np.flatnonzero(~is_held)
    # Complex numbers are in order of their real parts, then of the others.
    key = lambda g, v: g + 1j * v
    held, at, of = value[evidence], pc.fill_null(column["at"], 0).to_numpy(zero_copy_only=False)[evidence], group[evidence]
    keys, v, g = key(of, held), value[own], group[own]
    # The first evidence row of each value of a group, which is the earliest in place.
    fresh = np.r_[True, keys[1:] != keys[:-1]][: len(keys)]
    run = np.maximum.accumulate(np.where(fresh, np.arange(len(keys)), 0))

    def same(h: np.ndarray, x: np.ndarray) -> np.ndarray:
        larger = np.maximum(h, x)
        return (h == x) | (np.abs(h - x) / np.where(larger == 0, 1, larger) <= TOLERANCE)

    def within(g: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and past the last evidence row that equals each figure."""
        a, b = np.searchsorted(keys, key(g, v * (1 - TOLERANCE) * (1 - SLACK))), np.searchsorted(keys, key(g, v / (1 - TOLERANCE) * (1 + SLACK)), "right")
        for edge, step in ((a, 1), (b, -1)):
            while len(wrong := np.flatnonzero(a < b)) and len(wrong := wrong[~same(held[(edge if step > 0 else edge - 1)[wrong]], v[wrong])]):
                edge[wrong] += step
        return a, b

    a, b = within(g, v)
    place = np.searchsorted(keys, key(g, v))
    has_below, has_above = ((place + d >= 0) & (place + d < len(keys)) for d in (-1, 0))
    below, above = np.maximum(place - 1, 0), np.minimum(place, len(keys) - 1)
    if len(keys):
        has_below, has_above = has_below & (of[below] == g), has_above & (of[above] == g)
    agreed = a < b
    nearest, source = np.full(len(own), np.nan), _earliest(at, a, b)
    one = np.flatnonzero(agreed)
    nearest[one] = held[source[one]]
    one = np.flatnonzero(~agreed & (has_below | has_above))
    if len(one):
        down, up = np.abs(held[below[one]] - v[one]), np.abs(held[above[one]] - v[one])
        upper = has_above[one] & (~has_below[one] | (up < down) | ((up == down) & (at[above[one]] < at[run[below[one]]])))
        nearest[one] = held[np.where(upper, above[one], below[one])]
    done, needed = np.ones(len(own), bool), np.zeros(len(rows), bool)
    if not last:
        end, most = group[-1], value[-1]
        done = (g < end) | (has_above & (v / (1 - TOLERANCE) * (1 + SLACK) < most))
        needed[own[~done]] = True
        # Later figures are not below the last one.
        least = np.array([min([most, *v[~done][:1]])])
        first = int(np.searchsorted(keys, key(np.array([end]), least * (1 - TOLERANCE) * (1 - SLACK)))[0])
        before = int(np.searchsorted(keys, key(np.array([end]), least))[0]) - 1
        if before >= 0 and of[before] == end:
            first = min(first, int(run[before]))
        needed[evidence[first:]] = True
    out = np.flatnonzero(done)
    taken = pa.array(own[out], pa.int64())
    currency = pc.take(column["currency"], pa.array(evidence[source[out]] if len(evidence) else np.zeros(len(out), np.int64), pa.int64(), mask=~agreed[out]))
    names = ["answer", "value", "claim", "place", "raw", "currency"]
    columns = [pc.take(column[name], taken) for name in names] + [pa.array(nearest[out], mask=np.isnan(nearest[out])), pa.array(agreed[out]), currency]
    return pa.RecordBatch.from_arrays(columns, names=[*names, "nearest", "agreed", "held_currency"]), rows.take(pa.array(np.flatnonzero(needed), pa.int64()))


def _earliest(at: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each range of rows from ``a`` up to ``b``, the row with the least ``at``; 0 for empty ranges."""
    out, width, table = np.zeros(len(a), np.int64), 1, np.arange(len(at))
    left = np.flatnonzero(a < b)
    while len(left):
        # ``table`` has the best row of every range of ``width``; ranges of less than twice that are two of these.
        size = b[left] - a[left]
        now = left[size < 2 * width]
        x, y = table[a[now]], table[b[now] - width]
        out[now] = np.where(at[y] < at[x], y, x)
        left = left[size >= 2 * width]
        if len(left):
            x, y = table[:-width], table[width:]
            table, width = np.where(at[y] < at[x], y, x), 2 * width
    return out


def consistency(checked: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: how many numbers were checked, how many do not agree, and the share that does."""
    wrong = F.count("reason")
    return checked.groupBy(*keys).agg(F.count(F.lit(1)).alias("figures"), wrong.alias("mismatches"), ((F.count(F.lit(1)) - wrong) / F.count(F.lit(1))).alias("consistency"))


def sentences(answers: DataFrame) -> DataFrame:
    """(answer, claim, text, factual): the sentences of each answer, and which claim something."""
    flat = F.regexp_replace("text", f"{BLANK}+", " ")
    # A mark after a capital or a digit ends no sentence, as in numbered clauses.
    split = F.split(flat, r"(?<![A-Z0-9])[.!?]+(?= +[A-Z\u201c\x22']| *\z)")
    whole = F.filter(F.transform(split, lambda s: F.trim(s)), lambda s: s != "")
    rows = answers.select("answer", F.posexplode(whole).alias("claim", "text"))
    return rows.withColumn("factual", (F.length("text") > LEAST_CHARS) & ~F.col("text").rlike(NON_FACTUAL))


def content_words(text: str) -> list[str]:
    """Words of three characters or more that may carry a claim, in order, without accents."""
    text = text.lower()
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text))
    return [w for w in _WORD_END.split(text) if len(w) > 2 and w not in COMMON]


def word_rows(texts: DataFrame) -> DataFrame:
    """(other columns, word, n): the distinct content words of ``text``, and how often each stands there."""
    kept = [c for c in texts.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, words, counts = [], [], []
            for k, text in enumerate(batch.column(len(kept)).to_pylist()):
                own: dict[str, int] = {}
                for w in content_words(text or ""):
                    own[w] = own.get(w, 0) + 1
                owner += [k] * len(own)
                words += own
                counts += own.values()
            columns = [batch.column(k).take(pa.array(owner, pa.int64())) for k in range(len(kept))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(words, pa.string()), pa.array(counts, pa.int64())], names=[*kept, "word", "n"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema if f.name != "text")
    return texts.select(*kept, "text").mapInArrow(run, f"{schema}, word string, n long")


def claim_support(claims: DataFrame, checked: DataFrame, evidence: DataFrame) -> DataFrame:
    """Per factual sentence: overlap, whether its figures agree, and its support.

    ``claims`` come from ``sentences``, ``checked`` from ``numeric_check`` of their numbers. A
    sentence's words are looked up in the words of the answer's evidence, one row for each; a
    sentence without content words overlaps in full. A wrong figure leaves a sentence unsupported.
    """
    factual = claims.where("factual").select("answer", "claim", "text")
    held = word_rows(evidence.select("answer", "text")).select("answer", "word").distinct().withColumn("held", F.lit(True))
    said = word_rows(factual).join(held, ["answer", "word"], "left").groupBy("answer", "claim").agg(F.sum("n").alias("words"), F.sum(F.when(F.col("held"), F.col("n")).otherwise(0)).alias("shared"))
    wrong = checked.where("reason IS NOT NULL").groupBy("answer", "claim").agg(F.count(F.lit(1)).alias("wrong"))
    rows = factual.select("answer", "claim").join(said, ["answer", "claim"], "left").join(wrong, ["answer", "claim"], "left")
    overlap = F.coalesce(F.col("shared") / F.col("words"), F.lit(1.0))
    agree = F.col("wrong").isNull()
    support = F.when(~agree | (overlap < INFERRED), "UNSUPPORTED").when(overlap < SUPPORTED, "INFERRED").otherwise("SUPPORTED")
    return rows.select("answer", "claim", F.round(overlap, 3).alias("overlap"), agree.alias("figures_agree"), support.alias("support"))


def groundedness(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """Support of every factual sentence of (answer, text) by the evidence (answer, passage, text)."""
    claims = sentences(answers)
    checked = numeric_check(number_rows(claims.drop("factual")), number_rows(evidence.select("answer", "passage", "text")).withColumn("place", _in_order()))
    return claim_support(claims, checked, evidence)


def _in_order() -> Column:
    """The place of a number in all of an answer's evidence: passages first, then places in them."""
    return F.col("passage").cast("long") * (1 << 32) + F.col("place")


def quote_form(text: Column) -> Column:
    """A text as quotes are compared: kinds of quotes, dashes and white space are one, case is none."""
    text = F.translate(text, "\u2018\u2019\u201a\u201b\u201c\u201d\u201e\u201f", "''''\"\"\"\"")
    text = F.regexp_replace(F.regexp_replace(text, r"[\u2010-\u2015]", "-"), f"{BLANK}+", " ")
    return F.lower(F.trim(text))


def verify_quote(quote: Column, source: Column) -> Column:
    """Why a quote counts or not: verified, short (under eight characters), absent from its source, or null for no quote."""
    own = quote_form(quote)
    return F.when(quote.isNull(), F.lit(None).cast("string")).when(F.length(own) < 8, "short").when(F.coalesce(F.contains(quote_form(source), own), F.lit(False)), "verified").otherwise("absent")


def answer_rates(answers: DataFrame, evidence: DataFrame, citations: DataFrame) -> DataFrame:
    """Per answer: citation_validity, quote_fidelity, numeric_consistency and unsupported_rate, each with its sample size.

    ``citations`` has answer, source (a passage of its evidence, if it exists) and quote. Sentences,
    numbers and words are taken out of the texts once. Each measure gives rows of (answer, measure, good, n); one
    grouping of all of them makes the rates, so no answer is joined measure by measure. An answer that refuses
    claims nothing, and what has no sample counts as right.
    """
    asked = answers.select("answer", "text", is_refusal(F.col("text")).alias("refused"))
    claiming = sentences(asked.where("NOT refused"))
    checked = numeric_check(number_rows(claiming.drop("factual")), number_rows(evidence.select("answer", "passage", "text")).withColumn("place", _in_order()))
    support = claim_support(claiming, checked, evidence)
    known = evidence.select("answer", F.col("passage").alias("source"), F.col("text").alias("shown"))
    cited = citations.join(known, ["answer", "source"], "left").withColumn("quoted", verify_quote(F.col("quote"), F.col("shown")))
    row = lambda df, name, good: df.select("answer", F.lit(name).alias("measure"), good.cast("int").alias("good"))
    parts = [
        row(cited, "citations", F.col("shown").isNotNull()),
        row(cited.where("quote IS NOT NULL AND shown IS NOT NULL"), "quotes", F.col("quoted") == "verified"),
        row(checked, "figures", F.col("reason").isNull()),
        row(support, "claims", F.col("support") != "UNSUPPORTED"),
        row(asked, "answers", F.lit(1)),
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    n = lambda name: F.count_if(F.col("measure") == name)
    share = lambda name: F.coalesce(F.round(F.avg(F.when(F.col("measure") == name, F.col("good").cast("double"))), 6), F.lit(1.0))
    return rows.groupBy("answer").agg(
        n("citations").alias("cited"), share("citations").alias("citation_validity"), n("quotes").alias("quotes"), share("quotes").alias("quote_fidelity"),
        n("figures").alias("figures"), share("figures").alias("numeric_consistency"), n("claims").alias("claims"), F.round(1 - share("claims"), 6).alias("unsupported_rate"), n("answers").alias("n"),
    ).where("n > 0").drop("n")


def _grouped(whole: Column) -> Column:
    return F.format_number(whole, 0)


def order_statements(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Statements about orders and their evidence, as texts: (answer, text), and (answer, passage, text) of the orders' lines.

    How an amount is written follows the order's priority: in thousands, plain, in another
    currency, in tenths, or the order's total.
    """
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"), F.col("l_quantity").cast("long").alias("units"), F.round(F.col("l_discount") * 100).cast("long").alias("off"))
    money = lambda c: F.concat(_grouped(F.expr(f"{c} DIV 100")), F.lit("."), F.lpad((F.col(c) % 100).cast("string"), 2, "0"))
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "cents", "units", "off"))
    evidence = lines.select(F.col("l_orderkey").alias("answer"), place.alias("passage"), F.concat(F.col("units"), F.lit(" units for "), money("cents"), F.lit(" USD, less "), F.col("off"), F.lit("%.")).alias("text"))
    tops = lines.groupBy("l_orderkey").agg(F.max("cents").alias("top"), F.sum("units").alias("units"), F.max("off").alias("off"), F.count(F.lit(1)).alias("n"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.substring("o_orderpriority", 1, 1).alias("style"), F.round(F.col("o_totalprice") * 100).cast("long").alias("total"))
    told = tops.join(orders.hint("merge"), "l_orderkey")
    amount = (
        F.when(F.col("style") == "1", F.concat(F.lit("USD "), F.expr("top DIV 100000"), F.lit("."), F.expr("top DIV 10000 % 10"), F.lit("k")))
        .when(F.col("style") == "2", money("top"))
        .when(F.col("style") == "3", F.concat(F.lit("EUR "), money("top")))
        .when(F.col("style") == "4", F.concat(F.lit("USD "), _grouped(F.expr("top DIV 10"))))
        .otherwise(F.concat(F.lit("USD "), money("total")))
    )
    text = F.concat(F.lit("The dearest of "), F.col("n"), F.lit(" lines is "), amount, F.lit(" at "), F.col("off"), F.lit("% off. In all "), F.col("units"), F.lit(" units were shipped."))
    return told.select(F.col("l_orderkey").alias("answer"), text.alias("text")), evidence


_SQL_NUMBER = rf"(?i)(?:(€|\$|£|¥)\s?)?(?:\b({CODES})\s?)?(\d{{1,3}}(?:[ ,.]\d{{3}})+(?:[.,]\d+)?|\d+(?:[.,]\d+)?)\s*(%|k\b|thousand\b|mn\b|m\b|million[s]?\b|bn\b|billion[s]?\b)?(?:\s?({CODES})\b)?"


def _sql_numbers(name: str, source: str) -> str:
    """SQL of the numbers of (answer, part, text), for the texts about orders."""
    column = lambda g: f"regexp_extract_all(text, '{_SQL_NUMBER}', {g})"
    return f"""{name}0 AS (SELECT answer, part, unnest({column(0)}) AS raw, coalesce(unnest({column(2)}), '') AS before, unnest({column(3)}) AS d, lower(coalesce(unnest({column(4)}), '')) AS suffix, coalesce(unnest({column(5)}), '') AS after, unnest(range(len({column(0)}))) AS place FROM {source}),
{name} AS (SELECT answer, part, place, trim(raw) AS raw, nullif(upper(before || after), '') AS currency, suffix = '%' AS percentage, CASE suffix WHEN 'k' THEN 1000 ELSE 1 END AS factor,
  CASE WHEN suffix = 'k' THEN 1000 ELSE 1 END * CASE WHEN regexp_full_match(d, '\\d{{1,3}}[.,]\\d{{3}}') THEN regexp_replace(d, '[.,]', '')::DOUBLE WHEN instr(d, '.') > 0 THEN replace(d, ',', '')::DOUBLE ELSE regexp_extract(replace(regexp_replace(d, ',', 'x'), 'x', '.'), '^\\d+\\.?\\d*')::DOUBLE END AS value FROM {name}0)"""


_STATEMENTS = """lines AS (SELECT l_orderkey, l_linenumber, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, CAST(l_quantity AS BIGINT) AS units, CAST(round(l_discount * 100) AS BIGINT) AS off FROM lineitem),
evidence AS (SELECT l_orderkey AS answer, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, cents, units, off) AS part, units || ' units for ' || format('{:,}', cents // 100) || '.' || lpad((cents % 100)::VARCHAR, 2, '0') || ' USD, less ' || off || '%.' AS text FROM lines),
told AS (SELECT l_orderkey, max(cents) AS top, sum(units)::BIGINT AS units, max(off) AS off, count(*) AS n FROM lines GROUP BY l_orderkey),
answers AS (SELECT l_orderkey AS answer, 0 AS part, 'The dearest of ' || n || ' lines is ' || CASE o_orderpriority[1] WHEN '1' THEN 'USD ' || top // 100000 || '.' || top // 10000 % 10 || 'k' WHEN '2' THEN format('{:,}', top // 100) || '.' || lpad((top % 100)::VARCHAR, 2, '0')
  WHEN '3' THEN 'EUR ' || format('{:,}', top // 100) || '.' || lpad((top % 100)::VARCHAR, 2, '0') WHEN '4' THEN 'USD ' || format('{:,}', top // 10) ELSE 'USD ' || format('{:,}', CAST(round(o_totalprice * 100) AS BIGINT) // 100) || '.' || lpad((CAST(round(o_totalprice * 100) AS BIGINT) % 100)::VARCHAR, 2, '0') END
  || ' at ' || off || '% off. In all ' || units || ' units were shipped.' AS text FROM told JOIN orders ON o_orderkey = l_orderkey)"""

_CHECKED = f"""{_STATEMENTS}, {_sql_numbers("stated", "answers")}, {_sql_numbers("held", "evidence")},
pairs AS (SELECT s.*, h.value AS other, h.currency AS other_currency, h.part AS hp, h.place AS hq, h.answer IS NOT NULL AS met, s.value = h.value OR abs(s.value - h.value) / greatest(s.value, h.value) <= 0.005 AS same
  FROM stated s LEFT JOIN held h ON h.answer = s.answer AND h.percentage = s.percentage WHERE s.currency IS NOT NULL OR s.percentage OR s.factor > 1 OR s.value >= 10),
best AS (SELECT answer, place, raw, value, bool_or(coalesce(same, false)) AS agreed, arg_min({{'v': other, 'c': other_currency, 'own': currency}}, hp * 1000 + hq) FILTER (same) AS exact,
  arg_min(other, abs(other - value) * 1000000 + (hp * 1000 + hq) / 100000) FILTER (met) AS nearest FROM pairs GROUP BY answer, place, raw, value)
"""


@query("numeric_check", f"""WITH {_CHECKED} SELECT answer, place, raw, round(value, 4) AS value, round(CASE WHEN agreed THEN exact.v ELSE nearest END, 4) AS nearest,
CASE WHEN agreed AND exact.own <> exact.c THEN 'currency' WHEN agreed THEN NULL WHEN nearest <> 0 AND value > 0 AND abs(log10(value / nearest) - round(log10(value / nearest))) < 0.02 AND round(log10(value / nearest)) <> 0 THEN 'magnitude' ELSE 'absent' END AS reason,
CASE WHEN agreed THEN 0.0 WHEN nearest <> 0 AND value > 0 THEN round(log10(value / nearest), 5) END AS decades FROM best""")
def numeric_check_query(spark, sf_dir):
    """Every figure that a statement about an order makes, against the figures of the order's lines."""
    answers, evidence = order_statements(spark, sf_dir)
    stated = number_rows(answers.withColumn("claim", F.lit(0)))
    held = number_rows(evidence).withColumn("place", _in_order())
    return numeric_check(stated, held).select("answer", "place", "raw", F.round("value", 4).alias("value"), F.round("nearest", 4).alias("nearest"), "reason", F.round(F.log10("ratio"), 5).alias("decades"))


@query("numeric_consistency", f"""WITH {_CHECKED} SELECT answer, count(*) AS figures, count(*) FILTER (NOT agreed OR exact.own <> exact.c) AS mismatches, round(count(*) FILTER (agreed AND (exact.own <> exact.c) IS NOT TRUE) / count(*), 6) AS consistency FROM best GROUP BY answer""")
def numeric_consistency_query(spark, sf_dir):
    """How many figures of a statement its evidence bears out."""
    answers, evidence = order_statements(spark, sf_dir)
    checked = numeric_check(number_rows(answers.withColumn("claim", F.lit(0))), number_rows(evidence).withColumn("place", _in_order()))
    return consistency(checked, ["answer"]).withColumn("consistency", F.round("consistency", 6))


def turns_with_evidence(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Assistant turns as answers, and the two turns before each as the passages of its evidence."""
    turns = table(spark, sf_dir, "conversations").where("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text"))
    turns = turns.groupBy("conv_id", "turn").agg(F.min(F.struct("role", "text")).alias("t")).select("conv_id", "turn", "t.role", "t.text")
    name = lambda turn: F.concat_ws(":", F.col("conv_id").cast("string"), turn.cast("string"))
    answers = turns.where("role = 'assistant'").select(name(F.col("turn")).alias("answer"), "text")
    asking = turns.where("role = 'assistant'").select("conv_id", F.col("turn").alias("of"), F.explode(F.array(F.lit(1), F.lit(2))).alias("passage")).withColumn("turn", F.col("of") - F.col("passage"))
    evidence = asking.join(turns.select("conv_id", "turn", "text"), ["conv_id", "turn"])
    return answers, evidence.select(name(F.col("of")).alias("answer"), "passage", "text")


@query("claim_support")
def claim_support_query(spark, sf_dir):
    """Every sentence of an answer against the two turns before it."""
    return groundedness(*turns_with_evidence(spark, sf_dir))


def answer_citations(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """(answer, place, source, quote, relevance): three citations an answer makes, of passages that may not exist.

    The first quotes words of its passage, the second words of the answer itself, the third nothing.
    """
    first = evidence.where("passage = 1").select("answer", F.slice(F.split("text", " "), 2, 6).alias("words"))
    own = answers.select("answer", F.slice(F.split("text", " "), 3, 4).alias("own")).join(first, "answer", "left")
    cite = lambda source, quote, weight: F.struct(F.lit(source).alias("source"), quote.alias("quote"), F.lit(weight).alias("relevance"))
    made = F.array(cite(1, F.array_join("words", "  "), 0.5), cite(2, F.array_join("own", " "), 0.9), cite(3, F.lit(None).cast("string"), 0.2))
    return own.select("answer", F.posexplode(made).alias("place", "c")).select("answer", "place", "c.source", "c.quote", "c.relevance")


@query("verify_answer")
def verify_answer(spark, sf_dir):
    """Four rates of every answer: citations that exist, quotes that stand in their source, figures that agree, claims without support."""
    answers, evidence = turns_with_evidence(spark, sf_dir)
    return answer_rates(answers, evidence, answer_citations(answers, evidence))


@query("groundedness")
def groundedness_query(spark, sf_dir):
    """How many sentences of every answer the two turns before it support, and the share that has no support."""
    answers, evidence = turns_with_evidence(spark, sf_dir)
    n = lambda support: F.count_if(F.col("support") == support)
    counted = groundedness(answers, evidence).groupBy("answer").agg(n("SUPPORTED").alias("supported"), n("INFERRED").alias("inferred"), n("UNSUPPORTED").alias("unsupported"))
    counted = answers.select("answer").join(counted, "answer", "left").na.fill(0)
    every = F.col("supported") + F.col("inferred") + F.col("unsupported")
    return counted.withColumn("unsupported_rate", F.when(every > 0, F.round(F.col("unsupported") / every, 6)).otherwise(0.0))


@query("verify_quote", r"""WITH asked AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant' AND text IS NOT NULL),
quotes AS (SELECT conv_id, turn, unnest(['inside', 'other', 'changed', 'start']) AS kind, unnest([replace(substr(text, 20, 30), ' ', '  '), NULL, reverse(substr(text, 5, 40)), substr(text, 1, 5)]) AS quote, text FROM asked),
named AS (SELECT q.conv_id, q.turn, kind, CASE kind WHEN 'other' THEN (SELECT min(substr(o.text, 1, 14)) FROM conversations o WHERE o.conv_id = q.conv_id + 1 AND o.role = 'user') ELSE quote END AS quote, text FROM quotes q),
formed AS (SELECT conv_id, turn, kind, quote, lower(trim(regexp_replace(quote, '\s+', ' ', 'g'))) AS own, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS source FROM named)
SELECT conv_id, turn, kind, CASE WHEN quote IS NULL THEN NULL WHEN length(own) < 8 THEN 'short' WHEN contains(source, own) THEN 'verified' ELSE 'absent' END AS verdict FROM formed""")
def verify_quote_query(spark, sf_dir):
    """Four quotes against each answer: from inside it, from the next conversation, turned around, and its first characters."""
    turns = table(spark, sf_dir, "conversations")
    asked = turns.where("role = 'assistant' AND text IS NOT NULL").select("conv_id", "turn", "text")
    other = turns.where("role = 'user'").groupBy((F.col("conv_id") - 1).alias("conv_id")).agg(F.min(F.substring("text", 1, 14)).alias("elsewhere"))
    kinds = {"inside": F.replace(F.substring("text", 20, 30), F.lit(" "), F.lit("  ")), "other": F.col("elsewhere"), "changed": F.reverse(F.substring("text", 5, 40)), "start": F.substring("text", 1, 5)}
    offered = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), q.alias("quote")) for k, q in kinds.items())))
    rows = asked.join(other, "conv_id", "left").select("conv_id", "turn", "text", offered.alias("o"))
    return rows.select("conv_id", "turn", "o.kind", verify_quote(F.col("o.quote"), F.col("text")).alias("verdict"))
