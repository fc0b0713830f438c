"""Numbers as texts state them: values, currencies, percentages and magnitudes."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Words for magnitudes, signs and codes of currencies. Fixed values.
SCALES = {"k": 1e3, "thousand": 1e3, "m": 1e6, "mn": 1e6, "million": 1e6, "millions": 1e6, "bn": 1e9, "billion": 1e9, "billions": 1e9}
SIGNS = {"€": "EUR", "$": "USD", "£": "GBP", "¥": "JPY"}
CODES = "EUR|USD|GBP|CHF|JPY|CAD|AUD|SEK|NOK|DKK"
#: White space as the texts' origin counts it: the no-break space and other Unicode blanks are of it.
BLANK = r"[\t\n\x0b\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
#: A number with its currency, grouping, decimals and magnitude; what it may begin with is looked at first. Fixed value.
NUMBER = re.compile(
    rf"(?=[€$£¥0-9{''.join(sorted({c[0] for c in CODES.split('|')}))}])(?:(€|\$|£|¥){BLANK}?)?(?:\b({CODES}){BLANK}?)?(\d{{1,3}}(?:[ ,.]\d{{3}})+(?:[.,]\d+)?|\d+(?:[.,]\d+)?){BLANK}*(%|k\b|thousand\b|mn\b|m\b|million[s]?\b|bn\b|billion[s]?\b)?(?:{BLANK}?({CODES})\b)?",
    re.I | re.A,
)
_DIGIT = re.compile("[0-9]")
_ALONE, _LEAD = re.compile("([0-9]{1,3})[.,]([0-9]{3})"), re.compile("[0-9]*")


def plain_digits(shown: str) -> float:
    """The value of digits with separators: the last kind of separator is the decimal one, but one group of three is thousands."""
    digits = "".join(shown.split())
    if digits.isdecimal():
        return float(digits)
    alone = _ALONE.fullmatch(digits)
    if alone:
        return float(alone[1] + alone[2])
    decimal = "," if digits.rfind(",") > digits.rfind(".") else "."
    whole, _, rest = digits.replace(",." [decimal == ","], "").partition(decimal)
    if not rest.isdecimal():
        rest = _LEAD.match(rest if decimal == "," else rest.split(".")[0])[0] or "0"
    return float(f"{whole}.{rest}")


def numbers_in(text: str) -> list[tuple[str, float, str | None, bool, float]]:
    """Each number with its value, currency, whether it is a percentage, and the factor of its magnitude; what is too large for a double is none."""
    out = []
    for found in NUMBER.finditer(text) if _DIGIT.search(text) else ():
        sign, before, digits, suffix, after = found.groups()
        unit, value = (suffix or "").lower(), plain_digits(digits)
        if math.isfinite(value):
            code = SIGNS.get(sign or "") or (before or after or "").upper() or None
            factor = SCALES.get(unit, 1.0)
            out.append((found[0].strip(), value * factor, code, unit == "%", factor))
    return out


NUMBER_COLUMNS = "place long, raw string, value double, currency string, percentage boolean, factor double"
_TYPES = [pa.int64(), pa.string(), pa.float64(), pa.string(), pa.bool_(), pa.float64()]


def number_rows(texts: DataFrame, text: str = "text") -> DataFrame:
    """One row for each number of a text: its place in it, the columns of ``NUMBER_COLUMNS`` and the other columns of ``texts``.

    Texts are read in Arrow batches, those without a digit are passed over, and no list of numbers is built for a text.
    """
    kept = [c for c in texts.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, rows = [], []
            for k, shown in enumerate(batch.column(len(kept)).to_pylist()):
                own = numbers_in(shown or "")
                owner += [k] * len(own)
                rows += [(at, *n) for at, n in enumerate(own)]
            columns = [batch.column(k).take(pa.array(owner, pa.int64())) for k in range(len(kept))]
            made = [pa.array(list(x), t) for x, t in zip(zip(*rows), _TYPES)] if rows else [pa.array([], t) for t in _TYPES]
            yield pa.RecordBatch.from_arrays([*columns, *made], names=[*kept, *(c.split()[0] for c in NUMBER_COLUMNS.split(", "))])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema if f.name != text)
    return texts.select(*(f"`{c}`" for c in kept), text).mapInArrow(run, f"{schema}, {NUMBER_COLUMNS}")
