"""Exact sums, safe division and rounding shared by all operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def money(col: Column | str) -> Column:
    """Exact value to nine decimals, so that sums do not depend on task order; NaN is null.

    A value of 1e21 or more raises instead of being lost.
    """
    value = F.col(col) if isinstance(col, str) else col
    return F.when(~F.isnan(value), value).cast("decimal(30,9)")


def money_sum(col: Column | str) -> Column:
    return F.sum(money(col))


def money_sum_double(col: Column | str) -> Column:
    """Sum as double, 0.0 when every value is null."""
    return F.coalesce(money_sum(col), F.lit(0).cast("decimal(30,9)")).cast("double")


#: from here on a value is added as a double and not as a decimal
LARGE = 1e20


def number_parts(col: Column | str) -> tuple[Column, Column]:
    """A number as an exact decimal and what that cannot hold, as a double; NaN is null in both.

    The rest is null for a number of at most nine decimals below ``LARGE``. Of a smaller fraction it is what lies
    behind the ninth decimal, of larger and infinite numbers all.
    """
    value = F.col(col) if isinstance(col, str) else col
    x = F.when(~F.isnan(value), value)
    exact = F.when(F.abs(x) < LARGE, x).cast("decimal(30,9)")
    rest = x.cast("double") - F.coalesce(exact.cast("double"), F.lit(0.0))
    return exact, F.when(rest != 0, rest)


def joined_parts(exact: Column, rest: Column) -> Column:
    """One double from the sums of both parts; null where neither has a value."""
    both = F.coalesce(exact.cast("double"), F.lit(0.0)) + F.coalesce(rest, F.lit(0.0))
    return F.when(exact.isNotNull() | rest.isNotNull(), both)


def ratio(a: Column, b: Column) -> Column:
    """Double division, null when the divisor is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def count_if(cond: Column) -> Column:
    return F.count_if(cond).cast("bigint")


def to_number(col: Column) -> Column:
    """Tolerant number parse: anything that is not a plain number becomes null."""
    text = F.trim(col.cast("string"))
    plain = text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
    return F.when(plain, text.try_cast("double"))


# --- one form for equal numbers ---------------------------------------------------

#: a plain number with or without exponent, as every type prints it
NUMBER_TEXT = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]{1,9})?$"


#: numbers with more zeros than this are written with an exponent
MOST_ZEROS = 40


def number_form_sql(text: str) -> str:
    """SQL: a printed number in plain digits without needless zeros, the same for every way to print it.

    ``12345678.50``, ``1.23456785E7`` and ``123456785e-1`` all give ``12345678.5``. What is no plain number
    (infinity among them) stays as it is.
    """
    whole, part = f"regexp_extract({text}, '^[+-]?([0-9]*)', 1)", f"regexp_extract({text}, '^[+-]?[0-9]*[.]([0-9]*)', 1)"
    digits = f"ltrim('0', concat({whole}, {part}))"
    bare = f"rtrim('0', {digits})"
    power = f"coalesce(try_cast(regexp_extract({text}, '[eE]([+-]?[0-9]+)$', 1) AS INT), 0)"
    exponent = f"({power} - length({part}) + length({digits}) - length({bare}))"
    before = f"(length({bare}) + {exponent})"
    plain = (
        f"CASE WHEN abs({exponent}) > {MOST_ZEROS} THEN concat({bare}, 'e', CAST({exponent} AS STRING)) "
        f"WHEN {exponent} >= 0 THEN concat({bare}, repeat('0', {exponent})) "
        f"WHEN {before} > 0 THEN concat(left({bare}, {before}), '.', substring({bare}, {before} + 1)) "
        f"ELSE concat('0.', repeat('0', -{before}), {bare}) END"
    )
    form = f"if({bare} = '', '0', concat(if(startswith({text}, '-'), '-', ''), {plain}))"
    return f"if({text} RLIKE '{NUMBER_TEXT}', {form}, {text})"


def whole_form_sql(value: str) -> str:
    """The same form of a whole-number column."""
    return f"CAST({value} AS STRING)"


def fraction_form_sql(value: str, decimal: bool) -> str:
    """The same form of a floating or decimal column; patterns are used only where it prints with an exponent."""
    text = f"CAST({value} AS STRING)"
    if decimal:
        bare = f"rtrim('.', rtrim('0', {text}))"
        return f"if(contains({text}, 'E'), {number_form_sql(text)}, if(contains({text}, '.'), if({value} = 0, '0', {bare}), {text}))"
    whole = f"{value} = floor({value}) AND abs({value}) < 1e15"
    short = f"abs({value}) >= 1e-3 AND abs({value}) < 1e7"
    return f"CASE WHEN {whole} THEN CAST(CAST({value} AS BIGINT) AS STRING) WHEN {short} THEN {text} ELSE {number_form_sql(text)} END"
