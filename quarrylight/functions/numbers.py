"""Lenient number parsing, guarded arithmetic and number formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed patterns: the number grammars the request parsers and the result cleaning accept.
_WORD = r"[+-]?([iI][nN][fF]([iI][nN][iI][tT][yY])?|[nN][aA][nN])"
DOT_NUMBER = rf"^({_WORD}|[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?)$"
PREFIX_NUMBER = rf"^\s*({_WORD}|[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?)"
PREFIX_HEX = r"^\s*([+-]?)0[xX](?=\.?[0-9a-fA-F])([0-9a-fA-F]*)\.?([0-9a-fA-F]*)(?:[pP]([+-]?\d+))?"
CSV_NUMBER = rf"^({_WORD}|[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?)$"

FLOAT_MAX = 3.4028234663852886e38
# Hexadecimal digits that a double holds exactly.
HEX_DIGITS = 13


def _to_double(text: Column) -> Column:
    """Checked number text as a double: digit separators and the sign of nan go first."""
    return F.regexp_replace(text, "_|^[+-](?=[nN])", "").try_cast("double")


def parse_dot(text: Column) -> Column:
    """Decimal comma becomes a point and the whole text must be a number, else 0.0."""
    dotted = F.trim(F.translate(text, ",\t\n\r", ".   "))
    return F.coalesce(F.when(dotted.rlike(DOT_NUMBER), _to_double(dotted)), F.lit(0.0))


def whole_number(text: Column) -> Column:
    """The text, less outer blanks, as a number of the dotted grammar; else null."""
    bare = F.trim(F.translate(text, "\t\n\r", "   "))
    return F.when(bare.rlike(DOT_NUMBER), _to_double(bare))


def _hexadecimal(text: Column) -> Column:
    """The hexadecimal number at the start of a text, fraction and binary exponent included.

    The first digits that a double holds exactly are read; any digit behind them only sets the last
    bit, so that rounding to a float sees on which side of the middle the number lies.
    """
    part = lambda i: F.regexp_extract(text, PREFIX_HEX, i)
    digits = F.ltrim(F.concat(part(2), part(3)), F.lit("0"))
    head, rest = F.substring(digits, 1, HEX_DIGITS), F.substring(digits, HEX_DIGITS + 1, 2**31 - 1)
    whole = F.coalesce(F.conv(F.nullif(head, F.lit("")), 16, 10).cast("double"), F.lit(0.0))
    whole = whole + F.when(rest.rlike("[1-9a-fA-F]") & (whole % 2 == 0), 1.0).otherwise(0.0)
    far = F.when(part(4).startswith("-"), -100_000).otherwise(100_000)
    power = F.when(part(4) == "", 0).otherwise(F.coalesce(part(4).try_cast("int"), far).cast("bigint"))
    shift = power + 4 * (F.length(rest) - F.length(part(3)))
    size = F.when(whole == 0, 0.0).otherwise(whole * F.pow(F.lit(2.0), shift.cast("double")))
    return F.when(part(1) == "-", -size).otherwise(size)


def parse_prefix(text: Column) -> Column:
    """Commas and blanks are removed and the longest leading number counts, as a float, else 0."""
    kept = F.translate(text, ", ", "")
    leading = F.regexp_extract(kept, PREFIX_NUMBER, 1)
    # Rare, and long as an expression: bound in a lambda it stays out of the generated code.
    hexadecimal = F.get(F.transform(F.array(kept), _hexadecimal), F.lit(0))
    number = F.when(kept.rlike(PREFIX_HEX), hexadecimal).otherwise(_to_double(leading))
    in_range = (F.abs(number) <= F.lit(FLOAT_MAX)) | leading.rlike("[iInN]")
    return F.when(in_range, number).otherwise(F.lit(0.0)).cast("float")


def to_numeric(value: Column) -> Column:
    """Number or null: text that is no number becomes null."""
    text = F.trim(value.cast("string"))
    number = F.when(text.rlike(CSV_NUMBER), _to_double(text))
    return F.nullif(number, F.lit(float("nan")))


def as_number(value: Column) -> Column:
    """A double: numbers as they are, text as `to_numeric` reads it (blank text is missing); NaN is null."""
    plain = value.try_cast("double")
    return F.when(F.typeof(value) == "string", to_numeric(value)).otherwise(F.when(~F.isnan(plain), plain))


def looks_numeric(value: Column) -> Column:
    """True if a numeric parse of the value would not fail; nulls and empty text are fine."""
    text = F.trim(value.cast("string"))
    return F.coalesce((text == "") | text.rlike(CSV_NUMBER), F.lit(True))


def guarded_ratio(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator, 0 where the denominator is not positive or unknown."""
    return F.when(denominator > 0, numerator / denominator).otherwise(F.lit(0.0))


def percent_div(part: Column, total: Column) -> Column:
    """Whole-number percentage truncated towards zero, 0 where the total is not positive."""
    scaled = part.cast("bigint") * F.lit(100)
    quotient = F.call_function("div", scaled, F.when(total > 0, total.cast("bigint")))
    return F.coalesce(quotient, F.lit(0).cast("bigint"))


def error_percent(success: Column, total: Column) -> Column:
    """100 * (1 - success/total); 0 if either count is missing or the total is 0."""
    known = success.isNotNull() & total.isNotNull() & (total != 0)
    return F.when(known, (F.lit(1.0) - success / F.nullif(total, F.lit(0))) * 100).otherwise(F.lit(0.0))


def error_percent_truncated(success: Column, total: Column) -> Column:
    """Like error_percent, but the quotient is cut to two decimals first."""
    known = success.isNotNull() & total.isNotNull() & (total != 0)
    cut = F.floor(success * 100 / F.nullif(total, F.lit(0)))
    return F.when(known, F.lit(100.0) - cut).otherwise(F.lit(0.0))


def leading_number(text: Column, decimals: int) -> Column:
    """Drop everything but digits and points, read the leading number, round; 0 if none."""
    return rounded(leading_digits(text), decimals)


def leading_digits(text: Column) -> Column:
    """leading_number without rounding. Text of digits with a point at most is read as it stands."""
    plain = F.when(F.translate(text, "0123456789.", "") == "", text.try_cast("double"))
    kept = F.regexp_replace(text, r"[^0-9.]", "")
    odd = F.nullif(F.regexp_extract(kept, r"^(\d+\.?\d*|\.\d+)", 1), F.lit("")).try_cast("double")
    return F.coalesce(plain, odd, F.lit(0.0))


def logistic_if_outside(value: Column) -> Column:
    """Values in [0, 1] are kept, others go through the logistic function."""
    outside = (value < 0) | (value > 1)
    return F.when(outside, F.lit(1.0) / (F.lit(1.0) + F.exp(-value))).otherwise(value)


def probability_from_output(output: Column) -> Column:
    """Positive-class probability from a model's raw output array.

    Two or more values: the second. One value: logistic_if_outside. Empty: null.
    """
    width = F.size(output)
    return F.when(width >= 2, F.get(output, F.lit(1))).when(
        width == 1, logistic_if_outside(F.get(output, F.lit(0)))
    )


def exceeds(probability: Column, threshold: float = 0.5) -> Column:
    """Strict threshold; a tie is negative."""
    return probability > F.lit(threshold)


def _scaled(value: Column, decimals: int) -> Column:
    """|value| * 10^decimals as a whole double: the exact binary value rounded, ties to even.

    The product is taken with its rounding error (both factors split in halves), which decides
    whether the exact value lies below, on or above the middle. The exact power has no error.
    """
    size, power = F.abs(value), float(10**decimals)
    high = 134217729.0 * size - (134217729.0 * size - size)
    low = size - high
    power_high = 134217729.0 * power - (134217729.0 * power - power)
    power_low = power - power_high
    product = size * power
    error = ((high * power_high - product) + high * power_low + low * power_high) + low * power_low
    whole = F.floor(product).cast("double")
    beyond = (product - whole) - 0.5
    up = (beyond > 0) | ((beyond == 0) & ((error > 0) | ((error == 0) & (whole % 2 == 1))))
    return whole + F.when(up, 1.0).otherwise(0.0)


def _bind(value: Column, expression) -> Column:
    """expression of a value that is computed once."""
    return F.get(F.transform(F.array(value.cast("double")), expression), F.lit(0))


def rounded_column(x: Column, decimals: int) -> Column:
    """`rounded` for a column that is there already: without a binding it stays in generated code."""
    near = _scaled(x, decimals) / float(10**decimals)
    return F.when(F.abs(x) * float(10**decimals) < 2.0**52, F.signum(x) * near).otherwise(x)


def rounded(value: Column, decimals: int) -> Column:
    """The exact binary value rounded to so many decimals, ties to even; beyond 2^52 units nothing is left to round."""
    return _bind(value, lambda x: rounded_column(x, decimals))


def fixed_text(value: Column, decimals: int) -> Column:
    """Fixed-point text of the exact binary value, ties to even: 2.675 is 2.67, 0.125 is 0.12."""
    def expression(x: Column) -> Column:
        units = _scaled(x, decimals).cast("bigint")
        power = F.lit(10**decimals).cast("bigint")
        whole = F.call_function("div", units, power).cast("string")
        tail = F.concat(F.lit("."), F.lpad((units % power).cast("string"), decimals, "0")) if decimals else F.lit("")
        text = F.concat(F.when(x < 0, F.lit("-")).otherwise(F.lit("")), whole, tail)
        return F.when(F.abs(x) * float(10**decimals) < 2.0**52, text).otherwise(F.format_string(f"%.{decimals}f", x))
    return _bind(value, expression)


def _shortest(value: Column) -> Column:
    java = value.cast("string")
    size = F.abs(value)
    plain = F.regexp_replace(java.try_cast("decimal(38,20)").cast("string"), r"0+$", "")
    power = F.regexp_extract(java, r"E(-?\d+)$", 1).try_cast("int")
    scientific = F.concat(
        F.regexp_replace(F.regexp_extract(java, r"^(-?[\d.]+)E", 1), r"\.0$", ""),
        F.when(power < 0, F.lit("e-")).otherwise(F.lit("e+")),
        F.format_string("%02d", F.abs(power)),
    )
    return (
        F.when(F.isnan(value) | (size == float("inf")), F.lower(F.replace(java, F.lit("inity"), F.lit(""))))
        .when(~java.contains("E"), java)
        .when((size >= 1e-4) & (size < 1e16), F.regexp_replace(plain, r"\.$", ".0"))
        .otherwise(scientific)
    )


def shortest_text(value: Column) -> Column:
    """Shortest decimal text of a double: plain digits from 1e-4 up to 1e16, else d.de+XX."""
    # The lambda binds the value once, which keeps the many uses out of the generated code.
    return F.get(F.transform(F.array(value.cast("double")), _shortest), F.lit(0))


def null_if_nan(name: str, dtype: str) -> Column:
    """Treat NaN in floating columns as missing."""
    column = F.col(f"`{name}`")
    return F.when(~F.isnan(column), column) if dtype in ("double", "float") else column
