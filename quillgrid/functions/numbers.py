"""Number parsing and printing as Columns: strict parsing, shortest printing, scaled rounding."""

from __future__ import annotations

import zlib

from pyspark.sql import Column
from pyspark.sql import functions as F

FLOAT = r"(?i)\A[+-]?(inf|infinity|nan|([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?)\z"
INTEGER = r"\A[+-]?[0-9]+\z"


def parse_float(text: Column) -> Column:
    """Double of a text, null if it is none; knows inf, infinity and nan with sign, no suffixes or blanks."""
    low = F.lower(text)
    return (
        F.when(~text.rlike(FLOAT), F.lit(None).cast("double"))
        .when(low.rlike("nan"), F.lit(float("nan")))
        .when(low.rlike("inf"), F.when(low.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf"))))
        .otherwise(text.try_cast("double"))
    )


def parse_integer(text: Column) -> Column:
    """64-bit integer of a text, null if it is none or does not fit."""
    return F.when(text.rlike(INTEGER), text.try_cast("bigint"))


def parse_boolean(text: Column) -> Column:
    """True and false in any case, null for anything else."""
    low = F.lower(text)
    return F.when(low == "true", F.lit(True)).when(low == "false", F.lit(False))


def display(x: Column) -> Column:
    """Shortest text of a double, never with an exponent: 1, 0.001, 10000000000, NaN, inf, -0."""
    s = x.cast("string")
    sign = F.when(s.startswith("-"), F.lit("-")).otherwise(F.lit(""))
    n = F.substring_index(s, "E", -1).try_cast("int")
    # a mantissa has one digit before its point; the one of a round number is d.0
    mantissa = F.translate(F.substring_index(s, "E", 1), "-.", "")
    digits = F.when((F.length(mantissa) == 2) & mantissa.endswith("0"), F.substring(mantissa, 1, 1)).otherwise(mantissa)
    large = F.when(F.length(digits) <= n + 1, F.rpad(digits, n + 1, F.lit("0"))).otherwise(F.concat(F.substring(digits, F.lit(1), n + 1), F.lit("."), F.substring(digits, n + 2, F.length(digits))))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -n - 1), digits)
    return (
        F.when((x == F.floor(x)) & (F.abs(x) < 1e15) & (x != 0), x.cast("bigint").cast("string"))
        .when(F.isnan(x), F.lit("NaN"))
        .when(s == "Infinity", F.lit("inf"))
        .when(s == "-Infinity", F.lit("-inf"))
        .when(s.contains("E"), F.concat(sign, F.when(n >= 0, large).otherwise(small)))
        .when(s.endswith(".0"), F.substring(s, F.lit(1), F.length(s) - 2))
        .otherwise(s)
    )


def round_scaled(x: Column, digits: Column | int = 0) -> Column:
    """Half away from zero on the binary double scaled by ten to the digits; negative digits round tens."""
    scale = F.pow(F.lit(10.0), (F.lit(digits) if isinstance(digits, int) else digits).cast("double"))
    y = x * scale
    whole = F.floor(F.abs(y))
    rounded = F.signum(y) * (whole + F.when(F.abs(y) - whole >= 0.5, 1.0).otherwise(0.0))
    return F.when(F.isnan(x) | (F.abs(y) >= 2.0**52), x).otherwise(rounded / scale)


def nice_step(raw: Column) -> Column:
    """Axis step near ``raw``: 1, 2, 5 or 10 times a power of ten (limits 1.5, 3.5, 7.5); 1 if raw is not positive."""
    power = F.pow(F.lit(10.0), F.floor(F.log10(raw)).cast("double"))
    part = raw / power
    return F.when((raw <= 0) | raw.isNull() | F.isnan(raw), F.lit(1.0)).otherwise(F.when(part < 1.5, 1.0).when(part < 3.5, 2.0).when(part < 7.5, 5.0).otherwise(10.0) * power)


def axis_ticks(low: Column, high: Column) -> Column:
    """Ticks from below low to one step above high, some six of them, 32 at most."""
    step = nice_step(F.greatest(high - low, F.lit(1.0)) / 6)
    first = F.floor(low / step) * step
    count = F.least(F.lit(32), (F.round((F.ceil(high / step) * step - first) / step) + 2).cast("int"))
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: first + i.cast("double") * step)


def format_tick(x: Column) -> Column:
    """Whole numbers plainly, others with up to four decimals."""
    whole = F.abs(x - F.round(x)) < 1e-9
    return F.when(whole, F.round(x).cast("bigint").cast("string")).otherwise(F.regexp_replace(F.regexp_replace(F.format_string("%.4f", x), "0+$", ""), r"\.$", ""))


def emu_to_mm(emu: Column) -> Column:
    return emu.cast("double") / 36000.0


def pt_to_mm(pt: Column) -> Column:
    return pt.cast("double") * 0.352778


def px_to_mm(px: Column) -> Column:
    return px.cast("double") * 0.264583


def adler32(data: Column) -> Column:
    """Adler-32 of bytes, as a long; null of null."""
    # a worker's loop over bytes in C; no built-in function has this sum
    return F.pandas_udf(lambda s: s.map(lambda b: zlib.adler32(b) if b is not None else None).astype("Int64"), "long")(data)
