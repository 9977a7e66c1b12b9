"""Column functions with the engine's rounding, modulo and exactness rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column) -> Column:
    """floor(x + 1/2): halves go up for negative values too."""
    return F.floor(x + F.lit(0.5)).cast("long")


def true_mod(x: Column, m: Column | int) -> Column:
    """Mathematical modulo, never negative."""
    return F.pmod(x, F.lit(m) if isinstance(m, int) else m)


def ceil_div(a: Column, b: int) -> Column:
    """ceil(a / b) of non-negative integers."""
    return F.call_function("div", a + F.lit(b - 1), F.lit(b))


def gcd(a: Column, b: Column, rounds: int = 48) -> Column:
    """Greatest common divisor by Euclid's rule, unrolled over a bounded sequence."""
    start = F.struct(F.abs(a).cast("long").alias("x"), F.abs(b).cast("long").alias("y"))
    step = lambda s, _: F.struct(F.when(s["y"] == 0, s["x"]).otherwise(s["y"]).alias("x"), F.when(s["y"] == 0, F.lit(0).cast("long")).otherwise(s["x"] % s["y"]).alias("y"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step, lambda s: s["x"])


def fraction_text(num: Column, den: Column) -> Column:
    """``num/den`` in lowest terms; the sign is the numerator's."""
    g = gcd(num, den)
    return F.concat_ws("/", _div(num, g).cast("string"), _div(den, g).cast("string"))


def _div(a: Column, b: Column) -> Column:
    """Integer quotient, towards zero."""
    return F.call_function("div", a, b)


def q9(num: Column, den: Column) -> Column:
    """num/den rounded half-even to nine places, times 10**9, as an integer.

    Long division of whole numbers, three digits at a time, so nothing is ever
    a float; the denominator must be below 9.2e15.
    """
    a, b = F.abs(num).cast("long"), F.abs(den).cast("long")
    out, rest = _div(a, b), F.call_function("mod", a, b)
    for _ in range(3):
        out = out * 1000 + _div(rest * 1000, b)
        rest = F.call_function("mod", rest * 1000, b)
    up = (2 * rest > b) | ((2 * rest == b) & (out % 2 == 1))
    return F.signum(num).cast("long") * F.signum(den).cast("long") * (out + up.cast("long"))


def sign9(num: Column, den: Column) -> Column:
    """Sign of the value rounded to nine places."""
    return F.signum(q9(num, den)).cast("int")


def log_ratio(a: Column, b: Column) -> Column:
    """log(a / b); null unless both are positive."""
    return F.when((a > 0) & (b > 0), F.log(a / b))


def error_bound(n: Column, unit: float = 2.0**-24) -> Column:
    """Relative error of n rounded operations: n u / (1 - n u)."""
    return n * F.lit(unit) / (F.lit(1.0) - n * F.lit(unit))


def lag_source(i: Column, k: Column) -> Column:
    """Lag permutation: 0 stays, i goes to (i mod (k - 1)) + 1; identity for k up to 2."""
    return F.when((i == 0) | (k <= 2), i).otherwise(F.pmod(i, F.greatest(k - 1, F.lit(1))) + 1)


def frame_number(name: Column) -> Column:
    """First run of digits of a file name."""
    return F.regexp_extract(F.trim(name), "([0-9]+)", 1).cast("int")


def label_list(text: Column) -> Column:
    """A list of integers written as ``[4, 5]``."""
    return F.from_json(text, "array<int>")


def without_nan(x: Column) -> Column:
    """NaN becomes null, as no comparison with a missing value may hold."""
    return F.when(~F.isnan(x), x)
