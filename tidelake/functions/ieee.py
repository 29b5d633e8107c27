"""IEEE-754 arithmetic and comparisons as columns.

Spark raises on division by zero in ANSI mode, treats NaN as equal to itself and as the
largest number, and gives null for logarithms of numbers that are not positive; the query
language follows the floating-point standard instead.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")
INF = float("inf")


def num(v: float) -> Column:
    return F.lit(float(v)).cast("double")


def divide(a: Column, b: Column) -> Column:
    """x/0 is an infinity of x's sign (the divisor's sign bit counts too), 0/0 is NaN."""
    negative = b.cast("string") == "-0.0"
    by_zero = F.when((a == 0) | F.isnan(a), num(NAN)).otherwise(F.signum(a) * F.when(negative, num(-INF)).otherwise(num(INF)))
    return F.when(b == 0, by_zero).otherwise(F.try_divide(a, b))


def modulo(a: Column, b: Column) -> Column:
    """C's fmod: the sign is the dividend's."""
    infinite = F.abs(a) == num(INF)
    return F.when((b == 0) | F.isnan(a) | F.isnan(b) | infinite, num(NAN)).when(F.abs(b) == num(INF), a).otherwise(F.try_mod(a, b))


def _some_nan(a: Column, b: Column) -> Column:
    return F.isnan(a) | F.isnan(b)


def compare(op: str, a: Column, b: Column) -> Column:
    if op == "!=":
        return _some_nan(a, b) | (a != b)
    plain = {"==": a == b, ">": a > b, "<": a < b, ">=": a >= b, "<=": a <= b}[op]
    return plain & ~_some_nan(a, b)


def power(a: Column, b: Column) -> Column:
    return F.when(b == 0, num(1.0)).when(a == 1, num(1.0)).otherwise(F.pow(a, b))


def arithmetic(op: str, a: Column, b: Column) -> Column:
    return {
        "+": lambda: a + b,
        "-": lambda: a - b,
        "*": lambda: a * b,
        "/": lambda: divide(a, b),
        "%": lambda: modulo(a, b),
        "^": lambda: power(a, b),
        "atan2": lambda: F.when(_some_nan(a, b), num(NAN)).otherwise(F.atan2(a, b)),
    }[op]()


def _log(function, v: Column) -> Column:
    return F.when(F.isnan(v) | (v < 0), num(NAN)).when(v == 0, num(-INF)).otherwise(function(v))


def _whole(function, v: Column) -> Column:
    """ceil and floor give integers, so huge and special values pass unchanged."""
    return F.when(F.isnan(v) | (F.abs(v) >= 2.0**53), v).otherwise(function(v).cast("double"))


#: Functions of one number.
UNARY = {
    "abs": F.abs,
    "ceil": lambda v: _whole(F.ceil, v),
    "floor": lambda v: _whole(F.floor, v),
    "exp": F.exp,
    "sqrt": F.sqrt,
    "ln": lambda v: _log(F.log, v),
    "log2": lambda v: _log(F.log2, v),
    "log10": lambda v: _log(F.log10, v),
    "sin": F.sin,
    "cos": F.cos,
    "tan": F.tan,
    "asin": F.asin,
    "acos": F.acos,
    "atan": F.atan,
    "sinh": F.sinh,
    "cosh": F.cosh,
    "tanh": F.tanh,
    "asinh": F.asinh,
    "acosh": F.acosh,
    "atanh": F.atanh,
    "deg": F.degrees,
    "rad": F.radians,
    "sgn": lambda v: F.when(F.isnan(v), v).otherwise(F.signum(v)),
}


def round_to(v: Column, nearest: Column) -> Column:
    """To the nearest multiple, halves up."""
    inverse = divide(num(1.0), nearest)
    return divide(_whole(F.floor, v * inverse + 0.5), inverse)


def lowest(a: Column, b: Column) -> Column:
    return F.when(_some_nan(a, b), num(NAN)).otherwise(F.least(a, b))


def highest(a: Column, b: Column) -> Column:
    return F.when(_some_nan(a, b), num(NAN)).otherwise(F.greatest(a, b))


def max_ignoring_nan(v: Column) -> Column:
    """NaN only if there is nothing else."""
    return F.coalesce(F.max(F.when(~F.isnan(v), v)), num(NAN))


def quantile(v: Column, q: Column) -> Column:
    """Interpolated quantile of a group; NaN counts as the smallest value."""
    inside = F.coalesce(F.when((q >= 0) & (q <= 1), q), num(0.5))
    ranked = F.array_sort(F.transform(F.collect_list(v), lambda x: F.struct((~F.isnan(x)).alias("some"), x.alias("x"))))
    n = F.size(ranked)
    rank = inside * (n - 1)
    low = F.floor(rank).cast("int")
    high = F.least(low + 1, n - 1)
    weight = rank - low
    value = F.element_at(ranked, low + 1)["x"] * (1 - weight) + F.element_at(ranked, high + 1)["x"] * weight
    return F.when(F.isnan(q), num(NAN)).when(q < 0, num(-INF)).when(q > 1, num(INF)).otherwise(value)


#: Calendar functions (UTC) of a number of seconds.
def _time(v: Column) -> Column:
    return F.timestamp_seconds(F.floor(v).cast("double"))


CALENDAR = {
    "year": lambda v: F.year(_time(v)),
    "month": lambda v: F.month(_time(v)),
    "day_of_month": lambda v: F.dayofmonth(_time(v)),
    "day_of_week": lambda v: F.dayofweek(_time(v)) - 1,
    "day_of_year": lambda v: F.dayofyear(_time(v)),
    "days_in_month": lambda v: F.dayofmonth(F.last_day(_time(v))),
    "hour": lambda v: F.hour(_time(v)),
    "minute": lambda v: F.minute(_time(v)),
}


def calendar(name: str, v: Column) -> Column:
    return F.when(F.isnan(v) | (F.abs(v) == num(INF)), num(NAN)).otherwise(CALENDAR[name](v).cast("double"))


def format_value(v: Column) -> Column:
    """Shortest decimal form: 5, 0.1, 10000000000, NaN, +Inf."""
    plain = F.when(
        (v == F.floor(v)) & (F.abs(v) < 1e15), F.floor(v).cast("long").cast("string")
    ).otherwise(F.regexp_replace(F.regexp_replace(v.cast("decimal(38,18)").cast("string"), r"0+$", ""), r"\.$", ""))
    small = F.abs(v) < 1e15
    return (
        F.when(F.isnan(v), F.lit("NaN")).when(v == num(INF), F.lit("+Inf")).when(v == num(-INF), F.lit("-Inf"))
        .when(small, plain).otherwise(F.format_string("%.0f", v))
    )
