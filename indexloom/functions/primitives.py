"""Scalar primitives with wrap-around integers and IEEE floating point, as column expressions.

Spark's own functions differ in places: division by zero and logarithms of non-positive numbers give null,
NaN equals itself and is the largest number, and in ANSI mode overflow raises. These functions give what the
array language defines. Integer arithmetic wraps only where ANSI mode is off while an expression is built: see
`plans.session.wrapping`.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")
NAN = float("nan")
WIDTH = {"tinyint": 8, "smallint": 16, "int": 32, "bigint": 64}


def _lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


# integers


def quot(x: Column, y: Column) -> Column:
    """Division towards zero."""
    return F.call_function("div", x, _lit(y))


def rem(x: Column, y: Column) -> Column:
    """The remainder of quot, with the dividend's sign."""
    return x % y


def mod(x: Column, y: Column) -> Column:
    """The remainder of floor division, with the divisor's sign."""
    y = _lit(y)
    r = x % y
    return F.when((r != 0) & ((r < 0) != (y < 0)), r + y).otherwise(r)


def div(x: Column, y: Column) -> Column:
    """Division towards minus infinity."""
    y = _lit(y)
    r = x % y
    return F.when((r != 0) & ((r < 0) != (y < 0)), quot(x, y) - 1).otherwise(quot(x, y))


def signum_int(x: Column) -> Column:
    return F.when(x > 0, 1).when(x < 0, -1).otherwise(0)


def complement(x: Column) -> Column:
    return F.bitwise_not(x)


def band(x: Column, y) -> Column:
    return x.bitwiseAND(_lit(y))


def bor(x: Column, y) -> Column:
    return x.bitwiseOR(_lit(y))


def bxor(x: Column, y) -> Column:
    return x.bitwiseXOR(_lit(y))


def shift_left(x: Column, k) -> Column:
    return F.call_function("shiftleft", x, _lit(k).cast("int"))


def shift_right(x: Column, k) -> Column:
    """Keeps the sign."""
    return F.call_function("shiftright", x, _lit(k).cast("int"))


def shift_right_logical(x: Column, k) -> Column:
    """Fills with zeros: the right shift of unsigned types."""
    return F.call_function("shiftrightunsigned", x, _lit(k).cast("int"))


def rotate_left(x: Column, k, width: int = 64) -> Column:
    """Of a 64-bit number, or of the low `width` bits, which must hold an unsigned number."""
    k = F.pmod(_lit(k).cast("int"), F.lit(width))
    if width == 64:
        return bor(shift_left(x, k), F.when(k == 0, F.lit(0).cast("long")).otherwise(shift_right_logical(x, F.lit(64) - k)))
    mask = (1 << width) - 1
    return band(bor(shift_left(x, k), shift_right_logical(x, F.lit(width) - k)), mask)


def rotate_right(x: Column, k, width: int = 64) -> Column:
    return rotate_left(x, -_lit(k).cast("int"), width)


def _own_bits(x: Column, width: int) -> Column:
    """The number's bits at its own width, as a non-negative long where that is under 64."""
    x = x.cast("long")
    return x if width == 64 else band(x, (1 << width) - 1)


def pop_count(x: Column, width: int = 64) -> Column:
    return F.bit_count(_own_bits(x, width))


def count_leading_zeros(x: Column, width: int = 64) -> Column:
    """`width` for 0."""
    x = _own_bits(x, width)
    return F.when(x == 0, F.lit(width)).otherwise(F.lit(width) - F.length(F.bin(x)))


def count_trailing_zeros(x: Column, width: int = 64) -> Column:
    """`width` for 0."""
    x = _own_bits(x, width)
    # the ones below the lowest set bit: x & ~x - 1 would overflow at the least number, so by bits
    low = band(complement(x), F.when(x == -(1 << 63), (1 << 63) - 1).otherwise(x - 1))
    return F.when(x == 0, F.lit(width)).otherwise(F.bit_count(low))


# floating point


def fdiv(x: Column, y) -> Column:
    """IEEE division; a zero divisor counts as +0."""
    x, y = _lit(x).cast("double"), _lit(y).cast("double")
    zero = F.when(x > 0, F.when(F.isnan(x), NAN).otherwise(INF)).when(x < 0, -INF).otherwise(NAN)
    return F.when(y == 0, zero).otherwise(F.try_divide(x, y))


def recip(x: Column) -> Column:
    return fdiv(F.lit(1.0), x)


def signum(x: Column) -> Column:
    """0.0 for NaN and for -0.0."""
    return F.when(F.isnan(x), 0.0).when(x > 0, 1.0).when(x < 0, -1.0).otherwise(0.0)


def ln(x: Column) -> Column:
    """-Infinity at 0, NaN below."""
    x = x.cast("double")
    return F.when(x == 0, -INF).when(x < 0, NAN).otherwise(F.log(x))


def log_base(base: float, x: Column) -> Column:
    """log x / log base, or the exact functions for 2 and 10."""
    exact = {2: F.log2, 10: F.log10}.get(base)
    x = x.cast("double")
    some = exact(x) if exact else F.log(x) / F.log(F.lit(float(base)))
    return F.when(x == 0, -INF).when(x < 0, NAN).otherwise(some)


def is_infinite(x: Column) -> Column:
    return F.abs(x) == INF


def fmax(x: Column, y: Column) -> Column:
    """The larger number; NaN only if both are."""
    return F.greatest(F.nanvl(x, y), F.nanvl(y, x))


def fmin(x: Column, y: Column) -> Column:
    return F.least(F.nanvl(x, y), F.nanvl(y, x))


def round_half_away(x: Column) -> Column:
    """To a double; numbers of 2^52 or more are whole already."""
    return F.when(F.abs(x) < float(1 << 52), F.round(x)).otherwise(x)


def truncate(x: Column) -> Column:
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x))


def _unordered(x: Column, y: Column) -> Column:
    return F.isnan(x) | F.isnan(y)


def feq(x: Column, y: Column) -> Column:
    """IEEE comparison: false if either is NaN."""
    return ~_unordered(x, y) & (x == y)


def fne(x: Column, y: Column) -> Column:
    return ~feq(x, y)


def flt(x: Column, y: Column) -> Column:
    return ~_unordered(x, y) & (x < y)


def fle(x: Column, y: Column) -> Column:
    return ~_unordered(x, y) & (x <= y)


def fgt(x: Column, y: Column) -> Column:
    return flt(y, x)


def fge(x: Column, y: Column) -> Column:
    return fle(y, x)


# conversions


def from_integral(x: Column, kind: str) -> Column:
    """Truncates to the type's width, or extends; `kind` names a signed Spark type, float or double."""
    if kind not in WIDTH or kind == "bigint":
        return x.cast(kind)
    half, whole = 1 << (WIDTH[kind] - 1), 1 << WIDTH[kind]
    low = band(x.cast("long"), whole - 1)
    return F.when(low >= half, low - whole).otherwise(low).cast(kind)


def to_word(x: Column, width: int) -> Column:
    """An unsigned number of `width` bits, under 64, as a long."""
    return band(x.cast("long"), (1 << width) - 1)


# structure


def while_loop(state: Column, steps: int, running, step) -> Column:
    """Apply step while running(state) holds; an error if it still holds after `steps` times."""
    last = F.aggregate(
        F.sequence(F.lit(1), F.lit(steps)), state, lambda s, _: F.when(running(s), step(s)).otherwise(s),
        lambda s: F.struct(s.alias("s"), running(s).alias("on")),
    )
    return F.when(last["on"], F.raise_error(F.lit(f"a loop still runs after {steps} steps"))).otherwise(last["s"])


def while_unbounded(x: Column, running, step, kind: str = "long") -> Column:
    """How many times step applies to x while running(x) holds, without a bound; both take and return a NumPy array.

    Runs in Arrow batches, each until its last value is done. A null has a null count.
    """
    @F.pandas_udf("long")
    def count(s):
        known = np.flatnonzero(s.notna().to_numpy())
        state, out = s.dropna().to_numpy(np.int64 if kind == "long" else np.float64), np.zeros(len(s), np.int64)
        at = known
        while len(on := np.flatnonzero(running(state))):
            at, state = at[on], step(state[on])
            out[at] += 1
        return pd.Series(out, dtype="Int64").where(s.notna().to_numpy())

    return count(x.cast(kind))


def case_of(tag: Column, branches: dict[int, Column], default: Column | None = None) -> Column:
    """The branch of a tag; an unknown tag without a default is an error."""
    out = None
    for value, branch in branches.items():
        out = F.when(tag == value, branch) if out is None else out.when(tag == value, branch)
    if default is None:
        default = F.raise_error(F.concat(F.lit("no branch for tag "), tag.cast("string")))
    return out.otherwise(default)


def vec_pack(*lanes: Column) -> Column:
    return F.array(*lanes)


def vec_unpack(vector: Column, n: int) -> list[Column]:
    return [F.element_at(vector, k + 1) for k in range(n)]


SAME_BITS = {"double": "bigint", "bigint": "double", "float": "int", "int": "float"}
_NUMPY = {"double": np.float64, "bigint": np.int64, "float": np.float32, "int": np.int32}


def coerce(x: Column, kind: str) -> Column:
    """The same bits as the other type of their width: double and bigint, float and int. A null stays null.

    Spark has no built-in for it, so this runs in Arrow batches.
    """
    to, start = _NUMPY[kind], _NUMPY[SAME_BITS[kind]]

    @F.pandas_udf(kind)
    def view(s):
        return pd.Series(np.ascontiguousarray(s.to_numpy(start)).view(to))

    zero = F.lit(0).cast(SAME_BITS[kind])
    return F.when(x.isNotNull(), view(F.coalesce(x, zero)))


def bits_of(x: Column) -> Column:
    """The bits of a double as a long."""
    return coerce(x, "bigint")
