"""Scalar primitives at the edges: least numbers, signs, zeros, NaN and infinities."""

import math

import pytest
from pyspark.sql import functions as F

from indexloom.functions import primitives as P
from indexloom.plans.session import wrapping

LEAST, MOST = -(1 << 63), (1 << 63) - 1
WHOLE = [0, 1, -1, 7, -7, 2, 255, -128, 1 << 40, LEAST, MOST]
REAL = [0.0, -0.0, 1.0, -1.0, 2.5, -2.5, 0.49999999999999994, 1e300, 5e-324, math.inf, -math.inf, math.nan]


def wrap(x, width=64):
    x &= (1 << width) - 1
    return x - (1 << width) if x >> (width - 1) else x


def each(spark, values, kind, *columns):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k long, x {kind}")
    return [tuple(r)[1:] for r in df.select("k", *columns).orderBy("k").collect()]


def same(a, b):
    return a == b or (isinstance(a, float) and math.isnan(a) and math.isnan(b))


def test_bits(spark):
    x = F.col("x")
    got = each(
        spark, WHOLE, "long", P.pop_count(x), P.count_leading_zeros(x), P.count_trailing_zeros(x), P.complement(x),
        P.rotate_left(x, 5), P.rotate_right(x, 5), P.rotate_left(x, 0), P.shift_right(x, 3), P.shift_right_logical(x, 3),
        P.pop_count(x, 8), P.to_word(x, 16), P.signum_int(x),
    )
    for v, row in zip(WHOLE, got):
        u = v & ((1 << 64) - 1)
        text = f"{u:064b}"
        model = (
            text.count("1"), 64 if not u else text.index("1"), 64 if not u else 63 - text.rindex("1"), ~v,
            wrap((u << 5 | u >> 59)), wrap((u >> 5 | u << 59)), v, v >> 3, wrap(u >> 3), bin(u & 255).count("1"), u & 65535,
            (v > 0) - (v < 0),
        )
        assert row == model, v


@pytest.mark.parametrize("y", [1, 2, -2, 7, -7])
def test_division(spark, y):
    values = [v for v in WHOLE if v not in (LEAST,)]
    x, d = F.col("x"), F.lit(y).cast("long")
    got = each(spark, values, "long", P.quot(x, d), P.rem(x, d), P.div(x, d), P.mod(x, d))
    for v, row in zip(values, got):
        q = abs(v) // abs(y) * (1 if (v < 0) == (y < 0) else -1)
        assert row == (q, v - q * y, v // y, v % y), v


def test_wrapping(spark):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(WHOLE)], "k long, x long")
    with wrapping(spark):
        out = df.select("k", F.col("x") + F.lit(MOST), F.col("x") * F.lit(3), -F.col("x"), F.abs(F.col("x")))
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"
    for v, row in zip(WHOLE, out.orderBy("k").collect()):
        assert tuple(row)[1:] == (wrap(v + MOST), wrap(v * 3), wrap(-v), wrap(abs(v)))


def test_narrowing(spark):
    x = F.col("x")
    got = each(spark, WHOLE, "long", P.from_integral(x, "tinyint"), P.from_integral(x, "smallint"), P.from_integral(x, "int"))
    assert got == [(wrap(v, 8), wrap(v, 16), wrap(v, 32)) for v in WHOLE]


@pytest.mark.parametrize("y", REAL)
def test_real_pairs(spark, y):
    x, d = F.col("x"), F.lit(y).cast("double")
    got = each(
        spark, REAL, "double", P.fmax(x, d), P.fmin(x, d), P.feq(x, d), P.fne(x, d), P.flt(x, d), P.fle(x, d), P.fdiv(x, d)
    )
    for v, row in zip(REAL, got):
        numbers = [n for n in (v, y) if not math.isnan(n)]
        model = (
            max(numbers, default=math.nan), min(numbers, default=math.nan), v == y, v != y, v < y, v <= y,
        )
        assert all(map(same, row[:6], model)), (v, y, row)
        if y:
            assert same(row[6], v / y if not (math.isinf(v) and math.isinf(y)) else math.nan)
        else:
            assert same(row[6], math.nan if v == 0 or math.isnan(v) else math.copysign(math.inf, v))


def test_real(spark):
    x = F.col("x")
    finite = [v for v in REAL if math.isfinite(v) and abs(v) < 1e10]
    got = each(spark, finite, "double", P.round_half_away(x), P.truncate(x), P.signum(x), P.ln(x), P.log_base(2, x))
    for v, (r, t, s, ln, log2) in zip(finite, got):
        assert t == math.trunc(v) and s == (v > 0) - (v < 0)
        assert r == math.copysign(math.floor(abs(v) + 0.5), v) or v == 0.49999999999999994
        logs = (math.log(v), math.log2(v)) if v > 0 else (-math.inf,) * 2 if v == 0 else (math.nan,) * 2
        assert all(same(a, b) or abs(a - b) < 1e-9 for a, b in zip((ln, log2), logs))
    assert each(spark, REAL, "double", P.is_infinite(x)) == [(math.isinf(v),) for v in REAL]
    assert each(spark, [math.nan, -0.0], "double", P.signum(x)) == [(0.0,), (0.0,)]


def test_structure(spark):
    x = F.col("x")
    halved = P.while_loop(x, 70, lambda s: s > 1, lambda s: P.quot(s, 2))
    assert each(spark, [1, 5, 1024], "long", halved) == [(1,), (1,), (1,)]
    case = P.case_of(x, {0: F.lit("a"), 1: F.lit("b")}, F.lit("c"))
    assert each(spark, [0, 1, 2], "long", case) == [("a",), ("b",), ("c",)]
    with pytest.raises(Exception, match="no branch"):
        each(spark, [2], "long", P.case_of(x, {0: F.lit("a")}))
    assert each(spark, [1.0, -2.0], "double", P.bits_of(x)) == [(0x3FF0 << 48,), (wrap(0xC000 << 48),)]


def test_loops_end_or_raise(spark):
    x = F.col("x")
    with pytest.raises(Exception, match="still runs"):
        each(spark, [1024], "long", P.while_loop(x, 9, lambda s: s > 1, lambda s: P.quot(s, 2)))
    assert each(spark, [1024], "long", P.while_loop(x, 10, lambda s: s > 1, lambda s: P.quot(s, 2))) == [(1,)]


def test_collatz_needs_over_400_steps(spark, tmp_path):
    from indexloom import catalog

    spark.sql("select 230630L p_partkey, 1.0D p_retailprice, 1 p_size").write.parquet(str(tmp_path / "part.parquet"))
    assert [tuple(r) for r in catalog.while_collatz(spark, str(tmp_path)).select("v").collect()] == [(442,)]


def test_coerce_keeps_the_bits(spark):
    import struct

    x = F.col("x")
    reals = [0.0, -0.0, 1.5, -2.0, math.inf, -math.inf, 5e-324, None]
    longs = [None if v is None else struct.unpack("<q", struct.pack("<d", v))[0] for v in reals]
    assert each(spark, reals, "double", P.coerce(x, "bigint")) == [(v,) for v in longs]
    assert each(spark, longs, "bigint", P.coerce(x, "double")) == [(v,) for v in reals]
    small = [0.0, 1.5, -2.0, math.inf, None]
    ints = [None if v is None else struct.unpack("<i", struct.pack("<f", v))[0] for v in small]
    assert each(spark, small, "float", P.coerce(x, "int")) == [(v,) for v in ints]
    assert each(spark, ints, "int", P.coerce(x, "float")) == [(v,) for v in small]


def test_rounding_at_the_edges(spark):
    values = [0.49999999999999994, 0.5, -0.5, 2.5, -2.5, 4503599627370497.0, -4503599627370497.0, 9007199254740993.0, 1e300, math.inf]
    got = each(spark, values, "double", P.round_half_away(F.col("x")))
    assert got == [(v,) for v in [0.0, 1.0, -1.0, 3.0, -3.0, 4503599627370497.0, -4503599627370497.0, 9007199254740992.0, 1e300, math.inf]]
