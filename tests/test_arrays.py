"""Each operator against a plain Python model of it, on small arrays and at the edges."""

from functools import reduce
from itertools import accumulate, product

import pytest
from pyspark.sql import functions as F

from indexloom import operators as op
from indexloom.array import NDArray
from indexloom.plans import monoid as M
from indexloom.plans.prepared import run, run_async, run_n, run_n_async, run_with
from indexloom.sources import from_local, generate, to_parquet, unit
from indexloom.streaming import stream


def long(x):
    return F.lit(x).cast("long")


def vec(spark, values, extent=None):
    return from_local(spark, values, extent)


SMALL = [8, 4, 2]
RAMP = list(range(10))


def sub(x, y):
    return x - y


def affine(x, y):
    return F.struct((x["a"] * y["a"] % 97).alias("a"), ((x["b"] * y["a"] + y["b"]) % 97).alias("b"))


def affine_model(x, y):
    return x[0] * y[0] % 97, (x[1] * y[0] + y[1]) % 97


def pairs(spark, n):
    rows = [(k, (k * 7 % 5 + 1, k * 3 % 11)) for k in range(n)]
    df = spark.createDataFrame(rows, "i0 long, v struct<a: long, b: long>")
    return NDArray(df, (n,)), [r[1] for r in rows]


def test_map_zip_unzip(spark):
    a = vec(spark, RAMP)
    assert op.amap(a, lambda v: {"v": v * 2}).collect() == [2 * x for x in RAMP]
    assert op.zip_with(lambda x, y: {"v": x * y}, a, vec(spark, SMALL)).collect() == [0, 4, 4]
    both = op.amap(a, lambda v: {"x": v, "y": v + 1})
    assert op.unzip(both, "y").collect() == [x + 1 for x in RAMP]
    assert op.zip_with(lambda x, y: {"v": x + y}, unit(spark, v=long(1)), unit(spark, v=long(2))).collect() == [3]


def test_gathers(spark):
    a = vec(spark, RAMP)
    assert op.reverse(a).collect() == RAMP[::-1]
    assert op.shift(a, 3).collect() == RAMP[3:] + RAMP[:3]
    assert op.backpermute(a, (4,), lambda i: [i * 2]).collect() == [0, 2, 4, 6]
    m = generate(spark, (3, 4), lambda i, j: {"v": i * 10 + j})
    assert op.transpose(m).collect() == [i * 10 + j for j in range(4) for i in range(3)]
    assert op.reshape(m, (2, 6)).collect() == m.collect()
    assert op.slice_at(m, i0=1).collect() == [10, 11, 12, 13]
    assert op.replicate(vec(spark, SMALL), i0=2).collect() == SMALL * 2
    assert op.replicate(vec(spark, SMALL), i1=2).collect() == [8, 8, 4, 4, 2, 2]
    assert op.take(m, 2).collect() == [0, 1, 10, 11, 20, 21]
    assert op.drop(m, 3).collect() == [3, 13, 23]
    assert op.index(m, 2, 1).collect() == [21]
    cube = generate(spark, (2, 3, 4), lambda i, j, k: {"v": (i * 3 + j) * 4 + k})
    assert cube.collect() == list(range(24))
    assert op.transpose(cube, (2, 0, 1)).extent == (4, 2, 3)
    with pytest.raises(IndexError):
        op.index(m, 3, 0)
    with pytest.raises(ValueError):
        op.reshape(m, (5, 2))


def test_gather_outside_raises(spark):
    with pytest.raises(Exception, match="is outside"):
        op.backpermute(vec(spark, SMALL), (3,), lambda i: [i + 1]).collect()


@pytest.mark.parametrize("limit", [0, 2, 1000])
def test_replicate_by_products(spark, limit, monkeypatch):
    from indexloom.operators import indexing

    monkeypatch.setattr(indexing, "BROADCAST", limit)
    m = generate(spark, (2, 3), lambda i, j: {"v": i * 10 + j})
    got = op.replicate(m, i0=4, i2=2)
    assert got.extent == (4, 2, 2, 3)
    assert got.collect() == [i * 10 + j for _ in range(4) for i in range(2) for _ in range(2) for j in range(3)]
    assert op.replicate(op.fold(vec(spark, SMALL), M.SUM, long(0)), i0=3).collect() == [14, 14, 14]


def test_rows_are_numbered_densely(spark):
    from indexloom.sources import from_rows

    a = from_rows(spark.range(0, 1000, 1, 7).selectExpr("id * 2 as x"), v="x")
    assert a.extent == (1000,) and a.collect() == [2 * k for k in range(1000)]
    assert sorted(r["i0"] for r in a.df.collect()) == list(range(1000))
    assert from_rows(spark.range(0).selectExpr("id as x"), v="x").extent == (0,)


def test_long_and_many_segments(spark):
    values = [k * 7 % 11 for k in range(500)]
    lengths = [0, 1, 200, 0, 0, 3, 31, 32, 33, 100, 0]
    got = op.fold_seg(vec(spark, values), M.SUM, long(1), vec(spark, lengths)).collect()
    model, at = [], 0
    for n in lengths:
        model.append(1 + sum(values[at : at + n]))
        at += n
    assert got == model


def test_compact_over_chunks(spark, monkeypatch):
    from indexloom.operators import scan

    monkeypatch.setattr(scan, "CHUNK", 16)
    a = op.amap(vec(spark, list(range(200))), lambda v: {"v": v, "w": v * 2})
    kept = op.compact(a, lambda v, w: (v % 3 == 0) & ((v < 40) | (v > 90)))
    model = [(v, 2 * v) for v in range(200) if v % 3 == 0 and (v < 40 or v > 90)]
    assert kept.collect() == model and kept.extent == (len(model),)
    assert op.compact(a, lambda v, w: v < 0).collect() == []


def test_fold(spark):
    a = vec(spark, SMALL)
    assert op.fold(a, M.SUM, long(100)).collect() == [114]
    pair, model = pairs(spark, 3000)  # three levels of runs
    assert tuple(op.fold1(pair, affine).df.select("v.a", "v.b").first()) == reduce(affine_model, model)
    m = generate(spark, (3, 4), lambda i, j: {"v": i * 10 + j})
    assert op.fold(m, M.MAX, long(0)).collect() == [3, 13, 23]
    assert op.fold(m, sub, long(0)).collect() == [-(0 - 1 - 2 - 3), -(10 - 11 - 12 - 13), -(20 - 21 - 22 - 23)]
    assert op.fold(vec(spark, []), M.SUM, long(5)).collect() == [5]
    assert op.fold(generate(spark, (3, 0), lambda i, j: {"v": i}), M.SUM, long(5)).collect() == [5, 5, 5]
    with pytest.raises(ValueError):
        op.fold1(vec(spark, []), M.SUM)
    with pytest.raises(ValueError):
        op.fold1(generate(spark, (0, 0), lambda i, j: {"v": i}), M.SUM)
    assert op.fold1(generate(spark, (0, 2), lambda i, j: {"v": i}), M.SUM).collect() == []


@pytest.mark.parametrize("monoid,model", [
    (M.SUM, lambda x, y: x + y), (M.MIN, min), (M.MAX, max), (M.BAND, lambda x, y: x & y), (M.BOR, lambda x, y: x | y),
    (M.BXOR, lambda x, y: x ^ y),
])
def test_monoids(spark, monoid, model):
    values = [5, 3, 12, 9, 6, 3]
    assert op.fold1(vec(spark, values), monoid).collect() == [reduce(model, values)]
    assert op.scanl1(vec(spark, values), monoid, chunk=2).collect() == list(accumulate(values, model))
    assert op.scanr1(vec(spark, values), monoid, chunk=4).collect() == list(accumulate(values[::-1], model))[::-1]


def test_float_monoids_ignore_nan(spark):
    nan = float("nan")
    a = from_local(spark, [nan, 2.0, 1.0], kind="double")
    assert op.fold1(a, M.FMAX).collect() == [2.0]
    assert op.scanl1(a, M.FMIN).collect()[1:] == [2.0, 1.0]
    assert str(op.fold1(from_local(spark, [nan], kind="double"), M.FMIN).collect()) == "[nan]"


def test_segments(spark):
    a, lengths = vec(spark, SMALL), vec(spark, [2, 0, 1])
    assert op.segment_offsets(lengths).collect() == [0, 2, 2, 3]
    assert op.fold_seg(a, M.SUM, long(0), lengths).collect() == [12, 0, 2]
    assert op.fold_seg(a, M.SUM, long(7), lengths).collect() == [19, 7, 9]
    assert op.fold_seg(a, lambda x, y: x - y, long(0), lengths).collect() == [-4, 0, -2]
    assert op.fold1_seg(a, M.MAX, vec(spark, [1, 2])).collect() == [8, 4]
    m = generate(spark, (2, 3), lambda i, j: {"v": i * 10 + j})
    assert op.fold_seg(m, M.SUM, long(0), lengths).collect() == [1, 0, 2, 21, 0, 12]
    with pytest.raises(Exception, match="empty segment"):
        op.fold1_seg(a, M.MAX, lengths).collect()


def test_scans(spark):
    a = vec(spark, RAMP)
    assert op.scanl(a, M.SUM, long(10)).collect() == [10, 10, 11, 13, 16, 20, 25, 31, 38, 46, 55]
    assert op.scanr(a, M.SUM, long(10)).collect() == list(accumulate(RAMP[::-1], initial=10))[::-1]
    body, total = op.scanl_prime(a, M.SUM, long(10))
    assert body.collect() == [10, 10, 11, 13, 16, 20, 25, 31, 38, 46] and total.collect() == [55]
    body, total = op.scanr_prime(a, M.SUM, long(10))
    assert body.collect() == list(accumulate(RAMP[::-1], initial=10))[::-1][1:] and total.collect() == [55]
    empty = vec(spark, [])
    assert op.scanl(empty, M.SUM, long(3)).collect() == [3] and op.scanl1(empty, M.SUM).collect() == []
    body, total = op.scanl_prime(empty, M.SUM, long(3))
    assert body.collect() == [] and total.collect() == [3]
    assert op.scanr(vec(spark, [7]), sub, long(1)).collect() == [6, 1]
    m = generate(spark, (2, 3), lambda i, j: {"v": i * 10 + j})
    assert op.scanl1(m, M.SUM).collect() == [0, 1, 3, 10, 21, 33]
    assert op.scanr1(m, M.SUM, chunk=2).collect() == [3, 3, 2, 33, 23, 12]


@pytest.mark.parametrize("n", [1, 2, 255, 256, 257, 700])
def test_ordered_scans_cross_chunks(spark, n):
    pair, model = pairs(spark, n)
    got = [tuple(x) for x in op.scanl1(pair, affine).collect()]
    assert got == list(accumulate(model, affine_model))
    got = [tuple(x) for x in op.scanr1(pair, affine).collect()]
    assert got == list(accumulate(model[::-1], lambda x, y: affine_model(y, x)))[::-1]


def test_chunked_scan_in_levels(spark):
    values = [(k * 37) % 101 - 50 for k in range(1000)]
    assert op.scanl1(vec(spark, values), M.SUM, chunk=4).collect() == list(accumulate(values))


def test_permute(spark):
    rows = [(0, 5, 0), (1, 6, 1), (2, 7, 0), (3, 8, None)]
    source = NDArray(spark.createDataFrame(rows, "i0 long, v long, t long"), (4,))
    defaults = vec(spark, [1000] * 3)

    def to(i, v, t):
        return [t]

    assert op.permute(source, defaults, M.SUM, to).collect() == [1012, 1006, 1000]
    assert op.permute(source, defaults, None, to).collect() == [7, 6, 1000]
    assert op.permute(source, defaults, lambda new, old: new * old, to).collect() == [35000, 6000, 1000]
    identity = op.permute(vec(spark, SMALL), vec(spark, [1, 1, 1]), M.SUM, lambda i, v: [i])
    assert identity.collect() == [9, 5, 3]
    assert op.histogram(vec(spark, [1, 1, 3]), 5, lambda v: v).collect() == [0, 2, 0, 1, 0]
    kept = op.compact(vec(spark, RAMP), lambda v: v % 3 == 0)
    assert kept.collect() == [0, 3, 6, 9] and kept.extent == (4,)


def neighbourhood(values, radius, rule):
    n = len(values)
    return [[values[i] if 0 <= i < n else rule(i, n) for i in range(k - radius, k + radius + 1)] for k in range(n)]


RULES = [
    (op.Clamp, lambda v: lambda i, n: v[max(0, min(n - 1, i))]),
    (op.Mirror, lambda v: lambda i, n: v[-i if i < 0 else 2 * n - 2 - i]),
    (op.Wrap, lambda v: lambda i, n: v[i % n]),
    (lambda: op.Constant(long(7)), lambda v: lambda i, n: 7),
    (lambda: op.Function(lambda i: i * 100), lambda v: lambda i, n: i * 100),
]


@pytest.mark.parametrize("k", range(5))
@pytest.mark.parametrize("radius", [1, 2, 4])
def test_stencils(spark, k, radius):
    boundary, rule = RULES[k]
    values = [x * x % 17 for x in range(9)]
    got = op.stencil(vec(spark, values), (radius,), boundary(), lambda c: sum((x * (j + 1) for j, x in enumerate(c)), long(0)))
    model = [sum(x * (j + 1) for j, x in enumerate(c)) for c in neighbourhood(values, radius, rule(values))]
    assert got.collect() == model


@pytest.mark.parametrize("k", range(5))
def test_stencils_over_tiles(spark, k, monkeypatch):
    import sys

    monkeypatch.setattr(sys.modules["indexloom.operators.stencil"], "TILE", 16)
    boundary, rule = RULES[k]
    values = [x * x % 17 for x in range(75)]
    got = op.stencil(vec(spark, values), (4,), boundary(), lambda c: sum((x * (j + 1) for j, x in enumerate(c)), long(0)))
    model = [sum(x * (j + 1) for j, x in enumerate(c)) for c in neighbourhood(values, 4, rule(values))]
    assert got.collect() == model


@pytest.mark.parametrize("boundary,at", [
    (op.Mirror(), lambda i, n: -i if i < 0 else 2 * n - 2 - i if i >= n else i), (op.Wrap(), lambda i, n: i % n),
    (op.Clamp(), lambda i, n: max(0, min(n - 1, i))),
])
def test_stencil_corners(spark, boundary, at):
    m = generate(spark, (4, 5), lambda i, j: {"v": i * 10 + j})
    got = op.stencil(m, (2, 1), boundary, lambda c: sum((x * (j + 1) for j, x in enumerate(c)), long(0))).collect()
    box = list(product(range(-2, 3), range(-1, 2)))
    assert got == [
        sum((at(i + a, 4) * 10 + at(j + b, 5)) * (k + 1) for k, (a, b) in enumerate(box)) for i in range(4) for j in range(5)
    ]
    values = op.stencil(m, (1, 1), op.Function(lambda i, j: i * 100 + j), lambda c: c[0]).collect()
    assert values[0] == -101 and values[6] == 0


def test_stencil_shapes(spark):
    m = generate(spark, (3, 4), lambda i, j: {"v": i * 10 + j})
    assert op.stencil(m, (0, 0), op.Clamp(), lambda c: c[0] * 2).collect() == [2 * x for x in m.collect()]

    def at(i, j):
        return max(0, min(2, i)) * 10 + max(0, min(3, j))

    model = [sum(at(i + a, j + b) for a, b in product((-1, 0, 1), repeat=2)) for i in range(3) for j in range(4)]
    assert op.stencil(m, (1, 1), op.Clamp(), lambda c: sum(c, long(0))).collect() == model
    cube = generate(spark, (2, 3, 4), lambda i, j, k: {"v": i + j + k})
    assert op.stencil(cube, (1, 1, 1), op.Constant(long(0)), lambda c: c[13]).collect() == cube.collect()
    two = op.stencil2(
        vec(spark, RAMP), (1,), op.Clamp(), vec(spark, SMALL), (1,), op.Mirror(), lambda x, y: x[1] * 100 + sum(y, long(0))
    )
    assert two.collect() == [16, 114, 210]
    with pytest.raises(ValueError):
        op.stencil(vec(spark, SMALL), (3,), op.Mirror(), lambda c: c[0])


def test_control(spark, capsys):
    a = vec(spark, SMALL)
    total = op.fold(a, M.SUM, long(0))
    assert op.acond(op.amap(total, lambda v: {"v": v > 10}), lambda: a, lambda: None).collect() == SMALL
    below = lambda s: op.amap(op.fold1(s, M.MAX), lambda v: {"v": v < 1000})
    done = op.awhile(below, lambda s: op.amap(s, lambda v: {"v": v * 2}), a)
    assert done.collect() == [x * 128 for x in SMALL]
    assert op.awhile(below, lambda s: s, vec(spark, [5000])).collect() == [5000]
    assert op.alet(total, lambda t: t, shared=True).collect() == [14]
    assert op.atrace(a, total).collect() == SMALL and "14" in capsys.readouterr().out


def test_foreign(spark):
    a = vec(spark, SMALL)

    def native(frames):
        for frame in frames:
            frame["v"] *= 3
            yield frame

    assert op.foreign_acc(a, native, lambda x: x).collect() == [24, 12, 6]
    assert op.foreign_acc(a, None, lambda x: x).collect() == SMALL

    def missing(frames):
        import no_such_module  # noqa: F401

        yield from frames

    def unable(frames):
        raise NotImplementedError

    for native in (missing, unable):
        assert op.foreign_acc(a, native, lambda x: op.amap(x, lambda v: {"v": v + 1})).collect() == [9, 5, 3]


def test_run(spark, tmp_path):
    a = vec(spark, SMALL)
    double = lambda x: op.amap(x, lambda v: {"v": v * 2})
    assert run((a, double(a))) == (SMALL, [16, 8, 4])
    assert run_n(double)(a) == [16, 8, 4] and run_with(spark, lambda s: vec(s, [1])) == [1]
    assert run_async(spark, a).wait() == SMALL
    from indexloom.plans.session import create_target

    assert create_target() is spark or create_target().sparkContext is spark.sparkContext
    assert run_n_async(spark, double)(a).wait() == [16, 8, 4]
    assert list(stream(double, [a, vec(spark, [1])])) == [[16, 8, 4], [2]]
    to_parquet(a, str(tmp_path / "a"))
    assert NDArray(spark.read.parquet(str(tmp_path / "a")), (3,)).collect() == SMALL


def test_ahead_of_time_example(spark):
    n = 10_000
    a = generate(spark, (n,), lambda i: {"v": i + 1})
    assert op.fold(op.amap(a, lambda v: {"v": v + 1}), M.SUM, long(0)).collect() == [n * (n + 1) // 2 + n]
    xs, ys = vec(spark, RAMP), vec(spark, list(range(1, 20, 2)))
    assert op.fold(op.zip_with(lambda x, y: {"v": x * y}, xs, ys), M.SUM, long(0)).collect() == [615]


def test_affine_scan_of_the_whole_table(spark, tmp_path):
    from indexloom import catalog

    values = [(k * 7919 % 4001 - 2000) for k in range(1500)]
    rows = [(k, v / 100) for k, v in enumerate(values)]
    spark.createDataFrame(rows, "event_id long, value double").write.parquet(str(tmp_path / "events.parquet"))
    got = [tuple(r) for r in catalog.scanl1_affine_events(spark, str(tmp_path)).orderBy("i0").collect()]
    prime, out = catalog.PRIME, []
    for k, v in enumerate(values):
        a, b = v % 997, v % 1009
        if out:
            a, b = out[-1][1] * a % prime, (out[-1][2] * a + b) % prime
        out.append((k, a, b))
    assert got == out
