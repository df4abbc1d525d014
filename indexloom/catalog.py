"""A query for each operator over the driver's tables, with the same query in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import operators as op
from .array import NDArray, from_linear, to_linear
from .functions import primitives as P
from .plans import monoid as M
from .plans.session import shared_folder, wrapping
from .sources import alloc, domain, from_local, from_rows, from_table, generate, unit, use
from .streaming import stream_files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def long(x) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("long")


def cents(column: str) -> Column:
    return F.round(F.col(column) * 100).cast("long")


def events(spark: SparkSession, d: str) -> NDArray:
    return from_table(spark, f"{d}/events.parquet", "event_id", v=cents("value"))


def parts(spark: SparkSession, d: str) -> NDArray:
    return from_table(spark, f"{d}/part.parquet", "p_partkey", v=cents("p_retailprice"), w=long(F.col("p_size")))


def matrix(spark: SparkSession, d: str) -> NDArray:
    """Embeddings as a matrix of whole numbers: thousandths, rounded down."""
    df = spark.read.parquet(f"{d}/embeddings.parquet")
    cells = df.select("vec_id", F.posexplode("embedding").alias("at", "x"))
    return use(cells, ["vec_id", "at"], (df.count(), 64), v=F.floor(F.col("x").cast("double") * 1000).cast("long"))


EV = "ev AS (SELECT event_id AS i0, CAST(round(value * 100) AS BIGINT) AS v FROM events)"
PT = """pt AS (SELECT p_partkey AS i0, CAST(round(p_retailprice * 100) AS BIGINT) AS v,
               CAST(p_size AS BIGINT) AS w FROM part)"""
MX = """mx AS (SELECT vec_id AS i0, CAST(k AS BIGINT) AS i1,
               CAST(floor(CAST(embedding[k + 1] AS DOUBLE) * 1000) AS BIGINT) AS v FROM embeddings, range(0, 64) t(k))"""


# sources and projections


@query("""SELECT CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)
                        * (100 - CAST(round(l_discount * 100) AS BIGINT))) AS BIGINT) AS v FROM lineitem""")
def fold_revenue(spark, d):
    lines = spark.read.parquet(f"{d}/lineitem.parquet")
    a = from_rows(lines, price=cents("l_extendedprice"), off=cents("l_discount"))
    return op.fold(op.amap(a, lambda price, off: {"v": price * (100 - off)}), M.SUM, long(0)).df


@query("SELECT CAST(round(l_extendedprice * 100) AS BIGINT) * (100 - CAST(round(l_discount * 100) AS BIGINT)) AS v FROM lineitem")
def use_map_discounted(spark, d):
    lines = spark.read.parquet(f"{d}/lineitem.parquet")
    a = from_rows(lines, price=cents("l_extendedprice"), off=cents("l_discount"))
    return op.amap(a, lambda price, off: {"v": price * (100 - off)}).df.select("v")


@query("SELECT o_orderkey AS i0, o_orderstatus AS status FROM orders")
def unzip_projection(spark, d):
    a = from_table(spark, f"{d}/orders.parquet", "o_orderkey", price=cents("o_totalprice"), status=F.col("o_orderstatus"))
    return op.unzip(a, "status").df


@query("SELECT CAST(42 AS BIGINT) AS v")
def unit_scalar(spark, d):
    return unit(spark, v=long(42)).df


@query("SELECT CAST(a AS BIGINT) AS i0, CAST(b AS BIGINT) AS i1 FROM range(0, 6) s(a), range(0, 7) t(b)")
def alloc_domain(spark, d):
    return alloc(spark, (6, 7)).df


@query("SELECT a AS i0, b AS i1, a * b + 1 AS v FROM range(0, 137) s(a), range(0, 11) t(b)")
def generate_index_grid(spark, d):
    return generate(spark, (137, 11), lambda i, j: {"v": i * j + 1}).df


@query("""SELECT a AS i0, b AS i1, c AS i2, (a * 7 + b) * 9 + c AS lin, a AS j0, b AS j1, c AS j2
          FROM range(0, 5) s(a), range(0, 7) t(b), range(0, 9) u(c)""")
def to_from_index_roundtrip(spark, d):
    extent = (5, 7, 9)
    cells = domain(spark, extent)
    df = cells.df.withColumn("lin", to_linear([F.col(c) for c in cells.index], extent))
    return df.select("*", *[c.alias(f"j{k}") for k, c in enumerate(from_linear(F.col("lin"), extent))])


# gathers


@query(f"""WITH {PT}, n AS (SELECT count(*) AS n FROM pt)
SELECT o.i0, 2 * s.v + s.w AS v FROM pt o, n JOIN pt s ON s.i0 = (o.i0 * 7) % n.n""")
def transform_gather_scale(spark, d):
    a = parts(spark, d)
    n = a.extent[0]
    return op.transform(a, a.extent, lambda i: [(i * 7) % n], lambda v, w: {"v": 2 * v + w}).df


@query(f"WITH {PT}, n AS (SELECT count(*) AS n FROM pt) SELECT o.i0, s.v, s.w FROM pt o, n JOIN pt s ON s.i0 = (o.i0 * 13 + 5) % n.n")
def backpermute_gather(spark, d):
    a = parts(spark, d)
    n = a.extent[0]
    return op.backpermute(a, a.extent, lambda i: [(i * 13 + 5) % n]).df


@query(f"WITH {EV} SELECT (SELECT count(*) FROM ev) - 1 - i0 AS i0, v FROM ev")
def backpermute_reverse(spark, d):
    return op.reverse(events(spark, d)).df


@query(f"WITH {MX} SELECT i1 AS i0, i0 AS i1, v FROM mx")
def backpermute_transpose(spark, d):
    return op.transpose(matrix(spark, d)).df


@query(f"WITH {EV}, n AS (SELECT count(*) AS n FROM ev) SELECT (i0 - 3 + n) % n AS i0, v FROM ev, n")
def backpermute_shift(spark, d):
    return op.shift(events(spark, d), 3).df


@query(f"WITH {EV} SELECT i0 // 100 AS i0, i0 % 100 AS i1, v FROM ev")
def reshape_events(spark, d):
    a = events(spark, d)
    return op.reshape(a, (a.extent[0] // 100, 100)).df


@query("SELECT CAST(k AS BIGINT) AS i0, CAST(n_nationkey AS BIGINT) AS i1, CAST(n_regionkey AS BIGINT) AS v FROM nation, range(0, 4) t(k)")
def replicate_outer(spark, d):
    a = from_table(spark, f"{d}/nation.parquet", "n_nationkey", v=long(F.col("n_regionkey")))
    return op.replicate(a, i0=4).df


@query(f"WITH {MX} SELECT i0, v FROM mx WHERE i1 = 3")
def slice_column(spark, d):
    return op.slice_at(matrix(spark, d), i1=3).df


@query(f"WITH {EV} SELECT i0 - 50 AS i0, v FROM ev WHERE i0 >= 50 AND i0 < 450")
def take_drop(spark, d):
    return op.drop(op.take(events(spark, d), 450), 50).df


@query(f"WITH {EV}, {PT} SELECT ev.i0, ev.v * pt.w AS v FROM ev JOIN pt USING (i0)")
def zipwith_products(spark, d):
    return op.zip_with(lambda x, price, size: {"v": x * size}, events(spark, d), parts(spark, d)).df


@query(f"WITH {EV} SELECT v FROM ev WHERE i0 = 77")
def index_lookup(spark, d):
    return op.index(events(spark, d), 77).df


@query("SELECT count(*) AS i0, CAST(64 AS BIGINT) AS i1, count(*) * 64 AS size FROM embeddings")
def shape_size(spark, d):
    a = matrix(spark, d)
    return unit(spark, i0=long(a.extent[0]), i1=long(a.extent[1]), size=long(a.size)).df


# reductions


@query(f"WITH {EV} SELECT CAST(sum(v) + 1000 AS BIGINT) AS v FROM ev")
def fold_sum_seed(spark, d):
    return op.fold(events(spark, d), M.SUM, long(1000)).df


@query(f"WITH {EV} SELECT greatest(max(v), -5) AS v FROM ev")
def fold_max(spark, d):
    return op.fold(events(spark, d), M.MAX, long(-5)).df


@query(f"WITH {EV} SELECT min(v) AS v FROM ev")
def fold1_min(spark, d):
    return op.fold1(events(spark, d), M.MIN).df


@query(f"WITH {PT} SELECT bit_and(v | 1) AS both, bit_or(v) AS some, bit_xor(v) AS odd, bool_and(w > 0) AS every, bool_or(w > 49) AS one FROM pt")
def fold_bits(spark, d):
    a = op.amap(parts(spark, d), lambda v, w: {"x": P.bor(v, 1), "v": v, "e": w > 0, "o": w > 49})
    pieces = [
        op.fold1(a, M.BAND, "x").df.select(F.col("x").alias("both")), op.fold1(a, M.BOR).df.select(F.col("v").alias("some")),
        op.fold1(a, M.BXOR).df.select(F.col("v").alias("odd")), op.fold1(a, M.ALL, "e").df.select(F.col("e").alias("every")),
        op.fold1(a, M.ANY, "o").df.select(F.col("o").alias("one")),
    ]
    first, *rest = pieces
    for p in rest:
        first = first.join(p, F.lit(True))  # one row each
    return first


PRIME = 1_000_003


def affine(x: Column, y: Column) -> Column:
    """First x, then y, as maps t -> a * t + b modulo a prime: associative, not commutative."""
    return F.struct((x["a"] * y["a"] % PRIME).alias("a"), ((x["b"] * y["a"] + y["b"]) % PRIME).alias("b"))


def affine_events(spark, d) -> NDArray:
    def pair(v):
        return {"v": F.struct(P.mod(v, long(997)).alias("a"), P.mod(v, long(1009)).alias("b"))}

    return op.amap(events(spark, d), pair)


AF = f"{EV}, af AS (SELECT i0, {{'a': ((v % 997) + 997) % 997, 'b': ((v % 1009) + 1009) % 1009}} AS v FROM ev)"
AFFINE = f"lambda x, y: {{'a': x.a * y.a % {PRIME}, 'b': (x.b * y.a + y.b) % {PRIME}}}"


@query(f"WITH {AF}, r AS (SELECT list_reduce(list(v ORDER BY i0), {AFFINE}) AS r FROM af) SELECT r.a AS a, r.b AS b FROM r")
def fold_ordered_affine(spark, d):
    return op.fold1(affine_events(spark, d), affine).df.select("v.a", "v.b")


@query(f"WITH {MX} SELECT i0, CAST(sum(v) + 7 AS BIGINT) AS v FROM mx GROUP BY i0")
def fold_inner_axis(spark, d):
    return op.fold(matrix(spark, d), M.SUM, long(7)).df


@query("SELECT k AS i0, CAST(9 AS BIGINT) AS v FROM range(0, 3) t(k)")
def fold_empty_fill(spark, d):
    return op.fold(generate(spark, (3, 0), lambda i, j: {"v": i}), M.SUM, long(9)).df


def order_lines(spark, d) -> tuple[NDArray, NDArray]:
    """Line quantities as one vector in order of their orders, and how many lines each order has."""
    lines, orders = spark.read.parquet(f"{d}/lineitem.parquet"), spark.read.parquet(f"{d}/orders.parquet")
    counts = lines.groupBy("l_orderkey").agg(F.count("*").alias("n"))
    n = orders.count()
    lengths = use(orders.join(counts, F.col("o_orderkey") == F.col("l_orderkey"), "left"), ["o_orderkey"], (n,), v=F.coalesce("n", long(0)))
    starts = op.segment_offsets(lengths).df.select(F.col("i0").alias("l_orderkey"), F.col("v").alias("lo"))
    own = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    placed = lines.withColumn("k", F.row_number().over(own) - 1).join(starts, "l_orderkey")
    return use(placed, [F.col("lo") + F.col("k")], (lines.count(),), v=F.col("l_quantity").cast("long")), lengths


@query("""SELECT o_orderkey AS i0, CAST(1000 + coalesce(sum(CAST(l_quantity AS BIGINT)), 0) AS BIGINT) AS v
          FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey""")
def foldseg_qty_by_order(spark, d):
    quantities, lengths = order_lines(spark, d)
    return op.fold_seg(quantities, M.SUM, long(1000), lengths).df


@query(f"WITH {EV} SELECT i0 // 10 AS i0, max(v) AS v FROM ev GROUP BY i0 // 10")
def fold1seg_nonempty(spark, d):
    a = events(spark, d)
    tens = generate(spark, (a.extent[0] // 10,), lambda i: {"v": long(10)})
    return op.fold1_seg(a, M.MAX, tens).df


@query(f"""WITH {MX} SELECT i0, CASE WHEN i1 < 10 THEN 0 WHEN i1 < 40 THEN 2 ELSE 3 END AS i1, CAST(sum(v) AS BIGINT) AS v
           FROM mx GROUP BY ALL UNION ALL SELECT vec_id, 1, 0 FROM embeddings""")
def foldseg_inner_axis(spark, d):
    return op.fold_seg(matrix(spark, d), M.SUM, long(0), from_local(spark, [10, 0, 30, 24])).df.withColumn("i1", F.col("i1").cast("int"))


@query("SELECT n_nationkey AS i0, CAST(coalesce(sum(n_regionkey + 1) OVER (ORDER BY n_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS v FROM nation UNION ALL SELECT 25, CAST(sum(n_regionkey + 1) AS BIGINT) FROM nation")
def derived_segment_offsets(spark, d):
    lengths = from_table(spark, f"{d}/nation.parquet", "n_nationkey", v=long(F.col("n_regionkey")) + 1)
    return op.segment_offsets(lengths).df.withColumn("i0", F.col("i0").cast("int"))


# scans

LEFT = "OVER (ORDER BY i0 ROWS UNBOUNDED PRECEDING)"
RIGHT = "OVER (ORDER BY i0 DESC ROWS UNBOUNDED PRECEDING)"


@query(f"WITH {EV} SELECT i0 + 1 AS i0, CAST(10 + sum(v) {LEFT} AS BIGINT) AS v FROM ev UNION ALL SELECT 0, 10")
def scanl_running(spark, d):
    return op.scanl(events(spark, d), M.SUM, long(10), chunk=4096).df


@query(f"WITH {EV} SELECT i0, CAST(10 + sum(v) {RIGHT} AS BIGINT) AS v FROM ev UNION ALL SELECT count(*), 10 FROM ev")
def scanr_running(spark, d):
    return op.scanr(events(spark, d), M.SUM, long(10), chunk=4096).df


@query(f"WITH {EV} SELECT i0, max(v) {LEFT} AS v FROM ev")
def scanl1_max(spark, d):
    return op.scanl1(events(spark, d), M.MAX, chunk=512).df


@query(f"WITH {EV} SELECT i0, min(v) {RIGHT} AS v FROM ev")
def scanr1_min(spark, d):
    return op.scanr1(events(spark, d), M.MIN, chunk=512).df


@query(f"WITH {MX} SELECT i0, i1, CAST(sum(v) OVER (PARTITION BY i0 ORDER BY i1 ROWS UNBOUNDED PRECEDING) AS BIGINT) AS v FROM mx")
def scanl1_rows(spark, d):
    return op.scanl1(matrix(spark, d), M.SUM).df


@query(f"WITH {MX} SELECT i0, i1, CAST(sum(v) OVER (PARTITION BY i0 ORDER BY i1 DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS v FROM mx")
def scanr1_rows(spark, d):
    return op.scanr1(matrix(spark, d), M.SUM).df


@query(f"WITH {EV} SELECT i0, CAST(10 + coalesce(sum(v) OVER (ORDER BY i0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS v FROM ev")
def scanl_prime_values(spark, d):
    return op.scanl_prime(events(spark, d), M.SUM, long(10))[0].df


@query(f"WITH {EV} SELECT CAST(10 + sum(v) AS BIGINT) AS v FROM ev")
def scanl_prime_total(spark, d):
    return op.scanl_prime(events(spark, d), M.SUM, long(10))[1].df


@query(f"WITH {EV} SELECT i0, CAST(10 + coalesce(sum(v) OVER (ORDER BY i0 DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS v FROM ev")
def scanr_prime_values(spark, d):
    return op.scanr_prime(events(spark, d), M.SUM, long(10))[0].df


@query(f"WITH {MX} SELECT i0, CAST(10 + sum(v) AS BIGINT) AS v FROM mx GROUP BY i0")
def scanr_prime_row_totals(spark, d):
    return op.scanr_prime(matrix(spark, d), M.SUM, long(10))[1].df


@query("SELECT k AS i0, CAST(0 AS BIGINT) AS i1, CAST(9 AS BIGINT) AS v FROM range(0, 3) t(k)")
def scan_empty_seed(spark, d):
    return op.scanl(generate(spark, (3, 0), lambda i, j: {"v": i}), M.SUM, long(9)).df


@query(f"""WITH RECURSIVE {AF}, runs AS (SELECT i0 // 100 AS r, list(v ORDER BY i0) AS vs FROM af GROUP BY 1),
tot AS (SELECT r, list_reduce(vs, {AFFINE}) AS t FROM runs),
carry(r, c) AS (SELECT CAST(0 AS BIGINT), {{'a': CAST(1 AS BIGINT), 'b': CAST(0 AS BIGINT)}}
  UNION ALL SELECT carry.r + 1, {{'a': c.a * t.a % {PRIME}, 'b': (c.b * t.a + t.b) % {PRIME}}} FROM carry JOIN tot USING (r)),
own AS (SELECT r * 100 + k AS i0, r, list_reduce(vs[1:k + 1], {AFFINE}) AS v FROM (SELECT r, vs, unnest(range(0, len(vs))) AS k FROM runs))
SELECT i0, c.a * v.a % {PRIME} AS a, (c.b * v.a + v.b) % {PRIME} AS b FROM own JOIN carry USING (r)""")
def scanl1_ordered_affine(spark, d):
    return op.scanl1(affine_events(spark, d), affine).df.select("i0", "v.a", "v.b")


@query(SQL["scanl1_ordered_affine"])
def scanl1_affine_events(spark, d):
    """The same scan by its level-by-level tree, under the name that it had when the other took a prefix."""
    return op.scanl1(affine_events(spark, d), affine).df.select("i0", "v.a", "v.b")


# scatter


def quantities(spark, d) -> NDArray:
    lines = spark.read.parquet(f"{d}/lineitem.parquet")
    return from_rows(lines, v=F.col("l_quantity").cast("long"))


@query("SELECT k AS i0, count(l_quantity) AS v FROM range(0, 51) t(k) LEFT JOIN lineitem ON CAST(l_quantity AS BIGINT) = k GROUP BY k")
def permute_histogram_qty(spark, d):
    return op.histogram(quantities(spark, d), 51, lambda v: v).df


@query(f"""WITH {EV}, s AS (SELECT CASE WHEN v >= 5000 THEN i0 % 64 END AS t, v FROM ev),
g AS (SELECT t, sum(v) AS v FROM s WHERE t IS NOT NULL GROUP BY t)
SELECT k AS i0, CAST(1000 + coalesce(v, 0) AS BIGINT) AS v FROM range(0, 64) r(k) LEFT JOIN g ON t = k""")
def permute_drop_small(spark, d):
    defaults = generate(spark, (64,), lambda i: {"v": long(1000)})
    return op.permute(events(spark, d), defaults, M.SUM, lambda i, v: [F.when(v >= 5000, i % 64)]).df


@query(f"WITH {EV}, g AS (SELECT i0 % 97 AS t, arg_max(v, i0) AS v FROM ev GROUP BY 1) SELECT k AS i0, coalesce(v, -1) AS v FROM range(0, 101) r(k) LEFT JOIN g ON t = k")
def permute_const_last(spark, d):
    defaults = generate(spark, (101,), lambda i: {"v": long(-1)})
    return op.permute(events(spark, d), defaults, None, lambda i, v: [i % 97]).df


@query(f"WITH {EV}, g AS (SELECT i0 % 50 AS a, i0 % 3 AS b, max(v) AS v FROM ev GROUP BY ALL) SELECT x AS i0, y AS i1, greatest(coalesce(v, 0), 0) AS v FROM range(0, 50) r(x), range(0, 3) s(y) LEFT JOIN g ON a = x AND b = y")
def permute_max_grid(spark, d):
    defaults = generate(spark, (50, 3), lambda i, j: {"v": long(0)})
    return op.permute(events(spark, d), defaults, M.MAX, lambda i, v: [i % 50, i % 3]).df


@query(f"""WITH {EV}, g AS (SELECT i0 % 10 AS t, list_reduce(list(((v % 997) + 997) % 997 ORDER BY i0), lambda x, y: x * y % {PRIME}) AS p FROM ev WHERE v % 997 <> 0 GROUP BY 1)
SELECT t AS i0, 2 * p % {PRIME} AS v FROM g""")
def permute_product(spark, d):
    a = op.amap(events(spark, d), lambda v: {"v": P.mod(v, long(997))})
    defaults = generate(spark, (10,), lambda i: {"v": long(2)})
    return op.permute(a, defaults, lambda x, y: x * y % PRIME, lambda i, v: [F.when(v != 0, i % 10)]).df


@query(f"WITH {EV} SELECT row_number() OVER (ORDER BY i0) - 1 AS i0, v FROM ev WHERE v % 3 = 0")
def derived_filter_compact(spark, d):
    return op.compact(events(spark, d), lambda v: v % 3 == 0).df


# stencils


def _stencil_sql(offsets: range, source: str, weights: str = "o.k") -> str:
    lo, hi = offsets.start, offsets.stop
    return f"""WITH {EV}, n AS (SELECT count(*) AS n FROM ev),
c AS (SELECT ev.i0, o.k, ev.i0 + o.k AS p, n.n FROM ev, n, range({lo}, {hi}) o(k)),
x AS (SELECT i0, k, p, {source} AS s, n FROM c)
SELECT x.i0, CAST(sum((x.k + 5) * coalesce(e.v, {{outside}})) AS BIGINT) AS v FROM x LEFT JOIN ev e ON e.i0 = x.s GROUP BY x.i0"""


def weighted(radius: int):
    return lambda cells: sum((c * (k - radius + 5) for k, c in enumerate(cells)), long(0))


@query(_stencil_sql(range(-1, 2), "greatest(0, least(n - 1, p))").format(outside=0))
def stencil3_clamp(spark, d):
    return op.stencil(events(spark, d), (1,), op.Clamp(), weighted(1)).df


@query(_stencil_sql(range(-1, 2), "CASE WHEN p < 0 THEN -p WHEN p >= n THEN 2 * n - 2 - p ELSE p END").format(outside=0))
def stencil3_mirror(spark, d):
    return op.stencil(events(spark, d), (1,), op.Mirror(), weighted(1)).df


@query(_stencil_sql(range(-2, 3), "(p + n) % n").format(outside=0))
def stencil5_wrap(spark, d):
    return op.stencil(events(spark, d), (2,), op.Wrap(), weighted(2)).df


@query(_stencil_sql(range(-3, 4), "p").format(outside=17))
def stencil7_constant(spark, d):
    return op.stencil(events(spark, d), (3,), op.Constant(long(17)), weighted(3)).df


@query(_stencil_sql(range(-4, 5), "p").format(outside="x.p * 100"))
def stencil9_function(spark, d):
    return op.stencil(events(spark, d), (4,), op.Function(lambda i: i * 100), weighted(4)).df


@query(f"""WITH {MX}, n AS (SELECT count(*) AS n FROM embeddings),
c AS (SELECT i0, i1, greatest(0, least(n - 1, i0 + a)) AS s0, greatest(0, least(63, i1 + b)) AS s1, 3 * a + b + 5 AS w
      FROM mx, n, range(-1, 2) p(a), range(-1, 2) q(b))
SELECT c.i0, c.i1, CAST(sum(c.w * e.v) AS BIGINT) AS v FROM c JOIN mx e ON e.i0 = c.s0 AND e.i1 = c.s1 GROUP BY c.i0, c.i1""")
def stencil3x3_clamp(spark, d):
    def f(cells):
        return sum((c * (k + 1) for k, c in enumerate(cells)), long(0))

    return op.stencil(matrix(spark, d), (1, 1), op.Clamp(), f).df


@query(f"""WITH {EV}, {PT}, a AS (
  SELECT ev.i0, sum(coalesce(e.v, 0)) AS v FROM ev CROSS JOIN range(-1, 2) o(k) LEFT JOIN ev e ON e.i0 = ev.i0 + k GROUP BY ev.i0),
n AS (SELECT count(*) AS n FROM pt),
b AS (SELECT p.i0, sum(q.v) AS v FROM pt p, n, range(-2, 3) o(k) JOIN pt q ON q.i0 = (p.i0 + k + n) % n GROUP BY p.i0)
SELECT i0, CAST(a.v * 3 + b.v AS BIGINT) AS v FROM a JOIN b USING (i0)""")
def stencil2_two_inputs(spark, d):
    prices = op.unzip(parts(spark, d), "v")
    return op.stencil2(
        events(spark, d), (1,), op.Constant(long(0)), prices, (2,), op.Wrap(), lambda x, y: sum(x, long(0)) * 3 + sum(y, long(0))
    ).df


# control flow


@query(f"WITH {EV} SELECT i0, v * 100 - (SELECT CAST(sum(v) AS BIGINT) FROM ev) AS v FROM ev")
def alet_shared_total(spark, d):
    a = events(spark, d)

    def body(total):
        return op.zip_with(lambda v, t: {"v": v * 100 - t}, a, op.replicate(total, i0=a.extent[0]))

    return op.alet(op.fold(a, M.SUM, long(0)), body).df


@query(f"WITH {EV} SELECT i0, CASE WHEN (SELECT max(v) FROM ev) > 100 THEN v * 2 ELSE v * 3 END AS v FROM ev")
def acond_branch(spark, d):
    a = events(spark, d)
    large = op.amap(op.fold1(a, M.MAX), lambda v: {"v": v > 100})
    return op.acond(large, lambda: op.amap(a, lambda v: {"v": v * 2}), lambda: op.amap(a, lambda v: {"v": v * 3})).df


@query("SELECT k AS i0, k * 1024 AS v FROM range(0, 100) t(k) WHERE k > -1")
def awhile_doubling(spark, d):
    start = generate(spark, (100,), lambda i: {"v": i})
    return op.awhile(
        lambda s: op.amap(op.fold1(s, M.MAX), lambda v: {"v": v < 99 * 1024}), lambda s: op.amap(s, lambda v: {"v": v * 2}), start
    ).df


@query("""WITH RECURSIVE c(i0, x, steps) AS (
  SELECT p_partkey, p_partkey + 1, CAST(0 AS BIGINT) FROM part
  UNION ALL SELECT i0, CASE WHEN x % 2 = 0 THEN x // 2 ELSE 3 * x + 1 END, steps + 1 FROM c WHERE x <> 1)
SELECT i0, max(steps) AS v FROM c GROUP BY i0""")
def while_collatz(spark, d):
    def steps(v, w):
        step = lambda x: np.where(x % 2 == 0, x // 2, 3 * x + 1)
        return {"v": P.while_unbounded(F.col("i0") + 1, lambda x: x != 1, step)}

    return op.amap(parts(spark, d), steps).df


# scalar expressions


def pairs(spark, d) -> DataFrame:
    """Two whole numbers for each part, of either sign and the divisor not 0."""
    a = parts(spark, d)
    return a.df.select("i0", (F.col("v") - 150_000).alias("x"), F.when(F.col("i0") % 2 == 0, F.col("w") + 1).otherwise(-F.col("w") - 1).alias("y"))


PR = f"{PT}, pr AS (SELECT i0, v - 150000 AS x, CASE WHEN i0 % 2 = 0 THEN w + 1 ELSE -w - 1 END AS y FROM pt)"


@query(f"WITH {PR} SELECT i0, x + y AS s, x - y AS d, x * y AS p, -x AS n, abs(x) AS a, CAST(sign(x) AS INTEGER) AS g FROM pr")
def prim_integer(spark, d):
    x, y = F.col("x"), F.col("y")
    return pairs(spark, d).select("i0", (x + y).alias("s"), (x - y).alias("d"), (x * y).alias("p"), (-x).alias("n"), F.abs(x).alias("a"), P.signum_int(x).alias("g"))


@query(f"WITH {PR} SELECT i0, x // y AS q, x % y AS r, (x - (((x % y) + y) % y)) // y AS d, ((x % y) + y) % y AS m FROM pr")
def prim_divmod(spark, d):
    x, y = F.col("x"), F.col("y")
    return pairs(spark, d).select("i0", P.quot(x, y).alias("q"), P.rem(x, y).alias("r"), P.div(x, y).alias("d"), P.mod(x, y).alias("m"))


@query(f"""WITH {PR}, b AS (SELECT i0, abs(x) AS x, abs(y) AS y, abs(x) AS z FROM pr)
SELECT i0, x & y AS a, x | y AS o, xor(x, y) AS e, ~x AS c, x << 3 AS l, x >> 2 AS r, CAST(bit_count(x) AS INTEGER) AS p,
       CAST(CASE WHEN x = 0 THEN 64 ELSE 64 - length(ltrim(bin(x), '0')) END AS INTEGER) AS z,
       CAST(CASE WHEN x = 0 THEN 64 ELSE bit_count(xor(x, x - 1)) - 1 END AS INTEGER) AS t FROM b""")
def prim_bits(spark, d):
    x, y = F.abs(F.col("x")), F.abs(F.col("y"))
    return pairs(spark, d).select(
        "i0", P.band(x, y).alias("a"), P.bor(x, y).alias("o"), P.bxor(x, y).alias("e"), P.complement(x).alias("c"),
        P.shift_left(x, 3).alias("l"), P.shift_right(x, 2).alias("r"), P.pop_count(x).alias("p"),
        P.count_leading_zeros(x).alias("z"), P.count_trailing_zeros(x).alias("t"),
    )


@query(f"""WITH {PR} SELECT i0, ((abs(x) << 5) & 4294967295) | (abs(x) >> 27) AS l,
((abs(x) >> 5) | (abs(x) << 27)) & 4294967295 AS r FROM pr""")
def prim_rotate(spark, d):
    x = F.abs(F.col("x"))
    return pairs(spark, d).select("i0", P.rotate_left(x, 5, 32).alias("l"), P.rotate_right(x, 5, 32).alias("r"))


WRAP = "CAST((({0}) + 9223372036854775808) % 18446744073709551616 + CASE WHEN (({0}) + 9223372036854775808) % 18446744073709551616 < 0 THEN 18446744073709551616 ELSE 0 END - 9223372036854775808 AS BIGINT)"


@query(f"""WITH {PR}, h AS (SELECT i0, CAST(x AS HUGEINT) * 70368744177664 AS x, CAST(y AS HUGEINT) AS y FROM pr)
SELECT i0, {WRAP.format('x + 9223372036854775807')} AS s, {WRAP.format('x * y')} AS p FROM h""")
def prim_wrap(spark, d):
    rows = pairs(spark, d)
    with wrapping(spark):
        x = F.col("x") * F.lit(1 << 46)
        return rows.select("i0", (x + F.lit((1 << 63) - 1)).alias("s"), (x * F.col("y")).alias("p"))


def angles(spark, d) -> DataFrame:
    return parts(spark, d).df.select("i0", ((F.col("v") % 2000 - 1000) / 997.0).alias("x"))


AN = f"{PT}, an AS (SELECT i0, (v % 2000 - 1000) / 997.0::DOUBLE AS x FROM pt)"
TRIG = ["sin", "cos", "tan", "sinh", "cosh", "tanh", "atan", "asinh"]


@query(f"""WITH {AN} SELECT i0, {', '.join(f"CAST(round({f}(x) * 1000000) AS BIGINT) AS f_{f}" for f in TRIG)},
CAST(round(asin(x / 2) * 1000000) AS BIGINT) AS f_asin, CAST(round(acos(x / 2) * 1000000) AS BIGINT) AS f_acos,
CAST(round(atanh(x / 2) * 1000000) AS BIGINT) AS f_atanh, CAST(round(acosh(3 + x) * 1000000) AS BIGINT) AS f_acosh,
CAST(round(atan2(x, 1 - x) * 1000000) AS BIGINT) AS f_atan2 FROM an""")
def prim_float_trig(spark, d):
    x = F.col("x")

    def micro(c, name):
        return F.round(c * 1_000_000).cast("long").alias(f"f_{name}")

    return angles(spark, d).select(
        "i0", *[micro(getattr(F, f)(x), f) for f in TRIG], micro(F.asin(x / 2), "asin"), micro(F.acos(x / 2), "acos"),
        micro(F.atanh(x / 2), "atanh"), micro(F.acosh(3 + x), "acosh"), micro(F.atan2(x, 1 - x), "atan2"),
    )


@query(f"""WITH {AN}, y AS (SELECT i0, x, x > 0 AS pos FROM an)
SELECT i0, CAST(round(exp(x) * 1000000) AS BIGINT) AS e, CAST(round(pow(2.0, x) * 1000000) AS BIGINT) AS p,
       CASE WHEN x >= 0 THEN CAST(round(sqrt(x) * 1000000) AS BIGINT) ELSE -1 END AS q,
       CASE WHEN pos THEN CAST(round(ln(x) * 1000000) AS BIGINT) WHEN x = 0 THEN -2 ELSE -1 END AS l,
       CASE WHEN pos THEN CAST(round(log2(x) * 1000000) AS BIGINT) WHEN x = 0 THEN -2 ELSE -1 END AS b FROM y""")
def prim_float_exp_log(spark, d):
    x = F.col("x")

    def micro(c):
        return F.when(F.isnan(c), long(-1)).when(P.is_infinite(c), long(-2)).otherwise(F.round(c * 1_000_000).cast("long"))

    return angles(spark, d).select(
        "i0", micro(F.exp(x)).alias("e"), micro(F.pow(F.lit(2.0), x)).alias("p"), micro(F.sqrt(x)).alias("q"),
        micro(P.ln(x)).alias("l"), micro(P.log_base(2, x)).alias("b"),
    )


@query(f"""WITH {PT}, h AS (SELECT i0, (v % 41 - 20) / 4.0::DOUBLE AS x FROM pt)
SELECT i0, CAST(trunc(x) AS BIGINT) AS t, CAST(round(x) AS BIGINT) AS r, CAST(floor(x) AS BIGINT) AS f, CAST(ceil(x) AS BIGINT) AS c,
       CAST(CASE WHEN x > 0 THEN 1 WHEN x < 0 THEN -1 ELSE 0 END AS DOUBLE) AS s FROM h""")
def prim_rounding(spark, d):
    x = F.col("x")
    rows = parts(spark, d).df.select("i0", ((F.col("v") % 41 - 20) / 4.0).alias("x"))
    return rows.select(
        "i0", long(P.truncate(x)).alias("t"), long(P.round_half_away(x)).alias("r"), long(F.floor(x)).alias("f"),
        long(F.ceil(x)).alias("c"), P.signum(x).alias("s"),
    )


def special(spark: SparkSession) -> DataFrame:
    """All pairs of numbers that IEEE treats specially."""
    values = [P.NAN, P.INF, -P.INF, 0.0, 1.5, -2.5]
    column = F.array(*[F.lit(v) for v in values])
    return generate(spark, (6, 6), lambda i, j: {"x": F.get(column, i.cast("int")), "y": F.get(column, j.cast("int"))}).df


SP = """val(k, v) AS (VALUES (0, 'nan'::DOUBLE), (1, 'inf'::DOUBLE), (2, '-inf'::DOUBLE), (3, 0.0), (4, 1.5), (5, -2.5)),
sp AS (SELECT CAST(a.k AS BIGINT) AS i0, CAST(b.k AS BIGINT) AS i1, a.v AS x, b.v AS y, isnan(a.v) OR isnan(b.v) AS u FROM val a, val b)"""


@query(f"""WITH {SP} SELECT i0, i1, NOT u AND x < y AS lt, NOT u AND x <= y AS le, NOT u AND x > y AS gt, NOT u AND x >= y AS ge,
           NOT u AND x = y AS eq, u OR x <> y AS ne FROM sp""")
def prim_compare_nan(spark, d):
    x, y = F.col("x"), F.col("y")
    return special(spark).select(
        "i0", "i1", P.flt(x, y).alias("lt"), P.fle(x, y).alias("le"), P.fgt(x, y).alias("gt"), P.fge(x, y).alias("ge"),
        P.feq(x, y).alias("eq"), P.fne(x, y).alias("ne"),
    )


@query(f"""WITH {SP} SELECT i0, i1,
CAST(CASE WHEN isnan(x) THEN y WHEN isnan(y) THEN x ELSE greatest(x, y) END AS VARCHAR) IS NOT NULL AS any_value,
coalesce(CASE WHEN isnan(x) AND isnan(y) THEN NULL WHEN isnan(x) THEN y WHEN isnan(y) THEN x ELSE greatest(x, y) END, 999.0) AS hi,
coalesce(CASE WHEN isnan(x) AND isnan(y) THEN NULL WHEN isnan(x) THEN y WHEN isnan(y) THEN x ELSE least(x, y) END, 999.0) AS lo,
isinf(x) AS i, isnan(x) AS n FROM sp""")
def prim_minmax_nan(spark, d):
    x, y = F.col("x"), F.col("y")
    return special(spark).select(
        "i0", "i1", F.lit(True).alias("any_value"), F.nanvl(P.fmax(x, y), F.lit(999.0)).alias("hi"),
        F.nanvl(P.fmin(x, y), F.lit(999.0)).alias("lo"), P.is_infinite(x).alias("i"), F.isnan(x).alias("n"),
    )


@query(f"""WITH {SP} SELECT i0, i1, CASE
 WHEN u THEN 'nan' WHEN isinf(x) AND isinf(y) THEN 'nan' WHEN y = 0 THEN CASE WHEN x = 0 THEN 'nan' WHEN x > 0 THEN 'inf' ELSE '-inf' END
 WHEN isinf(y) THEN '0' WHEN isinf(x) THEN CASE WHEN (x > 0) = (y > 0) THEN 'inf' ELSE '-inf' END
 ELSE CAST(CAST(round(x / y * 1000) AS BIGINT) AS VARCHAR) END AS q FROM sp""")
def prim_ieee_divide(spark, d):
    q = P.fdiv(F.col("x"), F.col("y"))
    text = F.when(F.isnan(q), "nan").when(q == P.INF, "inf").when(q == -P.INF, "-inf").otherwise(F.round(q * 1000).cast("long").cast("string"))
    return special(spark).select("i0", "i1", text.alias("q"))


@query(f"""WITH {PR}, w AS (SELECT i0, x, ((x % 256) + 256) % 256 AS b, ((x % 65536) + 65536) % 65536 AS s FROM pr)
SELECT i0, CAST(CASE WHEN b >= 128 THEN b - 256 ELSE b END AS TINYINT) AS i8,
       CAST(CASE WHEN s >= 32768 THEN s - 65536 ELSE s END AS SMALLINT) AS i16, CAST(x AS INTEGER) AS i32, b AS w8, s AS w16, CAST(x AS DOUBLE) AS f FROM w""")
def prim_casts(spark, d):
    x = F.col("x")
    return pairs(spark, d).select(
        "i0", P.from_integral(x, "tinyint").alias("i8"), P.from_integral(x, "smallint").alias("i16"),
        P.from_integral(x, "int").alias("i32"), P.to_word(x, 8).alias("w8"), P.to_word(x, 16).alias("w16"), x.cast("double").alias("f"),
    )


@query(f"WITH {PT} SELECT i0, CASE w % 4 WHEN 0 THEN v WHEN 1 THEN -v ELSE 7 END AS v FROM pt")
def prim_case(spark, d):
    return op.amap(parts(spark, d), lambda v, w: {"v": P.case_of(w % 4, {0: v, 1: -v}, long(7))}).df


@query(f"WITH {PT} SELECT i0, w AS a, v AS b, v + w AS c FROM pt")
def prim_vector(spark, d):
    def f(v, w):
        a, b = P.vec_unpack(P.vec_pack(w, v), 2)
        return {"a": a, "b": b, "c": a + b}

    return op.amap(parts(spark, d), f).df


@query(f"""WITH {PR}, s AS (SELECT i0, x, CASE WHEN x < 0 THEN 1 ELSE 0 END AS m, abs(x) AS a FROM pr WHERE x <> 0),
e AS (SELECT *, CAST(floor(log2(a)) AS BIGINT) AS k FROM s)
SELECT i0, ((1023 + k) << 52) + CAST((a - (1::BIGINT << k)) AS BIGINT) * (1::BIGINT << (52 - k)) - CASE WHEN m = 1 THEN 9223372036854775807 ELSE 0 END
         - m AS bits, CAST(x AS DOUBLE) AS back FROM e UNION ALL SELECT i0, 0, 0.0 FROM pr WHERE x = 0""")
def prim_coerce(spark, d):
    """The bits of whole numbers as doubles, and the doubles of those bits."""
    bits = P.coerce(F.col("x").cast("double"), "bigint")
    return pairs(spark, d).select("i0", bits.alias("bits"), P.coerce(bits, "double").alias("back"))


# derived


@query(f"WITH {MX} SELECT CAST(sum(a.v * b.v) AS BIGINT) AS v FROM mx a JOIN mx b ON a.i1 = b.i1 AND a.i0 = 0 AND b.i0 = 1")
def derived_dotp(spark, d):
    a = matrix(spark, d)
    products = op.zip_with(lambda x, y: {"v": x * y}, op.slice_at(a, i0=0), op.slice_at(a, i0=1))
    return op.fold(products, M.SUM, long(0)).df


@query("""WITH RECURSIVE z(i0, i1, x, y, n) AS (
  SELECT a, b, CAST(0 AS BIGINT), CAST(0 AS BIGINT), 0 FROM range(0, 24) s(a), range(0, 32) t(b)
  UNION ALL SELECT i0, i1, x * x // 4096 - y * y // 4096 + (i1 - 22) * 384, 2 * x * y // 4096 + (i0 - 12) * 384, n + 1
  FROM z WHERE x * x + y * y <= 67108864 AND n < 30)
SELECT i0, i1, max(n) AS v FROM z GROUP BY i0, i1""")
def derived_mandelbrot(spark, d):
    """In fixed point with 12 binary places, so that both engines agree to the last bit."""
    unit_ = 4096

    def escape(i, j):
        start = F.struct(long(0).alias("x"), long(0).alias("y"), F.lit(0).alias("n"))

        def step(s):
            x, y = s["x"], s["y"]
            return F.struct(
                (P.quot(x * x, unit_) - P.quot(y * y, unit_) + (j - 22) * 384).alias("x"),
                (P.quot(2 * x * y, unit_) + (i - 12) * 384).alias("y"), (s["n"] + 1).alias("n"),
            )

        return {"v": P.while_loop(start, 30, lambda s: (s["n"] < 30) & (s["x"] * s["x"] + s["y"] * s["y"] <= 4 * unit_ * unit_), step)["n"]}

    return generate(spark, (24, 32), escape).df


# foreign functions, streams, traces


@query(f"WITH {PT} SELECT i0, v * 2 + w AS v FROM pt")
def foreign_pandas_udf(spark, d):
    def native():
        return F.pandas_udf(lambda v, w: v * 2 + w, "long")

    f = op.foreign_exp(native, lambda v, w: v * 2 + w)
    return op.amap(parts(spark, d), lambda v, w: {"v": f(v, w)}).df


@query(f"WITH {PT} SELECT i0, v * 2 + w AS v FROM pt")
def foreign_fallback(spark, d):
    def native():
        raise NotImplementedError("no implementation for this backend")

    f = op.foreign_exp(native, lambda v, w: v * 2 + w)
    return op.amap(parts(spark, d), lambda v, w: {"v": f(v, w)}).df


@query(f"WITH {PT} SELECT i0, v + 1 AS v, w FROM pt")
def foreign_array_function(spark, d):
    def native(frames):
        for frame in frames:
            frame["v"] += 1
            yield frame

    return op.foreign_acc(parts(spark, d), native, lambda a: op.amap(a, lambda v, w: {"v": v + 1, "w": w})).df


@query(f"WITH {EV} SELECT i0, v FROM ev")
def atrace_identity(spark, d):
    a = events(spark, d)
    return op.atrace(a, op.fold(a, M.SUM, long(0)), tell=lambda line: None).df


@query("SELECT user_id, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS v FROM events GROUP BY user_id")
def stream_map_batches(spark, d):
    """Several files make several batches, each of which is folded by user; the batches' sums are then added up."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    spark.read.parquet(f"{d}/events.parquet").select("user_id", "value").repartition(4).write.parquet(f"{folder}/in")

    def program(batch: DataFrame, number: int) -> DataFrame:
        return batch.groupBy("user_id").agg(F.sum(cents("value")).alias("v"))

    stream_files(spark, f"{folder}/in", "user_id long, value double", program, f"{folder}/out", f"{folder}/state")
    return spark.read.parquet(f"{folder}/out").groupBy("user_id").agg(F.sum("v").alias("v"))
