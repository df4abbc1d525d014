"""Reductions along the innermost axis, whole and segmented.

With a Monoid they are Spark's partial and final aggregates, and a seed is combined once, at the end. Any
other associative function is a callable of two columns; order is kept. It is applied level by level: runs
of RUN neighbours are gathered, sorted and reduced, until one value is left, so no group grows with the data.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..array import NDArray, axes
from ..plans.monoid import Monoid
from ..sources import domain

RUN = 1024
CHUNK = 65_536
PIECE = 32  # positions of a segment that are looked up together

Combine = Monoid | Callable[[Column, Column], Column]


def combine_of(op: Combine) -> Callable[[Column, Column], Column]:
    return op.combine if isinstance(op, Monoid) else op


def ordered_tree(df: DataFrame, keys: list[str], at: str, value: str, op: Callable, n: int) -> DataFrame:
    """(keys, value): the values of each key combined in the order of `at`, which is below n."""
    df = df.select(*keys, F.col(at).alias("_at"), F.col(value).alias("_v"))
    while True:
        up = F.call_function("div", F.col("_at"), F.lit(RUN).cast("long"))
        runs = df.groupBy(*keys, up.alias("_up")).agg(F.sort_array(F.collect_list(F.struct("_at", "_v"))).alias("_run"))
        parts = F.transform("_run", lambda r: r["_v"])
        rest = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1)))
        df = runs.select(*keys, F.col("_up").alias("_at"), F.aggregate(rest, F.element_at(parts, 1), op).alias("_v"))
        n = -(-n // RUN)
        if n <= 1:
            return df.select(*keys, F.col("_v").alias(value))


def _reduced(a: NDArray, op: Combine, value: str) -> DataFrame:
    outer = a.index[:-1]
    if isinstance(op, Monoid):
        return a.df.groupBy(*outer).agg(op.aggregate(F.col(value)).alias(value))
    return ordered_tree(a.df, outer, a.index[-1], value, op, a.extent[-1])


def fold(a: NDArray, op: Combine, seed: Column, value: str = "v") -> NDArray:
    """Reduce the innermost axis, beginning with the seed, which need not be neutral.

    An empty axis gives the seed at every outer index.
    """
    outer = a.extent[:-1]
    if a.extent[-1] == 0 or a.size == 0:
        cells = domain(a.df.sparkSession, outer) if outer else NDArray(a.df.sparkSession.range(1).select(), ())
        return NDArray(cells.df.select(*axes(len(outer)), seed.alias(value)), outer)
    done = _reduced(a, op, value)
    return NDArray(done.withColumn(value, combine_of(op)(seed, F.col(value))), outer)


def fold1(a: NDArray, op: Combine, value: str = "v") -> NDArray:
    """Reduce the innermost axis, which must not be empty, whatever the outer ones are."""
    if a.extent[-1] == 0:
        raise ValueError("fold1: empty array")
    return NDArray(_reduced(a, op, value), a.extent[:-1])


def segment_offsets(lengths: NDArray, value: str = "v") -> NDArray:
    """Where each segment begins, and at last where all end: the exclusive prefix sum of the lengths."""
    from ..plans.monoid import SUM
    from .scan import scanl

    return scanl(lengths, SUM, F.lit(0).cast("long"), value)


def segment_ranges(lengths: NDArray, value: str = "v") -> DataFrame:
    """(seg, lo, hi) for every segment."""
    starts = segment_offsets(lengths, value).df.select(F.col("i0").alias("seg"), F.col(value).alias("lo"))
    sizes = lengths.df.select(F.col("i0").alias("seg"), F.col(value).cast("long").alias("n"))
    return starts.join(sizes, "seg").select("seg", "lo", (F.col("lo") + F.col("n")).alias("hi"))


def segment_of(df: DataFrame, at: str, ranges: DataFrame) -> DataFrame:
    """df with the segment `seg` that each row's position `at` lies in; rows in no segment are left out.

    Segments are cut where a piece of PIECE positions ends. A row is joined to its piece's segments, which are few,
    and keeps the one that holds it, so positions are not laid out, and a long segment is many pieces.
    """
    def piece(c):
        return F.call_function("div", c, F.lit(PIECE).cast("long"))

    # in two steps, so that the longest segment's pieces aren't one array
    pieces = ranges.where("hi > lo").select(
        "lo", "hi", "seg", F.explode(F.sequence("lo", F.col("hi") - 1, F.lit(CHUNK).cast("long"))).alias("start")
    ).select("seg", F.col("start").alias("lo"), F.least(F.col("start") + CHUNK, F.col("hi")).alias("hi"))
    pieces = pieces.select("seg", "lo", "hi", F.explode(F.sequence(piece(F.col("lo")), piece(F.col("hi") - 1))).alias("_piece"))
    held = (F.col(at) >= F.col("lo")) & (F.col(at) < F.col("hi"))
    return df.withColumn("_piece", piece(F.col(at))).join(pieces, "_piece").where(held).drop("_piece", "lo", "hi")


def fold_seg(a: NDArray, op: Combine, seed: Column, lengths: NDArray, value: str = "v", length: str = "v") -> NDArray:
    """Reduce each segment of the innermost axis, beginning with the seed; an empty segment gives the seed.

    lengths: a vector of segment lengths, whose sum is at most the axis. Elements meet their segment as
    `segment_of` tells, and segments are reduced by partial aggregates.
    """
    outer, last, n = a.index[:-1], a.index[-1], lengths.extent[0]
    rows = segment_of(a.df.select(*a.index, value), last, segment_ranges(lengths, length))
    keys = [*outer, "seg"]
    if isinstance(op, Monoid):
        done = rows.groupBy(*keys).agg(op.aggregate(F.col(value)).alias(value))
    else:
        done = ordered_tree(rows, keys, last, value, op, a.extent[-1])
    extent = (*a.extent[:-1], n)
    cells = domain(a.df.sparkSession, extent)
    done = done.withColumnRenamed("seg", axes(len(extent))[-1])
    full = cells.df.join(done, cells.index, "left")
    seeded = F.when(F.col(value).isNull(), seed).otherwise(combine_of(op)(seed, F.col(value)))
    return NDArray(full.select(*cells.index, seeded.alias(value)), extent)


def fold1_seg(a: NDArray, op: Combine, lengths: NDArray, value: str = "v", length: str = "v") -> NDArray:
    """Reduce each segment of the innermost axis; an empty segment is an error, raised by its task."""
    safe = lengths.with_df(lengths.df.select("i0", F.when(
        F.col(length) > 0, F.col(length)
    ).otherwise(F.raise_error(F.lit("fold1_seg: empty segment")).cast("long")).alias(length)))
    outer, last = a.index[:-1], a.index[-1]
    rows = segment_of(a.df.select(*a.index, value), last, segment_ranges(safe, length))
    if isinstance(op, Monoid):
        done = rows.groupBy(*outer, "seg").agg(op.aggregate(F.col(value)).alias(value))
    else:
        done = ordered_tree(rows, [*outer, "seg"], last, value, op, a.extent[-1])
    extent = (*a.extent[:-1], lengths.extent[0])
    return NDArray(done.withColumnRenamed("seg", axes(len(extent))[-1]), extent)
