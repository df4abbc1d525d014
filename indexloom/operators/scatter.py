"""Scatter with a combine function, and what is made of it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..array import NDArray, axes
from ..plans.monoid import SUM, Monoid
from ..plans.session import written
from ..sources import generate
from .reduce import Combine, combine_of, ordered_tree


def permute(
    source: NDArray, defaults: NDArray, op: Combine | None, target: Callable[..., list[Column]], value: str = "v"
) -> NDArray:
    """From defaults, combine each source element into target(index, components): out = op(new, old).

    A null in a target drops the element. Elements are combined by target before they meet the defaults,
    so a hot target costs a partial aggregate. op must be associative and commutative; with op None the
    element with the highest source index is written, where order would otherwise be left open.
    """
    rank = defaults.rank
    cells = [f"_to{k}" for k in range(rank)]
    where = target(*[F.col(c) for c in source.index], *[F.col(c) for c in source.values])
    rows = source.df.select(
        *[w.cast("long").alias(c) for w, c in zip(where, cells)], source.linear().alias("_at"), F.col(value).alias("_new")
    ).na.drop(subset=cells)
    if op is None:
        new = rows.groupBy(*cells).agg(F.max_by("_new", "_at").alias("_new"))
    elif isinstance(op, Monoid):
        new = rows.groupBy(*cells).agg(op.aggregate(F.col("_new")).alias("_new"))
    else:
        new = ordered_tree(rows, cells, "_at", "_new", lambda old, x: op(x, old), source.size)
    new = new.select(*[F.col(c).alias(a) for c, a in zip(cells, axes(rank))], "_new")
    joined = defaults.df.join(new, defaults.index, "left")
    both = F.col("_new") if op is None else combine_of(op)(F.col("_new"), F.col(value))
    out = F.when(F.col("_new").isNull(), F.col(value)).otherwise(both)
    return defaults.with_df(joined.select(*defaults.index, out.alias(value)))


def histogram(source: NDArray, bins: int, bin_of: Callable[..., Column]) -> NDArray:
    """How many elements fall in each bin, from 0; null bins don't count."""
    zeros = generate(source.df.sparkSession, (bins,), lambda i: {"v": F.lit(0).cast("long")})
    ones = source.with_df(source.df.withColumn("_one", F.lit(1).cast("long")))
    names = source.values

    def target(*cols):
        return [bin_of(*cols[source.rank : source.rank + len(names)])]

    counted = permute(ones, zeros.with_df(zeros.df.withColumnRenamed("v", "_one")), SUM, target, "_one")
    return counted.with_df(counted.df.withColumnRenamed("_one", "v"))


def compact(a: NDArray, keep: Callable[..., Column]) -> NDArray:
    """The elements of a vector for which keep holds, densely indexed in order.

    A first pass counts the elements kept in each chunk of the index; the counts are written, and their sum is the new
    extent. Kept elements are then numbered within their chunk, after those of the chunks before it.
    """
    from .scan import CHUNK, scanl

    kept = keep(*[F.col(c) for c in a.values])
    chunk = F.call_function("div", F.col("i0"), F.lit(CHUNK).cast("long"))
    counts = a.df.groupBy(chunk.alias("i0")).agg(F.count_if(kept).alias("v"))
    counts = NDArray(written(counts, "counts"), (-(-a.extent[0] // CHUNK),))
    n = counts.df.agg(F.sum("v")).first()[0] or 0
    starts = scanl(counts, SUM, F.lit(0).cast("long")).df.select(F.col("i0").alias("_chunk"), F.col("v").alias("_start"))
    own = Window.partitionBy("_chunk").orderBy("i0")
    numbered = a.df.where(kept).withColumn("_chunk", chunk).withColumn("_place", F.row_number().over(own) - 1)
    placed = numbered.join(starts, "_chunk")
    return NDArray(placed.select((F.col("_start") + F.col("_place")).alias("i0"), *a.values), (n,))
