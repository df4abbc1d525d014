"""Prefix scans along the innermost axis.

A window over a whole axis would put it into one task. An axis of more than CHUNK elements is therefore
scanned in three steps: a window within each chunk of the index, a scan of the chunks' totals (by the same
function, level by level), and a combination of each element with the total before its chunk. Rows of a
matrix are partitions of their own, and short ones need one window only.

Scans from the right are scans from the left over the mirrored index with the operands exchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..array import NDArray, axes
from ..plans.monoid import Monoid
from .reduce import Combine, combine_of

CHUNK = 65_536
RUN = 256  # elements of a chunk for combine functions that are no built-in aggregate


def _mirrored(a: NDArray) -> NDArray:
    last = a.index[-1]
    return a.with_df(a.df.withColumn(last, F.lit(a.extent[-1] - 1).cast("long") - F.col(last)))


def _flipped(op: Combine) -> Combine:
    if isinstance(op, Monoid):
        return op
    return lambda x, y: op(y, x)


def _running(a: NDArray, op: Combine, value: str, chunk: int) -> NDArray:
    """The inclusive scan from the left."""
    outer, last, n = a.index[:-1], a.index[-1], a.extent[-1]
    df = a.df.select(*a.index, value)
    size = chunk if isinstance(op, Monoid) else min(chunk, RUN)
    if n <= size:
        return NDArray(_local(df, outer, last, value, op), a.extent)
    df = df.withColumn("_chunk", F.call_function("div", F.col(last), F.lit(size).cast("long")))
    local = _local(df, [*outer, "_chunk"], last, value, op)
    chunks = -(-n // size)
    names = axes(len(outer) + 1)
    if isinstance(op, Monoid):
        totals = df.groupBy(*outer, "_chunk").agg(op.aggregate(F.col(value)).alias("v"))
    else:
        totals = local.groupBy(*outer, "_chunk").agg(F.max_by(value, last).alias("v"))
    totals = totals.withColumnRenamed("_chunk", names[-1])
    carry = _running(NDArray(totals, (*a.extent[:-1], chunks)), op, "v", chunk).df
    carry = carry.select(*outer, (F.col(names[-1]) + 1).alias("_chunk"), F.col("v").alias("_carry"))
    joined = local.join(carry, [*outer, "_chunk"], "left")
    full = F.when(F.col("_chunk") == 0, F.col(value)).otherwise(combine_of(op)(F.col("_carry"), F.col(value)))
    return NDArray(joined.select(*a.index, full.alias(value)), a.extent)


def _local(df, keys: list[str], last: str, value: str, op: Combine):
    """The running combination within each key."""
    if isinstance(op, Monoid):
        frame = Window.partitionBy(*keys).orderBy(last).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.withColumn(value, op.running(F.col(value), frame))
    kept = [c for c in df.columns if c not in (*keys, last, value)]
    runs = df.groupBy(*keys, *kept).agg(F.sort_array(F.collect_list(F.struct(last, value))).alias("_run"))
    first = F.element_at("_run", 1)

    def step(done, row):
        prior = F.element_at(done, -1)[value]
        return F.concat(done, F.array(F.struct(row[last].alias(last), op(prior, row[value]).alias(value))))

    rest = F.slice("_run", 2, F.greatest(F.size("_run") - 1, F.lit(1)))
    done = F.aggregate(rest, F.array(first), step)
    return runs.select(*keys, *kept, F.explode(done).alias("_x")).select(
        *keys, *kept, F.col(f"_x.{last}").alias(last), F.col(f"_x.{value}").alias(value)
    )


def _seeds(a: NDArray, at: int, seed: Column, value: str):
    """The seed at one place of the innermost axis, for every outer index."""
    from ..sources import domain

    spark = a.df.sparkSession
    outer = domain(spark, a.extent[:-1]).df if a.rank > 1 else spark.range(1).select()
    return outer.select(*a.index[:-1], F.lit(at).cast("long").alias(a.index[-1]), seed.alias(value))


def scanl1(a: NDArray, op: Combine, value: str = "v", chunk: int = CHUNK) -> NDArray:
    """Inclusive, from the left; an empty axis stays empty."""
    return a if a.size == 0 else _running(a, op, value, chunk)


def scanr1(a: NDArray, op: Combine, value: str = "v", chunk: int = CHUNK) -> NDArray:
    """Inclusive, from the right: out[j] = x_j + ... + x_n-1."""
    return a if a.size == 0 else _mirrored(_running(_mirrored(a), _flipped(op), value, chunk))


def scanl(a: NDArray, op: Combine, seed: Column, value: str = "v", chunk: int = CHUNK) -> NDArray:
    """Exclusive, from the left, with n + 1 elements: out[0] is the seed, out[n] the total."""
    last = a.index[-1]
    done = scanl1(a, op, value, chunk).df.select(
        *a.index[:-1], (F.col(last) + 1).alias(last), combine_of(op)(seed, F.col(value)).alias(value)
    )
    return NDArray(_seeds(a, 0, seed, value).unionByName(done), (*a.extent[:-1], a.extent[-1] + 1))


def scanr(a: NDArray, op: Combine, seed: Column, value: str = "v", chunk: int = CHUNK) -> NDArray:
    """Exclusive, from the right, with n + 1 elements: out[n] is the seed, out[0] the total."""
    done = scanr1(a, op, value, chunk).df.select(*a.index, combine_of(op)(F.col(value), seed).alias(value))
    return NDArray(done.unionByName(_seeds(a, a.extent[-1], seed, value)), (*a.extent[:-1], a.extent[-1] + 1))


def scanl_prime(a: NDArray, op: Combine, seed: Column, value: str = "v", chunk: int = CHUNK) -> tuple[NDArray, NDArray]:
    """scanl without its last element, and that element."""
    full, last, n = scanl(a, op, seed, value, chunk), a.index[-1], a.extent[-1]
    body = NDArray(full.df.where(F.col(last) < n), a.extent)
    return body, NDArray(full.df.where(F.col(last) == n).drop(last), a.extent[:-1])


def scanr_prime(a: NDArray, op: Combine, seed: Column, value: str = "v", chunk: int = CHUNK) -> tuple[NDArray, NDArray]:
    """scanr without its first element, and that element."""
    full, last = scanr(a, op, seed, value, chunk), a.index[-1]
    body = full.df.where(F.col(last) > 0).withColumn(last, F.col(last) - 1)
    return NDArray(body, a.extent), NDArray(full.df.where(F.col(last) == 0).drop(last), a.extent[:-1])
