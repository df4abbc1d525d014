"""Arrays from tables, local values, scalars and functions of the index; arrays to Parquet."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..array import NDArray, axes, from_linear


def domain(spark: SparkSession, extent: tuple[int, ...]) -> NDArray:
    """The index of each element and no payload: one range, cut into axes by arithmetic."""
    n = NDArray(None, extent).size
    rows = spark.range(n)
    return NDArray(rows.select(*[c.alias(a) for c, a in zip(from_linear(F.col("id"), extent), axes(len(extent)))]), extent)


def alloc(spark: SparkSession, extent: tuple[int, ...]) -> NDArray:
    """An array whose elements are unspecified: the domain alone."""
    return domain(spark, extent)


def generate(spark: SparkSession, extent: tuple[int, ...], f: Callable[..., dict[str, Column]]) -> NDArray:
    """f of the index columns at each index; f returns the components by name."""
    cells = domain(spark, extent)
    out = f(*[F.col(c) for c in cells.index])
    return cells.with_df(cells.df.select(*cells.index, *[v.alias(k) for k, v in out.items()]))


def unit(spark: SparkSession, **values: Column) -> NDArray:
    """A rank-0 array of one element."""
    return NDArray(spark.range(1).select(*[v.alias(k) for k, v in values.items()]), ())


def use(df: DataFrame, index: list[Column | str], extent: tuple[int, ...], **values: Column | str) -> NDArray:
    """A table with a unique dense index; `values` names the components."""
    cols = [(F.col(c) if isinstance(c, str) else c).cast("long").alias(a) for c, a in zip(index, axes(len(extent)))]
    parts = [(F.col(v) if isinstance(v, str) else v).alias(k) for k, v in values.items()]
    return NDArray(df.select(*cols, *parts), extent)


def from_table(spark: SparkSession, path: str, index: str, **values: Column | str) -> NDArray:
    """A rank-1 array from a Parquet table keyed 0, 1, ...; its extent is the table's row count.

    The count is read from the files' metadata. Only the columns that `values` uses are scanned.
    """
    df = spark.read.parquet(path)
    return use(df, [index], (df.count(),), **values)


def from_rows(df: DataFrame, **values: Column | str) -> NDArray:
    """A rank-1 array of a table without an index, numbered 0, 1, ... in the order of its scan.

    A first pass counts the rows of each of the scan's partitions; a row's index is its place in its own, after those
    of the partitions before it.
    """
    part, place = F.spark_partition_id(), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    sizes = df.groupBy(part.alias("_part")).agg(F.count("*").alias("_n")).persist()  # a row for each partition
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_start"))
    n = sizes.agg(F.sum("_n")).first()[0] or 0
    parts = [(F.col(v) if isinstance(v, str) else v).alias(k) for k, v in values.items()]
    rows = df.select(part.alias("_part"), place.alias("_place"), *parts).join(starts, "_part", "left")
    return NDArray(rows.select((F.col("_start") + F.col("_place")).alias("i0"), *values), (n,))


def from_local(spark: SparkSession, values: Iterable, extent: tuple[int, ...] | None = None, kind: str = "long") -> NDArray:
    """Local values in row-major order as component v."""
    values = list(values)
    extent = (len(values),) if extent is None else extent
    df = spark.createDataFrame(list(enumerate(values)), f"at long, v {kind}")
    index = [c.alias(a) for c, a in zip(from_linear(F.col("at"), extent), axes(len(extent)))]
    return NDArray(df.select(*index, "v"), extent)


def to_parquet(a: NDArray, path: str, **options: str) -> None:
    """Write an array range-partitioned by its index, so that reads of an index range skip files."""
    ordered = a.df.repartitionByRange(*a.index).sortWithinPartitions(*a.index) if a.rank else a.df
    ordered.write.options(**options).parquet(path)
