"""Stencils: functions of each element's neighbourhood.

The array is enlarged by what the boundary rule says of the cells around it, which are few. Axis by axis, a cell then
takes its neighbours from the rows beside it in a window. A long axis is cut into tiles of TILE indices for
that, and only the cells within the radius of a tile's end are copied to the next tile. So an array is shuffled once
for each axis with a radius, and not once for each cell of the box.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..array import NDArray
from ..sources import domain

TILE = 16_384


class Clamp:
    """Outside cells are the nearest inside."""

    def source(self, i: Column, n: int) -> Column:
        return F.greatest(F.lit(0).cast("long"), F.least(F.lit(n - 1).cast("long"), i))


class Mirror:
    """Outside cells are reflected, without repeating the edge."""

    def source(self, i: Column, n: int) -> Column:
        return F.when(i < 0, -i).when(i >= n, F.lit(2 * n - 2).cast("long") - i).otherwise(i)


class Wrap:
    """Outside cells come from the other side."""

    def source(self, i: Column, n: int) -> Column:
        return F.when(i < 0, i + n).when(i >= n, i - n).otherwise(i)


@dataclass
class Constant:
    """Outside cells have one value."""

    value: Column


@dataclass
class Function:
    """Outside cells have a value computed from their index."""

    f: Callable[..., Column]


Boundary = Clamp | Mirror | Wrap | Constant | Function


def _around(a: NDArray, radii: tuple[int, ...], boundary: Boundary) -> DataFrame:
    """(index, c0) of the cells outside the array within the radii, by slabs: each axis's two ends."""
    slabs = None
    for k, r in enumerate(radii):
        if not r:
            continue
        box = (*a.extent[:k], 2 * r, *[n + 2 * s for n, s in zip(a.extent[k + 1 :], radii[k + 1 :])])
        cells = domain(a.df.sparkSession, box)
        index = []
        for j, c in enumerate(cells.index):
            i = F.col(c)
            index.append(i if j < k else i - radii[j] if j > k else F.when(i < r, i - r).otherwise(i + (a.extent[k] - r)))
        slab = cells.df.select(*[i.alias(c) for i, c in zip(index, cells.index)])
        slabs = slab if slabs is None else slabs.union(slab)
    places = [F.col(c) for c in a.index]
    if isinstance(boundary, Constant):
        return slabs.select(*a.index, boundary.value.alias("c0"))
    if isinstance(boundary, Function):
        return slabs.select(*a.index, boundary.f(*places).alias("c0"))
    keys = [f"_from{k}" for k in range(a.rank)]
    asked = slabs.select(*a.index, *[boundary.source(p, n).alias(k) for p, n, k in zip(places, a.extent, keys)])
    held = a.df.select(*[F.col(c).alias(k) for c, k in zip(a.index, keys)], F.col("c0"))
    return asked.join(held, keys).select(*a.index, "c0")


def _beside(df: DataFrame, index: list[str], axis: int, n: int, r: int, cells: list[str]) -> tuple[DataFrame, list[str]]:
    """df within 0 <= index < n of an axis, with the cells of the 2 r + 1 rows around each row, first row first."""
    at = F.col(index[axis]) + r  # from 0
    tile = F.call_function("div", at, F.lit(TILE).cast("long"))
    if n + 2 * r > TILE:
        place = at % TILE
        near = F.array(tile, F.when(place < 2 * r, tile - 1), F.when(place >= TILE - 2 * r, tile + 1))
        df = df.withColumn("_tile", F.explode(F.array_compact(near)))
    else:
        df = df.withColumn("_tile", F.lit(0).cast("long"))
    rows = Window.partitionBy("_tile", *[c for k, c in enumerate(index) if k != axis]).orderBy(index[axis])
    shifted = [F.lag(c, -o).over(rows) if o else F.col(c) for o in range(-r, r + 1) for c in cells]
    names = [f"c{k}" for k in range(len(shifted))]
    own = df.select(*index, (F.col("_tile") == tile).alias("_own"), *[s.alias(f"_{c}") for s, c in zip(shifted, names)])
    inside = own.where(F.col("_own") & (F.col(index[axis]) >= 0) & (F.col(index[axis]) < n))
    return inside.select(*index, *[F.col(f"_{c}").alias(c) for c in names]), names


def _neighbours(a: NDArray, radii: tuple[int, ...], boundary: Boundary, value: str) -> DataFrame:
    """(index, c0, c1, ...): each cell's neighbourhood in row-major order of the offsets."""
    if any(r > 4 or r < 0 for r in radii) or len(radii) != a.rank:
        raise ValueError("a stencil has one radius of 0 to 4 for each axis")
    if isinstance(boundary, (Clamp, Mirror, Wrap)) and any(r >= n > 0 for r, n in zip(radii, a.extent)):
        raise ValueError("an extent is no larger than its radius")
    a = a.with_df(a.df.select(*a.index, F.col(value).alias("c0")))
    df, cells = a.df, ["c0"]
    if a.size and any(radii):
        df = df.unionByName(_around(a, radii, boundary))
    for axis in reversed(range(a.rank)):
        if radii[axis]:
            df, cells = _beside(df, a.index, axis, a.extent[axis], radii[axis], cells)
    return df.select(*a.index, *cells)


def stencil(
    a: NDArray, radii: tuple[int, ...], boundary: Boundary, f: Callable[[list[Column]], Column], value: str = "v"
) -> NDArray:
    """out[ix] = f(neighbourhood of ix); f gets the box's cells in row-major order. Radii: 0 to 4 for each axis."""
    cells = _neighbours(a, radii, boundary, value)
    names = [c for c in cells.columns if c not in a.index]
    return a.with_df(cells.select(*a.index, f([F.col(c) for c in names]).alias(value)))


def stencil2(
    a: NDArray, a_radii: tuple[int, ...], a_boundary: Boundary, b: NDArray, b_radii: tuple[int, ...],
    b_boundary: Boundary, f: Callable[[list[Column], list[Column]], Column], value: str = "v",
) -> NDArray:
    """Over two arrays with a rule each; the result's extent is the intersection of theirs."""
    left, right = _neighbours(a, a_radii, a_boundary, value), _neighbours(b, b_radii, b_boundary, value)
    mine = [c for c in left.columns if c not in a.index]
    yours = [c for c in right.columns if c not in b.index]
    right = right.select(*b.index, *[F.col(c).alias(f"_{c}") for c in yours])
    joined = left.join(right, a.index)
    out = f([F.col(c) for c in mine], [F.col(f"_{c}") for c in yours])
    return NDArray(joined.select(*a.index, out.alias(value)), tuple(map(min, zip(a.extent, b.extent))))
