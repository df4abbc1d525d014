"""Projections: map, unzip, zipWith, and the fused gather-map."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..array import NDArray


def amap(a: NDArray, f: Callable[..., dict[str, Column]]) -> NDArray:
    """f of the component columns at every element; f returns the new components by name."""
    out = f(*[F.col(c) for c in a.values])
    return a.with_df(a.df.select(*a.index, *[v.alias(k) for k, v in out.items()]))


def unzip(a: NDArray, *components: str) -> NDArray:
    """Some components; the others are pruned from the scan."""
    return a.with_df(a.df.select(*a.index, *components))


def zip_with(f: Callable[..., dict[str, Column]], *arrays: NDArray) -> NDArray:
    """f of the components of all arrays, point by point over the intersection of their extents.

    An inner join on the index is that intersection. Components are passed in order, array by array.
    """
    first = arrays[0]
    extent = tuple(map(min, zip(*[a.extent for a in arrays])))
    joined, names = None, []
    for k, a in enumerate(arrays):
        own = [f"_{k}_{c}" for c in a.values]
        names += own
        df = a.df.select(*a.index, *[F.col(c).alias(o) for c, o in zip(a.values, own)])
        if joined is None:
            joined = df
        else:
            joined = joined.join(df, first.index) if first.rank else joined.join(df, F.lit(True))
    out = f(*[F.col(c) for c in names])
    return NDArray(joined.select(*first.index, *[v.alias(k) for k, v in out.items()]), extent)


def transform(
    a: NDArray, extent: tuple[int, ...], source: Callable[..., list[Column]], f: Callable[..., dict[str, Column]]
) -> NDArray:
    """out[ix] = f(a[source(ix)]): a gather and a map in one plan."""
    from .indexing import backpermute

    return amap(backpermute(a, extent, source), f)
