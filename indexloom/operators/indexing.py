"""Index-space operators.

A gather in general is a join of the new domain with the array on the source index. Gathers whose index
map has an inverse (reverse, shift, transpose, reshape, slices) only rewrite the index columns: no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..array import NDArray, axes, from_linear
from ..sources import domain

BROADCAST = 1_000_000  # elements of the side of a product that is broadcast


def _moved(a: NDArray, extent: tuple[int, ...], index: list[Column], where: Column | None = None) -> NDArray:
    df = a.df if where is None else a.df.where(where)
    return NDArray(df.select(*[c.alias(n) for c, n in zip(index, axes(len(extent)))], *a.values), extent)


def backpermute(a: NDArray, extent: tuple[int, ...], source: Callable[..., list[Column]]) -> NDArray:
    """out[ix] = a[source(ix)] over a new extent.

    Every source index must lie in the array; the task of an element that reads outside raises an error.
    """
    cells = domain(a.df.sparkSession, extent)
    wanted = [c.cast("long") for c in source(*[F.col(c) for c in cells.index])]
    inside = F.lit(True)
    for c, n in zip(wanted, a.extent):
        inside = inside & F.coalesce((c >= 0) & (c < n), F.lit(False))
    place = F.concat_ws(", ", *[F.coalesce(c.cast("string"), F.lit("null")) for c in wanted])
    wrong = F.raise_error(F.concat(F.lit("backpermute: "), place, F.lit(f" is outside {a.extent}"))).cast("long")
    asked = cells.df.select(*cells.index, *[F.when(inside, c).otherwise(wrong).alias(f"_from{k}") for k, c in enumerate(wanted)])
    held = a.df.select(*[F.col(c).alias(f"_from{k}") for k, c in enumerate(a.index)], *a.values)
    keys = [f"_from{k}" for k in range(a.rank)]
    joined = asked.join(held, keys) if keys else asked.join(held, F.lit(True))
    return NDArray(joined.select(*cells.index, *a.values), extent)


def checked(a: NDArray) -> NDArray:
    """The array, after a job that makes sure that it is dense."""
    n = a.df.count()
    if n != a.size:
        raise IndexError(f"{a.size - n} of {a.size} elements are missing")
    return a


def reverse(a: NDArray, axis: int = -1) -> NDArray:
    axis %= a.rank
    index = [F.lit(n - 1) - F.col(c) if k == axis else F.col(c) for k, (c, n) in enumerate(zip(a.index, a.extent))]
    return _moved(a, a.extent, index)


def shift(a: NDArray, by: int, axis: int = -1) -> NDArray:
    """Rotate along an axis: out[i] = a[(i + by) mod n]."""
    axis %= a.rank
    index = [
        F.pmod(F.col(c) - by, F.lit(max(n, 1))) if k == axis else F.col(c) for k, (c, n) in enumerate(zip(a.index, a.extent))
    ]
    return _moved(a, a.extent, index)


def transpose(a: NDArray, order: tuple[int, ...] | None = None) -> NDArray:
    """Axis k of the result is axis order[k]; all axes reversed by default."""
    order = tuple(reversed(range(a.rank))) if order is None else order
    return _moved(a, tuple(a.extent[k] for k in order), [F.col(a.index[k]) for k in order])


def reshape(a: NDArray, extent: tuple[int, ...]) -> NDArray:
    """The same elements in row-major order under another shape of equal size."""
    if NDArray(a.df, extent).size != a.size:
        raise ValueError(f"cannot reshape {a.extent} to {extent}")
    return _moved(a, extent, from_linear(a.linear(), extent))


def slice_at(a: NDArray, **fixed: int) -> NDArray:
    """Fix axes, given by name, at one index each: slice_at(a, i1=3)."""
    left = [(c, n) for c, n in zip(a.index, a.extent) if c not in fixed]
    where = F.lit(True)
    for c, k in fixed.items():
        where = where & (F.col(c) == k)
    return _moved(a, tuple(n for _, n in left), [F.col(c) for c, _ in left], where)


def replicate(a: NDArray, **new: int) -> NDArray:
    """Add axes by repetition: replicate(a, i0=5) repeats a vector as the rows of a matrix.

    Names are those of the result's axes. The result is the product of the array with the range of the new axes. Both
    sizes are known, so the smaller side is broadcast if it has `BROADCAST` rows or fewer, and no task makes
    an element's copies alone.
    """
    rank = a.rank + len(new)
    names = axes(rank)
    old = iter(zip(a.index, a.extent))
    added = domain(a.df.sparkSession, tuple(new[name] for name in names if name in new))
    copies = added.df.select(*[F.col(c).alias(f"_new_{name}") for c, name in zip(added.index, [n for n in names if n in new])])
    if min(a.size, added.size) > BROADCAST:
        df = a.df.crossJoin(copies)
    else:
        df = copies.join(F.broadcast(a.df)) if a.size <= added.size else a.df.join(F.broadcast(copies))
    index, extent = [], []
    for name in names:
        if name in new:
            index.append(F.col(f"_new_{name}"))
            extent.append(new[name])
        else:
            c, n = next(old)
            index.append(F.col(c))
            extent.append(n)
    return NDArray(df.select(*[c.alias(n) for c, n in zip(index, names)], *a.values), tuple(extent))


def take(a: NDArray, n: int) -> NDArray:
    """The first n along the innermost axis."""
    n = max(0, min(n, a.extent[-1]))
    return _moved(a, (*a.extent[:-1], n), [F.col(c) for c in a.index], F.col(a.index[-1]) < n)


def drop(a: NDArray, n: int) -> NDArray:
    """All but the first n along the innermost axis."""
    n = max(0, min(n, a.extent[-1]))
    last = a.index[-1]
    index = [F.col(c) for c in a.index[:-1]] + [F.col(last) - n]
    return _moved(a, (*a.extent[:-1], a.extent[-1] - n), index, F.col(last) >= n)


def index(a: NDArray, *at: int) -> NDArray:
    """One element as a rank-0 array; the filter reaches the scan."""
    if not all(0 <= k < n for k, n in zip(at, a.extent)):
        raise IndexError(f"{at} is outside {a.extent}")
    where = F.lit(True)
    for c, k in zip(a.index, at):
        where = where & (F.col(c) == k)
    return NDArray(a.df.where(where).select(*a.values), ())
