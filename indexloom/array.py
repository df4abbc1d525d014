"""The data model: a dense n-dimensional array is a relation from its index to its element."""

from __future__ import annotations

from dataclasses import dataclass
from math import prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class NDArray:
    """A lazy, immutable, dense array.

    df has a long column for each axis, i0 (outermost) to i{rank-1}, and a column for each component of
    the element. `extent` is the shape; it is static, so that empty axes are known without a job. A rank-0
    array has one row and no index.
    """

    df: DataFrame
    extent: tuple[int, ...]

    @property
    def rank(self) -> int:
        return len(self.extent)

    @property
    def size(self) -> int:
        """The number of elements: 1 for rank 0."""
        return prod(self.extent)

    @property
    def index(self) -> list[str]:
        return axes(self.rank)

    @property
    def values(self) -> list[str]:
        return [c for c in self.df.columns if c not in self.index]

    def with_df(self, df: DataFrame, extent: tuple[int, ...] | None = None) -> NDArray:
        return NDArray(df, self.extent if extent is None else extent)

    def collect(self) -> list[tuple]:
        """The elements in row-major order, for arrays that fit the driver."""
        df = self.df.orderBy(*self.index) if self.rank else self.df
        rows = df.select(*self.values).collect()
        return [tuple(r) if len(r) > 1 else r[0] for r in rows]

    def linear(self) -> Column:
        """The row-major position of each row."""
        return to_linear([F.col(c) for c in self.index], self.extent)


def axes(rank: int) -> list[str]:
    return [f"i{k}" for k in range(rank)]


def to_linear(index: list[Column], extent: tuple[int, ...]) -> Column:
    at = F.lit(0).cast("long")
    for i, n in zip(index, extent):
        at = at * F.lit(n).cast("long") + i
    return at


def from_linear(at: Column, extent: tuple[int, ...]) -> list[Column]:
    """The index of a row-major position; the outermost axis isn't reduced modulo its extent."""
    out = []
    for n in reversed(extent[1:]):
        n = F.lit(max(n, 1)).cast("long")
        out.append(F.pmod(at, n))
        at = _quotient(at, n)
    return [*([at] if extent else []), *reversed(out)]


def _quotient(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)
