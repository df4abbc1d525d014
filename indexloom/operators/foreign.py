"""Foreign functions, with a pure fallback where they can't run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column

from ..array import NDArray


def foreign_acc(a: NDArray, native: Callable | None, fallback: Callable[[NDArray], NDArray], schema: str | None = None, extent: tuple[int, ...] | None = None) -> NDArray:
    """An array function in Arrow batches (an iterator of pandas frames to an iterator of them).

    Without a native function, or with one that can't run on the executors, the fallback runs: one task first
    tries it on a frame without rows, and an ImportError or NotImplementedError there decides.
    """
    if native is None or not _runs(a, native):
        return fallback(a)
    df = a.df.mapInPandas(native, schema or a.df.schema)
    return a.with_df(df, a.extent if extent is None else extent)


def _runs(a: NDArray, native: Callable) -> bool:
    empty = a.df.limit(0).toPandas()

    def attempt(frames):
        for frame in frames:
            try:
                for _ in native(iter([empty])):
                    pass
                yield frame
            except (ImportError, NotImplementedError):
                pass

    return a.df.sparkSession.range(1, numPartitions=1).mapInPandas(attempt, "id long").count() == 1


def foreign_exp(native: Callable[[], Callable] | None, fallback: Callable[..., Column]) -> Callable[..., Column]:
    """A scalar function: what `native` makes, such as a pandas UDF, or the fallback if it can't."""
    if native is None:
        return fallback
    try:
        return native()
    except (ImportError, NotImplementedError):
        return fallback
