"""Control flow over whole arrays."""

from __future__ import annotations

from collections.abc import Callable

from ..array import NDArray
from ..plans.session import discard, written


def alet(bound: NDArray, body: Callable[[NDArray], NDArray], shared: bool = False) -> NDArray:
    """body(bound); with `shared` the bound array is kept for the jobs of several uses."""
    if shared:
        bound = bound.with_df(bound.df.persist())
    return body(bound)


def acond(predicate: NDArray, then: Callable[[], NDArray], otherwise: Callable[[], NDArray]) -> NDArray:
    """One of two arrays by a rank-0 boolean, which is read first; only that branch is planned."""
    return then() if predicate.collect()[0] else otherwise()


def awhile(
    running: Callable[[NDArray], NDArray], step: Callable[[NDArray], NDArray], start: NDArray
) -> NDArray:
    """Apply step while the rank-0 boolean running(state) holds; zero rounds are allowed.

    Each round's state is written to the folder all executors share, which cuts the lineage, and the state before
    it is deleted: the predicate and the next round read it instead of computing it anew.
    """
    state, before = start, None
    while running(state).collect()[0]:
        state = step(state)
        state = state.with_df(written(state.df, "state"))
        if before is not None:
            discard(before)
        before = state.df
    return state


def atrace(a: NDArray, traced: NDArray, tell: Callable[[str], None] = print, name: str = "trace", most: int = 1000) -> NDArray:
    """The array unchanged; the traced array's elements are told first, in order, or its first `most` and its extent."""
    first = traced.df.orderBy(*traced.index).limit(most) if traced.rank else traced.df
    rows = [tuple(r) if len(r) > 1 else r[0] for r in first.select(*traced.values).collect()]
    tell(f"{name}: {rows}" + (f" ... of {traced.extent}" if traced.size > most else ""))
    return a
