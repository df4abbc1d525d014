"""Running array programs: at once, prepared, asynchronously."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor

from pyspark.sql import SparkSession

from ..array import NDArray

_pool = ThreadPoolExecutor(8)


def run(a: NDArray | tuple) -> list:
    """Evaluate an array, or a tuple of arrays, to local values."""
    return tuple(map(run, a)) if isinstance(a, tuple) else a.collect()


def run_with(spark: SparkSession, program: Callable[[SparkSession], NDArray]) -> list:
    """Evaluate a program on a session of one's choice."""
    return run(program(spark))


def run_n(program: Callable[..., NDArray]) -> Callable[..., list]:
    """A prepared program: a function of arrays to local values.

    The program builds the plan anew for its arguments; Spark keeps the compiled code of equal plans.
    """
    return lambda *args: run(program(*args))


class Running:
    """A result to come."""

    def __init__(self, spark: SparkSession, job: Callable[[], list]):
        self.spark, self.group = spark, f"indexloom-{uuid.uuid4().hex}"
        self.future: Future = _pool.submit(self._work, job)

    def _work(self, job):
        self.spark.sparkContext.setJobGroup(self.group, "asynchronous array program", interruptOnCancel=True)
        return job()

    def wait(self):
        return self.future.result()

    def poll(self):
        """The result, or None while it is not there."""
        return self.future.result() if self.future.done() else None

    def cancel(self) -> None:
        self.future.cancel()
        self.spark.sparkContext.cancelJobGroup(self.group)


def run_async(spark: SparkSession, a: NDArray | tuple) -> Running:
    return Running(spark, lambda: run(a))


def run_n_async(spark: SparkSession, program: Callable[..., NDArray]) -> Callable[..., Running]:
    return lambda *args: Running(spark, lambda: run(program(*args)))
