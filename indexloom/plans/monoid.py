"""Combine functions that Spark can aggregate partially."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

from ..functions import primitives as P


@dataclass(frozen=True)
class Monoid:
    """An associative, commutative combine function that is also a built-in aggregate."""

    name: str
    partial: Callable[[Column], Column]
    combine: Callable[[Column, Column], Column]
    finish: Callable[[Column], Column] = lambda x: x

    def aggregate(self, x: Column) -> Column:
        return self.finish(self.partial(x))

    def running(self, x: Column, frame: WindowSpec) -> Column:
        return self.finish(self.partial(x).over(frame))


def _number(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def _or_nan(x: Column) -> Column:
    return F.coalesce(x, F.lit(P.NAN))


SUM = Monoid("sum", F.sum, lambda a, b: a + b)
MIN = Monoid("min", F.min, F.least)
MAX = Monoid("max", F.max, F.greatest)
FMIN = Monoid("fmin", lambda x: F.min(_number(x)), P.fmin, _or_nan)
FMAX = Monoid("fmax", lambda x: F.max(_number(x)), P.fmax, _or_nan)
BAND = Monoid("band", F.bit_and, lambda a, b: a.bitwiseAND(b))
BOR = Monoid("bor", F.bit_or, lambda a, b: a.bitwiseOR(b))
BXOR = Monoid("bxor", F.bit_xor, lambda a, b: a.bitwiseXOR(b))
ALL = Monoid("all", F.bool_and, lambda a, b: a & b)
ANY = Monoid("any", F.bool_or, lambda a, b: a | b)
