"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.session import discard, written_bytes
from ..plans.session import shared_folder as shared_dir
from ..plans.session import written as materialize

__all__ = ["discard", "lower_ascii", "materialize", "shared_dir", "signed", "spread", "table", "tokenizer_path", "written_bytes"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table that is read from fewer files than there are cores, dealt evenly over the cores; others as they are.

    A file's row group is one task's, so that a few large ones would leave the other cores without work.
    """
    files, cores = len(df._jdf.inputFiles()), df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if files < cores else df


def tokenizer_path(name: str) -> str:
    """The place of a public tokenizer's file, the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def lower_ascii(col: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(col, UPPER, LOWER)


def signed(value: int) -> int:
    """The 64-bit two's complement reading of an unsigned value."""
    return value - (1 << 64) if value >= 1 << 63 else value
