"""A compiled function over a lazy sequence of arrays, local or micro-batched.

Inputs are independent: no state is carried from one to the next, and there is no event time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession

from ..array import NDArray


def stream(program: Callable[[NDArray], NDArray], inputs: Iterable[NDArray]) -> Iterator[list]:
    """The results of a program over arrays, one at a time and as they are asked for."""
    return (program(a).collect() for a in inputs)


def stream_files(
    spark: SparkSession, path: str, schema: str, program: Callable[[DataFrame, int], DataFrame], out: str, checkpoint: str,
    files_per_batch: int = 1,
) -> None:
    """Run a program over each micro-batch of the Parquet files at path, and append its rows to out.

    Structured Streaming keeps track of the files in the checkpoint folder: a restarted stream goes on
    where it stopped, and a repeated batch replaces its own output.
    """

    def write(batch: DataFrame, number: int) -> None:
        program(batch, number).write.mode("overwrite").parquet(f"{out}/batch={number}")

    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    query = source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
