"""Session settings: what expressions mean, and where shared files go."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession


@contextmanager
def wrapping(spark: SparkSession):
    """Integers wrap around and casts truncate in the expressions of DataFrames built inside.

    Spark captures ANSI mode when a DataFrame is built, so the session's own mode is back afterwards.
    """
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


_own: dict[str, str] = {}
_written: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def create_target(cores: int | None = None, memory: str | None = None, name: str = "indexloom", **settings: str) -> SparkSession:
    """A session to run programs on: a local one of so many cores, or, without cores, the one that spark-submit describes.

    settings: further Spark settings, with underscores for dots.
    """
    builder = SparkSession.builder.appName(name)
    if cores is not None:
        builder = builder.master(f"local[{cores}]")
    if memory is not None:
        builder = builder.config("spark.driver.memory" if cores is not None else "spark.executor.memory", memory)
    for key, value in settings.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()


def written(df: DataFrame, label: str, **options: str) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage is cut, and it is computed once.

    A lost executor then costs the rerun of its tasks only.
    """
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    _written[table] = path
    return table


def _place(df: DataFrame, path: str):
    """The file system of a path, and the path, in Hadoop's terms."""
    place = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()), place


def discard(*tables: DataFrame) -> None:
    """Delete tables of `written` that nothing will read again: what came of them has been written.

    DataFrames of another origin are left alone.
    """
    for df in tables:
        if path := _written.pop(df, None):
            files, place = _place(df, path)
            files.delete(place, True)


def written_bytes(df: DataFrame) -> int | None:
    """The size of a table of `written`, from its files; None for other DataFrames."""
    if not (path := _written.get(df)):
        return None
    files, place = _place(df, path)
    return files.getContentSummary(place).getLength()


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share; a folder of its own on a local master."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if context.applicationId not in _own:
        _own[context.applicationId] = tempfile.mkdtemp(prefix="spark-")
    return "file://" + _own[context.applicationId]
