"""Byte-balanced sharding of indivisible groups by Karmarkar-Karp differencing.

A partial partition is a vector of shard sums. Differencing takes the two partial partitions with the
largest spread and adds them oppositely ordered, largest to smallest, until one is left.

It runs in three steps, each of bounded tasks, whatever the number of groups and shards:
- Groups above a fair share of what is left, fewer than there are shards, get a shard each. Of the others, large
  ones are those above one part in `items` of the bytes, so fewer than that. One task differences them to one
  partial partition, which names the shards.
- Most others are hashed over buckets. A task differences a bucket's groups together with the bucket's equal
  part of that partial partition, so that smaller groups fill the gaps that the large ones leave.
- A bucket's shards then differ by a few bytes, and many buckets' by more. So some small groups, `items` of
  them by hash, have been held back: one task differences these onto the sum of all before, which closes what
  is left. With few groups all small ones are held back, and there is no bucket.

A group is never cut: rows with equal keys go to one shard. The driver holds some numbers for each shard.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, materialize

CELLS = 16_000_000  # numbers in the partial partitions that a task differences: groups times shards


def difference(sums: np.ndarray) -> np.ndarray:
    """For partial partitions (n, shards), the shard of each one's slots, by differencing.

    Ties go by position, so equal inputs give equal results.
    """
    n, shards = sums.shape
    order = np.argsort(sums, axis=1, kind="stable")  # slots by sum, smallest first
    ranked = np.take_along_axis(sums, order, axis=1)
    heap = [(int(r[0] - r[-1]), k) for k, r in enumerate(ranked)]
    heapq.heapify(heap)
    vectors = {k: r - r[0] for k, r in enumerate(ranked)}
    merges = []
    node = n
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        total = vectors.pop(a) + vectors.pop(b)[::-1]
        place = np.argsort(total, kind="stable")
        total = total[place]
        total -= total[0]
        vectors[node] = total
        merges.append((a, b, place))
        heapq.heappush(heap, (-int(total[-1]), node))
        node += 1
    # where each rank of a node ends up: the root's ranks are the shards, largest sum first
    at: dict[int, np.ndarray] = {node - 1: np.arange(shards)[::-1].copy()}
    for node in range(node - 1, n - 1, -1):
        a, b, place = merges[node - n]
        back = np.empty(shards, np.int64)
        back[place] = at.pop(node)
        at[a], at[b] = back, back[::-1]
    out = np.empty((n, shards), np.int64)
    for k in range(n):
        out[k, order[k]] = at[k]
    return out


def difference_items(sizes: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each single item."""
    if not len(sizes):
        return np.zeros(0, np.int64)
    sums = np.zeros((len(sizes), shards), np.int64)
    sums[:, 0] = sizes
    return difference(sums)[:, 0]


def difference_onto(sizes: np.ndarray, base: np.ndarray) -> np.ndarray:
    """The shard of each item, where the shards hold `base` already."""
    shards = len(base)
    sums = np.zeros((len(sizes) + 1, shards), np.int64)
    sums[:-1, 0] = sizes
    sums[-1] = base
    place = difference(sums)
    named = np.empty(shards, np.int64)
    named[place[-1]] = np.arange(shards)
    return named[place[:-1, 0]]


def balanced_shards(rows: DataFrame, shards: int, items: int | None = None) -> DataFrame:
    """rows (id, size, g1, g2) with a column shard; g1, g2 are the group's 128-bit key.

    items: groups that a task differences at most, 20,000 by default, fewer for more than 800 shards; it should be
    several times the shards, which holds for up to some 2,000 of them. Sizes are not negative.
    """
    items = items or max(200, min(20_000, CELLS // shards))
    units = materialize(rows.groupBy("g1", "g2").agg(F.sum("size").alias("bytes")), "units")
    left = units.agg(F.sum("bytes").alias("bytes")).first()["bytes"] or 0
    alone = []  # groups above the fair share of what is left: fewer than `shards`
    for r in units.orderBy(F.desc("bytes"), "g1", "g2").limit(shards).collect():
        if r["bytes"] * (shards - len(alone)) <= left:
            break
        left -= r["bytes"]
        alone.append((r["g1"], r["g2"], r["bytes"], len(alone)))
    rest = shards - len(alone)
    shared = units.where(F.col("bytes") < alone[-1][2]) if alone else units
    large = F.col("bytes") > F.lit(left // items)
    small = shared.where(~large)
    n = small.count()
    held = F.pmod(F.xxhash64("g1", "g2", F.lit("held")), F.lit(max(1, n))) < items  # all of them, up to `items`
    buckets = 1 + max(0, n - items) // items
    bucket = F.pmod(F.xxhash64("g1", "g2"), F.lit(buckets)).cast("int")

    def placed(chosen: DataFrame, number, parts: int, base: np.ndarray) -> DataFrame:
        """(g1, g2, bytes, shard) of the groups, differenced by their number below `parts` onto its part of base."""

        def task(batches):
            for own in runs_of(batches, 3):
                k = own.column(3)[0].as_py()
                # shards in an order of the bucket's own: what it leaves uneven is then not uneven alike in all
                order = np.random.default_rng(k).permutation(len(base))
                shard = order[difference_onto(own.column(2).to_numpy(), (base * (k + 1) // parts - base * k // parts)[order])] + first
                columns = [c.combine_chunks() for c in own.columns[:3]]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(shard.astype(np.int32))], names=["g1", "g2", "bytes", "shard"])

        dealt = chosen.select("g1", "g2", "bytes", number.alias("number")).repartition("number")
        dealt = dealt.sortWithinPartitions("number", F.desc("bytes"), "g1", "g2")
        return materialize(dealt.mapInArrow(task, "g1 long, g2 long, bytes long, shard int"), "placed")

    def sums(*steps: DataFrame) -> np.ndarray:
        out = np.zeros(rest, np.int64)
        for step in steps:
            for r in step.groupBy("shard").agg(F.sum("bytes").alias("bytes")).collect():  # `shards` rows
                out[r["shard"] - first] += r["bytes"]
        return out

    one, first = F.lit(0), len(alone)
    steps = [placed(shared.where(large), one, 1, sums())]
    if n > items:
        steps.append(placed(small.where(~held), bucket, buckets, sums(*steps)))
        steps.append(placed(small.where(held), one, 1, sums(*steps)))
    else:
        steps.append(placed(small, one, 1, sums(*steps)))
    located = rows.sparkSession.createDataFrame(alone, "g1 long, g2 long, bytes long, shard int").select("g1", "g2", "shard")
    for step in steps:
        located = located.union(step.select("g1", "g2", "shard"))
    discard(units)
    return rows.join(located, ["g1", "g2"])


def runs_of(batches, column: int):
    """Tables of consecutive rows with equal values in a column."""
    held, value = [], None
    for batch in batches:
        values = batch.column(column).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(values)) + 1).tolist(), len(values)]
        for start, stop in zip(cuts, cuts[1:]):
            if start == stop:
                continue
            if held and values[start] != value:
                yield pa.Table.from_batches(held)
                held = []
            value = values[start]
            held.append(batch.slice(start, stop - start))
    if held:
        yield pa.Table.from_batches(held)


def numbered(rows: DataFrame) -> DataFrame:
    """rows with a column slot: 0, 1, ... within each shard, over all tasks.

    Rows are counted within the tasks that hold them, without a shuffle; a task's counts then start where
    those of the tasks before it end. The starts are one number for each task and shard.
    """
    dealt = rows
    schema = T.StructType(dealt.schema.fields + [
        T.StructField("part", T.IntegerType()), T.StructField("local", T.LongType()),
    ])
    at = dealt.columns.index("shard")

    def task(batches):
        part, seen = TaskContext.get().partitionId(), np.zeros(0, np.int64)
        for batch in batches:
            shard = batch.column(at).to_numpy().astype(np.int64)
            if not len(shard):
                continue
            if shard.max() >= len(seen):
                seen = np.concatenate([seen, np.zeros(shard.max() + 1 - len(seen), np.int64)])
            by = np.argsort(shard, kind="stable")
            counts = np.bincount(shard, minlength=len(seen))
            first = np.cumsum(counts) - counts
            local = np.empty(len(shard), np.int64)
            local[by] = np.arange(len(shard)) - first[shard[by]] + seen[shard[by]]
            seen = seen + counts
            columns = [*batch.columns, pa.array(np.full(len(shard), part, np.int32)), pa.array(local)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    counted = materialize(dealt.mapInArrow(task, schema), "slots")
    sizes = counted.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("shard", "part", F.coalesce(before, F.lit(0)).alias("start"))
    joined = counted.join(starts, ["shard", "part"])  # one row for each task and shard
    return joined.withColumn("slot", F.col("start") + F.col("local")).drop("part", "local", "start")


def shard_documents(
    docs: DataFrame, shards: int, overhead: int = 16, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id_col, size, text_crc32, shard, slot) for every row of docs; equal texts are a group.

    size: the text's UTF-8 bytes plus overhead, however long it is. A null text counts as an empty one. Rows
    may share ids or have none. An empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + overhead).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("g1"),
        F.xxhash64(F.lit("group"), text).alias("g2"),
    )
    rows = materialize(rows, "sizes")
    placed = balanced_shards(rows, shards)
    out = numbered(placed.select("id", "size", "text_crc32", "shard").sortWithinPartitions("shard", "id", "text_crc32"))
    discard(rows)
    return out.withColumnRenamed("id", id_col)
