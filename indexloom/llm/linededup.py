"""Exact line deduplication across documents, by range-partitioned line hashes.

A line's key is the line without ASCII white space at its ends and with A-Z lower-cased. Keys of
`min_chars` code points or more that occur in `min_docs` documents or more lose all their lines
but those of the largest id that holds them.

A row is a document's key with the positions of its lines. Rows are range-partitioned by hash and id, so a line
that a third of all documents share is spread over many tasks, and sorted by hash, id (largest first) and
first position. A task streams its runs of equal hashes in Arrow batches, without a loop over rows: a run's
first id is the one that stays, and from the `min_docs`-th id on all is settled. Ids two to `min_docs` - 1 depend on
the run's end. Where a batch or the task ends first, they are left open, and settled by a join with the runs'
totals: a few rows for each batch, and nothing is held.

The result is a compressed bitmap of the lines to keep for every document that loses some, not text. Ids may be of
any type that can be sorted. A very long text is one row of each step, and its lines are only held by the task that
splits it.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, signed, written_bytes

SEED = 42  # of Spark's xxhash64, so that both sides hash a text alike
DROP, OPEN, TOTAL = 0, 1, 2
HASHED = 32 << 20  # bytes of a join's smaller side for each of its tasks that are hashed rather than sorted


def line_key(line: bytes) -> bytes:
    return line.strip().lower()


def line_keys(text: bytes, min_chars: int) -> tuple[int, dict[bytes, list[int]]]:
    """The number of lines, and the positions of each key that is long enough, by its 128-bit hash."""
    lines, found = text.split(b"\n"), {}
    for pos, line in enumerate(lines):
        if len(line) >= min_chars:
            key = line_key(line)
            if len(key) >= min_chars and (key.isascii() or len(key.decode()) >= min_chars):
                found.setdefault(xxhash.xxh3_128_digest(key), []).append(pos)
    return len(lines), found


def line_hashes(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(id, text_hash, n_lines, h1, h2, at) of every document's keys; at: the lines' positions, in order."""

    def task(batches):
        for batch in batches:
            rows, docs_of, hashes, sizes, keys, sums, places = [], [], [], [], [], [], []
            for row, text in enumerate(batch.column(1).cast(pa.binary())):
                text = text.as_py()
                if text is None or not batch.column(0)[row].is_valid:
                    continue
                n, found = line_keys(text, min_chars)
                if found:
                    text_hash = signed(xxhash.xxh64_intdigest(text, SEED))
                    docs_of += [row] * len(found)
                    hashes += [text_hash] * len(found)
                    sizes += [n] * len(found)
                    keys += found
                    sums += map(len, found.values())
                    for at in found.values():
                        places += at
            if docs_of:
                halves = np.frombuffer(b"".join(keys), ">i8").astype(np.int64).reshape(-1, 2)
                offsets = np.concatenate([[0], np.cumsum(sums)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(places, pa.int32()))
                columns = [
                    batch.column(0).take(pa.array(docs_of)), pa.array(hashes, pa.int64()), pa.array(sizes, pa.int32()),
                    pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy()), lists,
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "text_hash", "n_lines", "h1", "h2", "at"])

    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(task, f"id {kind}, text_hash long, n_lines int, h1 long, h2 long, at array<int>")


def stream_runs(batches, min_docs: int):
    """Mark one task's rows (id, text_hash, n_lines, h1, h2, at), sorted by hash, id descending and position.

    Yields record batches of those columns, mark and docs. DROP: lines that go. OPEN: lines of a run that a batch
    or other tasks cut, which go if its documents are enough and their id is not its first. TOTAL: a row with
    an open run's first id, and in docs its number of ids in this task.
    """
    prior = first = None  # the row before, and the first row of its run
    rank, task_first = 0, True  # its id's place in the run; whether the run is the task's first

    def marked(rows: pa.RecordBatch, marks: np.ndarray, docs: np.ndarray) -> pa.RecordBatch:
        columns = [pa.array(marks.astype(np.int32)), *rows.columns, pa.array(docs.astype(np.int32))]
        return pa.RecordBatch.from_arrays(columns, names=["mark", *rows.schema.names, "docs"])

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        both = batch if prior is None else pa.concat_batches([prior, batch])
        h1, h2, ids = both.column(3).to_numpy(), both.column(4).to_numpy(), both.column(0)
        same = pc.equal(ids.slice(1), ids.slice(0, len(ids) - 1)).to_numpy(zero_copy_only=False).astype(bool)
        fresh = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        if prior is None:
            fresh, same = np.concatenate([[True], fresh]), np.concatenate([[False], same])
        docs, run, starts = np.cumsum(fresh | ~same), np.cumsum(fresh), np.flatnonzero(fresh)
        # run 0 goes on from the batch before; a place counts ids from 1 within a run
        place = docs - np.concatenate([[-rank], docs[starts] - 1])[run]
        tops = np.append(np.where(starts > 0, place[starts - 1], rank), place[-1])  # each run's ids by the end of the batch
        last = len(starts)
        enough = (tops >= min_docs)[run]
        cut = (run == 0) | (run == last)  # runs that a batch cuts
        if prior is None:
            cut |= run == 1
        mark = np.where(enough & (place > 1), DROP, np.where(cut & (place > 1), OPEN, -1))
        if task_first:
            mark[(place == 1) & (run == (prior is None))] = OPEN
        if len(rows := np.flatnonzero(mark >= 0)):
            yield marked(batch.take(pa.array(rows)), mark[rows], np.zeros(len(rows)))
        if last and prior is not None:  # run 0 has ended
            yield marked(first, np.array([TOTAL]), tops[:1])
        if prior is None and last > 1:
            yield marked(batch.slice(0, 1), np.array([TOTAL]), tops[1:2])
        if last:
            task_first = prior is None and last == 1
            first = batch.slice(int(starts[-1]), 1)
        prior, rank = batch.slice(n - 1), int(place[-1])
    if prior is not None:
        yield marked(first, np.array([TOTAL]), np.array([rank]))


def line_bitmaps(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5
) -> DataFrame:
    """(id_col, text_hash, n_lines, n_dropped, keep) for every document that loses lines.

    keep: a bit for each line, first line first, set if the line stays; zlib-compressed.
    text_hash (XXH64 of the text) tells rows apart that share an id; they count as one document.
    Rows whose id or text is null hold no keys and lose nothing. An empty table gives no rows.
    """
    hashed = materialize(line_hashes(docs, id_col, text_col, min_chars), "lines")
    kind = hashed.schema["id"].dataType.simpleString()
    first_place = F.col("at")[0]
    ranged = hashed.repartitionByRange("h1", "h2", F.desc("id")).sortWithinPartitions("h1", "h2", F.desc("id"), first_place)
    fields = f"mark int, id {kind}, text_hash long, n_lines int, h1 long, h2 long, at array<int>, docs int"
    marks = materialize(ranged.mapInArrow(lambda batches: stream_runs(batches, min_docs), fields), "marks")
    totals = marks.where(F.col("mark") == TOTAL).groupBy("h1", "h2").agg(F.sum("docs").alias("docs"), F.max("id").alias("first"))
    settled = marks.where(F.col("mark") == OPEN).join(totals.where(F.col("docs") >= min_docs).drop("docs"), ["h1", "h2"])
    slim = ["id", "text_hash", "n_lines", "at"]
    dropped = marks.where(F.col("mark") == DROP).select(slim).union(settled.where("id < first").select(slim))
    lists = dropped.groupBy("id", "text_hash", "n_lines").agg(F.flatten(F.collect_set("at")).alias("pos"))

    def pack(batches):
        for batch in batches:
            out = []
            for n, pos in zip(batch.column(2).to_pylist(), batch.column(3)):
                keep = np.ones(n, bool)
                keep[pos.values.to_numpy()] = False
                out.append(zlib.compress(np.packbits(keep).tobytes()))
            sizes = pa.array([len(p) for p in batch.column(3)], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], sizes, pa.array(out, pa.binary())],
                names=["id", "text_hash", "n_lines", "n_dropped", "keep"],
            )

    bitmaps = lists.mapInArrow(pack, f"id {kind}, text_hash long, n_lines int, n_dropped int, keep binary")
    bitmaps = materialize(bitmaps.withColumnRenamed("id", id_col), "bitmaps")
    discard(hashed, marks)
    return bitmaps


def drop_lines(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the dropped lines gone from text_col, and n_lines (before) and n_dropped, as long.

    A null text becomes an empty one: one empty line. The two replace columns of those names. Texts go to their
    bitmaps by a join on id and text; bitmaps that fit a task's memory are hashed, so that texts are not sorted.
    """
    docs = docs.drop("n_lines", "n_dropped")
    marked = docs.withColumn("_loom_hash", F.xxhash64(text_col))
    keep = bitmaps.select(
        F.col(id_col).alias("_loom_id"), F.col("text_hash").alias("_loom_of"), F.col("keep").alias("_loom_keep")
    )
    size = written_bytes(bitmaps)
    if size is not None and size <= HASHED * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        keep = keep.hint("shuffle_hash")
    same = (marked[id_col] == keep["_loom_id"]) & (marked["_loom_hash"] == keep["_loom_of"])
    joined = marked.join(keep, same, "left").select(*[F.col(f"`{c}`") for c in docs.columns], "_loom_keep")
    at, bits = docs.columns.index(text_col), len(docs.columns)
    shape = joined.drop("_loom_keep").schema.add("n_lines", "long").add("n_dropped", "long")

    def task(batches):
        for batch in batches:
            texts, total, gone = [], [], []
            for text, keep in zip(batch.column(at).cast(pa.binary()), batch.column(bits)):
                text, keep = text.as_py() or b"", keep.as_py()
                if keep is None:
                    total.append(text.count(b"\n") + 1)
                    gone.append(0)
                else:
                    lines = text.split(b"\n")
                    mask = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(lines))
                    text = b"\n".join([x for x, m in zip(lines, mask.tolist()) if m])
                    total.append(len(lines))
                    gone.append(len(lines) - int(mask.sum()))
                texts.append(text)
            columns = list(batch.columns[:bits])
            columns[at] = pa.array(texts, pa.binary()).cast(pa.string())
            columns += [pa.array(total, pa.int64()), pa.array(gone, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=shape.names)

    return joined.mapInArrow(task, shape)


SQL = r"""
WITH lines AS (
  SELECT doc_id, text, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
common AS (
  SELECT key, max(doc_id) AS holder FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT k.*, c.key IS NOT NULL AND k.doc_id <> c.holder AS gone
  FROM keyed k LEFT JOIN common c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
