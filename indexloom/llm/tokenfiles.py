"""Token ids in Parquet list columns that allow selective reads of tokens and metadata.

Documents are range-partitioned and sorted by id, encoded, and written by Spark's Parquet writer: one
row a document with its id, its token count, its start within the file's task, and a list of ids. The
ids are dictionary-encoded (a vocabulary of some 50,000 fits one dictionary page, so an id takes 16 bits),
ids and starts are delta-encoded, row groups and pages are of a set size, and the page index lets a read
of some documents skip the other pages. A small manifest (task, tokens before it) gives global starts.

Encoding: a text is cut before each space that a non-space follows. The byte-level pre-tokenizer always
has a boundary there, so the parts can be encoded apart, and a worker keeps the ids of parts it has seen.
"""

from __future__ import annotations

import re
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import PLAIN, SHORT, byte_alphabet
from .common import shared_dir

# Unicode's White_Space characters
SPACES = "\t\n\x0b\x0c\r \x85\xa0                　"
CUT = re.compile(f" (?=[^{SPACES}])")
ASCII_RUNS = tuple(" " + c for c in SPACES if c.isascii())
ALL_RUNS = tuple(" " + c for c in SPACES)
# The byte-level pre-tokenizer's words; the first for ASCII alone
ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII)
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
KEPT = 400_000  # parts and words whose ids a worker keeps; others are encoded whenever they occur
GROUP = 1 << 20  # characters that are cut up at once

WRITER = {
    "compression": "zstd",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#local_start": "false",
    "parquet.enable.dictionary#n_tokens": "false",
}


def cut(text: str) -> list[str]:
    """The parts of a text; all but the first lack the space before them."""
    runs = ASCII_RUNS if text.isascii() else ALL_RUNS
    if text.endswith(" ") or any(run in text for run in runs):
        return CUT.split(text)
    return text.split(" ")


class Parts(dict):
    """The ids, as bytes, of a text's parts; `lead` is the space before them, or none."""

    def __init__(self, encoder: PartEncoder, lead: str):
        super().__init__()
        self.encoder, self.lead = encoder, lead

    def __missing__(self, part: str) -> bytes:
        ids = self.encoder.part(self.lead + part)
        if len(part) <= SHORT and len(self) < KEPT:
            self[part] = ids
        return ids


class PartEncoder:
    """Encodes texts as tokenizers does, without special tokens of its own.

    A part that is new is cut into the pre-tokenizer's words, and the library's model encodes each new
    word. Texts with special tokens, and parts with characters that Unicode's versions class
    differently, are left to the library as a whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = tuple(t.content for t in self.library.get_added_tokens_decoder().values())
        self.letters = byte_alphabet()
        self.first, self.rest = Parts(self, ""), Parts(self, " ")
        self.words: dict[str, bytes] = {}

    def part(self, part: str) -> bytes:
        if part.isascii():
            words = ASCII_WORDS.findall(part)
        elif PLAIN.fullmatch(part):
            words = WORDS.findall(part)
        else:
            ids = self.library.encode(part, add_special_tokens=False).ids
            return np.array(ids, np.int32).tobytes()
        return b"".join([self.words.get(w) or self.word(w) for w in words])

    def word(self, word: str) -> bytes:
        letters = self.letters
        tokens = self.library.model.tokenize("".join([letters[b] for b in word.encode()]))
        ids = array("i", [t.id for t in tokens]).tobytes()
        if len(word) <= SHORT and len(self.words) < KEPT:
            self.words[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """The ids of a text, as little-endian 32-bit integers."""
        if any(s in text for s in self.special):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.int32).tobytes()
        first, *rest = cut(text)
        return self.first[first] + b"".join(map(self.rest.__getitem__, rest))


@lru_cache(2)
def encoder(path: str) -> PartEncoder:
    return PartEncoder(path)


def grouped(texts):
    """Slices of rows with some GROUP characters together."""
    block, size = [], 0
    for text in texts:
        block.append(text)
        size += len(text)
        if size >= GROUP:
            yield block
            block, size = [], 0
    if block:
        yield block


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode docs in ascending id order, each text followed by end_id, into the files at path.

    A null text counts as empty. Rows that share an id follow each other by text; null ids come first.
    """

    def task(batches):
        encode = encoder(tokenizer).encode
        part, start, end = TaskContext.get().partitionId(), 0, np.int32(end_id).tobytes()
        for batch in batches:
            texts, at = [t or "" for t in batch.column(1).to_pylist()], 0
            for block in grouped(texts):
                ids = [encode(text) + end for text in block]
                counts = np.array([len(x) // 4 for x in ids], np.int64)
                offsets = np.concatenate([[0], np.cumsum(counts)])
                values = pa.array(np.frombuffer(b"".join(ids), np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(block)),
                        pa.array(np.full(len(block), part, np.int32)),
                        pa.array(start + offsets[:-1]),
                        pa.array(counts),
                        pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values),
                    ],
                    names=["doc_id", "part", "local_start", "n_tokens", "tokens"],
                )
                at += len(block)
                start += int(offsets[-1])

    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    ordered = slim.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    encoded = ordered.mapInArrow(task, f"doc_id {kind}, part int, local_start long, n_tokens long, tokens array<int>")
    encoded.write.options(**WRITER).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, tokens) of the files at path; start counts the ids of all documents before.

    Spark reads only the columns and, by the page index, the documents that a query asks for.
    """
    files = spark.read.parquet(path)
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    manifest = totals.select("part", F.coalesce(before, F.lit(0)).alias("base"))  # a row for each writing task
    return files.join(F.broadcast(manifest), "part").select(
        "doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "tokens"
    )


def token_digests(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of what read_tokens gives, from the lists themselves."""

    def task(batches):
        for batch in batches:
            lists = batch.column(2)
            values = lists.values.to_numpy().astype("<u4", copy=False)
            offsets = lists.offsets.to_pylist()
            spans = [values[a:b] for a, b in zip(offsets, offsets[1:])]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1),
                    pa.array([len(x) for x in spans], pa.int64()),
                    pa.array([zlib.crc32(x) for x in spans], pa.int64()),
                ],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    kind = tokens.schema["doc_id"].dataType.simpleString()
    slim = tokens.select("doc_id", "start", "tokens")
    return slim.mapInArrow(task, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def new_path(spark: SparkSession) -> str:
    import uuid

    return f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
