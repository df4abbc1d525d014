"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints: 64 bits; a bit is set if it is set in over half of the XXH64 hashes (seed 42) of the
document's word shingles. Two fingerprints link at `radius` differing bits or fewer.

Covering tables: bit i carries the vector m(i) = 1 + i mod (2^(r+1) - 1) of GF(2)^(r+1); table v
(any non-zero vector) keeps the bits with <m(i), v> = 1. At most r differing bits span a space of
dimension r, so some v is orthogonal to all of them and the pair meets in table v: no pair within
the radius is missed, and for r = 2 there are 7 tables of 36 or 37 bits. For r = 6, m(i) = 64 + i: all
tables have 32 bits, but for one of 64, which only equal fingerprints share and which is left out.

Large buckets: comparing all pairs of a bucket is quadratic. Beyond `pair_limit` members a bucket
is linked through centres instead, which is exact for radius 2: two fingerprints are within two
bits just if they have a common neighbour at one bit or less, so each member meets the others at
its own value with any one free bit flipped (at most 28 + 1 values), and those that meet at one
value (28 + 1 at most) are linked to the smallest of them.

Near copies (`keep_one`): the contract asks for five-word shingles and a similarity of 0.8. A pair's
fingerprints of those differ in some ten bits, beyond any selective covering. So documents are found by
the fingerprint of their words, each weighted by the root of its count: it differs in three bits on average,
and few such pairs differ in more than six, if their fingerprints of five-word shingles agree roughly too.
The first few tables are settled before the others, whose rows then carry their group: what is in one group
already is neither compared nor linked again, so that a large group costs about one link for each member.
These groups are candidates. Within each, texts link if their similarity is 0.8 or more by a sketch of 1,024
bits and the number of shingles: 16 further fingerprints, each of the hashes mixed anew. The angle between two
sketches gives the shared shingles, with a standard error of 0.024 in the similarity at 0.8.

Texts of any length are hashed in chunks; nulls, repeats and empty tables are told by each function.
"""

from __future__ import annotations

from collections import Counter
from itertools import accumulate
from math import isqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, signed
from .components import connected_components

BITS = 64
SEED = 42
CHUNK = 1 << 15
FIRST_TABLES = 6  # of a wide covering, settled before the others
LANES = 16  # of a sketch, 64 bits each
COSINES = np.cos(np.pi * np.arange(BITS * LANES + 1) / (BITS * LANES))  # by the differing bits of two sketches


def shingle_hashes(text: bytes, width: int):
    """XXH64 of every word shingle of one text: words end at ASCII white space, A-Z count as a-z."""
    words = text.lower().split()
    digest = xxhash.xxh64_intdigest
    if not words:
        return iter(()), 0
    if len(words) < width:
        return iter((digest(b" ".join(words), SEED),)), 1
    line = b" ".join(words)
    starts = list(accumulate(map(len, words), lambda at, n: at + n + 1, initial=0))
    ends = starts[width:]
    return (digest(line[s : e - 1], SEED) for s, e in zip(starts, ends)), len(ends)


def _majority(hashes, n: int, weights: np.ndarray | None = None) -> int:
    """The bits set in over half of n hashes (an iterator or an array), or of their weights, as an unsigned number."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, CHUNK):
        held = isinstance(hashes, np.ndarray)
        part = hashes[at : at + CHUNK] if held else np.fromiter(hashes, np.uint64, min(CHUNK, n - at))
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint32) if weights is None else weights[at : at + CHUNK] @ bits
    whole = n if weights is None else int(weights.sum())
    return int(np.packbits(2 * ones > whole, bitorder="little").view("<u8")[0])


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """The SimHash of one text, unsigned; 0 without words."""
    hashes, n = shingle_hashes(text or b"", width)
    return _majority(hashes, n) if n else 0


def set_fingerprint(different: np.ndarray) -> int:
    """The SimHash of a text's different shingles, each of which counts once."""
    return _majority(different, len(different)) if len(different) else 0


def mixed(hashes: np.ndarray, lane: int) -> np.ndarray:
    """Other hashes of the same things, by the finaliser of SplitMix64."""
    x = hashes + np.uint64(lane * 0x9E3779B97F4A7C15 % (1 << BITS))
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def sketch(different: np.ndarray) -> bytes:
    """LANES fingerprints of a set of hashes, in little-endian order."""
    return b"".join(set_fingerprint(mixed(different, lane)).to_bytes(8, "little") for lane in range(1, LANES + 1))


def copy_prints(text: bytes | None, width: int) -> tuple[int, int, int, bytes]:
    """What `keep_one` compares of a text: its words' fingerprint, and fingerprint, number and sketch of its different shingles."""
    different = np.fromiter(set(shingle_hashes(text or b"", width)[0]), np.uint64)
    return signed(word_fingerprint(text)), signed(set_fingerprint(different)), len(different), sketch(different)


def word_fingerprint(text: bytes | None) -> int:
    """The SimHash of a text's words, each weighted by the square root of its count, in quarters."""
    counts = Counter((text or b"").lower().split())
    weights = np.fromiter((isqrt(16 * n) for n in counts.values()), np.int64, len(counts))
    hashes = (xxhash.xxh64_intdigest(w, SEED) for w in counts)
    return _majority(hashes, len(counts), weights) if counts else 0


def _printed(docs: DataFrame, carried: dict[str, Column], text_col: str, fields: str, function) -> DataFrame:
    """The carried columns, and what the function makes of the text (a tuple of `fields`), for every row."""
    slim = docs.select(*[c.alias(n) for n, c in carried.items()], F.col(text_col).alias("_text"))
    shape, at = slim.drop("_text").schema, len(carried)
    for field in fields.split(", "):
        shape = shape.add(*field.split())
    types = [pa.binary() if f.endswith("binary") else pa.int64() for f in fields.split(", ")]
    names = shape.names

    def task(batches):
        for batch in batches:
            found = [function(t.as_py()) for t in batch.column(at).cast(pa.binary())]
            made = [pa.array([f[k] for f in found], kind) for k, kind in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], *made], names=names)

    return slim.mapInArrow(task, shape)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id_col, fp long) for every row; a null text has no words."""
    printed = _printed(docs, {"id": F.col(id_col)}, text_col, "fp long", lambda text: (signed(fingerprint(text, width)),))
    return printed.withColumnRenamed("id", id_col)


def ninth_power(x: int) -> int:
    """x^9 in GF(64) over t^6 + t + 1, as a number below 8: three bits tell the eight values apart."""

    def times(a: int, b: int) -> int:
        out = 0
        for k in range(6):
            out ^= a << k if b >> k & 1 else 0
        for k in range(10, 5, -1):
            out ^= 0b1000011 << (k - 6) if out >> k & 1 else 0
        return out

    y = x
    for _ in range(3):
        y = times(y, y)
    y = times(y, x)
    return y & 3 | (y >> 3 & 1) << 2


def covering_masks(radius: int = 2) -> list[int]:
    """The bit mask of each table, by the rules above; beyond six bits m(i) also has a part of i^9."""
    if not 0 <= radius <= 9:
        raise ValueError("a covering of 64 bits has a radius of 0 to 9 here")
    vectors, more = (1 << (radius + 1)) - 1, max(0, radius - 6)
    if radius < 6:
        dealt = [1 + i % vectors for i in range(BITS)]
    else:
        dealt = [(64 + i) << more | ninth_power(i) & ((1 << more) - 1) for i in range(BITS)]
    masks = [sum(1 << i for i, m in enumerate(dealt) if (m & v).bit_count() % 2) for v in range(1, vectors + 1)]
    return [m for m in masks if m != (1 << BITS) - 1 or radius == 0]


def near_links(nodes: DataFrame, pair_limit: int = 64) -> DataFrame:
    """Links (a, b) between the nodes (fp, rep) whose fingerprints differ in two bits or fewer.

    nodes has each fp once. The links connect exactly the pairs' components; pairs of large
    buckets are replaced by links to a common centre's smallest member.
    """
    masks = covering_masks(2)
    tables = F.array(*[
        F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key"))
        for t, m in enumerate(masks)
    ])
    rows = nodes.select("fp", "rep", F.explode(tables).alias("s")).select("fp", "rep", "s.t", "s.key")
    sizes = rows.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = materialize(rows.join(sizes, ["t", "key"]), "buckets")

    small = shared.where(F.col("n") <= pair_limit)
    left = small.select("t", "key", F.col("fp").alias("fp_a"), F.col("rep").alias("a"))
    right = small.select("t", "key", F.col("fp").alias("fp_b"), F.col("rep").alias("b"))
    close = (F.col("a") < F.col("b")) & (F.bit_count(F.col("fp_a").bitwiseXOR(F.col("fp_b"))) <= 2)
    pairs = left.join(right, ["t", "key"]).where(close).select("a", "b")

    free = F.array(*[
        F.array(F.lit(0).cast("long"), *[F.lit(signed(1 << i)) for i in range(BITS) if not m >> i & 1])
        for m in masks
    ])
    large = shared.where(F.col("n") > pair_limit).repartition("fp")
    centres = large.select(
        "t", "rep", "fp", F.explode(F.element_at(free, F.col("t") + 1)).alias("flip")
    ).select("t", "rep", F.col("fp").bitwiseXOR(F.col("flip")).alias("centre"))
    met = centres.groupBy("t", "centre").agg(F.collect_set("rep").alias("met")).where(F.size("met") > 1)
    stars = met.select(F.array_min("met").alias("a"), F.explode("met").alias("b")).where("a != b")
    return pairs.union(stars)


def wide_links(
    nodes: DataFrame, radius: int, apart: int = BITS, tables: slice = slice(None), pair_limit: int = 20_000
) -> DataFrame:
    """Links (a, b) between the groups of nodes (group, fp, check) that are near each other.

    Near: fp differs in at most `radius` bits (up to 9) and check in at most `apart`. Of the covering, only
    `tables` are taken. Members of one bucket meet in one task, sorted, and are compared there; of the links
    those that join two groups are kept, fewer than the members. A bucket above `pair_limit` is cut into
    blocks by hash, and each pair of blocks is a task's: every pair is still compared, in bounded memory.
    """
    masks = covering_masks(radius)[tables]
    array = F.array(*[F.lit(signed(m)) for m in masks])

    def task(batches):
        for key, rows, whole in buckets(batches, pair_limit):
            if whole:
                found = forest(rows, radius, apart)
                columns, n = [found[:, 0], found[:, 1], None, None, None], len(found)
            else:
                columns, n = [rows[:, 0], None, rows[:, 1], rows[:, 2], np.full(len(rows), key)], len(rows)
            if n:
                arrays = [pa.nulls(n, pa.int64()) if c is None else pa.array(np.ascontiguousarray(c)) for c in columns]
                yield pa.RecordBatch.from_arrays(arrays, names=["a", "b", "fp", "check", "key"])

    fields = "a long, b long, fp long, check long, key long"
    # the rows that are dealt do not carry their key: those of one fp for a task differ in the table alone
    cells = nodes.select("group", "fp", "check", F.explode(F.sequence(F.lit(1), F.lit(len(masks)))).alias("t"))
    key = F.xxhash64("t", F.col("fp").bitwiseAND(F.element_at(array, F.col("t"))))
    dealt = cells.repartition(key).select(key.alias("key"), "group", "fp", "check").sortWithinPartitions("key")
    done = materialize(dealt.mapInArrow(task, fields), "links")
    links = done.where("key is null").select("a", "b")
    large = done.where("key is not null").select(F.col("a").alias("group"), "fp", "check", "key")
    if large.isEmpty():
        return links
    parts = large.groupBy("key").agg(F.ceil(F.count("*") / pair_limit).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("group", "fp", "check"), F.col("parts")).cast("int")
    paired = large.join(parts, "key").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    meet = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    paired = paired.repartition(meet).select(meet.alias("key"), "group", "fp", "check").sortWithinPartitions("key")

    def block_task(batches):
        for _, rows, _ in buckets(batches, None):  # two blocks: some 2 * pair_limit rows
            if len(found := forest(rows, radius, apart)):
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0].copy()), pa.array(found[:, 1].copy())], names=["a", "b"])

    return links.union(materialize(paired.mapInArrow(block_task, "a long, b long"), "links"))


def buckets(batches, most: int | None):
    """(key, rows, whole) of each key with two rows or more, from batches sorted by their first column.

    rows: the other columns as a matrix of longs. A key with more than `most` rows comes in pieces, not whole.
    """
    key, held, size = None, [], 0

    def closed():
        if held and size > 1:
            yield key, np.concatenate(held), most is None or size <= most

    for batch in batches:
        keys = batch.column(0).to_numpy()
        if not len(keys):
            continue
        rows = np.column_stack([c.to_numpy() for c in batch.columns[1:]])
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        ends = np.append(starts[1:], len(keys))
        first = 0
        if key is not None and keys[0] == key:
            first = 1
            held.append(rows[: ends[0]])
            size += int(ends[0])
            if most is not None and size > most:
                yield key, np.concatenate(held), False
                held = []
            if len(starts) == 1:
                continue
        yield from closed()
        for k in (np.flatnonzero((ends - starts)[first:-1] > 1) + first).tolist():
            yield int(keys[starts[k]]), rows[starts[k] : ends[k]], most is None or ends[k] - starts[k] <= most
        key, held, size = int(keys[-1]), [rows[starts[-1] :]], len(keys) - int(starts[-1])
    yield from closed()


def forest(rows: np.ndarray, radius: int, apart: int) -> np.ndarray:
    """Pairs of groups that connect what all near pairs of rows (group, fp, check) connect."""
    group, fp, check = (np.ascontiguousarray(c) for c in rows.T)
    out: list[tuple[int, int]] = []
    if (group == group[0]).all():
        return np.zeros((0, 2), np.int64)
    root = np.unique(group, return_inverse=True)[1]
    for k in range(1, len(group)):
        near = np.bitwise_count((fp[:k] ^ fp[k]).view(np.uint64)) <= radius
        near &= np.bitwise_count((check[:k] ^ check[k]).view(np.uint64)) <= apart
        near &= root[:k] != root[k]
        found = np.flatnonzero(near)
        if len(found):
            joined, first = np.unique(root[found], return_index=True)
            out += [(int(group[found[f]]), int(group[k])) for f in first.tolist()]
            root[np.isin(root, joined)] = root[k]
    return np.array(out, np.int64).reshape(-1, 2)


def near_groups(nodes: DataFrame, radius: int, apart: int = BITS, pair_limit: int = 20_000) -> DataFrame:
    """(node, fp, check, group) of nodes (node, fp, check): the components over near pairs, named by one of their nodes."""
    current = nodes.select("node", "fp", "check", F.col("node").alias("group"))
    rounds = [slice(FIRST_TABLES), slice(FIRST_TABLES, None)] if len(covering_masks(radius)) > FIRST_TABLES else [slice(None)]
    for tables in rounds:
        found = connected_components(wide_links(current, radius, apart, tables, pair_limit))
        moved = current.join(found.select(F.col("node").alias("group"), "root"), "group", "left")
        before, current = current, materialize(
            moved.select("node", "fp", "check", F.coalesce("root", "group").alias("group")), "groups"
        )
        discard(before, found)
    return current


def similar_links(members: DataFrame, least: float, pair_limit: int = 20_000) -> DataFrame:
    """Links (a, b) between the nodes of members (node, size, sketch, group) that are similar and of one group.

    Similar: the estimate of the similarity of their shingles is `least` or more. The links connect what all such
    pairs connect. A group above `pair_limit` is cut into blocks by hash, and each pair of blocks is a task's.
    """
    parts = members.groupBy("group").agg(F.count("*").alias("n")).where("n > 1")
    parts = parts.select("group", F.ceil(F.col("n") / pair_limit).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    paired = members.join(parts, "group").withColumn("own", own)
    paired = paired.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    meet = F.xxhash64("group", F.least("own", "other"), F.greatest("own", "other"))
    dealt = paired.repartition(meet).select(meet.alias("key"), "node", "size", "sketch").sortWithinPartitions("key")

    def unpacked(batches):
        for batch in batches:
            bits = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.int64).reshape(-1, LANES)
            lanes = [pa.array(bits[:, k].copy()) for k in range(LANES)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *lanes], names=[str(k) for k in range(3 + LANES)])

    def task(batches):
        for _, rows, _ in buckets(unpacked(batches), None):  # two blocks: some 2 * pair_limit rows
            if len(found := similar_forest(rows, least)):
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0].copy()), pa.array(found[:, 1].copy())], names=["a", "b"])

    return dealt.mapInArrow(task, "a long, b long")


def estimated(differing, size_a, size_b):
    """The Jaccard similarity of two sets, by the differing bits of their sketches and their sizes."""
    both = COSINES[differing] * np.sqrt(size_a * size_b)
    return both / np.maximum(size_a + size_b - both, 1e-9)


def similar_forest(rows: np.ndarray, least: float) -> np.ndarray:
    """Pairs of nodes that connect what all similar pairs of rows (node, size, sketch's lanes) connect.

    A row meets one member of each component first; only the components that it has not joined by that are
    searched whole, so that a large component of close copies is not compared pair by pair.
    """
    node, size, bits = rows[:, 0], rows[:, 1].astype(np.float64), np.ascontiguousarray(rows[:, 2:]).view(np.uint64)
    head = np.arange(len(rows))  # of each row's component, its first member
    own = head.copy()
    out: list[tuple[int, int]] = []

    def near(k: int, at: np.ndarray) -> np.ndarray:
        differing = np.bitwise_count(bits[at] ^ bits[k]).sum(axis=1, dtype=np.int64)
        return at[estimated(differing, size[at], size[k]) >= least]

    for k in range(1, len(rows)):
        first = head[:k] == own[:k]
        joined = np.zeros(k, bool)
        met = near(k, np.flatnonzero(first))
        joined[met] = True
        more = near(k, np.flatnonzero(~first & ~joined[head[:k]]))
        heads, at = np.unique(head[more], return_index=True)
        joined[heads] = True
        ends = np.concatenate([met, more[at]])
        if len(ends):
            out += [(int(node[e]), int(node[k])) for e in ends.tolist()]
            oldest = int(np.flatnonzero(joined)[0])
            head[:k][joined[head[:k]]] = oldest
            head[k] = oldest
    return np.array(out, np.int64).reshape(-1, 2)


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, pair_limit: int = 64) -> DataFrame:
    """(id_col, fp, component_id) for every row of docs, at two differing bits.

    component_id: the smallest id reachable over links, a row's own included. Equal fingerprints
    are one node, however many copies there are; documents without words share fingerprint 0.
    Rows without an id get their class's id too; a fingerprint that only they have links to nothing.
    """
    prints = materialize(fingerprints(docs, id_col, text_col, width), "prints")
    nodes = materialize(prints.groupBy("fp").agg(F.min(id_col).alias("rep")), "nodes")
    roots = connected_components(near_links(nodes.where("rep is not null"), pair_limit))
    classes = nodes.join(roots, nodes["rep"] == roots["node"], "left").select(
        "fp", F.coalesce("root", "rep").alias("component_id")
    )
    classes = materialize(classes, "classes")
    discard(nodes, roots)
    return prints.join(classes, "fp").select(id_col, "fp", "component_id")


def fingerprint_hex(fp: str) -> Column:
    """16 lower-case hex digits of a fingerprint column."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_one(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, slack: float = 0.02,
    radius: int = 6, apart: int = 16, pair_limit: int = 20_000,
) -> DataFrame:
    """One row of docs for each group of near copies: that with the smallest id, a null id being the largest.

    Candidates are groups of texts linked by fingerprints of their words that differ in at most `radius` bits, and
    of their shingles of `width` words in at most `apart`. In such a group texts are near copies if the
    similarity of their shingles is estimated at `similarity` less `slack` (most of a standard error) or more.
    Texts without words are one group. Of rows with equal id and text any one stays, also where
    the id is null; of rows that share an id but not the text, one.
    """
    text = F.col(text_col)
    keys = {"k1": F.xxhash64(id_col, text), "k2": F.xxhash64(F.lit("copy"), id_col, text)}  # of (id, text), 128 bits
    fields = "fp long, check long, size long, sketch binary"
    rows = materialize(_printed(docs, keys | {"id": F.col(id_col)}, text_col, fields, lambda t: copy_prints(t, width)), "prints")
    head = F.struct(F.col("id").isNull().alias("none"), "id", "k1", "k2")
    nodes = rows.groupBy("fp", "check", "size", "sketch").agg(F.min(head).alias("head"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")  # written once, so a node keeps its number
    discard(rows)
    groups = near_groups(nodes.groupBy("fp", "check").agg(F.min("node").alias("node")), radius, apart, pair_limit)
    members = nodes.join(groups.select("fp", "check", "group"), ["fp", "check"]).select("node", "size", "sketch", "group")
    members = materialize(members, "members")
    discard(groups)
    roots = connected_components(similar_links(members, similarity - slack, pair_limit))
    named = nodes.select("node", "head").join(roots, "node", "left")
    heads = named.groupBy(F.coalesce("root", "node").alias("group")).agg(F.min("head").alias("head"))
    heads = materialize(heads.select(F.col("head.k1").alias("_loom_k1"), F.col("head.k2").alias("_loom_k2")), "heads")
    discard(nodes, members, roots)
    # repeated rows go before the shuffle; the join then finds the rows dealt and sorted by its keys
    single = docs.withColumns({"_loom_k1": keys["k1"], "_loom_k2": keys["k2"]}).dropDuplicates(["_loom_k1", "_loom_k2"])
    return single.join(heads, ["_loom_k1", "_loom_k2"], "left_semi").drop("_loom_k1", "_loom_k2")
