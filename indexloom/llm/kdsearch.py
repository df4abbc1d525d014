"""Exact top-k inner-product search with a KD-tree for each shard of the vectors.

Shards are the leaves of one coarse tree of median splits, so that a shard's vectors lie together. It is fitted
on a sample of some `SAMPLE` vectors, in the directions of their largest variance; every vector is then dealt by it,
and a shard with more than its rows is dealt over several by hash. A task builds its shard's own tree (median splits of the
widest direction down to leaves of `LEAF` vectors, tight bounding boxes, and for leaves a ball about their mean)
and writes it leaf by leaf, so that it is built once. A box or ball bounds a query's scores from above. A search
visits boxes best bound first and stops at the first bound below its k-th score; a bound equal to it is
still visited, as ties go to the smaller id.

Two passes: each query first searches the shard that it would be dealt to, and then, with the k-th score found there,
only those other shards whose bound reaches it. A shard that many queries ask is read by several tasks, each with
a block of them. Of equal vectors only the k + 1 smallest ids can be an answer, so only those are kept, which also
keeps a hot vector from filling shards. In many dimensions without clusters no bound is of use, and every query
visits every shard: see the README for figures.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize

LEAF = 128
SAMPLE = 20_000  # vectors that the coarse tree is fitted on, about
SHARDS = 16_384  # at most, so that their boxes are a table of bounded size; shards grow beyond it
QUERIES = 4096  # queries that one task asks of a shard
EXACT = float(1 << 53)
LOW, HIGH = -(1 << 63), (1 << 63) - 1


class Tree:
    """A KD-tree over the rows of an integer matrix that lie in the order of its leaves.

    starts: where each leaf begins, and the number of rows. basis: orthonormal directions of the boxes.
    """

    def __init__(self, ids: np.ndarray, points: np.ndarray, starts: np.ndarray, basis: np.ndarray):
        self.ids, self.points, self.starts, self.basis, self.visited = ids, points, starts, basis, 0
        turned = points @ basis
        first, sizes = starts[:-1], np.diff(starts)
        low, high = np.minimum.reduceat(turned, first), np.maximum.reduceat(turned, first)
        centre = np.add.reduceat(turned, first) / sizes[:, None]
        away = np.sqrt(((turned - np.repeat(centre, sizes, axis=0)) ** 2).sum(axis=1))
        radius = np.maximum.reduceat(away, first)
        self.most = np.maximum.reduceat(np.abs(points).max(axis=1), first)  # by leaf
        self.children: list[tuple[int, int] | None] = [None] * len(first)
        lows, highs, level = [*low], [*high], list(range(len(first)))
        while len(level) > 1:  # neighbours in the order of the leaves are neighbours in space
            pairs, rest = [*zip(level[::2], level[1::2])], level[len(level) // 2 * 2 :]
            level = []
            for a, b in pairs:
                level.append(len(lows))
                lows.append(np.minimum(lows[a], lows[b]))
                highs.append(np.maximum(highs[a], highs[b]))
                self.children.append((a, b))
            level += rest
        self.root = level[0]
        self.low, self.high = np.array(lows), np.array(highs)
        self.centre, self.radius = (self.low + self.high) / 2, np.sqrt(((self.high - self.low) ** 2).sum(axis=1)) / 2
        self.centre[: len(first)], self.radius[: len(first)] = centre, radius
        self.norm = float(np.sqrt((points**2).sum(axis=1)).max())

    def summary(self) -> np.ndarray:
        """The root's box and ball, and the largest norm, in one row."""
        r = self.root
        return np.concatenate([self.low[r], self.high[r], self.centre[r], [self.radius[r], self.norm]])

    def search(self, query: np.ndarray, bounds: np.ndarray, own: int | None, k: int, floor: int):
        """The k best (score, id) at floor or above; own is an id that doesn't count.

        bounds: an upper bound of the query's scores in each box.
        """
        best: list[tuple[int, int]] = []  # a heap with the worst on top: (score, -id)
        frontier = [(-bounds[self.root], self.root)]
        while frontier:
            bound, node = heapq.heappop(frontier)
            if -bound < floor:
                break
            if self.children[node]:
                for child in self.children[node]:
                    if bounds[child] >= floor:
                        heapq.heappush(frontier, (-bounds[child], child))
                continue
            self.visited += 1
            for score, i in self._leaf(node, query, own, k, floor):
                if len(best) < k:
                    heapq.heappush(best, (score, -i))
                elif (score, -i) > best[0]:
                    heapq.heapreplace(best, (score, -i))
            if len(best) == k:
                floor = max(floor, best[0][0])
        return [(s, -i) for s, i in best]

    def _leaf(self, node, query, own, k, floor):
        """The leaf's k best (score, id) at floor or above; exact also where doubles would round."""
        start, stop = self.starts[node], self.starts[node + 1]
        points, ids = self.points[start:stop], self.ids[start:stop]
        if float(np.abs(query).max()) * self.most[node] * len(query) < EXACT:
            scores = points @ query
            good = scores >= floor
        else:
            whole = np.array([[int(x) for x in p] for p in points.tolist()], object) @ np.array([int(x) for x in query.tolist()], object)
            scores = np.array([max(LOW, min(HIGH, s)) for s in whole.tolist()], np.int64)
            good = scores >= floor
        if own is not None:
            good &= ids != own
        scores, ids = scores[good], ids[good]
        if len(ids) > k:
            top = np.lexsort((ids, -scores))[:k]
            scores, ids = scores[top], ids[top]
        return [(int(s), i) for s, i in zip(scores.tolist(), ids.tolist())]

    def answer(self, queries: np.ndarray, owns, k: int, floors):
        """The search of each query of a block."""
        limits = upper_bounds(queries, self.basis, self.low, self.high, self.centre, self.radius, self.norm)
        for q, b, own, floor in zip(queries, limits, owns, floors):
            yield self.search(q, b, own, k, floor)


def upper_bounds(queries, basis, low, high, centre, radius, norm) -> np.ndarray:
    """For each query and box, what no score in it exceeds: the box's or the ball's, with room for rounding."""
    turned = queries @ basis
    size = np.sqrt((queries**2).sum(axis=1))[:, None]
    box = np.maximum(turned, 0) @ high.T + np.minimum(turned, 0) @ low.T
    ball = turned @ centre.T + size * radius[None, :]
    return np.minimum(box, ball) + 1 + 1e-9 * size * norm


def planted(ids: np.ndarray, points: np.ndarray, basis: np.ndarray) -> Tree:
    """The tree of some vectors: rows are put in the order of its leaves by median splits."""
    order, starts = np.argsort(ids, kind="stable"), []
    turned = points @ basis
    todo = [(0, len(order))]
    while todo:
        start, stop = todo.pop()
        own = turned[order[start:stop]]
        wide = own.max(axis=0) - own.min(axis=0)
        at = int(np.argmax(wide))
        if stop - start > LEAF and wide[at] > 0:
            middle = (start + stop) // 2
            halves = np.argpartition(own[:, at], middle - start, kind="introselect")
            order[start:stop] = order[start:stop][halves]
            todo += [(middle, stop), (start, middle)]  # the left half is taken next
        else:
            starts.append(start)
    return Tree(ids[order], points[order], np.array([*starts, len(order)]), basis)


class Splits:
    """The coarse tree: median splits of a sample of vectors of one dimension, in their principal directions."""

    def __init__(self, sample: np.ndarray, shards: int):
        self.width = sample.shape[1]
        spread = np.cov(sample.T).reshape(self.width, self.width) if len(sample) > 1 else np.eye(self.width)
        self.basis = np.linalg.eigh(np.nan_to_num(spread))[1][:, ::-1].copy()
        self.axis, self.value, self.child = [], [], []
        self.leaves = 0
        self._split(sample @ self.basis, shards)
        self.axis, self.value, self.child = np.array(self.axis), np.array(self.value), np.array(self.child)

    def _split(self, own: np.ndarray, shards: int) -> int:
        node = len(self.axis)
        self.axis.append(0)
        self.value.append(np.inf)
        self.child.append((-1, -1))
        wide = own.max(axis=0) - own.min(axis=0) if len(own) else np.zeros(1)
        at = int(np.argmax(wide))
        if shards < 2 or len(own) < 2 or wide[at] == 0:
            self.value[node], self.leaves = self.leaves, self.leaves + 1
            return node
        middle = np.partition(own[:, at], len(own) // 2)[len(own) // 2]
        left = own[:, at] < middle
        if not left.any():
            middle = own[own[:, at] > middle, at].min()
            left = own[:, at] < middle
        self.axis[node], self.value[node] = at, middle
        self.child[node] = (self._split(own[left], shards // 2), self._split(own[~left], shards - shards // 2))
        return node

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        turned, node = points @ self.basis, np.zeros(len(points), np.int64)
        rows = np.arange(len(points))
        while len(rows := rows[self.child[node[rows], 0] >= 0]):
            here = node[rows]
            right = turned[rows, self.axis[here]] >= self.value[here]
            node[rows] = self.child[here, right.astype(int)]
        return self.value[node].astype(np.int64)


def quantised(vectors: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) with v = floor(scale * x) of each component as array<double>, without unusable vectors.

    Unusable: null id, null or empty vector, a null or non-finite component.
    """
    v = F.col(vector_col)
    scaled = F.transform(v, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("double"))
    wide = F.transform(v, lambda x: x.cast("double"))
    good = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v"), good.alias("good"), scaled.alias("s"))
    return rows.where("id is not null and v is not null and size(v) > 0 and good").select("id", F.col("s").alias("v"))


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024,
    id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = 8192,
) -> DataFrame:
    """(query_id, rank, id, score): the k best inner products of each query with the vectors.

    Components count as floor(scale * x). Rows with a query's id are no candidates of it; rows of other
    dimensions aren't either. Ties go to the smaller id. Rows that repeat both id and vector are one candidate; of
    queries that repeat both, each is asked once. Empty tables give no rows.
    """
    equal = Window.partitionBy("v").orderBy("id")
    points = quantised(vectors, scale, id_col, vector_col).withColumn("nth", F.dense_rank().over(equal))
    points = materialize(points.where(F.col("nth") <= k + 1).select("v", "id").distinct(), "points")
    asked = materialize(quantised(queries, scale, id_col, vector_col).distinct(), "queries")
    widths = {r["w"]: r["n"] for r in points.groupBy(F.size("v").alias("w")).agg(F.count("*").alias("n")).collect()}
    trees = {w: _fitted(points.where(F.size("v") == w), n, shard_rows) for w, n in widths.items()}
    base = dict(zip(trees, np.cumsum([0, *[t.leaves for t in trees.values()]]).tolist()))

    def dealt(rows: DataFrame) -> DataFrame:
        """rows (id, v) with the leaf that each falls in; those of a dimension without vectors are left out."""

        def task(batches):
            for batch in batches:
                for width, own, matrix in by_width(batch.column(1)):
                    if width in trees:
                        part = batch.take(pa.array(own))
                        yield pa.RecordBatch.from_arrays(
                            [*part.columns, pa.array(base[width] + trees[width].leaf_of(matrix))], names=["id", "v", "leaf"]
                        )

        return rows.select("id", "v").mapInArrow(task, "id long, v array<double>, leaf long")

    fell = materialize(dealt(points), "leaves")
    parts = fell.groupBy("leaf").agg(F.ceil(F.count("*") / F.lit(2 * shard_rows)).cast("long").alias("parts"))
    parts = materialize(parts, "parts")  # at most SHARDS rows for each dimension
    discard(points)
    salt = F.pmod(F.xxhash64("id"), F.col("parts"))
    shard = (F.col("leaf") * F.lit(1 << 24) + salt).alias("shard")
    none = F.lit(LOW).alias("floor")
    stored = fell.join(parts, "leaf").select(shard, F.lit(0).alias("kind"), "id", "v", none)
    homes = materialize(dealt(asked).join(parts, "leaf").select("id", "v", shard), "homes")
    fields = "kind int, shard long, id long, score long, ids array<long>, values array<double>"
    names = ["kind", "shard", "id", "score", "ids", "values"]

    def plant(batches):
        """A shard's tree, leaf by leaf (kind 0), its summary (2), and the answers of the queries at home (1)."""
        for number, rows, asking in shard_runs(batches):
            if asking is None:
                ids, matrix = rows
                width = matrix.shape[1]
                tree = planted(ids, matrix, trees[width].basis)
                for start, stop in zip(tree.starts, tree.starts[1:]):
                    yield row_batch(0, number, width, tree.ids[start:stop], tree.points[start:stop].ravel())
                yield row_batch(2, number, width, [], tree.summary())
            else:
                yield from _answers(number, tree, asking, k, names)

    rows = stored.union(homes.select("shard", F.lit(1), "id", "v", none))
    grown = rows.repartition("shard").sortWithinPartitions("shard", "kind")
    grown = materialize(grown.mapInArrow(plant, fields), "trees")
    discard(fell)
    first = grown.where("kind = 1").select(F.col("shard").alias("query_id"), "id", "score")
    kth = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("worst"))
    floors = kth.where(F.col("n") >= k).select(F.col("query_id").alias("id"), F.col("worst").alias("floor"))
    boxes: dict[int, tuple] = {}
    for r in grown.where("kind = 2").select("shard", "id", "values").collect():  # a row for each shard
        boxes.setdefault(r["id"], ([], []))[0].append(r["shard"])
        boxes[r["id"]][1].append(r["values"])
    boxes = {w: (np.array(s), np.array(x)) for w, (s, x) in boxes.items()}

    def route(batches):
        """The other shards whose bound reaches a query's k-th score."""
        for batch in batches:
            for width, own, matrix in by_width(batch.column(1)):
                shards, box = boxes[width]
                low, high, centre = (box[:, j * width : (j + 1) * width] for j in range(3))
                limits = upper_bounds(matrix, trees[width].basis, low, high, centre, box[:, -2], box[:, -1].max())
                part = batch.take(pa.array(own))
                reach = limits >= part.column(3).to_numpy().astype(float)[:, None]
                reach &= shards[None, :] != part.column(2).to_numpy()[:, None]
                for at in range(0, len(own), 256):
                    query, place = np.nonzero(reach[at : at + 256])
                    if len(query):
                        sent = part.slice(at, 256).take(pa.array(query))
                        columns = [pa.array(shards[place]), sent.column(0), sent.column(1), sent.column(3)]
                        yield pa.RecordBatch.from_arrays(columns, names=["shard", "id", "v", "floor"])

    wanted = homes.join(floors, "id", "left").select("id", "v", "shard", F.coalesce("floor", F.lit(LOW)).alias("floor"))
    routed = materialize(wanted.mapInArrow(route, "shard long, id long, v array<double>, floor long"), "routed")
    blocks = routed.groupBy("shard").agg(F.ceil(F.count("*") / F.lit(QUERIES)).cast("int").alias("blocks"))
    read = grown.where("kind = 0").join(blocks, "shard").select(
        "shard", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("kind"),
        F.col("ids"), F.col("values").alias("v"), F.col("id").alias("width"), none,
    )
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    asking = routed.join(blocks, "shard").select(
        "shard", block, F.lit(1), F.array("id"), "v", F.size("v").cast("long"), "floor"
    )

    def search(batches):
        for number, tree, wanted in tree_runs(batches, {w: t.basis for w, t in trees.items()}):
            yield from _answers(number, tree, wanted, k, names)

    spread = read.union(asking).repartition("shard", "block").sortWithinPartitions("shard", "block", "kind")
    second = spread.mapInArrow(search, fields).select(F.col("shard").alias("query_id"), "id", "score")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return first.union(second).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", "rank", F.col("id").alias(id_col), "score"
    )


def _fitted(points: DataFrame, n: int, shard_rows: int) -> Splits:
    """The coarse tree of n vectors, fitted on about SAMPLE of them, which are picked by their id's hash."""
    picked = points if n <= SAMPLE else points.where(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(n)) < SAMPLE)
    sample = np.array([r["v"] for r in picked.select("v").collect()], np.float64)
    return Splits(sample if len(sample) else np.zeros((1, len(points.first()["v"]))), min(SHARDS, 1 + n // shard_rows))


def by_width(lists):
    """(dimension, row numbers, matrix) for the rows of each dimension."""
    offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy()
    widths = np.diff(offsets)
    for width in np.unique(widths).tolist():
        own = np.flatnonzero(widths == width)
        yield width, own, values[offsets[own][:, None] + np.arange(width)]


def row_batch(kind: int, number: int, width: int, ids, values) -> pa.RecordBatch:
    columns = [
        pa.array([kind], pa.int32()), pa.array([number]), pa.array([width]), pa.nulls(1, pa.int64()),
        pa.array([np.asarray(ids, np.int64)], pa.list_(pa.int64())), pa.array([values], pa.list_(pa.float64())),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["kind", "shard", "id", "score", "ids", "values"])


def stretches(batch, columns: int):
    """Slices of a batch with equal values in its first columns."""
    change = np.zeros(max(0, batch.num_rows - 1), bool)
    for c in batch.columns[:columns]:
        change |= np.diff(c.to_numpy()) != 0
    ends = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
    for start, stop in zip(ends, ends[1:]):
        if start < stop:
            yield batch.slice(start, stop - start)


def shard_runs(batches):
    """(shard, (ids, matrix), None) of each shard's vectors, then (shard, None, (ids, matrix, floors)) of its queries.

    batches: (shard, kind, id, v, floor), sorted by shard and kind. All vectors of a shard have one dimension.
    """
    shard, held = None, []

    def whole():
        return shard, (np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])), None

    for batch in batches:
        for part in stretches(batch, 2):
            number, kind, ids = part.column(0)[0].as_py(), part.column(1)[0].as_py(), part.column(2).to_numpy()
            if held and (number != shard or kind):
                yield whole()
                held = []
            shard = number
            matrix = next(by_width(part.column(3)))[2]
            if kind:
                yield shard, None, (ids, matrix, part.column(4).to_numpy())
            else:
                held.append((ids, matrix))
    if held:
        yield whole()


def tree_runs(batches, bases: dict[int, np.ndarray]):
    """(shard, tree, (ids, matrix, floors)) of each batch of queries, whose shard's leaves come before them.

    batches: (shard, block, kind, ids, v, width, floor), sorted by the first three.
    """
    at, tree, held = None, None, []
    for batch in batches:
        for part in stretches(batch, 3):
            here, kind = (part.column(0)[0].as_py(), part.column(1)[0].as_py()), part.column(2)[0].as_py()
            if here != at:
                at, tree, held = here, None, []
            if not kind:
                held += [(i.values.to_numpy(), v.values.to_numpy()) for i, v in zip(part.column(3), part.column(4))]
                width = part.column(5)[0].as_py()
                continue
            if tree is None:
                starts = np.cumsum([0, *[len(i) for i, _ in held]])
                points = np.concatenate([v for _, v in held]).reshape(-1, width)
                tree, held = Tree(np.concatenate([i for i, _ in held]), points, starts, bases[width]), []
            ids = part.column(3).values.to_numpy()[part.column(3).offsets.to_numpy()[:-1]]
            yield at[0], tree, (ids, next(by_width(part.column(4)))[2], part.column(6).to_numpy())


def _answers(number, tree, asking, k, names):
    ids, matrix, floors = asking
    rows = []
    for i, best in zip(ids.tolist(), tree.answer(matrix, ids.tolist(), k, floors.tolist())):
        rows += [(i, c, s) for s, c in best]
    if rows:
        query, found, score = zip(*rows)
        n = len(rows)
        columns = [
            pa.array(np.ones(n, np.int32)), pa.array(query, pa.int64()), pa.array(found, pa.int64()), pa.array(score, pa.int64()),
            pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.float64())),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=names)


SQL = r"""
WITH good AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM good q JOIN good c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 10
"""
