import math
import random
import zlib

import numpy as np
import pytest

from indexloom.llm import kdsearch, sharding


def brute(rows, queries, k):
    out = {}
    for qi, q in queries:
        if not usable(qi, q):
            continue
        q = [math.floor(1024 * x) for x in q]
        found = []
        for ci, c in rows:
            if usable(ci, c) and ci != qi and len(c) == len(q):
                found.append((-sum(a * math.floor(1024 * b) for a, b in zip(q, c)), ci))
        for rank, (score, ci) in enumerate(sorted(found)[:k], 1):
            out.setdefault((qi, rank), []).append((ci, -score))
    return out


def usable(i, v):
    return i is not None and v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v)


def got(df, name="vec_id"):
    return {(r["query_id"], r["rank"]): [(r[name], r["score"])] for r in df.collect()}


@pytest.mark.parametrize("shard_rows", [40, 1000])
def test_top_k_against_brute_force(spark, shard_rows):
    rng = random.Random(4)
    hot = [rng.choice([0.25, -0.5, 1.0]) for _ in range(6)]
    rows = [(i, hot if i % 3 == 0 else [rng.gauss(0, 1) for _ in range(6)]) for i in range(500)]  # many ties
    rows += [(1000, None), (1001, []), (1002, [None] * 6), (1003, [math.nan] * 6), (1004, [math.inf] * 6), (1005, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as id", "2 as shard")
    asked = df.where("vec_id % 20 = 0 or vec_id > 999")
    queries = [(i, v) for i, v in rows if i % 20 == 0 or i > 999]
    found = got(kdsearch.top_k(df, asked, k=10, shard_rows=shard_rows))
    assert found == brute(rows, queries, 10)


def test_fewer_rows_than_k_and_none(spark):
    rows = [(0, [1.0, 0.5]), (100, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert got(kdsearch.top_k(df, df, k=10)) == brute(rows, rows, 10)
    assert kdsearch.top_k(df.limit(0), df.limit(0)).count() == 0


def test_large_components_are_exact(spark):
    rows = [(i, [1e6 + i, -1e6, 3.0 * i]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert got(kdsearch.top_k(df, df.where("vec_id < 3"), k=5)) == brute(rows, rows[:3], 5)


def test_tree_boxes_are_tight_and_prune():
    rng = np.random.default_rng(0)
    points = rng.integers(-50, 50, (4000, 3)).astype(float)
    tree = kdsearch.planted(np.arange(4000), points, np.eye(3))
    for k, (start, stop) in enumerate(zip(tree.starts, tree.starts[1:])):
        own = tree.points[start:stop]
        assert (own.min(axis=0) == tree.low[k]).all() and (own.max(axis=0) == tree.high[k]).all() and stop - start <= kdsearch.LEAF
    query = np.array([[40.0, -45, 30]])
    best = next(iter(tree.answer(query, [None], 10, [kdsearch.LOW])))
    assert sorted(s for s, _ in best) == sorted(np.sort(points @ query[0])[-10:].tolist())
    assert tree.visited < 8  # of 32 leaves


def clustered(n, width, clusters, rng):
    centres = rng.normal(0, 1, (clusters, width))
    return centres[rng.integers(0, clusters, n)] + rng.normal(0, 0.03, (n, width))


def test_bounds_hold_and_prune_in_64_dimensions():
    rng = np.random.default_rng(3)
    points = np.floor(1024 * clustered(8192, 64, 32, rng))
    splits = kdsearch.Splits(points[:4000], 16)
    tree = kdsearch.planted(np.arange(8192), points, splits.basis)
    asked = points[::200]
    limits = kdsearch.upper_bounds(asked, tree.basis, tree.low, tree.high, tree.centre, tree.radius, tree.norm)
    scores = asked @ tree.points.T
    for node in range(len(tree.starts) - 1):
        assert (scores[:, tree.starts[node] : tree.starts[node + 1]].max(axis=1) <= limits[:, node]).all()
    for q, best in zip(asked, tree.answer(asked, [None] * len(asked), 10, [kdsearch.LOW] * len(asked))):
        assert sorted((s for s, _ in best), reverse=True) == np.sort(points @ q)[::-1][:10].tolist()
    assert tree.visited < 0.5 * len(asked) * (len(tree.starts) - 1)
    leaf = splits.leaf_of(points)
    assert splits.leaves == 16 and np.bincount(leaf, minlength=16).max() < 2 * 8192 / 16


def test_queries_go_to_few_shards_of_clustered_vectors(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, v.tolist()) for i, v in enumerate(clustered(3000, 64, 24, rng))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    tables = {}
    written = kdsearch.materialize

    def kept(table, label):
        tables[label] = written(table, label)
        return tables[label]

    monkeypatch.setattr(kdsearch, "materialize", kept)
    monkeypatch.setattr(kdsearch, "QUERIES", 7)
    asked = df.where("vec_id % 50 = 0")
    found = got(kdsearch.top_k(df, asked, k=10, shard_rows=100))
    assert found == brute(rows, rows[::50], 10)
    shards = tables["trees"].where("kind = 2").count()
    assert shards > 20 and tables["routed"].count() < 0.5 * 60 * shards


def test_hot_vectors_and_repeats(spark):
    hot = [0.5] * 8
    rows = [(i, hot if i % 2 else [float(i % 7 - 3)] * 8) for i in range(600)] + [(3, hot), (3, [0.25] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = df.where("vec_id in (1, 2, 11)")
    found = got(kdsearch.top_k(df, asked, k=10, shard_rows=20))
    assert found == brute(sorted(set((i, tuple(v)) for i, v in rows)), [(i, v) for i, v in rows if i in (1, 2, 11)], 10)


@pytest.mark.parametrize("seed", range(3))
def test_differencing(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 10_000, 500)
    place = sharding.difference_items(sizes, 7)
    sums = np.bincount(place, weights=sizes, minlength=7)
    assert sums.sum() == sizes.sum() and sums.max() - sums.min() <= 20
    base = np.array([9000, 0, 100, 4000, 70, 1, 12000])
    sums = np.bincount(sharding.difference_onto(sizes, base), weights=sizes, minlength=7) + base
    assert sums.max() - sums.min() <= 20
    assert sharding.difference_items(np.array([8, 7, 6, 5, 4]), 2).tolist() in ([0, 1, 1, 0, 0], [1, 0, 0, 1, 1], [0, 1, 0, 1, 1], [1, 0, 1, 0, 0])


def plain_differencing(sizes, shards):
    """Partial partitions as lists, the two of largest spread combined until one is left."""
    parts = [[[s], *[[] for _ in range(shards - 1)]] for s in sizes]
    spread = lambda p: max(map(sum, p)) - min(map(sum, p))
    while len(parts) > 1:
        parts.sort(key=spread)
        a, b = (sorted(parts.pop(), key=sum) for _ in range(2))
        parts.append([x + y for x, y in zip(a, b[::-1])])
    return sorted(map(sum, parts[0]))


def test_differencing_is_as_even_as_a_plain_one():
    rng = np.random.default_rng(9)
    for n, shards in ((60, 5), (200, 3), (30, 8)):
        sizes = rng.integers(1, 3000, n)
        sums = np.bincount(sharding.difference_items(sizes, shards), weights=sizes, minlength=shards)
        plain = plain_differencing(sizes.tolist(), shards)
        assert sums.max() - sums.min() <= plain[-1] - plain[0] + 3 * max(1, 100 // n)


def test_shards(spark):
    rng = random.Random(1)
    texts = ["common text " * 3] * 400 + ["é" * rng.randrange(1, 400) for _ in range(600)] + [None, "", "", "long " * 20_000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "no id")] * 50 + [(5, "repeated id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as shard", "2 as size", "3 as slot", "4 as g1")
    found = sharding.shard_documents(df, shards=8).collect()
    assert len(found) == len(rows)
    by_shard, by_text = {}, {}
    for r in found:
        by_shard.setdefault(r["shard"], []).append(r)
        by_text.setdefault((r["text_crc32"], r["size"]), set()).add(r["shard"])
    sums = sorted(sum(r["size"] for r in x) for x in by_shard.values())
    assert set(by_shard) == set(range(8)) and sums[-1] == 100_016 and sums[-2] - sums[0] <= 2  # one text above a fair share
    assert all(sorted(r["slot"] for r in x) == list(range(len(x))) for x in by_shard.values())
    assert all(len(s) == 1 for s in by_text.values())  # no group is cut
    model = sorted((str(i), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in found) == model
    assert sharding.shard_documents(df.limit(0), shards=8).count() == 0


@pytest.mark.parametrize("items,shards", [(500, 4), (100_000, 4), (None, 300)])
def test_shards_over_any_number_of_buckets(spark, items, shards):
    n = 9000
    rows = spark.range(n).selectExpr("id", "20 + id % 37 as size", "xxhash64(id) as g1", "id as g2")
    sums = [r["sum(size)"] for r in sharding.balanced_shards(rows, shards, items).groupBy("shard").sum("size").collect()]
    assert len(sums) == shards and sum(sums) == sum(20 + k % 37 for k in range(n))
    assert max(sums) - min(sums) <= (2 if shards == 4 else 60)


def test_thousands_of_buckets_are_even(spark):
    rows = spark.range(1_600_000).selectExpr("id", "20 + id % 37 as size", "xxhash64(id) as g1", "id as g2")
    found = sharding.balanced_shards(rows, 4, 400)  # 4,000 buckets
    sums = [r["sum(size)"] for r in found.groupBy("shard").sum("size").collect()]
    assert sum(sums) == sum(20 + k % 37 for k in range(1_600_000)) and max(sums) - min(sums) <= 2
