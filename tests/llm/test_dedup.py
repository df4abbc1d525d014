import hashlib
import math
import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from indexloom.llm import linededup, simhash
from indexloom.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def print_of(text, width=3):
    words = WORD.findall(lower(text or ""))
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def shingles_of(text, width):
    words = WORD.findall(lower(text or ""))
    shingles = {" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()
    return [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]


def bits_of(hashes):
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def remixed(h, lane):
    whole = (1 << 64) - 1
    h = (h + lane * 0x9E3779B97F4A7C15) & whole
    h = ((h ^ h >> 30) * 0xBF58476D1CE4E5B9) & whole
    h = ((h ^ h >> 27) * 0x94D049BB133111EB) & whole
    return h ^ h >> 31


def sketch_of(hashes):
    return sum(bits_of([remixed(h, lane) for h in hashes]) << 64 * (lane - 1) for lane in range(1, 17))


def similarity_of(a, b):
    """Of two (number of shingles, sketch)."""
    both = math.cos(math.pi * (a[1] ^ b[1]).bit_count() / 1024) * math.sqrt(a[0] * b[0])
    return both / (a[0] + b[0] - both) if a[0] + b[0] else 1


def word_print_of(text):
    counts = Counter(WORD.findall(lower(text or "")))
    votes = [(xxhash.xxh64_intdigest(w.encode(), 42), math.isqrt(16 * n)) for w, n in counts.items()]
    return sum(1 << b for b in range(64) if 2 * sum(n for h, n in votes if h >> b & 1) > sum(n for _, n in votes))


def copies_of(texts, radius=6, apart=16, least=0.78):
    """The smallest id of each text's group of near copies, by union over all pairs: candidates, then similar ones among them."""
    hashes = {i: shingles_of(t, 5) for i, t in texts.items()}
    prints = {i: (word_print_of(t), bits_of(hashes[i])) for i, t in texts.items()}
    near = lambda a, b: (a[0] ^ b[0]).bit_count() <= radius and (a[1] ^ b[1]).bit_count() <= apart
    groups = classes(prints, near=near)
    sketches = {i: (groups[i], (len(h), sketch_of(h))) for i, h in hashes.items()}
    return classes(sketches, near=lambda a, b: a[0] == b[0] and similarity_of(a[1], b[1]) >= least)


def classes(prints, radius=2, near=None):
    """The smallest id of each row's component, by union over all pairs of fingerprints."""
    near = near or (lambda a, b: (a ^ b).bit_count() <= radius)
    root = {p: p for p in prints.values()}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for a, b in combinations(list(root), 2):
        if near(a, b):
            root[find(a)] = find(b)
    best = {}
    for i, p in prints.items():
        best[find(p)] = min(i, best.get(find(p), i))
    return {i: best[find(p)] for i, p in prints.items()}


def texts():
    rng = random.Random(7)
    vocabulary = ["".join(rng.choices("abcdeéß", k=rng.randrange(2, 7))) for _ in range(300)]
    out = [" ".join(rng.choices(vocabulary, k=rng.randrange(1, 200))) for _ in range(40)]
    for k in range(0, 40, 4):
        words = out[k].split()
        for _ in range(3):
            near = list(words)
            near[rng.randrange(len(near))] = rng.choice(vocabulary)
            out.append(" ".join(near))
    return out + [out[0]] * 20 + [out[0].upper(), "", None, " \t\n", "one", "one two", "A\x0bB\x0cC\rD", "x " * 5000, "a\x1cb\x85c d e"]


def test_fingerprints(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit(1)).withColumn("id", F.lit(2))
    found = {r["doc_id"]: r["fp"] & (1 << 64) - 1 for r in simhash.fingerprints(df).collect()}
    assert found == {i: print_of(t) for i, t in rows}


@pytest.mark.parametrize("limit", [2, 64])
def test_near_classes(spark, limit):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in simhash.near_classes(df, pair_limit=limit).collect()}
    assert found == classes({i: print_of(t) for i, t in rows})


@pytest.mark.parametrize("limit", [2, 8, 64])
def test_links_of_crowded_buckets(spark, limit):
    rng = random.Random(limit)
    centres = [rng.getrandbits(64) for _ in range(3)]
    prints = set()
    for c in centres:
        for _ in range(60):
            flips = rng.sample(range(64), rng.randrange(0, 6))
            prints.add(c ^ sum(1 << b for b in flips))
    prints = dict(enumerate(sorted(prints)))
    nodes = spark.createDataFrame([(simhash.signed(p), i) for i, p in prints.items()], "fp long, rep long")
    roots = {r["node"]: r["root"] for r in connected_components(simhash.near_links(nodes, pair_limit=limit)).collect()}
    assert {i: roots.get(i, i) for i in prints} == classes(prints)


def test_covering_masks_miss_no_pair():
    masks = simhash.covering_masks(2)
    assert len(masks) == 7 and {m.bit_count() for m in masks} <= {36, 37}
    for a in range(64):
        for b in range(a, 64):
            assert any(not m & (1 << a | 1 << b) for m in masks)


def test_components_of_long_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(100)] + [(1000, 1001 + i) for i in range(50)] + [(2000, 2000), (3001, 3000), (3000, 3001)]
    df = spark.createDataFrame(edges, "a long, b long")
    found = {r["node"]: r["root"] for r in connected_components(df).collect()}
    model = {i: 0 for i in range(101)} | {1000 + i: 1000 for i in range(51)} | {3000: 3000, 3001: 3000}
    assert found == model
    assert connected_components(df.limit(0)).count() == 0


def test_simhash_edges(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (None, "q"), (2, None), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_x", F.lit(0))
    found = sorted(map(tuple, simhash.near_classes(df).select("doc_id", "component_id").collect()), key=str)
    assert found == sorted([(1, 1), (1, 1), (None, 1), (None, None), (2, 2), (3, 2)], key=str)
    kept = simhash.keep_one(df)
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 2] and kept.columns == df.columns
    assert simhash.keep_one(df.limit(0)).count() == 0
    assert simhash.near_classes(df.limit(0)).count() == 0


def line_model(rows, min_chars=40, min_docs=5):
    def key(line):
        return lower(line.strip(" \t\n\x0b\x0c\r"))

    holders = {}
    for i, t in rows:
        if i is not None:
            for line in (t or "").split("\n"):
                holders.setdefault(key(line), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [
            x for x in lines
            if i is None or len(key(x)) < min_chars or len(holders[key(x)]) < min_docs or i == max(holders[key(x)])
        ]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def line_rows():
    rng = random.Random(3)
    shared = ["ÄÖ shared passage number %d that is long enough to count %s" % (k, "x" * k) for k in range(12)]
    rows = []
    for i in range(120):
        lines = ["own line %d of document %d which nobody else has at all" % (k, i) for k in range(rng.randrange(3))]
        lines += rng.sample(shared[:9], rng.randrange(4)) + ["  HOT LINE THAT EVERY SINGLE DOCUMENT HOLDS, PADDED \t"] + ["short"] * 2
        if i % 30 == 0:
            lines += [shared[10], shared[10].upper()]
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines)))
    rows += [(500, None), (501, ""), (502, "\n\n"), (503, "hot line that every single document holds, padded"), (504, "é" * 39), (505, "é" * 40)]
    rows += [(7, "another row of document 7\nhot line that every single document holds, padded"), (None, rows[0][1]), rows[3]]
    return rows


@pytest.mark.parametrize("partitions", [1, 4, 37])
def test_line_dedup(spark, partitions):
    rows = line_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_lines", F.lit("clash")).withColumn("pos", F.lit(1))
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        kept = linededup.drop_lines(df, linededup.line_bitmaps(df))
        found = sorted(map(tuple, kept.select("doc_id", "n_lines", "n_dropped", "text").collect()), key=str)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert found == line_model(rows)
    assert kept.columns.count("n_lines") == 1
    assert linededup.drop_lines(df.limit(0), linededup.line_bitmaps(df.limit(0))).count() == 0


@pytest.mark.parametrize("seed", range(8))
def test_streamed_runs_over_any_cuts(seed):
    """However the sorted rows are cut into tasks and batches, drops and open rows settle to the same lines."""
    import pyarrow as pa

    rng = random.Random(seed)
    rows = [(doc, k, 9, h, h, [pos]) for h in range(8) for doc in rng.sample(range(30), rng.choice([1, 3, 4, 5, 6, 20])) for k, pos in enumerate(range(rng.randrange(1, 3)))]
    rows.sort(key=lambda r: (r[3], r[4], -r[0], r[5]))
    cuts = sorted(c for c in rng.sample(range(len(rows)), 6) if (rows[c][0], rows[c][3]) != (rows[c - 1][0], rows[c - 1][3]))
    kinds = [pa.string() if seed % 2 else pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
    marks, size = [], rng.choice([1, 2, 5, 1000])
    for a, b in zip([0, *cuts], [*cuts, len(rows)]):
        parts = [rows[k : min(k + size, b)] for k in range(a, b, size)]
        batches = [
            pa.RecordBatch.from_arrays(
                [pa.array([f"{x:02}" if seed % 2 and c == 0 else x for x in col], t) for c, (col, t) in enumerate(zip(zip(*part), kinds))],
                names=["id", "text_hash", "n_lines", "h1", "h2", "at"],
            )
            for part in parts
        ]
        for batch in linededup.stream_runs(batches, 5):
            marks += [list(r.values()) for r in batch.to_pylist()]
    marks = [(m[0], int(m[1]), *m[2:]) for m in marks]
    dropped = {(m[1], m[2], m[4]) for m in marks if m[0] == linededup.DROP}
    for h in {m[4] for m in marks if m[0] != linededup.DROP}:
        own = [m for m in marks if m[0] == linededup.TOTAL and m[4] == h]
        if sum(m[7] for m in own) >= 5:
            first = max(m[1] for m in own)
            dropped |= {(m[1], m[2], h) for m in marks if m[0] == linededup.OPEN and m[4] == h and m[1] < first}
    model = set()
    for h in range(8):
        docs = {r[0] for r in rows if r[3] == h}
        if len(docs) >= 5:
            model |= {(r[0], r[1], h) for r in rows if r[3] == h and r[0] != max(docs)}
    assert dropped == model


@pytest.mark.parametrize("kind", ["smallint", "decimal(10,2)", "string", "date"])
def test_line_dedup_with_any_type_of_id(spark, kind):
    line = "a line of more than forty characters that six documents hold"
    df = spark.range(6).selectExpr(
        ("date_add(date'2020-01-01', int(id))" if kind == "date" else f"cast(id as {kind})") + " as doc_id", f"concat('{line}', '\n', id) as text"
    )
    kept = linededup.drop_lines(df, linededup.line_bitmaps(df))
    assert sorted(r["n_dropped"] for r in kept.collect()) == [0, 1, 1, 1, 1, 1]
    assert [r["text"] for r in kept.where("n_dropped = 0").collect()] == [f"{line}\n5"]


def test_line_dedup_of_very_long_texts(spark):
    line = "the same line of a very long document, over and over again"
    rows = [(i, "\n".join([line] * (200_000 if i == 2 else 1))) for i in range(7)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["text"]) for r in linededup.drop_lines(df, linededup.line_bitmaps(df)).collect()}
    assert found[2] == (200_000, 200_000, "") and found[6] == (1, 0, line) and found[0] == (1, 1, "")


def test_registered_query_digest(spark):
    text = "a\nb"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    kept = linededup.drop_lines(df, linededup.line_bitmaps(df)).select(F.sha2("text", 256).alias("d")).first()["d"]
    assert kept == hashlib.sha256(text.encode()).hexdigest()


def crowd(rng, groups, members, most):
    out = set()
    for c in [rng.getrandbits(64) for _ in range(groups)]:
        for _ in range(members):
            out.add(c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, most))))
    return sorted(out)


@pytest.mark.parametrize("radius,limit", [(1, 20_000), (6, 20_000), (6, 20), (8, 20_000)])
def test_near_groups(spark, radius, limit):
    rng = random.Random(radius)
    prints = crowd(rng, 4, 40 if radius < 8 else 12, radius + 3)
    checks = [rng.choice([0, 0, 7, (1 << 20) - 1]) for _ in prints]
    rows = [(k, simhash.signed(p), c) for k, (p, c) in enumerate(zip(prints, checks))]
    nodes = spark.createDataFrame(rows, "node long, fp long, check long")
    found = {}
    for r in simhash.near_groups(nodes, radius, apart=4, pair_limit=limit).collect():
        found.setdefault(r["group"], []).append(r["node"])
    near = lambda a, b: (a[0] ^ b[0]).bit_count() <= radius and (a[1] ^ b[1]).bit_count() <= 4
    model = {}
    for k, c in classes(dict(enumerate(zip(prints, checks))), near=near).items():
        model.setdefault(c, []).append(k)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, model.values()))


@pytest.mark.parametrize("size", [1, 3, 7, 100])
@pytest.mark.parametrize("most", [None, 5])
def test_buckets_over_any_batches(size, most):
    import numpy as np
    import pyarrow as pa

    rng = random.Random(size)
    keys = sorted(rng.choice([1, 2, 3, 3, 3, 9, *range(20, 60)]) for _ in range(150))
    batches = [
        pa.RecordBatch.from_arrays([pa.array(keys[k : k + size]), pa.array(range(k, min(k + size, 150)))], names=["key", "x"])
        for k in range(0, 150, size)
    ]
    found = {}
    for key, rows, whole in simhash.buckets(batches, most):
        got = found.setdefault(key, [[], set()])
        got[0] += rows[:, 0].tolist()
        got[1].add(whole)
    counts = {k: keys.count(k) for k in set(keys)}
    assert {k: sorted(v[0]) for k, v in found.items()} == {
        k: list(np.flatnonzero(np.array(keys) == k)) for k, n in counts.items() if n > 1
    }
    assert all(v[1] == {most is None or counts[k] <= most} for k, v in found.items())


@pytest.mark.parametrize("radius", range(1, 10))
def test_covering_of_every_radius(radius):
    rng = random.Random(radius)
    masks = simhash.covering_masks(radius)
    if radius > 6:
        assert len(masks) == 2 ** (radius + 1) - 2 and {m.bit_count() for m in masks} == {28, 32, 36}
    for _ in range(3000):
        bits = sum(1 << b for b in rng.sample(range(64), rng.randrange(1, radius + 1)))
        assert any(not m & bits for m in masks)
    with pytest.raises(ValueError):
        simhash.covering_masks(10)


def test_keep_one_catches_near_copies(spark):
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(500)]
    rows = []
    for k in range(60):
        text = rng.choices(words, k=400)
        rows.append((2 * k, " ".join(text)))
        text[rng.randrange(400)] = "changed"
        rows.append((2 * k + 1, " ".join(text) + " end"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"] for r in simhash.keep_one(df).collect()}
    assert kept >= {2 * k for k in range(60)} and len(kept) <= 63


def test_keep_one_finds_nine_in_ten_similar_pairs(spark):
    """Recall of pairs at 0.8 or more by their five-word shingles, and no link of unrelated texts."""
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghij", k=rng.randrange(2, 7))) for _ in range(3000)]
    often = rng.choices(words, k=60)
    rows, similar = [], 0
    for k in range(300):
        n = rng.randrange(40, 400)
        text = [rng.choice(often if rng.random() < 0.5 else words) for _ in range(n)]
        near = list(text)
        for at in rng.sample(range(n), max(1, n // 50)):
            near[at] = rng.choice(words)
        a, b = ({" ".join(t[i : i + 5]) for i in range(n - 4)} for t in (text, near))
        rows.append((2 * k, " ".join(text)))
        if len(a & b) >= 0.8 * len(a | b):
            similar += 1
            rows.append((2 * k + 1, " ".join(near)))
    kept = {r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept >= {2 * k for k in range(300)} and similar > 150
    assert len(kept) - 300 <= 0.1 * similar


def edited(rng, text, share):
    """The words of a text, so many of them changed."""
    words = text.split()
    for at in rng.sample(range(len(words)), int(share * len(words))):
        words[at] = rng.choice("abcdefghij") * 3
    return " ".join(words)


@pytest.mark.parametrize("limit", [3, 7, 1000])
def test_keep_one_is_the_brute_force(spark, limit):
    """Chains and groups of copies around the threshold, in blocks of any size."""
    rng = random.Random(limit)
    words = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(300)]
    texts = [" ".join(rng.choices(words, k=120)) for _ in range(12)]
    for _ in range(60):
        texts.append(edited(rng, rng.choice(texts), rng.choice([0, 0.01, 0.02, 0.03, 0.05])))
    texts += [None, "", "   ", "two words"]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), pair_limit=limit)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(copies_of(dict(rows)).values()))


def test_similar_forest_connects_all_similar_pairs():
    rng = np.random.default_rng(3)
    centres = rng.integers(-(1 << 62), 1 << 62, (6, simhash.LANES))
    bits = centres[rng.integers(0, 6, 300)]
    for row in bits:
        for at in rng.integers(0, 64 * simhash.LANES, rng.integers(80, 130)).tolist():
            row[at // 64] ^= simhash.signed(1 << at % 64)
    rows = np.column_stack([np.arange(300) * 10, rng.integers(90, 110, 300), bits])
    nodes = {int(r[0]): (int(r[1]), sum((int(x) % (1 << 64)) << 64 * k for k, x in enumerate(r[2:]))) for r in rows}
    wanted = classes({i: (i, p) for i, p in nodes.items()}, near=lambda a, b: similarity_of(a[1], b[1]) >= 0.78)
    root = {i: i for i in nodes}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    found = simhash.similar_forest(rows, 0.78)
    for a, b in found.tolist():
        root[max(find(a), find(b))] = min(find(a), find(b))
    assert {i: find(i) for i in nodes} == wanted and 6 < len(set(wanted.values())) < 200
    assert len(found) == 300 - len(set(wanted.values()))


def test_sketches_estimate_similarity():
    rng = random.Random(6)
    errors = []
    for _ in range(60):
        text = " ".join("".join(rng.choices("abcdef", k=6)) for _ in range(300))
        sets = [set(shingles_of(t, 5)) for t in (text, edited(rng, text, 0.02))]
        a, b = (np.frombuffer(simhash.sketch(np.fromiter(s, np.uint64)), np.uint64) for s in sets)
        estimate = simhash.estimated(int(np.bitwise_count(a ^ b).sum()), len(sets[0]), len(sets[1]))
        errors.append(estimate - len(sets[0] & sets[1]) / len(sets[0] | sets[1]))
    assert abs(np.mean(errors)) < 0.015 and np.std(errors) < 0.04


def test_keep_one_of_repeated_rows_and_long_texts(spark):
    long_text = " ".join(f"w{k % 5000}" for k in range(400_000))
    rows = [(1, "same text of these rows")] * 3 + [(None, "rows without an id")] * 2 + [(4, long_text), (3, long_text + " end"), (1, "other words under an id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as fp", "2 as node", "3 as k1")
    kept = simhash.keep_one(df)
    assert sorted((r["doc_id"] or 0, len(r["text"])) for r in kept.collect()) == [(0, 18), (1, 23), (1, 23), (3, len(long_text) + 4)]
    assert kept.columns == df.columns
