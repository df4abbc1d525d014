import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from indexloom.llm import bpe, tokenfiles
from indexloom.llm.common import tokenizer_path

LETTERS = "abc xyz'sdtrellvem 12 ,.!?-\n\t\u00a0éèßÄÖİΣς½²Ⅷ日本语한국어\u0301\u200d\x1c\x85🙂<|>٣\u0000\u0558"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    out = ["".join(rng.choices(LETTERS, k=rng.randrange(60))) for _ in range(3000)]
    out += ["", " ", "  lead", "trail  ", "\n\n x", "a <|endoftext|> b<|startoftext|>", "<|endoftext|>", "a" * 3000, "it's WE'LL i'd", " \n word"]
    return out + [chr(c) + "a " + chr(c) for c in range(0x3000) if c % 3 == 0]


def library(name, texts, decode=False):
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(tokenizer_path(name))
    ids = [e.ids for e in tool.encode_batch(texts, add_special_tokens=False)]
    return ids, [tool.decode(x, skip_special_tokens=False) for x in ids] if decode else None


def test_prefix_tables_give_the_library_s_ids(texts):
    ids, decoded = library("word_bpe_49k.json", texts, decode=True)
    code = bpe.WordCodec(tokenizer_path("word_bpe_49k.json"))
    for text, want, back in zip(texts, ids, decoded):
        got = code.encode(text)
        assert got.tolist() == want, text
        assert code.decode(got).decode() == back, text


def merged(word, merges):
    """The merge rules applied one by one: best rank first, leftmost first."""
    parts = list(word)
    while True:
        ranks = [(merges[p], k) for k, p in enumerate(zip(parts, parts[1:])) if p in merges]
        if not ranks:
            return parts
        _, k = min(ranks)
        parts[k : k + 2] = ["".join(parts[k : k + 2])]


@pytest.mark.parametrize("seed", range(4))
def test_prefix_tables_against_merging(seed):
    rng = random.Random(seed)
    vocabulary, merges = list("abc"), []
    while len(vocabulary) < 40:
        pair = rng.choice(vocabulary), rng.choice(vocabulary)
        if "".join(pair) not in vocabulary and len("".join(pair)) < 9:
            merges.append(pair)
            vocabulary.append("".join(pair))
    tool = bpe.PairMerges({t: i for i, t in enumerate(vocabulary)}, [list(m) for m in merges])
    ranks = {m: k for k, m in enumerate(merges)}
    for _ in range(1500):
        word = "".join(rng.choices("abc", k=rng.randrange(1, 25)))
        assert [vocabulary[i] for i in tool.encode(word)] == merged(word, ranks), word


def test_round_trip_on_spark(spark, texts):
    few = [*texts[:200], None, texts[3]]
    df = spark.createDataFrame(list(enumerate(few)), "doc_id long, text string").withColumn("id", F.lit(1)).withColumn("ids", F.lit(2))
    ids, decoded = library("word_bpe_49k.json", [t or "" for t in few], decode=True)
    path = tokenizer_path("word_bpe_49k.json")
    rows = {r["doc_id"]: r for r in bpe.encode_decode(df, path).collect()}
    assert all(rows[i]["ids"] == ids[i] and rows[i]["decoded"] == decoded[i] for i in range(len(few)))
    for r in bpe.coded_digests(df, path).collect():
        raw = np.array(ids[r["doc_id"]], "<u4").tobytes()
        assert r["n_tokens"] == len(raw) // 4 and r["ids_sha256"] == hashlib.sha256(raw).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(decoded[r["doc_id"]].encode()).hexdigest()
    assert bpe.encode_decode(df.limit(0), path).count() == 0


def test_long_words_are_not_kept_and_caches_are_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "KEPT", 50)
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randrange(3, 12))) for _ in range(800)]
    text = " ".join(words) + " " + "x1" * 5000
    code = bpe.WordCodec(tokenizer_path("word_bpe_49k.json"))
    assert code.encode(text).tolist() == library("word_bpe_49k.json", [text])[0][0]
    assert len(code.known) <= 50 and len(code.chunks) <= 50 and len(code.merges._fits) <= 50
    assert max(map(len, [*code.known, *code.chunks])) <= bpe.SHORT
    parts = tokenfiles.PartEncoder(tokenizer_path("byte_bpe_50k.json"))
    assert np.frombuffer(parts.encode(text), "<i4").tolist() == library("byte_bpe_50k.json", [text])[0][0]
    assert max(map(len, [*parts.rest, *parts.words])) <= bpe.SHORT


def test_round_trip_of_null_and_repeated_ids(spark):
    rows = [(None, "a b"), (None, "a b"), (1, "c"), (1, "d e"), (1, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = [(r["doc_id"], r["decoded"]) for r in bpe.encode_decode(df, tokenizer_path("word_bpe_49k.json")).collect()]
    assert sorted(found, key=str) == sorted(
        [(i, library("word_bpe_49k.json", [t or ""], decode=True)[1][0]) for i, t in rows], key=str
    )


def test_part_encoder_gives_the_library_s_ids(texts):
    ids, _ = library("byte_bpe_50k.json", texts)
    code = tokenfiles.PartEncoder(tokenizer_path("byte_bpe_50k.json"))
    for text, want in zip(texts, ids):
        assert np.frombuffer(code.encode(text), "<i4").tolist() == want, text


def test_token_files(spark, texts, tmp_path):
    few = [*texts[:300], None, ""]
    rows = [(i * 7 % 302, t) for i, t in enumerate(few)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("part", F.lit(1)).withColumn("tokens", F.lit(2))
    path = str(tmp_path / "tokens")
    tokenfiles.write_tokens(df, path, tokenizer_path("byte_bpe_50k.json"), end_id=0)
    want, _ = library("byte_bpe_50k.json", [t or "" for _, t in sorted(rows, key=lambda r: r[0])])
    got = {r["doc_id"]: r for r in tokenfiles.token_digests(tokenfiles.read_tokens(spark, path)).collect()}
    start = 0
    for doc, ids in zip(sorted(got), want):
        raw = np.array([*ids, 0], "<u4")
        assert tuple(got[doc]) == (doc, start, len(raw), zlib.crc32(raw.tobytes()))
        start += len(raw)
    assert len(got) == 302


def test_token_files_are_selective(spark, tmp_path):
    import pyarrow.parquet as pq

    rows = [(i, f"document {i} " * 40) for i in range(8000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    path = str(tmp_path / "tokens")
    tokenfiles.write_tokens(df, path, tokenizer_path("byte_bpe_50k.json"))
    meta = pq.read_metadata(next((tmp_path / "tokens").glob("part-*.parquet")))
    columns = {meta.row_group(0).column(k).path_in_schema: meta.row_group(0).column(k) for k in range(meta.num_columns)}
    tokens = next(c for name, c in columns.items() if name.startswith("tokens"))
    assert "RLE_DICTIONARY" in tokens.encodings and tokens.has_offset_index and tokens.compression == "ZSTD"
    assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings and columns["doc_id"].has_column_index
    sizes = [meta.row_group(k).total_byte_size for k in range(meta.num_row_groups)]
    assert max(sizes) <= 33 << 20 and sum(meta.row_group(k).num_rows for k in range(meta.num_row_groups)) == 8000
    plan = tokenfiles.read_tokens(spark, path).where("doc_id = 17").select("n_tokens")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(doc_id,17)" in plan and "tokens:array" not in plan


def test_empty_token_files_and_repeats(spark, tmp_path):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (None, "c"), (1, "a")], "doc_id long, text string")
    path = tokenizer_path("byte_bpe_50k.json")
    tokenfiles.write_tokens(df, str(tmp_path / "few"), path)
    starts = sorted(r["start"] for r in tokenfiles.read_tokens(spark, str(tmp_path / "few")).collect())
    assert starts == [0, 2, 4, 6]
    tokenfiles.write_tokens(df.limit(0), str(tmp_path / "none"), path)
    assert tokenfiles.token_digests(tokenfiles.read_tokens(spark, str(tmp_path / "none"))).count() == 0
