"""The pipeline's rows against plain Python versions of its stages, one after the other."""

import hashlib
import random
from collections import Counter

import pytest
from test_dedup import copies_of, line_model
from test_filters import draw_of, features_of, posteriors_of
from test_tokens import library

import corpus_pipeline
from indexloom.llm import quality
from indexloom.llm.common import materialize

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(8)
    words = "the of and to house tree water light green stone river cloud paper wind glass bread".split()
    shared = ["This very passage stands in more documents than one would like to see"] + ["the of and to be"]
    texts = []
    for k in range(120):
        lines = [" ".join(rng.choices(words, k=rng.randrange(8, 30))) for _ in range(rng.randrange(2, 6))]
        if k % 4 == 0:
            lines.insert(rng.randrange(len(lines)), shared[0])
        texts.append("\n".join([*lines, shared[1]]))
    texts += [texts[3]] * 10 + [texts[5].upper().lower() + "."] + [" ".join(["###"] * 50), "spam " * 60, "tiny", "", None]
    return [(i, t, "en", ["a", "a", "b", None][i % 4], len(t or "")) for i, t in enumerate(texts)]


def votes_of(features):
    names = dict(zip(quality.FEATURES, features))
    out = ""
    for bad, good in quality.RULES.values():
        bad, good = (r.replace("between 3 * n_words and 9 * n_words", ">= 3 * n_words and word_chars <= 9 * n_words") for r in (bad, good))
        out += "0" if eval(bad, {}, names) else "2" if eval(good, {}, names) else "1"
    return out


def model(rows):
    features = {r[0]: features_of(r[1]) for r in rows}
    patterns = {i: votes_of(f) for i, f in features.items()}
    good = posteriors_of(Counter(patterns.values()), quality.ROUNDS)
    rows = [r for r in rows if not (features[r[0]][0] < 20 or 100 * features[r[0]][4] > 30 * features[r[0]][0]) and good[patterns[r[0]]] >= 0.5]
    texts = {i: t for i, _, _, t in line_model([(r[0], r[1]) for r in rows])}
    heads = copies_of(texts)
    rows = [(*r[:1], texts[r[0]], *r[2:4]) for r in rows if heads[r[0]] == r[0]]
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(r[1].encode())
    targets = {s: n**0.5 for s, n in sizes.items()}
    out = Counter()
    for i, text, _, source in rows:
        u = (int(hashlib.md5(f"poisson17|{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        n = draw_of(u, targets[source] / sum(targets.values()) * sum(sizes.values()) / sizes[source])
        ids, decoded = library("word_bpe_49k.json", [text], decode=True)
        if n:
            out[i, tuple(ids[0]), hashlib.sha256(decoded[0].encode()).hexdigest()] += n
    return out


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(corpus(), COLUMNS).write.parquet(str(folder / "documents.parquet"))
    return str(folder)


def test_rows(spark, docs):
    got = Counter((r["doc_id"], tuple(r["ids"]), r["decoded_sha256"]) for r in corpus_pipeline.run(spark, docs).collect())
    assert got == model(corpus())


def test_stages_keep_the_columns(spark, docs):
    table = spark.read.parquet(f"{docs}/documents.parquet")
    before = table.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        table = materialize(stage(spark, table, docs), name)
        assert table.columns == [c.split()[0] for c in COLUMNS.split(", ")], name
        assert [f.dataType.simpleString() for f in table.schema] == ["bigint", "string", "string", "string", "bigint"]
    assert 0 < table.count() < 2 * before
    assert table.where("n_chars <> char_length(text)").count() == 0


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
