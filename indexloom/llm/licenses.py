"""License scans by diagonal voting.

All rolling word k-gram hashes of all documents are joined to the template positions that have the same
k-gram. A hit votes for the diagonal (its position in the document less its position in the template);
votes are summed by text, template and diagonal, so that what is shuffled is the hits, not the grams.
Neighbouring diagonals are merged, which bridges a few inserted or missing words. A merged span is a candidate
if its hits cover enough of the template and it is not much longer than it.

Candidates are verified word for word: each goes back to its text, and its score is the longest common
subsequence of the span's and the template's words, as a share of the template's.

Texts are told apart by a hash of 128 bits, not by their ids: rows that share an id, or have none, get their
own labels, and equal texts the same. Templates of any length are a parameter; their table is broadcast while it has
`BROADCAST_ROWS` rows or fewer, as are the candidates, and shuffled beyond. Texts of any length are hashed in
segments and scanned in one pass for phrases.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, materialize

K = 3
BROADCAST_ROWS = 100_000
SEGMENT = 1 << 20  # bytes of a text that are hashed at once
ROWS = 200_000  # grams in one Arrow batch

# Phrases and their labels: fixed values of the query
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Customary notices and the licenses they name: fixed values
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", """
        licensed under the apache license version 2 0 the license you may not use this file except in compliance with
        the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by
        applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
        without warranties or conditions of any kind either express or implied see the license for the specific
        language governing permissions and limitations under the license"""),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-2-clause", """
        redistribution and use in source and binary forms with or without modification are permitted provided that the
        following conditions are met 1 redistributions of source code must retain the above copyright notice this list
        of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright
        notice this list of conditions and the following disclaimer in the documentation and or other materials
        provided with the distribution this software is provided by the copyright holders and contributors as is and
        any express or implied warranties including but not limited to the implied warranties of merchantability and
        fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be
        liable for any direct indirect incidental special exemplary or consequential damages including but not limited
        to procurement of substitute goods or services loss of use data or profits or business interruption however
        caused and on any theory of liability whether in contract strict liability or tort including negligence or
        otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"""),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-4.0", "licensed under cc by 4 0"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3.0", """
        this program is free software you can redistribute it and or modify it under the terms of the gnu general public
        license as published by the free software foundation either version 3 of the license or at your option any
        later version this program is distributed in the hope that it will be useful but without any warranty without
        even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public
        license for more details"""),
    ("mit", "released under the mit license"),
    ("mit", """
        permission is hereby granted free of charge to any person obtaining a copy of this software and associated
        documentation files the software to deal in the software without restriction including without limitation the
        rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit
        persons to whom the software is furnished to do so subject to the following conditions the above copyright
        notice and this permission notice shall be included in all copies or substantial portions of the software the
        software is provided as is without warranty of any kind express or implied including but not limited to the
        warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the
        authors or copyright holders be liable for any claim damages or other liability whether in an action of
        contract tort or otherwise arising from out of or in connection with the software or the use or other dealings
        in the software"""),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
]

# Lower-cases A-Z, keeps digits, a-z and all bytes of non-ASCII characters, makes the rest spaces
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
BASE = 0x9E3779B97F4A7C15  # an odd multiplier: 2^64 over the golden ratio


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.full(n, BASE, np.uint64))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word of a text."""
    data, out, at = text.translate(WORD_BYTES), [], 0
    while at < len(data):
        stop = len(data) if len(data) - at <= SEGMENT else data.find(b" ", at + SEGMENT)
        stop = len(data) if stop < 0 else stop
        part = np.frombuffer(data, np.uint8, stop - at, at)
        at = stop
        letter = part != 32
        first = letter.copy()
        first[1:] &= ~letter[:-1]
        letters = part[letter].astype(np.uint64)
        starts = np.flatnonzero(first[letter])
        if len(starts):
            sizes = np.diff(starts, append=len(letters))
            place = np.arange(len(letters)) - np.repeat(starts, sizes)
            terms = (letters + np.uint64(1)) * _powers(int(sizes.max()))[place]
            out.append(_mixed(np.add.reduceat(terms, starts) + sizes.astype(np.uint64)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def gram_hashes(words: np.ndarray, k: int = K) -> np.ndarray:
    """The hash of each k words in a row, as long."""
    n = max(0, len(words) - k + 1)
    total = np.zeros(n, np.uint64)
    for j, weight in enumerate(_powers(k)):
        total += words[j : j + n] * weight
    return _mixed(total).view(np.int64)


def _keyed(docs: DataFrame, text_col: str) -> list:
    """The 128-bit key of a text, as two columns; a null text counts as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("text"), text).alias("k2")]


def gram_table(docs: DataFrame, text_col: str, k: int) -> DataFrame:
    """(k1, k2, pos, gram) of every k words in a row of every text."""

    def task(batches):
        for batch in batches:
            keys, held, size = [c.to_numpy() for c in batch.columns[:2]], [], 0
            for row, text in enumerate(batch.column(2).cast(pa.binary())):
                grams = gram_hashes(word_hashes(text.as_py() or b""), k)
                for at in range(0, len(grams), ROWS):
                    held.append((row, at, grams[at : at + ROWS]))
                    size += len(held[-1][2])
                    if size >= ROWS:
                        yield packed(keys, held)
                        held, size = [], 0
            if held:
                yield packed(keys, held)

    def packed(keys, held):
        rows = np.repeat([row for row, _, _ in held], [len(g) for _, _, g in held])
        places = [np.arange(at, at + len(g), dtype=np.int32) for _, at, g in held]
        columns = [keys[0][rows], keys[1][rows], np.concatenate(places), np.concatenate([g for _, _, g in held])]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["k1", "k2", "pos", "gram"])

    slim = docs.select(*_keyed(docs, text_col), F.col(text_col).alias("text"))
    return slim.mapInArrow(task, "k1 long, k2 long, pos int, gram long")


def template_table(spark: SparkSession, templates: list[tuple[str, str]], k: int) -> tuple[DataFrame, int]:
    """(template, words, at, gram), and its number of rows."""
    rows = []
    for t, (_, text) in enumerate(templates):
        n = len(words_of(text.encode()))
        if n < k:
            raise ValueError(f"a template has {k} words at least: {text}")
        for at, gram in enumerate(gram_hashes(word_hashes(text.encode()), k).tolist()):
            rows.append((t, n, at, gram))
    return spark.createDataFrame(rows, "template int, words int, at int, gram long"), len(rows)


def candidates(
    docs: DataFrame, templates: list[tuple[str, str]], k: int = K, cover: float = 0.75, drift: int = 2, text_col: str = "text"
) -> DataFrame:
    """(k1, k2, template, first, last) of each merged span whose hits cover enough of its template.

    Diagonals are merged if `drift` words apart or less. A span is at most half as long again as its template.
    """
    table, n = template_table(docs.sparkSession, templates, k)
    if n <= BROADCAST_ROWS:
        table = F.broadcast(table)
    hits = gram_table(docs, text_col, k).join(table, "gram")
    own = ["k1", "k2", "template", "words"]
    votes = hits.groupBy(*own, (F.col("pos") - F.col("at")).alias("diagonal")).agg(
        F.collect_set("at").alias("ats"), F.min("pos").alias("first"), (F.max("pos") + (k - 1)).alias("last"),
    )
    near = Window.partitionBy("k1", "k2", "template").orderBy("diagonal")
    fresh = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(near)) > drift, F.lit(True)).cast("int")
    spans = votes.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(near)).groupBy(*own, "island").agg(
        F.array_distinct(F.flatten(F.collect_list("ats"))).alias("ats"), F.min("first").alias("first"), F.max("last").alias("last")
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform("ats", lambda at: F.sequence(at, at + (k - 1))))))
    fits = (covered >= F.lit(cover) * F.col("words")) & (2 * (F.col("last") - F.col("first") + 1) <= 3 * F.col("words"))
    return spans.where(fits).select("k1", "k2", "template", "first", "last")


def common_words(span: list[bytes], masks: dict[bytes, int], n: int) -> int:
    """The longest common subsequence of a span and a template of n words, by bits of one number a word.

    masks: for each word of the template, the places where it stands.
    """
    full = (1 << n) - 1
    row = full
    for word in span:
        if here := masks.get(word, 0) & row:
            row = ((row + here) | (row - here)) & full
    return n - row.bit_count()


def phrase_places(line: bytes, keys: list[tuple[bytes, str]]) -> tuple[int, int | None, int | None, list[str]]:
    """(places, first, last, labels) of phrases in words joined by single spaces, with one around."""
    n, first, last, labels = 0, len(line), -1, set()
    for key, label in keys:
        at = line.find(key)
        if at >= 0:
            first = min(first, at)
            labels.add(label)
        while at >= 0:
            n, last = n + 1, max(last, at)
            at = line.find(key, at + 1)
    if not n:
        return 0, None, None, []
    start = line.count(b" ", 0, first)
    return n, start, start + line.count(b" ", first, last), sorted(labels)


def scan_licenses(
    docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES, cover: float = 0.75,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(id_col, n_words, n_base, first_word, last_word, base_labels, labels, score, spans) for every row.

    spans: an array of (label, template, first, last, score) of the verified spans, words counted from 0, in
    order of their place; score, `cover` or more: the share of the template's words that stand in the span in
    order. labels: those of the phrases and of the spans. The row's score is the best span's, 0 without one. A
    null or empty text has no words. Rows that share an id are told apart; an empty table gives no rows.
    """
    found = materialize(candidates(docs, templates, cover=cover, text_col=text_col), "candidates")
    lists = found.groupBy("k1", "k2").agg(F.sort_array(F.collect_list(F.struct("first", "last", "template"))).alias("spans"))
    lists = materialize(lists, "candidates")
    discard(found)
    few = lists.count() <= BROADCAST_ROWS
    keys = [(b" " + p.encode() + b" ", label) for p, label in phrases.items()]
    labels = [label for label, _ in templates]
    forms = []
    for _, text in templates:
        masks: dict[bytes, int] = {}
        words = words_of(text.encode())
        for at, word in enumerate(words):
            masks[word] = masks.get(word, 0) | 1 << at
        forms.append((masks, len(words)))
    span = pa.struct([("label", pa.string()), ("template", pa.int32()), ("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64())])
    kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.float64(), pa.list_(span)]
    names = ["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]

    def judged(text: bytes, spans) -> tuple:
        words = words_of(text)
        n, first, last, base = phrase_places(b" " + b" ".join(words) + b" ", keys)
        verified = []
        for s in spans or ():
            masks, size = forms[s["template"]]
            score = common_words(words[s["first"] : s["last"] + 1], masks, size) / size
            if score >= cover:
                verified.append((labels[s["template"]], s["template"], s["first"], s["last"], score))
        both = sorted({*base, *(v[0] for v in verified)})
        best = max((v[4] for v in verified), default=0.0)
        return len(words), n, first, last, ",".join(base), ",".join(both), best, verified

    def task(batches):
        for batch in batches:
            rows = [judged(t.as_py() or b"", s.as_py()) for t, s in zip(batch.column(1).cast(pa.binary()), batch.column(2))]
            if rows:
                columns = [batch.column(0), *[pa.array(c, t) for c, t in zip(zip(*rows), kinds)]]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *_keyed(docs, text_col))
    joined = slim.join(F.broadcast(lists) if few else lists, ["k1", "k2"], "left").select("id", "text", "spans")
    fields = (
        f"id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
        "score double, spans array<struct<label: string, template: int, first: long, last: long, score: double>>"
    )
    return joined.mapInArrow(task, fields).withColumnRenamed("id", id_col)
