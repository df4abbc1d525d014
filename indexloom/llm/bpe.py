"""BPE encoding by dynamic programming over prefixes, and decoding.

For each prefix of a word the encoding of that prefix ends in exactly one token. An automaton over the
vocabulary gives the tokens that end at the prefix's last character; such a token is the right one just
if it stands alone, or if it is compatible with the last token of the prefix before it: merging the two
side by side leaves both as they are. Storing that token for every prefix costs one step a character,
and following the tokens back from the end gives the ids that the merge rules give.

Compatible: both tokens are built by merges of rising rank. Between the pieces that face each other at
the boundary a merge would come first if its rank is below that of the next merge inside the left token
(left occurrences of one rule go first, hence "below"), and at or below the next inside the right one.

What a worker keeps is bounded in number and in size. A null text counts as empty; ids may be null or repeat,
and each row has its own result; texts are encoded whole, one at a time. An empty table gives no rows.

The vocabulary's path is a parameter; `end` (such as "</w>") marks tokens that end a word.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

END = "\x00"  # stands for the end-of-word mark; no symbol of the byte alphabet
NEVER = 1 << 60
KEPT = 300_000  # chunks and words that a worker keeps, and pairs of tokens
SHORT = 64  # characters of a chunk or word that is kept: longer ones hardly recur
ODD = re.compile("[\x1c-\x1f]")  # white space to str.split, not to the pre-tokenizer
# Characters that every Unicode version since 5 classes alike; other texts are split up by the library.
PLAIN = re.compile("[\0-\u02ff\u0391-\u03a1\u03a4-\u03ce\u0400-\u0481\u048a-\u0513\u2010-\u2027\u2030-\u205e\u20a0-\u20b5\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fbb\uac00-\ud7a3]*")


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: itself if printable in Latin-1, else the next from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class PairMerges:
    """The merge rules of a vocabulary, and the encoding of single words by them."""

    def __init__(self, vocab: dict[str, int], merges: list, end: str = ""):
        self.end = end
        form = (lambda t: t[: -len(end)] + END if end and t.endswith(end) else t)
        self.ids = {form(t): i for t, i in vocab.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}  # by token: rank, left, right
        for rank, merge in enumerate(merges):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            a, b, whole = (self.ids[form(t)] for t in (left, right, left + right))
            self.rank[a, b] = rank
            if whole not in self.made:
                self.made[whole] = (rank, a, b)
        self.match = ahocorasick.Automaton()
        for text, i in self.ids.items():
            self.match.add_word(text, (len(text), i))
        self.match.make_automaton()
        self._facing: tuple[dict, dict] = ({}, {})
        self._fits: dict[tuple[int, int], bool] = {}
        self._whole: dict[int, bool] = {}

    def facing(self, token: int, side: int) -> list[tuple[int, int]]:
        """The pieces at a token's left (0) or right (1) edge, smallest first, each with the rank that ends it."""
        known = self._facing[side]
        if token not in known:
            chain, piece, until = [], token, NEVER
            while True:
                chain.append((piece, until))
                if piece not in self.made:
                    break
                until, piece = self.made[piece][0], self.made[piece][1 + side]
            known[token] = chain[::-1]
        return known[token]

    def _meet(self, left: int, right: int, limit: int = NEVER) -> bool:
        """Whether no merge across the boundary of two tokens comes before `limit`."""
        a, b = self.facing(left, 1), self.facing(right, 0)
        i = j = 0
        while True:
            (x, x_until), (y, y_until) = a[i], b[j]
            rank = self.rank.get((x, y))
            if rank is not None and rank < x_until and rank <= y_until and rank < limit:
                return False
            if x_until == y_until == NEVER:
                return True
            if x_until <= y_until:
                i += 1
            else:
                j += 1

    def fits(self, left: int, right: int) -> bool:
        known = self._fits.get((left, right))
        if known is None:
            known = self._meet(left, right)
            if len(self._fits) < KEPT:
                self._fits[left, right] = known
        return known

    def whole(self, token: int) -> bool:
        """Whether the merges turn the token's own text into this token."""
        known = self._whole.get(token)
        if known is None:
            known = True
            if token in self.made:
                rank, left, right = self.made[token]
                known = self.whole(left) and self.whole(right) and self._meet(left, right, rank)
            self._whole[token] = known
        return known

    def encode(self, word: str) -> list[int]:
        """The ids of one word of the byte alphabet."""
        if self.end:
            word += END
        n = len(word)
        last: list[int] = [-1] * n
        back: list[int] = [-1] * n
        fits, whole, known = self.fits, self.whole, self._fits
        for stop, (size, token) in self.match.iter(word):
            if last[stop] >= 0:
                continue
            before = stop - size
            if before < 0:
                good = whole(token)
            else:
                prior = last[before]
                if prior < 0:
                    continue
                good = known.get((prior, token))
                if good is None:
                    good = whole(token) and fits(prior, token)
            if good:
                last[stop], back[stop] = token, before
        out, at = [], n - 1
        while at >= 0:
            out.append(last[at])
            at = back[at]
        return out[::-1]


class WordCodec:
    """Encoding and decoding with a tokenizer file whose pre-tokenizer drops white space.

    Normalisation: composed characters (NFC), lower case character by character. Words: what the
    file's pattern finds. The file's added tokens are found in the raw text first. Texts with rare
    characters are normalised and split by the library, whose Unicode version may be another.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        model = data["model"]
        self.merges = PairMerges(model["vocab"], model["merges"], model["end_of_word_suffix"] or "")
        self.added = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.path, self.library = path, None
        self.fence = re.compile("(" + "|".join(map(re.escape, self.added)) + ")")
        self.words = regex.compile(data["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.alphabet = byte_alphabet()
        names = {i: t for t, i in [*model["vocab"].items(), *self.added.items()]}
        self.names = [names[i].encode() if i in names else b"" for i in range(max(names) + 1)]
        self.chunks: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        ids = self.known.get(word)
        if ids is None:
            letters = self.alphabet
            ids = np.array(self.merges.encode("".join([letters[b] for b in word.encode()])), "<u4").tobytes()
            if len(word) <= SHORT and len(self.known) < KEPT:
                self.known[word] = ids
        return ids

    def _chunk(self, chunk: str) -> bytes:
        word = self._word
        ids = word(chunk) if chunk.isascii() and chunk.isalpha() else b"".join(map(word, self.words.findall(chunk)))
        if len(chunk) <= SHORT and len(self.chunks) < KEPT:
            self.chunks[chunk] = ids
        return ids

    def _rare(self, text: str) -> bytes:
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        text = self.library.normalizer.normalize_str(text)
        words = [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]
        return b"".join([np.array(self.merges.encode(w), "<u4").tobytes() for w in words])

    def _plain(self, text: str) -> bytes:
        if not text.isascii():
            if not PLAIN.fullmatch(text):
                return self._rare(text)
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            text = text.lower()
        else:
            text = text.lower()
        if ODD.search(text):
            return b"".join(map(self._word, self.words.findall(text)))
        known, new = self.chunks, self._chunk
        parts = text.split()
        try:
            return b"".join(map(known.__getitem__, parts))
        except KeyError:
            return b"".join([known.get(p) or new(p) for p in parts])

    def encode(self, text: str) -> np.ndarray:
        """The ids of one text, as unsigned 32-bit integers."""
        if "<" in text and self.fence.search(text):
            parts = self.fence.split(text)
            raw = b"".join(
                np.uint32(self.added[p]).tobytes() if k % 2 else self._plain(p) for k, p in enumerate(parts)
            )
        else:
            raw = self._plain(text)
        return np.frombuffer(raw, "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens' texts with a space between, as UTF-8: what the file's decoder (none) gives."""
        return b" ".join(map(self.names.__getitem__, ids.tolist()))


@lru_cache(2)
def codec(path: str) -> WordCodec:
    return WordCodec(path)


def encode_decode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids, decoded) for every row; a null text counts as empty."""
    return _coded(docs, tokenizer, id_col, text_col, "ids array<int>, decoded string", _lists)


def coded_digests(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256): digests of what encode_decode gives, made in its tasks."""
    return _coded(docs, tokenizer, id_col, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string", _digests)


def encode_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, ids, decoded_sha256): the ids, and a digest of the text that they decode to."""
    return _coded(docs, tokenizer, id_col, text_col, "n_tokens long, ids array<int>, decoded_sha256 string", _kept)


def _kept(coded):
    rows = [(len(ids), ids.astype(np.int32), hashlib.sha256(text).hexdigest()) for ids, text in coded]
    return [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.list_(pa.int32()), pa.string()))]


def _lists(coded):
    ids, texts = zip(*coded)
    return [pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())), pa.array([t.decode() for t in texts])]


def _digests(coded):
    sha = hashlib.sha256
    rows = [(len(ids), sha(ids.tobytes()).hexdigest(), sha(text).hexdigest()) for ids, text in coded]
    return [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.string()))]


def _coded(docs, tokenizer, id_col, text_col, fields, form):
    def task(batches):
        code = codec(tokenizer)
        for batch in batches:
            def pairs():
                for text in batch.column(1):
                    ids = code.encode(text.as_py() or "")
                    yield ids, code.decode(ids)

            if batch.num_rows:
                columns = [batch.column(0), *form(pairs())]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    names = ["id", *[f.split()[0] for f in fields.split(", ")]]
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(task, f"id {kind}, {fields}").withColumnRenamed("id", id_col)
