"""Byte-level BPE encoding and decoding; merges are found by a segment tree over the ranks of adjacent pairs.

A text is cut at the special tokens of the vocabulary file and then into pre-tokens. Leaf i of a pre-token's tree holds
the rank of the pair that begins at byte i (with i, so that the left one wins a tie); the root is the next merge. A merge
changes three leaves, each in time logarithmic in the length of the pre-token, until no pair of the list remains. Equal
pre-tokens are merged once for each task as long as its store of bounded size holds them. The trees of the short
pre-tokens that are new in a run of texts stand in one array each width and take their merges together, round by round.

Defined results: null text = empty text, which has no ids; one row for each input row, also with null or repeated ids; an
empty table gives no rows; other columns are ignored. `ids` holds little-endian unsigned 32-bit numbers.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textops import groups, slices

#: Bytes of the pre-tokens that a Python worker remembers (each counts for 32 more).
STORE = 24_000_000
#: The pre-tokenization of a byte-level vocabulary, for ASCII and the letters of Latin-1.
_LETTERS = rb"A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff"
_PRETOKEN = re.compile(rb"'(?:s|t|re|ve|m|ll|d)| ?[" + _LETTERS + rb"]+| ?[0-9]+| ?[^\s0-9" + _LETTERS + rb"]+|\s+(?!\S)|\s+")
#: Bytes for which these classes hold; texts with other characters are cut by the library's own pre-tokenizer.
_KNOWN = bytes(c for c in range(256) if c < 0x80 and not 0x1C <= c <= 0x1F or c >= 0xC0 and c not in (0xD7, 0xF7))
#: The settings of a vocabulary file for which these rules hold.
_RULES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
#: Bytes that a byte-level vocabulary writes as themselves; the others follow from 256 on.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_SIGNS = {b: chr(b) for b in _PLAIN} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in set(_PLAIN))}
_BYTES = {sign: b for b, sign in _SIGNS.items()}
_SHIFT = 32
#: Pre-tokens of up to so many bytes are merged in arrays; longer ones, however long, have a tree of their own.
SHORT = 32
_NONE = np.int64(1) << 40


class ByteBpe:
    """Vocabulary, merge ranks and special tokens of a byte-level vocabulary file."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        with open(path, encoding="utf-8") as f:
            settings = json.load(f)
        vocab, merges = settings["model"]["vocab"], settings["model"]["merges"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.rank = {vocab[a] << _SHIFT | vocab[b]: k for k, (a, b) in enumerate(pairs)}
        self.made = [vocab[a + b] for a, b in pairs]
        self.pairs = np.array(sorted(self.rank), np.int64)
        self.ranks, self.made_ids = np.array([self.rank[x] for x in self.pairs.tolist()], np.int64), np.array(self.made, np.int64)
        self.byte_ids = [vocab[_SIGNS[b]] for b in range(256)]
        self.special = {t["content"]: t["id"] for t in settings["added_tokens"]}
        self.cut_special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.table = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in {**vocab, **self.special}.items():
            self.table[i] = bytes(_BYTES[c] for c in token) if all(c in _BYTES for c in token) else token.encode()
        if settings["pre_tokenizer"] != _RULES or settings["normalizer"] is not None:
            raise ValueError("the vocabulary file has other rules than byte-level ones without normalization")
        self.known: dict[bytes | str, bytes] = {}
        self.stored, self.path, self.library = 0, path, None

    def merged(self, data: bytes) -> list[int]:
        """Ids of one pre-token."""
        ids, n = [self.byte_ids[b] for b in data], len(data)
        if n < 2:
            return ids
        size, rank, none = 1 << (n - 1).bit_length(), self.rank.get, len(self.made) * n
        tree = [none] * (2 * size)
        for i in range(n - 1):
            r = rank(ids[i] << _SHIFT | ids[i + 1])
            if r is not None:
                tree[size + i] = r * n + i
        for k in range(size - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        while tree[1] < none:
            r, i = divmod(tree[1], n)
            j = after[i]
            k = after[i] = after[j]
            ids[i], ids[j] = self.made[r], -1
            if k < n:
                before[k] = i
            for left, right in ((i, k), (before[i], i), (j, n)):
                if left < 0:
                    continue
                r = rank(ids[left] << _SHIFT | ids[right]) if right < n else None
                value, at = none if r is None else r * n + left, size + left
                while at and tree[at] != value:
                    tree[at] = value
                    at >>= 1
                    value = min(tree[2 * at], tree[2 * at + 1]) if at else 0
        return [i for i in ids if i >= 0]

    def leaves(self, left: np.ndarray, right: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
        """Leaf values of pairs of ids that begin at `at`; -1 is no id."""
        key = left << _SHIFT | np.maximum(right, 0)
        k = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where((self.pairs[k] == key) & (right >= 0), self.ranks[k] * width + at, _NONE)

    def merged_together(self, words: list[bytes], width: int) -> list[bytes]:
        """Ids of each of many pre-tokens of at most `width` bytes (a power of two), one tree in each row."""
        n = len(words)
        size = np.fromiter(map(len, words), np.int64, n)
        ids = np.full((n, width + 1), -1, np.int64)  # column `width` is the end
        ids[np.arange(width + 1) < size[:, None]] = np.array(self.byte_ids, np.int64)[np.frombuffer(b"".join(words), np.uint8)]
        tree = np.full((n, 2 * width), _NONE)
        tree[:, width:] = self.leaves(ids[:, :-1].ravel(), ids[:, 1:].ravel(), np.tile(np.arange(width), n), width).reshape(n, width)
        for k in range(width.bit_length() - 2, -1, -1):
            below = tree[:, 2 << k : 4 << k]
            tree[:, 1 << k : 2 << k] = np.minimum(below[:, ::2], below[:, 1::2])
        after = np.tile(np.minimum(np.arange(1, width + 2), width), (n, 1))
        before = np.tile(np.arange(-1, width), (n, 1))
        rows = np.arange(n)
        while len(rows := rows[tree[rows, 1] < _NONE]):
            r, i = np.divmod(tree[rows, 1], width)
            j = after[rows, i]
            k = after[rows, j]
            ids[rows, i], ids[rows, j], after[rows, i], before[rows, k] = self.made_ids[r], -1, k, i
            h = before[rows, i]
            none = np.full(len(rows), _NONE)
            left = np.where(h < 0, none, self.leaves(ids[rows, h], ids[rows, i], h, width))
            node = width + np.stack([i, np.where(h < 0, j, h), j])
            tree[rows, node] = np.stack([self.leaves(ids[rows, i], ids[rows, k], i, width), left, none])
            for _ in range(width.bit_length() - 1):
                node >>= 1
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
        kept = ids >= 0
        data, ends = ids[kept].astype("<u4").tobytes(), (4 * np.cumsum(kept.sum(1))).tolist()
        return [data[x:y] for x, y in zip([0, *ends], ends, strict=False)]

    def pretokens(self, text: str) -> list[bytes | str]:
        """Of a text without special tokens: Latin-1 bytes, or the library's signs for texts with other characters."""
        try:
            data = text.encode("latin-1")
        except UnicodeEncodeError:
            data = None
        if data is not None and not data.translate(None, _KNOWN):
            return _PRETOKEN.findall(data)
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path).pre_tokenizer
        return [signs for signs, _ in self.library.pre_tokenize_str(text)]

    def learn(self, new: set[bytes | str]) -> None:
        by_width: dict[int, list[tuple[bytes | str, bytes]]] = {}
        for word in new:
            data = word.decode("latin-1").encode() if isinstance(word, bytes) else bytes(map(_BYTES.__getitem__, word))
            by_width.setdefault(1 << (len(data) - 1).bit_length(), []).append((word, data))
            self.stored += len(word) + 32
        for width, words in by_width.items():
            if width > SHORT:
                found = [np.array(self.merged(data), "<u4").tobytes() for _, data in words]
            else:
                found = self.merged_together([data for _, data in words], width)
            self.known.update(zip((w for w, _ in words), found, strict=True))

    def parts(self, text: str) -> list[tuple[list[bytes | str], bytes]]:
        """Pre-tokens up to each special token, and that token's id (nothing at the end)."""
        found, at = [], 0
        for m in self.cut_special.finditer(text) if self.cut_special else ():
            found.append((self.pretokens(text[at : m.start()]), np.array([self.special[m[0]]], "<u4").tobytes()))
            at = m.end()
        return [*found, (self.pretokens(text[at:] if at else text), b"")]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit numbers."""
        cuts = [self.parts(t or "") for t in texts]
        every = set().union(*(words for parts in cuts for words, _ in parts))
        if self.stored > STORE:
            self.known, self.stored = {}, 0
        self.learn(every.difference(self.known))
        ids_of = self.known.__getitem__
        return [b"".join(x for words, mark in parts for x in (b"".join(map(ids_of, words)), mark)) for parts in cuts]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.table.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=1)
def worker_bpe(path: str) -> ByteBpe:
    """One for all tasks of a Python worker."""
    return ByteBpe(path)


def encode(docs: DataFrame, path: str, decoded: bool = False) -> DataFrame:
    """doc_id, n_tokens and ids of each document; with `decoded` also the text that the ids give."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), *[("decoded", pa.string())] * decoded])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_bpe(path)
        for batch in slices(batches):
            doc_ids, texts = batch.column(0), batch.column(1).to_pylist()
            for lo, hi in groups(texts):
                ids = bpe.encode(texts[lo:hi])
                columns = [doc_ids.slice(lo, hi - lo), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
                columns += [pa.array(map(bpe.decode, ids), pa.string())] * decoded
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return docs.selectExpr("CAST(doc_id AS LONG) AS doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids binary" + ", decoded string" * decoded)


def decode(rows: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows with doc_id and ids; null ids = no ids."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_bpe(path)
        for batch in slices(batches, 100):
            texts = [bpe.decode(x or b"") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], schema=schema)

    return rows.selectExpr("CAST(doc_id AS LONG) AS doc_id", "ids").mapInArrow(run, "doc_id long, text string")
