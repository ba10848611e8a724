"""Word rules, hashing and Spark plumbing shared by the operators of this subpackage."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shared import cut as cut

#: ASCII bytes outside [0-9a-z] become blanks; bytes of longer UTF-8 sequences stay.
_ALNUM = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
#: Words remembered by a task; the store is emptied when it is full.
WORD_CACHE = 120_000
#: Rows that a task holds as Python values at a time.
SLICE = 1_000
#: Bytes hashed at a time; words of more bytes than SHORT are hashed one by one.
BLOCK, SHORT = 1 << 18, 64
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def blank_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space (space, \\t to \\r), as UTF-8; null gives none."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def lower_ascii(text: str | None) -> bytes:
    """UTF-8 bytes with A-Z in lower case and all other characters unchanged."""
    return text.encode("utf-8", "surrogatepass").lower() if text else b""


def alnum_words(text: str | None) -> list[bytes]:
    """Lower-cased words of 0-9, a-z and characters beyond ASCII."""
    return lower_ascii(text).translate(_ALNUM).split()


class WordHasher(dict):
    """word -> 64-bit hash, computed once per distinct word and bounded in size."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def word_hashes(data: bytes) -> np.ndarray:
    """64-bit hashes of the words between ASCII white space, made from all bytes of a block at once."""
    parts, at = [], 0
    while at < len(data):
        end = min(at + BLOCK, len(data))
        if end < len(data):  # cut between words; a word longer than a block stays whole
            blank = _BLANKS.search(data, end)
            end = blank.start() if blank else len(data)
        parts.append(_block_hashes(data[at:end]))
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def _block_hashes(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = ~_IS_BLANK[raw]
    step = np.diff(inside)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    place = np.arange(first[-1] + lengths[-1]) - np.repeat(first, lengths)
    values = _BYTE[raw[inside[1:-1].view(bool)]] * _PLACE[np.minimum(place, SHORT)]
    out = mix(np.add.reduceat(values, first) + lengths.astype(np.uint64) * _M3)
    for i in np.flatnonzero(lengths > SHORT):
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]])
    return out


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit mixer; each seed gives another global order of the same tokens."""
    x = x ^ np.uint64((seed * 0xD6E8FEB86659FD93) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(32))) * _M1
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


#: Random numbers for each byte and each place in a word; white space.
_BYTE, _PLACE = mix(np.arange(1, 257, dtype=np.uint64), 7), mix(np.arange(1, SHORT + 2, dtype=np.uint64), 8) | np.uint64(1)
_IS_BLANK = np.array([chr(c) in " \t\n\x0b\x0c\r" for c in range(256)])
_BLANKS = re.compile(rb"[ \t-\r]")


def shingle_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """One hash for each run of `size` words; fewer words give a single hash of them all."""
    n = len(hashes)
    if n == 0:
        return hashes
    width = min(size, n)
    out = np.zeros(n - width + 1, np.uint64)
    for i in range(width):
        out = (out ^ hashes[i : n - width + 1 + i]) * _M1
        out ^= out >> np.uint64(31)
    return mix(out + _M3 * np.uint64(width))


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches; an empty batch stays. After the last one Arrow gives its unused memory back, as
    the worker may wait for later tasks."""
    for batch in batches:
        for at in range(0, max(1, batch.num_rows), rows):
            yield batch.slice(at, rows)
    batch = None
    pa.default_memory_pool().release_unused()


def groups(texts: list[str | None], chars: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Runs (from, to) of texts of about `chars` characters; no run for no texts."""
    lo = size = 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= chars or i + 1 == len(texts):
            yield lo, i + 1
            lo, size = i + 1, 0


def per_row(columns: list[str], schema: pa.Schema, fn: Callable[..., tuple], keep: list[str] | None = None):
    """A mapInArrow function: fn(*values of `columns`) -> values of the new fields; `keep` columns pass through."""
    keep = keep or []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            values = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in columns]
            rows = [fn(*row) for row in zip(*values, strict=True)]
            new = list(zip(*rows, strict=True)) if rows else [()] * (len(schema) - len(keep))
            arrays = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            fields = list(schema)[len(keep) :]
            arrays += [pa.array(v, f.type) for v, f in zip(new, fields, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(prefix: str, columns: list[str]) -> str:
    """The prefix, lengthened until no column starts with it."""
    while any(c.lower().startswith(prefix.lower()) for c in columns):
        prefix = "_" + prefix
    return prefix


def hash_limit(rows: int, of: int) -> int | None:
    """Below this number lie about `rows` of `of` 63-bit hashes, never none; None where all are wanted."""
    return None if of <= rows else max(1, int(rows / of * 2.0**63))


def hash_below(column: str, rows: int, of: int) -> Column:
    """True for about `rows` of `of` rows by a hash of a column, at any number of rows; True for all where there are no more."""
    limit = hash_limit(rows, of)
    return F.lit(True) if limit is None else F.shiftrightunsigned(F.xxhash64(column), 1) < F.lit(limit)
