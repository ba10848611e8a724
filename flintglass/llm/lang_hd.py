"""Language identification by hyperdimensional profiles.

Each letter has a random +-1 vector. A trigram is bound from its three letters' vectors, permuted once for each place;
a text bundles (adds) its trigrams' vectors, a language prototype bundles the texts of that language, and the cosine
between text and prototypes decides. Letters are case-folded; all other characters are one blank. Vectors come from a
seeded mixer of the code point, so that every script works and every task makes the same vectors.

Prototypes are learned from a sample of the labelled rows of the training fold, drawn by a hash of the text: about
`MAX_TRAINING` distinct texts dealt equally to the languages, `LEAST_TRAINING` at least for each, and every row of a
language with fewer.
Defined results: `und` and score 0 for a null text or one without letters; with nothing learned all are `und`; ties go to
the first language in order; one row for each input row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import cut, mix, slices

DIMENSIONS = 1024
MAX_TRAINING, LEAST_TRAINING = 20_000, 500
#: Languages whose counts are broadcast; more of them are joined by a shuffle.
MOST_BROADCAST = 10_000
#: Trigram vectors kept by a task; the store is rebuilt when it is full.
STORE = 16_384
#: Trigrams bundled at a time, so that a long text needs no more memory than a short one.
BLOCK = 2_048


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigram codes (21 bits a place) and their counts; empty without letters."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(points) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    letter = _is_letter(points)
    if not letter.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    p = np.concatenate([[32], np.where(letter, points, 32).astype(np.int64), [32]])
    p = p[np.concatenate([[True], (p[1:] != 32) | (p[:-1] != 32)])]  # runs of other characters are one blank
    return np.unique(p[:-2] << 42 | p[1:-1] << 21 | p[2:], return_counts=True)


_LETTERS = np.array([chr(c).isalpha() for c in range(0x3000)])


def _is_letter(points: np.ndarray) -> np.ndarray:
    known = _LETTERS[np.minimum(points, len(_LETTERS) - 1)]
    if len(points) and points.max() >= len(_LETTERS):
        known = known.copy()
        for i in np.flatnonzero(points >= len(_LETTERS)):
            known[i] = chr(points[i]).isalpha()
    return known


def letter_vectors(points: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """+-1 vectors of code points from a seeded mixer, one row each."""
    words = mix((points.astype(np.uint64)[:, None] << np.uint64(16)) + np.arange(dimensions // 64, dtype=np.uint64), 11)
    return np.unpackbits(words.view(np.uint8).reshape(len(points), -1), axis=1).astype(np.int8) * 2 - 1


def trigram_vectors(codes: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Bound vectors: the product of the letters' vectors, rolled by two, one and no places."""
    parts = [codes >> 42, codes >> 21 & 0x1FFFFF, codes & 0x1FFFFF]
    points, where = np.unique(np.concatenate(parts), return_inverse=True)
    base = letter_vectors(points, dimensions)
    a, b, c = np.split(where, 3)
    return np.roll(base, 2, 1)[a] * np.roll(base, 1, 1)[b] * base[c]


class Bundler:
    """Bundles texts, keeping the vectors of trigrams already met (as float32 rows of one matrix)."""

    def __init__(self) -> None:
        self.codes = np.zeros(0, np.int64)
        self.vectors = np.zeros((0, DIMENSIONS), np.float32)

    def _learn(self, codes: np.ndarray) -> None:
        new = np.setdiff1d(codes, self.codes, assume_unique=False)
        if len(new) == 0:
            return
        if len(self.codes) + len(new) > STORE:
            self.__init__()
            new = np.unique(codes)
        both = np.concatenate([self.codes, new])
        order = np.argsort(both, kind="stable")
        self.codes = both[order]
        self.vectors = np.concatenate([self.vectors, trigram_vectors(new).astype(np.float32)])[order]

    def bundle(self, texts: list[str | None]) -> np.ndarray:
        """One hypervector a text; all zero without letters."""
        grams = [trigrams(t) if t else (np.zeros(0, np.int64), np.zeros(0, np.int64)) for t in texts]
        out = np.zeros((len(texts), DIMENSIONS), np.float32)
        at = np.repeat(np.arange(len(texts)), [len(c) for c, _ in grams])
        codes = np.concatenate([c for c, _ in grams]) if grams else np.zeros(0, np.int64)
        counts = np.concatenate([n for _, n in grams]).astype(np.float32) if grams else np.zeros(0, np.float32)
        distinct, place = np.unique(codes, return_inverse=True)
        if len(distinct) <= STORE:
            self._learn(distinct)
            slot = np.searchsorted(self.codes, distinct)
        for lo in range(0, len(distinct), BLOCK):
            inside = (place >= lo) & (place < lo + BLOCK)
            if len(distinct) <= BLOCK:
                inside = slice(None)
            part = distinct[lo : lo + BLOCK]
            vectors = self.vectors[slot[lo : lo + BLOCK]] if len(distinct) <= STORE else trigram_vectors(part).astype(np.float32)
            dense = np.zeros((len(texts), len(part)), np.float32)
            dense[at[inside], place[inside] - lo] = counts[inside]
            out += dense @ vectors
        return out


def learn(docs: DataFrame, max_training: int = MAX_TRAINING) -> list[tuple[str, np.ndarray]]:
    """(language, unit prototype) in order of the language; docs: the rows that may be learned from."""
    known = docs.filter("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text")
    counts = known.groupBy("lang").agg(F.least(F.count("*"), F.approx_count_distinct(F.xxhash64("text"))).alias("n"))  # one row for each language
    counts = cut(counts)
    n_langs = counts.count()
    each = max(LEAST_TRAINING, max_training // max(1, n_langs))
    sized = known.join(F.broadcast(counts) if n_langs <= MOST_BROADCAST else counts, "lang")
    drawn = sized.filter(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) * F.col("n") < F.lit(each * 1_000_000)).select("lang", "text").distinct()
    schema = pa.schema([("lang", pa.string()), ("v", pa.list_(pa.float64()))])

    def bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundler, sums = Bundler(), {}
        for batch in slices(batches):
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo in range(0, len(texts), 64):
                x = bundler.bundle(texts[lo : lo + 64])
                norm = np.linalg.norm(x, axis=1, keepdims=True)
                x = x / np.where(norm > 0, norm, 1)
                for lang, row in zip(langs[lo : lo + 64], x, strict=True):
                    sums[lang] = sums.get(lang, 0) + row.astype(np.float64)
        names = sorted(sums)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([sums[n].tolist() for n in names], schema.field("v").type)], schema=schema)

    parts = drawn.mapInArrow(bundles, "lang string, v array<double>")
    summed = parts.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    rows = summed.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v")).collect()  # languages x DIMENSIONS
    found = []
    for r in sorted(rows, key=lambda r: r.lang):
        v = np.array([p.x for p in r.v])
        if np.linalg.norm(v) > 0:
            found.append((r.lang, v / np.linalg.norm(v)))
    return found


def predict(docs: DataFrame, prototypes: list[tuple[str, np.ndarray]]) -> DataFrame:
    """doc_id, lang_pred, score (cosine, 0 at least) of each row."""
    names = [n for n, _ in prototypes]
    matrix = np.stack([v for _, v in prototypes]).T.astype(np.float32) if prototypes else np.zeros((DIMENSIONS, 0), np.float32)
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundler = Bundler()
        for batch in slices(batches):
            texts, langs, scores = batch.column(1).to_pylist(), [], []
            for lo in range(0, len(texts), 128):
                x = bundler.bundle(texts[lo : lo + 128])
                norm = np.linalg.norm(x, axis=1)
                cos = (x @ matrix) / np.where(norm > 0, norm, 1)[:, None]
                best = cos.argmax(1) if names else np.zeros(len(x), int)
                sure = (norm > 0) & bool(names)
                langs += [names[b] if ok else "und" for b, ok in zip(best, sure, strict=True)]
                scores += [float(min(max(c[b], 0), 1)) if ok else 0.0 for c, b, ok in zip(cos, best, sure, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], schema=schema)

    return docs.selectExpr("CAST(doc_id AS LONG) AS doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
