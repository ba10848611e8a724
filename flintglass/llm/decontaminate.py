"""Benchmark decontamination by a prefix-filtered set join.

An item's windows are its runs of WINDOW words (the whole item if shorter). A window is the set of its word shingles;
as a whole window must occur, one shingle of it is a sufficient prefix, and shingles are ordered by rarity over all
documents, so that the rarest is taken. Documents give the places of their shingles that may be prefixes, each with the
words around it; Spark joins them with the prefix table by shingle. The place of the shingle in the window gives the only
possible start, bounds on length and position drop impossible ones, and the words themselves are compared.

Windows, rarities and prefixes are tables of any size, dealt by shingle or window. What is broadcast is a bitmap of
2 ** BITS bits that lets documents leave out shingles which no window holds; a larger benchmark fills it more, so that
more places are shuffled, but no task holds more of it. Documents are read twice, and their places are written to the
checkpoint folder.

Defined results: null text has no words; items without words are ignored; a null item_id is reported as `null`; repeated
items or windows count once per item_id; an empty benchmark leaves all documents clean; an empty table gives no rows;
repeated rows give a row each; other columns are ignored unless named in `keep`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .textops import _ALNUM, cut, lower_ascii, shingle_hashes, slices, word_hashes

WINDOW, SHINGLE = 10, 3
BITS = 24
#: Rows of a batch of windows or places.
ROWS = 5_000


def spaced(text: str | None) -> bytes:
    """Lower-cased words of 0-9, a-z and characters beyond ASCII, between blanks."""
    return lower_ascii(text).translate(_ALNUM)


def item_windows(benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """(item, window: its words between blanks, k: shingle size, tokens: its shingles in order) of every run of words."""
    fields = [("item", pa.string()), ("window", pa.string()), ("k", pa.int32()), ("tokens", pa.list_(pa.int64()))]
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = spaced(text)
                words = data.split()
                if not words:
                    continue
                size = min(window, len(words))
                k = min(shingle, size)
                tokens = shingle_hashes(word_hashes(data), k).view(np.int64)
                for s in range(len(words) - size + 1):
                    rows.append((item, b" ".join(words[s : s + size]).decode(), k, tokens[s : s + size - k + 1]))
                    if len(rows) == ROWS:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], schema=schema)
                        rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], schema=schema)

    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")), "text")
    return items.mapInArrow(run, "item string, window string, k int, tokens array<long>")


def _low(bits: int) -> Column:
    """The lowest bits of a shingle."""
    return F.col("token").bitwiseAND(F.lit((1 << bits) - 1))


def bitmap(tokens: DataFrame, bits: int) -> np.ndarray:
    """One bit for each value of the lowest bits of the column `token`; 2 ** (bits - 6) numbers reach the driver at most."""
    part = tokens.select(F.shiftright(_low(bits), 6).alias("word"), F.expr("shiftleft(1L, CAST(token & 63 AS INT))").alias("bits")).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    found = part.toArrow()
    words = np.zeros(1 << (bits - 6), np.int64)
    words[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return np.unpackbits(words.view(np.uint8), bitorder="little").view(bool)


def _places(tokens: np.ndarray, bits: np.ndarray) -> np.ndarray:
    return np.flatnonzero(bits[(tokens & np.uint64(len(bits) - 1)).astype(np.int64)])


def rarities(docs: DataFrame, sizes: list[int], bits: np.ndarray) -> DataFrame:
    """(bit, n): occurrences over all documents of the shingles that share the lowest bits with one of a window."""
    schema = pa.schema([("bit", pa.int64()), ("n", pa.int64())])
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(shared.value).view(bool)
        for batch in slices(batches):
            met = []
            for text in batch.column(0).to_pylist():
                hashes = word_hashes(spaced(text))
                for k in sizes:
                    if len(hashes) >= k:
                        low = (shingle_hashes(hashes, k) & np.uint64(len(known) - 1)).astype(np.int64)
                        met.append(low[known[low]])
            found, n = np.unique(np.concatenate(met), return_counts=True) if met else (np.zeros(0, np.int64),) * 2
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(n, pa.int64())], schema=schema)

    return docs.select("text").mapInArrow(run, "bit long, n long").groupBy("bit").agg(F.sum("n").alias("n"))


def prefixes(docs: DataFrame, windows: DataFrame, sizes: list[int], bits: int) -> DataFrame:
    """(k, token, place, window, size): the rarest shingle of each window, its place there and the window's words."""
    shingles = windows.select("window", "k", F.posexplode("tokens").alias("place", "token"))
    counted = rarities(docs, sizes, bitmap(shingles, bits)).select(F.col("bit").alias("low"), "n")
    ranked = shingles.withColumn("low", _low(bits)).join(counted, "low", "left")
    best = ranked.groupBy("window").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "place", "k")).alias("p"))
    return best.select("p.k", "p.token", "p.place", "window", F.size(F.split("window", " ")).alias("size"))


def candidates(docs: DataFrame, keep: list[str], sizes: list[int], bits: np.ndarray, window: int, names: tuple[str, ...]) -> DataFrame:
    """One row for each document (keep, row number, words) and one for each of its places that may hold a prefix
    (row number, k, token, place, words before it in the context, context)."""
    numbered = docs.select(*dict.fromkeys([*keep, "text"])).withColumn(names[0], F.monotonically_increasing_id())
    kept = numbered.select(*keep, names[0]).schema
    extra = list(zip(names[1:], [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.string()], strict=True))
    schema = pa.schema([*to_arrow_schema(kept), *extra])
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(bits))
    row = len(keep)

    def of_document(number: int, data: bytes, hashes: np.ndarray, known: np.ndarray) -> Iterator[tuple]:
        words = None
        for k in sizes:
            if len(hashes) >= k:
                tokens = shingle_hashes(hashes, k)
                for p in _places(tokens, known).tolist():
                    words = data.split() if words is None else words
                    first = max(0, p - window + 1)
                    yield number, None, k, int(tokens[p].view(np.int64)), p, p - first, b" ".join(words[first : p + window]).decode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(shared.value).view(bool)

        def of_places(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([*(pa.nulls(len(rows), f.type) for f in list(schema)[:row]), *(pa.array(c, f.type) for c, f in zip(cols, list(schema)[row:], strict=True))], schema=schema)

        for batch in slices(batches):
            place = {f.name: i for i, f in enumerate(batch.schema)}
            counts, rows = [], []
            numbers = batch.column(place[names[0]]).to_pylist()
            for number, text in zip(numbers, batch.column(place["text"]).to_pylist(), strict=True):
                data = spaced(text)
                hashes = word_hashes(data)
                counts.append(len(hashes))
                for found in of_document(number, data, hashes, known):
                    rows.append(found)
                    if len(rows) == ROWS:
                        yield of_places(rows)
                        rows = []
            given = [batch.column(place[f.name]) for f in kept]
            yield pa.RecordBatch.from_arrays([*given, pa.array(counts, pa.int64()), *(pa.nulls(len(counts), t) for _, t in extra[1:])], schema=schema)
            if rows:
                yield of_places(rows)

    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), *(f"`{n}` {t}" for n, t in zip(names[1:], ("long", "int", "long", "int", "int", "string"), strict=True))])
    return numbered.mapInArrow(run, ddl)


def scan(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, prefix: str = "", window: int = WINDOW, shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """`keep` columns and n_words, hits (word positions), items (ids, sorted as strings), named with `prefix`."""
    keep = ["doc_id"] if keep is None else keep
    raw = item_windows(benchmark, window, shingle)
    pairs = cut(raw.select("window", "item").distinct())
    windows = cut(raw.select("window", "k", "tokens").dropDuplicates(["window"]))
    sizes = sorted(r.k for r in windows.select("k").distinct().collect())  # shingle sizes, `shingle` at most
    heads = cut(prefixes(docs, windows, sizes, bits))
    names = tuple(f"{prefix}_{n}_" for n in ("row", "words", "k", "token", "place", "before", "context"))
    number, words, k, token, place, before, context = names
    found = cut(candidates(docs, keep, sizes, bitmap(heads.select("token"), bits), window, names))

    spots = found.filter(F.col(token).isNotNull()).select(number, F.col(k).alias("k"), F.col(token).alias("token"), F.col(place).alias("at"), F.col(before).alias("before"), F.split(context, " ").alias("around"))
    joined = spots.join(heads, ["k", "token"]).filter("before >= place AND before - place + size <= size(around)")
    same = F.array_join(F.slice("around", F.col("before") - F.col("place") + 1, F.col("size")), " ") == F.col("window")
    hits = joined.filter(same).select(number, (F.col("at") - F.col("place")).alias("start"), "size", "window").distinct()
    gathered = hits.join(pairs, "window").groupBy(number).agg(F.collect_set(F.struct("start", "size")).alias("runs"), F.array_sort(F.collect_set("item")).alias("items"))
    positions = F.array_sort(F.array_distinct(F.flatten(F.transform("runs", lambda r: F.sequence(r["start"], r["start"] + r["size"] - 1)))))
    result = gathered.select(number, positions.alias("hits"), "items")

    out = {n: prefix + n for n in ("n_words", "hits", "items")}
    rows = found.filter(F.col(token).isNull()).select(*keep, number, F.col(words).alias(out["n_words"]))
    result = result.select(number, F.col("hits").alias(out["hits"]), F.col("items").alias(out["items"]))
    none = {out["hits"]: "array<int>", out["items"]: "array<string>"}
    joined = rows.join(result, number, "left").withColumns({n: F.coalesce(n, F.array().cast(t)) for n, t in none.items()})
    return joined.select(*keep, *out.values())


def report(docs: DataFrame, benchmark: DataFrame, bits: int = BITS) -> DataFrame:
    found = scan(docs.selectExpr("CAST(doc_id AS LONG) AS doc_id", "text"), benchmark, bits=bits)
    return found.select(
        "doc_id", "n_words", F.size("hits").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"),
    )
