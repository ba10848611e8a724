"""Tables of rules over bytes and texts: file signatures for carving, literal patterns with tags.

Rules are rows, so that a user adds one without code. A table of rules is checked and compiled once a call; what is sent to
tasks is bounded by a size check, beyond which literal patterns are joined to the texts by a gram of each."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..plans.shared import cut

#: Signature rules, and bytes of literal rules as Python values, that are sent to all tasks.
MOST_SIGNATURES, RULE_BYTES = 10_000, 16_000_000
#: Bytes of the grams by which patterns are found; shorter patterns are found by all their bytes.
GRAM = 8
#: Rows that a task holds as Python values at a time.
SLICE = 100
SIGNATURE_COLUMNS = "ord long, format string, header string, trailer string, ext string, category string"


class Signature(NamedTuple):
    format: str
    ext: str
    category: str
    pattern: re.Pattern
    literals: list[str | None]


# Escapes of one byte in a header.
_ESCAPES = {"n": "\n", "r": "\r", "t": "\t", "f": "\f", "v": "\v", "0": "\0"}
_TOKEN = re.compile(r"\\x([0-9A-Fa-f]{2})|\\(.)|\[(?:\\.|[^\]])*\]|(\{\d*,?\d*\}|[?*+])|([().^$|])|(.)", re.S)


def longest_literal(pattern: str) -> str | None:
    """The most telling run of fixed bytes (Latin-1) that every match of a plain pattern holds: that of most different
    bytes, then the longest; null if there is none of two bytes or the pattern has groups or alternatives."""
    if re.search(r"(?<!\\)[(|]", pattern):
        return None
    runs, run = [], ""
    for m in _TOKEN.finditer(pattern):
        code, escaped, repeat, special, plain = m.groups()
        if repeat is not None:  # the byte before it may be missing
            runs.append(run[:-1])
            run = ""
        elif code or plain or escaped and (escaped in _ESCAPES or not escaped.isalnum()):
            run += chr(int(code, 16)) if code else _ESCAPES.get(escaped, escaped) if escaped else plain
        else:
            runs.append(run)
            run = ""
    best = max([*runs, run], key=lambda r: (len(set(r)), len(r)))
    return best if len(best) > 1 else None


def signature_rules(spark: SparkSession, signatures: tuple) -> DataFrame:
    """A table of rules (SIGNATURE_COLUMNS) from (format, ((header, trailer), ..), ext, category) tuples."""
    rows = [(name, header, trailer, ext, category) for name, forms, ext, category in signatures for header, trailer in forms]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SIGNATURE_COLUMNS)


def compiled(rules: DataFrame) -> list[Signature]:
    """The formats of a table of rules in order of their first rule, each with one pattern over all its forms. A match
    begins with a header and ends with the nearest trailer, or with the data where a rule has none.

    A rule without a format or header, one that does not compile or that matches nothing at all is named in an error, as
    is a table of more than MOST_SIGNATURES rules."""
    rows = rules.select("ord", "format", "header", "trailer", "ext", "category").orderBy("ord", "format", "header").limit(MOST_SIGNATURES + 1).collect()
    if len(rows) > MOST_SIGNATURES:
        raise ValueError(f"more than {MOST_SIGNATURES} signature rules")
    forms: dict[str, list] = {}
    for r in rows:
        if not r.format or not r.header:
            raise ValueError(f"signature rule {r.ord} has no format or header")
        try:
            if re.compile(r.header.encode("latin-1"), re.S).match(b"") or r.trailer and re.compile(r.trailer.encode("latin-1"), re.S).groups:
                raise ValueError(f"signature rule of {r.format} has an empty header or a trailer with groups")
        except (re.error, UnicodeEncodeError) as e:
            raise ValueError(f"signature rule of {r.format} is no byte pattern: {e}") from e
        forms.setdefault(r.format, []).append(r)
    found = []
    for name, own in forms.items():
        whole = "|".join(f"(?:{r.header}.*" + (f"?{r.trailer})" if r.trailer else ")") for r in own)
        found.append(Signature(name, own[0].ext or "", own[0].category or "", re.compile(whole.encode("latin-1"), re.S), [longest_literal(r.header) for r in own]))
    return found


def prefilter(signatures: list[Signature]) -> tuple[ahocorasick.Automaton | None, set[int]]:
    """A machine that finds the literals of all formats in one pass, and the formats that must be tried anyway."""
    always = {i for i, s in enumerate(signatures) if None in s.literals}
    by_literal: dict[str, set[int]] = {}
    for i, s in enumerate(signatures):
        if i not in always:
            for x in s.literals:
                by_literal.setdefault(x, set()).add(i)
    if not by_literal:
        return None, always
    machine = ahocorasick.Automaton()
    for x, formats in by_literal.items():
        machine.add_word(x, formats)
    machine.make_automaton()
    return machine, always


def possible(data: bytes, machine: ahocorasick.Automaton | None, always: set[int], n: int) -> set[int]:
    """The formats of which a header may stand in the data."""
    found = set(always)
    if machine is not None:
        for _, formats in machine.iter(data.decode("latin-1")):
            found |= formats
            if len(found) == n:
                break
    return found


def carve(payloads: DataFrame, data: str, rules: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One row for each match of a format in a binary column: the `keep` columns (all by default), format, category, ext,
    number (from 1) and carved bytes. Null and empty values hold none."""
    signatures, keep = compiled(rules), payloads.columns if keep is None else keep
    plain = payloads.select(*(f"`{c}`" for c in keep), F.col(data).cast("binary")).toDF(*(f"c{i}" for i in range(len(keep) + 1)))  # whatever the names
    extra = T.StructType().add("format", "string").add("category", "string").add("ext", "string").add("number", "integer").add("carved", "binary")
    out = T.StructType([*plain.schema[:-1], *extra])
    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, always = prefilter(signatures)
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE):
                part = batch.slice(lo, SLICE)
                rows, index = [], []
                for i, value in enumerate(part.column(part.num_columns - 1).to_pylist()):
                    for k in sorted(possible(value, machine, always, len(signatures))) if value else ():
                        s = signatures[k]
                        for number, m in enumerate(s.pattern.finditer(value), 1):
                            rows.append((s.format, s.category, s.ext, number, m[0]))
                            index.append(i)
                if rows:
                    columns = [c.take(pa.array(index, pa.int32())) for c in part.columns[:-1]]
                    columns += [pa.array(v, f.type) for v, f in zip(zip(*rows, strict=True), list(schema)[-5:], strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return plain.mapInArrow(run, out).toDF(*keep, *extra.names)


# ---- literal patterns

_ODD = (np.arange(1, GRAM + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_BITS = 20


def gram_hashes(data: bytes, size: int) -> np.ndarray:
    """A hash of the `size` bytes that begin at each place."""
    raw = np.frombuffer(data, np.uint8)
    n = len(raw) - size + 1
    out = np.zeros(max(n, 0), np.uint64)
    for j in range(size if n > 0 else 0):
        out += (raw[j : j + n].astype(np.uint64) + np.uint64(1)) * _ODD[j]
        out ^= out >> np.uint64(31)
    return out * np.uint64(0xC2B2AE3D27D4EB4F)


class PatternIndex:
    """Literal patterns by one gram each: of a pattern's grams the one that fewest patterns hold."""

    def __init__(self, patterns: list[bytes]):
        self.patterns = patterns
        sized: dict[int, list[int]] = {}
        for i, p in enumerate(patterns):
            sized.setdefault(min(len(p), GRAM), []).append(i)
        self.by_size = {}
        for size, own in sized.items():
            grams = [gram_hashes(patterns[i], size) for i in own]
            values, counts = np.unique(np.concatenate([np.unique(g) for g in grams]), return_counts=True)
            key = np.array([g[counts[np.searchsorted(values, g)].argmin()] for g in grams], np.uint64)
            by = np.argsort(key, kind="stable")
            bits = np.zeros(1 << _BITS, bool)
            bits[key >> np.uint64(64 - _BITS)] = True
            self.by_size[size] = key[by], np.array(own)[by], bits

    def found(self, texts: list[bytes]) -> list[tuple[int, int]]:
        """(text, pattern) of every pattern that a text holds; the grams of all texts are looked up at once."""
        data, hits = b"\0".join(texts), []
        starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
        for size, (keys, rule, bits) in self.by_size.items():
            hashes = gram_hashes(data, size)
            at = np.flatnonzero(bits[hashes >> np.uint64(64 - _BITS)])
            first = np.searchsorted(keys, hashes[at])
            same = np.flatnonzero(keys[np.minimum(first, len(keys) - 1)] == hashes[at])
            row = np.searchsorted(starts, at[same], "right") - 1
            for met in np.unique(row * len(keys) + first[same]).tolist():  # a gram across two texts is no pattern of either
                i, x = divmod(met, len(keys))
                y = int(np.searchsorted(keys, keys[x], "right"))
                hits += [(i, r) for r in rule[x:y].tolist() if self.patterns[r] in texts[i]]
        return sorted(hits)


@lru_cache(maxsize=1)
def _index(token: str, shared) -> PatternIndex:
    """One for all tasks of a Python worker that have the same broadcast."""
    return PatternIndex([p for _, _, p in shared.value])


def _block_matches(docs: DataFrame, key: str, text: str, rows: list[tuple[str, list[str], bytes]]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(rows)
    out = T.StructType([docs.schema[key], T.StructField("rule", T.StringType()), T.StructField("tags", T.ArrayType(T.StringType()))])
    schema, token = to_arrow_schema(out), str(shared.id if hasattr(shared, "id") else id(shared))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, rules = _index(token, shared), shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE):
                part = batch.slice(lo, SLICE)
                found = index.found([t.encode() if t else b"" for t in part.column(1).to_pylist()])
                names, tags = pa.array([rules[r][0] for _, r in found], pa.string()), pa.array([rules[r][1] for _, r in found], schema.field(2).type)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array([i for i, _ in found], pa.int32())), names, tags], schema=schema)

    return docs.select(F.col(key), F.col(text).cast("string")).mapInArrow(run, out)


# ---- tables of patterns of any size

#: Bytes that a rule is taken to need as Python values, besides its texts (an estimate).
ROW_BYTES = 700
#: Patterns of up to SHORT bytes are checked in a window of the text, longer ones in windows of the longest pattern's size.
SHORT = 64
#: Bits of the counts of grams, and most bits of the map of the rules' grams, that reach the driver and each task.
_COUNT_BITS, _MAP_BITS = 22, 27
#: Texts that are looked up at once, by rows and bytes; bytes of text in one batch of hits.
_ROWS, _LOOKED_UP, _SENT = 10_000, 1_000_000, 8_000_000
#: A kind of pattern: 1 to 7 bytes, 8 to SHORT bytes, longer ones. Grams of different kinds are told apart by these.
_KIND = [np.uint64(k * 0xD6E8FEB86659FD93 % (1 << 64)) for k in range(GRAM + 2)]


def _kind(size: int) -> int:
    return size if size < GRAM else GRAM + (size > SHORT)


def pattern_grams(patterns: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(pattern, gram) of all grams of all patterns, by pattern."""
    kinds: dict[int, list[int]] = {}
    for i, p in enumerate(patterns):
        kinds.setdefault(_kind(len(p)), []).append(i)
    owners, grams = [], []
    for kind, own in kinds.items():
        size, lengths = min(kind, GRAM), np.array([len(patterns[i]) for i in own])
        n, starts = lengths - size + 1, np.cumsum([0, *(lengths + 1)])[:-1]
        place = np.repeat(starts - np.cumsum([0, *n])[:-1], n) + np.arange(n.sum())
        owners.append(np.repeat(own, n))
        grams.append(gram_hashes(b"\0".join(patterns[i] for i in own), size)[place] ^ _KIND[kind])
    owner = np.concatenate(owners)
    by = np.argsort(owner, kind="stable")
    return owner[by], np.concatenate(grams)[by]


def _gram_counts(rules: DataFrame) -> np.ndarray:
    """How many grams of all rules share each value of the upper _COUNT_BITS bits."""
    schema = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found, n = np.unique(pattern_grams(batch.column(0).to_pylist())[1] >> np.uint64(64 - _COUNT_BITS), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(n, pa.int64())], schema=schema)

    found = rules.select("pattern").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.least(F.sum("n"), F.lit(65_535)).cast("int").alias("n")).toArrow()
    counts = np.zeros(1 << _COUNT_BITS, np.uint16)
    counts[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return counts


def _by_rare_gram(rules: DataFrame) -> DataFrame:
    """(gram, name, tags, pattern) of each rule: of a pattern's grams one that few hold."""
    shared = rules.sparkSession.sparkContext.broadcast(_gram_counts(rules))
    out = T.StructType([T.StructField("gram", T.LongType()), *rules.schema])
    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                owner, grams = pattern_grams(batch.column(2).to_pylist())
                by = np.lexsort((shared.value[grams >> np.uint64(64 - _COUNT_BITS)], owner))
                chosen = grams[by[np.searchsorted(owner, np.arange(batch.num_rows))]]
                yield pa.RecordBatch.from_arrays([pa.array(chosen.view(np.int64)), *batch.columns], schema=schema)

    return rules.mapInArrow(run, out)


def _gram_map(rules: DataFrame, bits: int) -> np.ndarray:
    """One bit for each value of the upper bits of the rules' grams; 2 ** (bits - 6) numbers reach the driver at most."""
    word = F.shiftrightunsigned("gram", 70 - bits).cast("int").alias("word")
    bit = F.expr(f"shiftleft(1L, CAST(shiftrightunsigned(gram, {64 - bits}) & 63 AS INT))").alias("bits")
    found = rules.select(word, bit).groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(1 << (bits - 6), np.int64)
    words[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return words.view(np.uint8)


def _hits(data: bytes, starts: np.ndarray, ends: np.ndarray, kind: int, known: np.ndarray, bits: int) -> tuple[np.ndarray, ...]:
    """(text, gram, place) of the grams of one kind that a rule may have, by text and gram."""
    size = min(kind, GRAM)
    grams = gram_hashes(data, size) ^ _KIND[kind]
    low = grams >> np.uint64(64 - bits)
    at = np.flatnonzero(known[low >> np.uint64(3)] >> (low & np.uint64(7)).astype(np.uint8) & 1)
    row = np.searchsorted(starts, at, "right") - 1
    whole = at + size <= ends[row]  # a gram across two texts is no gram of either
    at, row = at[whole], row[whole]
    by = np.lexsort((at, grams[at], row))
    return row[by], grams[at[by]], at[by]


def _pieces(data: bytes, starts: np.ndarray, ends: np.ndarray, hits: tuple[np.ndarray, ...], size: int, reach: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes] | None]]:
    """(texts, grams, pieces) of the hits, once for each text and gram. A piece holds every place at which a pattern of up to
    `reach` bytes with that gram may stand: windows with a byte between them that no pattern has, or null for the text
    where that is not longer."""
    row, gram, at = hits
    if not len(row):
        return
    first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (gram[1:] != gram[:-1])])
    low, high = np.maximum(at - (reach - size), starts[row]), np.minimum(at + reach, ends[row])
    length, width = (ends - starts)[row[first]], np.add.reduceat(high - low + 1, first)
    last = np.r_[first[1:], len(row)]
    whole = width >= length
    for part, cut_out in ((np.flatnonzero(whole), False), (np.flatnonzero(~whole), True)):
        sent = np.cumsum(np.minimum(width, length)[part]) // _SENT
        for own in np.split(part, np.flatnonzero(np.diff(sent)) + 1) if len(part) else ():
            pieces = [b"\xff".join(data[low[j] : high[j]] for j in range(first[i], last[i])) for i in own] if cut_out else None
            yield row[first[own]], gram[first[own]], pieces


def _text_slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in slices of up to _ROWS rows and about _LOOKED_UP bytes of its second column."""
    total = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < batch.num_rows:
        hi = int(np.searchsorted(total, (total[lo - 1] if lo else 0) + _LOOKED_UP, "right"))
        hi = min(max(hi, lo + 1), lo + _ROWS)
        yield batch.slice(lo, hi - lo)
        lo = hi


def _joined_matches(docs: DataFrame, key: str, text: str, rules: DataFrame) -> DataFrame:
    """The matches of a table of rules of any size: rules meet the texts that have their rare gram in a join, which checks
    the pattern. Only two tables of fixed size, counts of grams and a map of rare ones, reach the driver and the tasks."""
    rules = cut(_by_rare_gram(rules.select("name", "tags", F.col("pattern").cast("binary").alias("pattern"))))
    found = rules.groupBy(F.octet_length("pattern").alias("size")).agg(F.count("*").alias("n"))
    kind = F.when(F.col("size") < GRAM, F.col("size")).otherwise(F.lit(GRAM) + (F.col("size") > SHORT).cast("int"))
    kinds = found.groupBy(kind.alias("kind")).agg(F.max("size").alias("reach"), F.sum("n").alias("n")).collect()  # GRAM + 1 at most
    reach = {r.kind: r.reach for r in kinds}
    bits = min(_MAP_BITS, max(10, 5 + sum(r.n for r in kinds).bit_length()))
    shared = docs.sparkSession.sparkContext.broadcast(_gram_map(rules, bits))
    out = T.StructType([T.StructField("key", docs.schema[key].dataType), T.StructField("gram", T.LongType()), T.StructField("piece", T.BinaryType())])
    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for part in _text_slices(batch):
                texts = [t or b"" for t in part.column(1).to_pylist()]
                data, ends = b"\0".join(texts), np.cumsum([len(t) + 1 for t in texts]) - 1
                starts = np.r_[0, ends[:-1] + 1]
                for kind, most in reach.items():
                    hits = _hits(data, starts, ends, kind, known, bits)
                    for row, gram, pieces in _pieces(data, starts, ends, hits, min(kind, GRAM), most):
                        took = pa.array(row, pa.int32())
                        column = part.column(1).take(took) if pieces is None else pa.array(pieces, pa.binary())
                        yield pa.RecordBatch.from_arrays([part.column(0).take(took), pa.array(gram.view(np.int64)), column.cast(schema.field(2).type)], schema=schema)

    hits = docs.select(F.col(key), F.col(text).cast("string").cast("binary")).mapInArrow(run, out)
    return hits.join(rules, "gram").filter(F.contains("piece", "pattern")).select(F.col("key").alias(key), F.col("name").alias("rule"), "tags")


def rule_matches(docs: DataFrame, key: str, text: str, rules: DataFrame, most_bytes: int = RULE_BYTES) -> DataFrame:
    """(key, rule, tags) for every rule (name, tags: array of strings, pattern: literal text) that a text holds, once for
    each row of `docs` and each row of `rules`.

    Rules that take up to `most_bytes` bytes as Python values are sent to all tasks and found in one pass over the texts; a
    larger table stays distributed and is joined. Null and empty patterns match nothing, as do null texts."""
    checked = rules.selectExpr("CAST(name AS STRING) AS name", "coalesce(CAST(tags AS ARRAY<STRING>), array()) AS tags", "CAST(pattern AS STRING) AS pattern").filter("pattern <> ''")
    checked = cut(checked)
    size = F.octet_length("pattern") + F.coalesce(F.octet_length("name"), F.lit(0)) + F.octet_length(F.concat_ws(",", "tags")) + 60 * F.size("tags") + ROW_BYTES
    if checked.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0] > most_bytes:
        return _joined_matches(docs, key, text, checked)
    return _block_matches(docs, key, text, [(r.name, r.tags, r.pattern.encode()) for r in checked.collect()])
