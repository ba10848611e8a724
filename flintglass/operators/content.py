"""Bytes and texts: entropy classes, carving by signature, HTTP requests, log events, rules, domains."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.text import file_time_text
from ..plans.shared import cut
from . import rules
from .messages import http_bodies, http_body

ENTROPY_BYTES, LEAST_BYTES = 102_400, 1280
# Format, (header, trailer or None: to the end) alternatives, extension, category. The pattern text is Latin-1.
SIGNATURES = (
    ("avi", (("RIFF.{4}AVI LIST", None),), "avi", "Video"),
    ("bmp", (("BM.{4}\\x00\\x00\\x00\\x00", None),), "bmp", "Image"),
    ("elf", (("\\x7FELF", None),), "", "Executable"),
    ("exe", (("MZ.{254}PE", None),), "exe", "Executable"),
    ("gif", (("GIF8[79]a", "\\x00\\x3B"),), "gif", "Image"),
    ("jpeg", (("\\xFF\\xD8\\xFF", "\\xFF\\xD9"), (".{6}JFIF\\x00", None)), "jpg", "Image"),
    ("mkv", (("\\x1A\\x45\\xDF\\xA3.{4}matroska", None),), "mpg", "Video"),
    ("mp3", (("ID3", None),), "mp3", "Audio"),
    ("mpg", (("\\x00\\x00\\x01[\\xB0-\\xBF]", "\\x00\\x00\\x01[\\xB7\\xB9]"),), "mpg", "Video"),
    ("pdf", (("%PDF", ".*%%EOF[()\\n\\r]?"),), "pdf", "Document"),
    ("png", (("\\x89PNG\\r\\n\\x1A\\n", "IEND\\xAE\\x42\\x60\\x82"),), "png", "Image"),
    ("rar", (("Rar!\\x1A\\x07", None),), "rar", "Compressed"),
    ("wav", (("RIFF.{4}WAVEfmt", None),), "wav", "Audio"),
    ("zip", (("PK\\x03\\x04", None),), "zip", "Compressed"),
)


def with_histograms(rows: DataFrame, data: str, limit: int = ENTROPY_BYTES) -> DataFrame:
    """Adds n and bins, the counts of the 256 byte values of the first `limit` bytes of a binary column, in Arrow batches."""
    plain = rows.toDF(*(f"c{i}" for i in range(len(rows.columns))))  # whatever the names
    at = rows.columns.index(data)
    out = T.StructType([*plain.schema, T.StructField("n", T.LongType()), T.StructField("bins", T.ArrayType(T.LongType()))])
    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = batch.column(at)
            bins = np.zeros((batch.num_rows, 256), np.int64)
            for i in range(batch.num_rows):
                held = data[i].as_buffer()
                if held is not None:
                    bins[i] = np.bincount(np.frombuffer(held, np.uint8)[:limit], minlength=256)
            lists = pa.ListArray.from_arrays(np.arange(0, bins.size + 1, 256, dtype=np.int32), bins.ravel())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bins.sum(1)), lists], schema=schema)

    return plain.mapInArrow(run, out).toDF(*rows.columns, "n", "bins")


def byte_histograms(rows: DataFrame, key: str, data: str, limit: int = ENTROPY_BYTES) -> DataFrame:
    """(key, n, bins) of each value."""
    return with_histograms(rows.select(key, F.col(data).cast("binary")), data, limit).drop(data)


def with_entropy(rows: DataFrame, data: str) -> DataFrame:
    """Adds n, Shannon entropy, chi-square against equal bins and class of each value, in the pass that counts its bytes;
    empty and null values are left out."""
    zero = F.lit(0.0)
    p = lambda c: c / F.col("n")
    entropy = F.aggregate(F.filter("bins", lambda c: c > 0), zero, lambda a, c: a - p(c) * F.log2(p(c)))
    expected = F.col("n") / 256
    chi = F.aggregate("bins", zero, lambda a, c: a + (c - expected) * (c - expected) / expected)
    kind = (
        F.when(F.col("n") < LEAST_BYTES, "uncategorized").when(F.col("entropy") < 7.9, "plain")
        .when((F.col("chi_square") > 206) & (F.col("chi_square") < 311), "encrypted").otherwise("compressed")
    )
    found = with_histograms(rows, data).filter("n > 0").withColumns({"entropy": entropy, "chi_square": chi})
    return found.withColumn("entropy_class", kind).drop("bins")


def entropy_classes(rows: DataFrame, key: str, data: str) -> DataFrame:
    """Key, n, entropy, chi_square and entropy_class of each value that is not empty."""
    return with_entropy(rows.select(key, F.col(data).cast("binary")), data).drop(data)


def spans(text: Column, *signatures: tuple[str, str | None]) -> Column:
    """Non-overlapping spans from a header to the nearest trailer, or to the end; of several signatures the first that fits."""
    forms = [f"{header}.*" + (f"?{trailer}" if trailer else "") for header, trailer in signatures]
    return F.regexp_extract_all(text, F.lit("(?s)" + "|".join(f"(?:{f})" for f in forms)), F.lit(0))


def carve(payloads: DataFrame, data: str, signatures: tuple | DataFrame = SIGNATURES, keep: list[str] | None = None) -> DataFrame:
    """One row for each signature match in a binary column: format, category, ext, number, carved bytes, and the `keep`
    columns (all by default).

    signatures: a table of rules (rules.SIGNATURE_COLUMNS), or rows like those of SIGNATURES. Users add rows."""
    table = signatures if isinstance(signatures, DataFrame) else rules.signature_rules(payloads.sparkSession, signatures)
    return rules.carve(payloads, data, table, keep)


#: Decoders of a payload column by name, with their order; null for a payload that one cannot decode.
DECODERS: dict[str, tuple[int, Callable[[Column], Column]]] = {
    "plain": (10, lambda c: c), "base64": (50, lambda c: F.try_to_binary(F.decode(c, "ISO-8859-1"), F.lit("base64"))),
}
#: Protocols by name: order, test of the first line, the payloads of a stream (array of binary; null if it is none of this
#: protocol after all, so that the next one is tried). Only streams that pass the test, and that no earlier protocol has
#: taken, are given to the payloads' function.
DISSECTORS: dict[str, tuple[int, Callable[[Column], Column], Callable[[Column], Column]]] = {
    "http10": (45, lambda line: F.contains(line, F.lit("HTTP/1.0")), lambda data: http_body(data)), "http11": (50, lambda line: F.contains(line, F.lit("HTTP/1.1")), lambda data: http_bodies(data)),
    "unknown": (200, lambda line: F.lit(True), lambda data: F.array(data)),
}


def register_decoder(name: str, order: int, decode: Callable[[Column], Column]) -> None:
    DECODERS[name] = (order, decode)


def register_dissector(name: str, order: int, test: Callable[[Column], Column], payloads: Callable[[Column], Column]) -> None:
    DISSECTORS[name] = (order, test, payloads)


def decoded(payloads: DataFrame, data: str) -> DataFrame:
    """Each payload through each decoder in order; `ord` is the decoder's place, results that are null are left out."""
    listed = sorted(DECODERS.items(), key=lambda d: (d[1][0], d[0]))
    forms = F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(name).alias("decoder"), decode(F.col(data)).alias("decoded")) for i, (name, (_, decode)) in enumerate(listed)))
    return payloads.withColumn("d", F.explode(F.filter(forms, lambda f: f["decoded"].isNotNull()))).select(*payloads.columns, "d.*")


def _dissectors() -> list[tuple[str, tuple]]:
    return sorted(DISSECTORS.items(), key=lambda d: (d[1][0], d[0]))


def protocol(first_line: Column) -> Column:
    """The first registered protocol whose test the first line passes."""
    return F.coalesce(*(F.when(test(first_line), name) for name, (_, test, _) in _dissectors()))


def first_line(data: Column) -> Column:
    """The first line of a stream, of any length, without its line end."""
    return F.rtrim(F.substring_index(F.decode(data, "ISO-8859-1"), "\n", 1), F.lit("\r"))


def identified(streams: DataFrame, data: str) -> DataFrame:
    """protocol and payloads (array of binary) of each stream: of the first protocol in order whose test the first line
    passes and which finds payloads; null for null streams."""
    taken, line, given, got = "_taken", "_line", "_given", "_got"
    rows = streams.withColumns({line: first_line(F.col(data)), taken: F.lit(None).cast("struct<protocol:string,payloads:array<binary>>")})
    for name, (_, test, take) in _dissectors():
        rows = rows.withColumn(given, F.when(test(F.col(line)) & F.col(taken).isNull(), F.col(data)))
        rows = rows.withColumn(got, F.when(F.col(given).isNotNull(), take(F.col(given))))
        rows = rows.withColumn(taken, F.coalesce(taken, F.when(F.col(got).isNotNull(), F.struct(F.lit(name).alias("protocol"), F.col(got).alias("payloads")))))
    return rows.select(*streams.columns, f"{taken}.protocol", f"{taken}.payloads")


def dissected(streams: DataFrame, data: str) -> DataFrame:
    """protocol and payload: a row for each payload of each stream."""
    return identified(streams, data).withColumn("payload", F.explode("payloads")).drop("payloads")


def found_files(streams: DataFrame, data: str, entropy: bool = False) -> DataFrame:
    """The files inside the payloads of streams (file, ip_src, ip_dst, first_us): name, category, ext and bytes; entropy:
    each decoded payload also as a file of its own, with its entropy class as category.

    With entropy the decoded payloads are written once and read by both; each is classed in one pass."""
    keys = ["file", "ip_src", "ip_dst", "first_us"]
    payloads = decoded(dissected(streams, data).select(*keys, "payload"), "payload").select(*keys, "ord", F.col("decoded").cast("binary").alias("decoded"))
    payloads = cut(payloads) if entropy else payloads
    files = carve(payloads, "decoded", keep=[*keys, "ord"]).select(*keys, "ord", "category", "ext", "number", "carved")
    if entropy:
        own = with_entropy(payloads, "decoded").select(*keys, "ord", F.col("entropy_class").alias("category"), F.lit("unknown").alias("ext"), F.lit(1).alias("number"), F.col("decoded").alias("carved"))
        files = files.unionByName(own)
    place = Window.partitionBy(*keys, "category", "ext").orderBy("ord", "number", F.md5("carved"))
    name = F.concat_ws("_", F.concat("category", F.lit("s")), "ip_src", "ip_dst", file_time_text(F.col("first_us") / 1_000_000), F.row_number().over(place).cast("string"))
    return files.withColumn("name", F.concat(name, F.when(F.col("ext") != "", F.concat(F.lit("."), "ext")).otherwise("")))


def last_of_each(pairs: Column) -> Column:
    """A map of pairs (k, v) in which the last of several values of a key stays."""
    return F.aggregate(pairs, F.create_map().cast("map<string,string>"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, _: k != p["k"]), F.create_map(p["k"], p["v"])))


def http_request(raw: Column) -> Column:
    """Struct of method, uri, version and header map of a request text; null where the request line does not parse. Headers
    end at the first empty line."""
    lines = F.split(F.substring_index(raw, "\r\n\r\n", 1), "\r\n")
    pattern = r"^([A-Z]+) (\S+) HTTP/([0-9.]+)$"
    head = lines[0]
    header = F.filter(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: F.contains(x, F.lit(":")))
    pairs = F.transform(header, lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("k"), F.trim(F.substr(x, F.instr(x, ":") + 1)).alias("v")))
    whole = F.struct(F.regexp_extract(head, pattern, 1).alias("method"), F.regexp_extract(head, pattern, 2).alias("uri"), F.regexp_extract(head, pattern, 3).alias("version"), last_of_each(pairs).alias("headers"))
    return F.when(head.rlike(pattern), whole)


def cef_event(line: Column) -> Column:
    """The seven header fields of a CEF log line and its extension as a map."""
    body = F.regexp_extract(line, r"CEF:(.*)$", 1)
    part = lambda i: F.regexp_replace(F.regexp_extract(body, r"^" + r"(?:(?:\\.|[^|\\])*\|)" * i + r"((?:\\.|[^|\\])*)\|", 1), r"\\(.)", "$1")
    extension = F.regexp_extract(body, r"^(?:(?:\\.|[^|\\])*\|){7}(.*)$", 1)
    names = F.regexp_extract_all(extension, F.lit(r"(\w+)=(.*?)(?=\s\w+=|$)"), F.lit(1))
    values = F.regexp_extract_all(extension, F.lit(r"(\w+)=(.*?)(?=\s\w+=|$)"), F.lit(2))
    fields = ("version", "vendor", "product", "device_version", "event_id", "name", "severity")
    return F.struct(*(part(i).alias(f) for i, f in enumerate(fields)), last_of_each(F.zip_with(names, values, lambda k, v: F.struct(k.alias("k"), v.alias("v")))).alias("extension"))


def registered_domains(urls: DataFrame, url: str, suffixes: DataFrame) -> DataFrame:
    """host, its longest public suffix and the registered domain below it; suffixes(suffix) may be of any size."""
    host = F.lower(F.regexp_extract(url, r"^[a-z]+://([^/:?#]+)", 1))
    hosts = urls.select(host.alias("host")).filter("host <> ''").distinct()
    labels = F.split("host", r"\.")
    tails = hosts.withColumn("labels", labels).withColumn("i", F.explode(F.sequence(F.lit(1), F.size("labels"))))
    tails = tails.withColumn("suffix", F.array_join(F.slice("labels", F.col("i"), F.size("labels")), "."))
    best = tails.join(suffixes, "suffix").groupBy("host").agg(F.min("i").alias("i"), F.min_by("suffix", "i").alias("suffix"), F.first("labels").alias("labels"))
    domain = F.when(F.col("i") > 1, F.array_join(F.slice("labels", F.col("i") - 1, F.size("labels")), "."))
    sub = F.when(F.col("i") > 2, F.array_join(F.slice("labels", F.lit(1), F.col("i") - 2), ".")).otherwise("")
    return best.select("host", "suffix", domain.alias("domain"), sub.alias("subdomain"))
