"""Packet captures: classic libpcap files to one row a record, with the header fields of Ethernet, IPv4, TCP and UDP."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "file string, pkt_no long, ts_us long, caplen int, len int, frame binary"
#: Records of one Arrow batch.
BATCH = 1_000
# Magic numbers of the file header -> byte order and units of a second.
MAGIC = {b"\xd4\xc3\xb2\xa1": ("<", 1_000_000), b"\xa1\xb2\xc3\xd4": (">", 1_000_000), b"\x4d\x3c\xb2\xa1": ("<", 1_000_000_000), b"\xa1\xb2\x3c\x4d": (">", 1_000_000_000)}


def records(content: bytes) -> Iterator[tuple[int, int, int, bytes]]:
    """(ts_us, caplen, len, frame) of each whole record; a file of another kind has none."""
    order, unit = MAGIC.get(content[:4], (None, 0))
    at = 24
    while order and at + 16 <= len(content):
        sec, part, caplen, length = struct.unpack_from(order + "IIII", content, at)
        if at + 16 + caplen > len(content):
            return
        yield sec * 1_000_000 + part * 1_000_000 // unit, caplen, length, content[at + 16 : at + 16 + caplen]
        at += 16 + caplen


def parse_captures(files: DataFrame) -> DataFrame:
    """The records of captures (path, content: whole files as binary values), numbered within each."""
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    names = ["file", "pkt_no", "ts_us", "caplen", "len", "frame"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                for n, record in enumerate(records(content.as_py() or b"")):
                    rows.append((path.as_py(), n, *record))
                    if len(rows) == BATCH:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return files.select("path", "content").mapInArrow(run, SCHEMA)


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """All captures of a path or glob; one task reads a file, which holds 2 GB at most (longer captures are landed in parts)."""
    return parse_captures(spark.read.format("binaryFile").load(path))


def _number(start, size: int):
    return F.conv(F.hex(F.substring("frame", start, size)), 16, 10).cast("long")


def dissect(packets: DataFrame) -> DataFrame:
    """Adds addresses, ports, flags and payload of IPv4 TCP and UDP packets; other packets are dropped."""
    rows = packets.filter(F.conv(F.hex(F.substring("frame", 13, 2)), 16, 10) == "2048")
    rows = rows.withColumn("ihl", (_number(15, 1) % 16 * 4).cast("int")).withColumn("ip_len", _number(17, 2).cast("int")).withColumn("ip_proto", _number(24, 1).cast("int"))
    address = lambda at: F.concat_ws(".", *(_number(at + i, 1).cast("string") for i in range(4)))
    rows = rows.filter("ip_proto IN (6, 17)").withColumn("ip_src", address(27)).withColumn("ip_dst", address(31)).withColumn("l4", 15 + F.col("ihl"))
    rows = rows.withColumn("sport", _number(F.col("l4"), F.lit(2)).cast("int")).withColumn("dport", _number(F.col("l4") + 2, F.lit(2)).cast("int"))
    tcp = F.col("ip_proto") == 6
    flags = _number(F.col("l4") + 13, F.lit(1))
    head = F.when(tcp, F.floor(_number(F.col("l4") + 12, F.lit(1)) / 16) * 4).otherwise(8).cast("int")
    rows = rows.withColumn("seq", F.when(tcp, _number(F.col("l4") + 4, F.lit(4)))).withColumn("fin", F.when(tcp, (flags % 2).cast("int")).otherwise(0)).withColumn("syn", F.when(tcp, (F.floor(flags / 2) % 2).cast("int")).otherwise(0))
    return rows.withColumn("head", head).withColumn("payload", F.substring("frame", F.col("l4") + F.col("head"), F.greatest(F.col("ip_len") - F.col("ihl") - F.col("head"), F.lit(0)))).withColumn("payload_len", F.length("payload")).drop("l4", "head", "ihl", "ip_len")


def truncated(packets: DataFrame) -> DataFrame:
    """Whether any record of a capture was cut."""
    return packets.groupBy("file").agg(F.bool_or(F.col("caplen") != F.col("len")).alias("truncated"))
