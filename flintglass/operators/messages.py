"""Messages inside payloads: DNS answers, bodies of pipelined HTTP messages, checksums of packets.

Each needs a cursor over the bytes of one value and runs in Arrow batches; broken or null values give null or no items.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.segments import numbered

# Numbers of the kept record types.
DNS_TYPES = {1: "A", 5: "CNAME", 12: "PTR"}
ANSWER = T.StructType([T.StructField(c, T.StringType()) for c in ("type", "request", "response")])
_LENGTH = re.compile(rb"(?im)^content-length[ \t]*:[ \t]*([0-9]+)[ \t]*\r?$")
_CODING = {k: re.compile(rb"(?im)^%s[ \t]*:[ \t]*([a-z-]+)" % k) for k in (b"transfer-encoding", b"content-encoding")}


def _name(data: bytes, at: int) -> tuple[str, int]:
    """A possibly compressed name and the place after it; a pointer must lead backwards."""
    labels, after, bound = [], None, len(data)
    while True:
        n = data[at]
        if n >= 0xC0:
            after = after or at + 2
            to = (n & 0x3F) << 8 | data[at + 1]
            if to >= min(at, bound):
                raise ValueError("pointer does not lead backwards")
            at = bound = to
        elif n == 0:
            return ".".join(labels), after or at + 1
        else:
            labels.append(data[at + 1 : at + 1 + n].decode("latin-1"))
            at += 1 + n


def _answers(data: bytes | None, found: list[dict]) -> bool:
    """Adds the answers of a kept type to `found`; whether this is a good response: response bit, plain query, no error, at
    least one answer, all of them whole."""
    try:
        _, flags, questions, answers = struct.unpack_from(">4H", data)
        if flags & 0xF80F != 0x8000:
            return False
        at = 12
        for _ in range(questions):
            at = _name(data, at)[1] + 4
        for _ in range(answers):
            name, at = _name(data, at)
            kind, _, _, size = struct.unpack_from(">HHIH", data, at)
            at += 10
            if at + size > len(data):
                return False
            if kind in DNS_TYPES:
                value = ".".join(map(str, data[at : at + size])) if kind == 1 else _name(data, at)[0]
                found.append({"type": DNS_TYPES[kind], "request": name, "response": value})
            at += size
        return answers > 0
    except (TypeError, ValueError, IndexError, struct.error):
        return False  # null or cut message


def read_answers(data: bytes | None) -> list[dict]:
    """Answers of a kept type of a response; of a cut one those before the cut."""
    found: list[dict] = []
    _answers(data, found)
    return found


def read_good_response(data: bytes | None) -> list[dict] | None:
    """Answers of a kept type of a good response (maybe none); null for any other message."""
    found: list[dict] = []
    return found if _answers(data, found) else None


@F.pandas_udf(T.ArrayType(ANSWER))
def dns_answers(data: pd.Series) -> pd.Series:
    return data.map(read_answers)


@F.pandas_udf(T.ArrayType(ANSWER))
def good_response(data: pd.Series) -> pd.Series:
    return data.map(read_good_response)


def inflated(body: bytes, coding: bytes) -> bytes:
    """The decoded body; other codings and broken bodies stay as they are."""
    for bits in {b"gzip": (31,), b"x-gzip": (31,), b"deflate": (15, -15)}.get(coding, ()):
        try:
            return zlib.decompress(body, bits)
        except zlib.error:
            continue
    return body


def _messages(data: bytes, at: int = 0) -> Iterator[bytes | None]:
    """The body of each message from `at` on, by its length header; null for a message without one."""
    while (end := data.find(b"\r\n\r\n", at)) >= 0:
        head, at = data[at : end + 2], end + 4
        m = _LENGTH.search(head)
        if not m:
            yield None
            continue
        body, at = data[at : at + int(m[1])], at + int(m[1])
        yield inflated(body, next((c[1].lower() for p in _CODING.values() if (c := p.search(head))), b""))


def read_bodies(data: bytes | None) -> list[bytes] | None:
    """Bodies of consecutive messages; empty ones and those without a length are left out. Null for null."""
    return None if data is None else [body for body in _messages(data) if body]


def read_body(data: bytes | None) -> list[bytes] | None:
    """The body of the one message of a stream; null, so that another reader may try, where it has no length or is empty."""
    body = None if data is None else next(_messages(data), None)
    return [body] if body else None


@F.pandas_udf(T.ArrayType(T.BinaryType()))
def http_bodies(data: pd.Series) -> pd.Series:
    return data.map(read_bodies)


@F.pandas_udf(T.ArrayType(T.BinaryType()))
def http_body(data: pd.Series) -> pd.Series:
    return data.map(read_body)


def _sums_to_zero(data: bytes) -> bool:
    total = int(np.frombuffer(data + b"\0" * (len(data) % 2), ">u2").sum(dtype=np.uint64))
    while total >> 16:
        total = (total & 0xFFFF) + (total >> 16)
    return total == 0xFFFF


def has_checksums(frame: bytes | None) -> bool | None:
    """IPv4 header sum, then (but for fragments) the TCP or UDP sum over its pseudo-header; null for other frames."""
    if frame is None or len(frame) < 34 or frame[12:14] != b"\x08\x00":
        return None
    ip = frame[14:]
    head, length, part = ip[0] % 16 * 4, int.from_bytes(ip[2:4], "big"), int.from_bytes(ip[6:8], "big")
    if not _sums_to_zero(ip[:head]):
        return False
    if part & 0x3FFF or ip[9] not in (6, 17):
        return True
    segment = ip[head:length]
    return _sums_to_zero(ip[12:20] + struct.pack(">HH", ip[9], len(segment)) + segment)


@F.pandas_udf(T.BooleanType())
def checksum_ok(frame: pd.Series) -> pd.Series:
    return frame.map(has_checksums)


def number_files(files: DataFrame, alike: list[str], order: list[str]) -> DataFrame:
    """Adds number: 1, 2, .. among files of equal name, however many there are."""
    return numbered(files, alike, [F.col(c) for c in order], "number").withColumn("number", (F.col("number") + 1).cast("int"))


def summary_items(file: Column, **sections: tuple[DataFrame, list[str]]) -> DataFrame:
    """(file, section, item) with each row of each section as a JSON item: a capture's document, one row an item, so that
    a capture of any size never has to fit in one row."""
    found = None
    for name, (rows, fields) in sections.items():
        part = rows.select(file, F.lit(name).alias("section"), F.to_json(F.struct(*fields)).alias("item"))
        found = part if found is None else found.unionByName(part)
    return found
