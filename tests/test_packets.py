"""Packets and streams: protocol dispatch, outcomes of packets, flows, rebuilding of hot flows."""

import random
import struct
import time
from collections import defaultdict

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flintglass.operators import content, messages, packets
from flintglass.plans import segments

PNG = b"\x89PNG\r\n\x1a\nabcIEND\xae\x42\x60\x82"


def test_dispatch_falls_through(spark):
    long_line = b"GET /" + b"p" * 5_000 + b" HTTP/1.1\r\nContent-Length: 2\r\n\r\nok"
    streams = {
        1: b"HTTP/1.0 200 OK\r\nContent-Length: %d\r\n\r\n" % len(PNG) + PNG, 2: b"HTTP/1.0 200 OK\r\n\r\n" + PNG, 3: b"HTTP/1.0 200 OK\r\nContent-Length: 0\r\n\r\n", 4: long_line,
        5: b"HTTP/1.1 200 OK\r\n\r\n", 6: b"\x00\xff\n", 7: b"", 8: None, 9: b"GET / HTTP/1.0 HTTP/1.1\r\n\r\nGET / HTTP/1.1\r\nContent-Length: 1\r\n\r\nz", 10: b"HTTP/1.1 no line end",
    }
    rows = spark.createDataFrame(list(streams.items()), "id int, data binary")
    got = {r.id: (r.protocol, None if r.payloads is None else [bytes(p) for p in r.payloads]) for r in content.identified(rows, "data").collect()}
    assert got == {
        1: ("http10", [PNG]), 2: ("unknown", [streams[2]]), 3: ("unknown", [streams[3]]), 4: ("http11", [b"ok"]), 5: ("http11", []), 6: ("unknown", [b"\x00\xff\n"]),
        7: ("unknown", [b""]), 8: (None, None), 9: ("http11", [b"z"]), 10: ("http11", []),
    }
    assert content.carve(content.dissected(rows.filter("id = 2"), "data").select("payload"), "payload").count() == 1
    assert sorted(r.id for r in content.dissected(rows, "data").select("id").collect()) == [1, 2, 3, 4, 6, 7, 9]


def test_only_streams_of_a_protocol_reach_its_reader(spark):
    @F.pandas_udf(T.ArrayType(T.BinaryType()))
    def reader(data: pd.Series) -> pd.Series:
        assert data.dropna().map(lambda d: d.startswith(b"own")).all()  # others come as null
        return data.map(lambda d: [d[4:]] if d is not None and d.endswith(b"!") else None)

    content.register_dissector("own", 1, lambda line: F.startswith(line, F.lit("own")), lambda data: reader(data))
    try:
        rows = spark.createDataFrame([(1, b"own yes!"), (2, b"own no"), (3, b"other!")], "id int, data binary")
        assert sorted((r.id, r.protocol, bytes(r.payload)) for r in content.dissected(rows, "data").collect()) == [(1, "own", b"yes!"), (2, "unknown", b"own no"), (3, "unknown", b"other!")]
    finally:
        del content.DISSECTORS["own"]


def dns(flags=0x8180, kind=1, answers=1, cut=0):
    wire = struct.pack(">6H", 7, flags, 1, answers, 0, 0) + b"\x01a\x00" + b"\0\1\0\1"
    wire += (b"\xc0\x0c" + struct.pack(">HHIH", kind, 1, 60, 4) + b"\1\2\3\4") * answers
    return wire[: len(wire) - cut]


def test_outcomes_of_packets(spark):
    get = b"GET /x HTTP/1.1\r\nHost: h\r\nUri: no\r\nSource_IP: me\r\n\r\nLater: body"
    rows = [
        (1, 1000, 80, get), (2, 1000, 443, b"\x16\x03\x01"), (3, 1000, 80, None), (4, 1000, 80, b""), (5, 53, 4000, dns()), (6, 4000, 53, dns(flags=0x0100)), (7, 4000, 53, dns(flags=0x8183)),
        (8, 53, 4000, dns(answers=0)), (9, 53, 4000, dns(kind=16)), (10, 53, 4000, dns(cut=2)), (11, 53, 80, get), (12, 53, 80, dns()), (13, 5, 6, b"x"), (14, 5, 6, None), (15, 53, 4000, None),
    ]
    frame = spark.createDataFrame([("f", n, "a", s, "b", d, p) for n, s, d, p in rows], "file string, pkt_no long, ip_src string, sport int, ip_dst string, dport int, payload binary")
    found = packets.outcomes(frame)
    assert {r.pkt_no for r in found.filter("skipped").collect()} == {2, 3, 4, 6, 7, 8, 10, 11, 12, 15}
    requests = {r.pkt_no: r for r in packets.http_requests(found).collect()}
    assert set(requests) == {1, 11}  # a packet from port 53 to port 80 is a request, though no good response
    assert requests[1].fields == {"host": "h", "source_ip": "a", "destination_ip": "b", "method": "GET", "version": "1.1", "uri": "/x"}
    assert (requests[1].source_ip, requests[1].uri) == ("a", "/x")
    assert [(r.pkt_no, r.type, r.request, r.response) for r in packets.dns_requests(found).collect()] == [(5, "A", "a", "1.2.3.4")]
    assert {(r.flow, r.first_pkt) for r in packets.distinct_flows(found).collect()} == {("a/1000=>b/80", 1), ("a/53=>b/4000", 5), ("a/5=>b/6", 13)}
    assert packets.all_flows(found).count() == 6
    assert messages.read_good_response(None) is None and messages.read_answers(dns(cut=2)) == []


KINDS = "file string, ip_src string, sport int, ip_dst string, dport int, pkt_no long, ts_us long, ip_proto int, seq long, syn int, fin int, len int"


def random_packets(rng, n=1_500):
    """Half of all packets are of one flow; time jumps, sequence numbers repeat, streams open and close anywhere."""
    rows, at, seq = [], 0, defaultdict(int)
    for i in range(n):
        at += rng.choice((1, 5, 130)) * 1_000_000
        flow = 1 if rng.random() < 0.5 else rng.randrange(2, 8)
        for proto in (6, 17):
            length = rng.choice((0, 10, 10, 10))
            rows.append(("f", "a", flow, None if flow == 7 else "b", 80, 2 * i + (proto == 17), at, proto, 100 + seq[flow], int(rng.random() < 0.1), int(rng.random() < 0.03), length))
            if proto == 6 and rng.random() < 0.97:
                seq[flow] += length
            if rng.random() < 0.02:
                seq[flow] = 0
    return rows


def modelled(rows, timeout=120_000_000):
    """Valid TCP streams and UDP sessions by a loop over the packets."""
    opened, number, tcp, last, session, udp = {}, defaultdict(int), [], {}, defaultdict(int), defaultdict(list)

    def close(key, epoch):
        parts = sorted((q, n, t) for q, (n, t) in opened.pop(key).items())
        if parts:
            whole = all(a[0] + a[1] == b[0] for a, b in zip(parts, parts[1:], strict=False))
            tcp.append((*key, epoch, len(parts), min(p[2] for p in parts), max(p[2] for p in parts), whole, sum(p[1] for p in parts)))

    for file, src, sport, dst, dport, _, t, proto, seq, syn, fin, n in sorted(rows, key=lambda r: r[5]):
        key = (file, src, sport, dst, dport)
        if proto == 6:
            if syn and key not in opened:
                opened[key] = {}
            if key in opened and n:
                opened[key].setdefault(seq, (n, t))
            if fin:
                if key in opened:
                    close(key, number[key])
                number[key] += 1
        elif n:
            if key in last and t - last[key] > timeout:
                session[key] += 1
            last[key] = t
            udp[(*key, session[key])].append(t)
    for key in list(opened):
        close(key, number[key])
    return tcp, [(*k, len(v), min(v), max(v)) for k, v in udp.items()]


def as_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("run,seq_run,seed", [(1 << 20, 1 << 24, 1), (64, 64, 2), (7, 10, 3)])
def test_hot_flows_in_runs(spark, monkeypatch, run, seq_run, seed):
    monkeypatch.setattr(packets, "RUN", run)
    monkeypatch.setattr(packets, "SEQ_RUN", seq_run)
    rows = random_packets(random.Random(seed))
    given = spark.createDataFrame(rows, KINDS)
    tcp, udp = modelled(rows)
    found = packets.tcp_streams(given).select(*packets.STREAM, F.col("epoch").cast("long"), "n_packets", "first_us", "last_us", "valid")
    assert as_rows(found) == sorted((r[:-1] for r in tcp), key=repr)
    assert as_rows(packets.udp_sessions(given).withColumn("session", F.col("session").cast("long"))) == sorted(udp, key=repr)
    chunks = packets.stream_chunks(packets.tcp_segments(given)).groupBy(*packets.STREAM, F.col("epoch").cast("long")).agg(F.min("pos"), F.max(F.col("pos") + F.col("len")))
    assert as_rows(chunks) == sorted(((*r[:6], 0, r[-1]) for r in tcp if r[-2]), key=repr)


def test_a_hot_flow_is_shared_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(packets, "RUN", 1_000)
    rows = spark.range(100_000).selectExpr("'f' AS file", "'a' AS ip_src", "1 AS sport", "'b' AS ip_dst", "2 AS dport", "id AS pkt_no", "id AS ts_us", "6 AS ip_proto", "id * 10 AS seq", "CAST(id = 0 AS INT) AS syn", "0 AS fin", "10 AS len")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        shares = packets.tcp_epochs(rows).groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(r["count"] for r in shares) == 100_000 and max(r["count"] for r in shares) < 50_000


def test_running_values(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["a", "b", None]), i, rng.choice([None, rng.randrange(-50, 50)])) for i in range(400)]
    frame = spark.createDataFrame(rows, "k string, i long, v long").withColumn("part", F.floor(F.col("i") / 13))
    values = {"total": ("sum", "v"), "most": ("max", "v", "before"), "least": ("min", "v"), "mixed": ("xor", F.abs("v"))}
    got = {r.i: r for r in segments.running(frame, ["k"], "part", ["i"], values).collect()}
    assert len(got) == 400
    for k, i, _ in rows:
        upto = [v for kk, j, v in rows if kk == k and j <= i and v is not None]
        before = [v for kk, j, v in rows if kk == k and j < i and v is not None]
        mixed = None
        for v in upto:
            mixed = (mixed or 0) ^ abs(v)
        assert (got[i].total, got[i].most, got[i].least, got[i].mixed) == (sum(upto) if upto else None, max(before, default=None), min(upto, default=None), mixed)
    numbered = segments.numbered(frame.select("k", "i", "v"), ["k"], [F.col("v").asc_nulls_first(), F.col("i").desc()], "place").collect()
    for k in ("a", "b", None):
        own = sorted((r for r in numbered if r.k == k), key=lambda r: (r.v is not None, r.v or 0, -r.i))
        assert [r.place for r in own] == list(range(len(own)))


def test_stream_bytes_take_time_in_proportion(spark):
    def took(n):
        rows = spark.range(n).selectExpr("'f' AS file", "'a' AS ip_src", "1 AS sport", "'b' AS ip_dst", "2 AS dport", "0 AS epoch", f"{n} - id AS seq", "true AS joined", "unhex(repeat(lpad(hex(id % 256), 2, '0'), 2000)) AS payload")
        began = time.time()
        assert packets.stream_bytes(rows, "payload").select(F.length("data"), F.hex(F.substring("data", 1, 1))).first()[0] == 2_000 * n
        return time.time() - began

    took(100)
    assert took(16_000) < 16 * took(2_000) + 5  # copying all earlier bytes at each step takes 64 times as long
