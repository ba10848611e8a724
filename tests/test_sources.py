import gzip
import json
import struct
import zlib

from pyspark.sql import functions as F

from flintglass.functions import text as fn
from flintglass.operators import content, messages, packets
from flintglass.sources import captures, catalogues


def frame(src, dst, sport, dport, payload, proto=6, seq=0, flags=0):
    l4 = struct.pack(">HHIIBBHHH", sport, dport, seq, 0, 0x50, flags, 0, 0, 0) if proto == 6 else struct.pack(">HHHH", sport, dport, 8 + len(payload), 0)
    ip = struct.pack(">BBHHHBBH4s4s", 0x45, 0, 20 + len(l4) + len(payload), 0, 0, 64, proto, 0, bytes(map(int, src.split("."))), bytes(map(int, dst.split("."))))
    return b"\0" * 12 + b"\x08\x00" + ip + l4 + payload


def capture(frames):
    out = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
    for i, f in enumerate(frames):
        out += struct.pack("<IIII", 1_700_000_000 + i, 5, len(f), len(f)) + f
    return out


def test_capture_to_carved_file(spark, tmp_path):
    body = b"xx\x89PNG\r\n\x1a\n" + bytes(range(256)) + b"IEND\xae\x42\x60\x82yy"
    a, b = "10.0.0.1", "10.0.0.2"
    frames = [
        frame(a, b, 1000, 80, b"", flags=2, seq=99), frame(a, b, 1000, 80, body[100:], seq=200), frame(a, b, 1000, 80, body[:100], seq=100),
        frame(a, b, 1000, 80, body[:100], seq=100), frame(a, b, 1000, 80, b"", flags=1, seq=1), frame(a, b, 5, 53, b"hello", proto=17), b"\0" * 12 + b"\x86\xdd" + b"\0" * 40,
    ]
    (tmp_path / "one.pcap").write_bytes(capture(frames))
    (tmp_path / "bad.pcap").write_bytes(b"no capture")
    rows = captures.read_captures(spark, str(tmp_path / "*.pcap"))
    assert rows.count() == 7 and not captures.truncated(rows).first().truncated
    found = captures.dissect(rows)
    udp = found.filter("ip_proto = 17").first()
    assert (udp.ip_src, udp.sport, udp.dport, bytes(udp.payload)) == (a, 5, 53, b"hello")
    segments = packets.tcp_segments(found.drop("len").withColumnRenamed("payload_len", "len"))
    stream = packets.stream_bytes(segments, "payload")
    assert bytes(stream.first().data) == body
    carved = content.carve(stream.select("data"), "data").collect()
    assert [(r.format, r.ext, bytes(r.carved)) for r in carved] == [("png", "png", body[2:-2])]


def test_landed_files(spark, tmp_path):
    (tmp_path / "build.conf").write_text("version=9\n# c=1\n deprecated = true \nnothing\nversion=1.0=a\n")
    assert catalogues.build_properties(catalogues.landed_files(spark, str(tmp_path / "build.conf"))).first().props == {"version": "1.0=a", "deprecated": "true"}
    (tmp_path / "Dockerfile").write_text("FROM busybox:2.4 as tools\nRUN x\nFROM mill/grain:7.1.0.42\nFROM mill/flour\n")
    refs = catalogues.image_bases(catalogues.landed_files(spark, str(tmp_path / "Dockerfile"))).select(fn.split_image_ref(F.col("ref")).alias("r")).select("r.*").collect()
    assert sorted(map(tuple, refs), key=repr) == [("library", "busybox", "2.4"), ("mill", "flour", None), ("mill", "grain", "7.1.0.42")]
    (tmp_path / "Pipfile").write_text('[requires]\npython_version = "3.10"\n')
    assert catalogues.python_requirements(catalogues.landed_files(spark, str(tmp_path / "Pipfile"))).first().version == "3.10"
    rows = spark.createDataFrame([("x", '[{"name":"a","version":"1"}]'), ("y", '{"name":"b","version":"2"}')], "image string, t string")
    assert sorted(tuple(r) for r in catalogues.package_inventory(rows, "t").collect()) == [("x", "a", "1"), ("y", "b", "2")]


def test_constraints(spark):
    cases = [("3.10.1", "3.10", False, True, "3.10"), ("3.10.1", "~3.10", True, True, "~3.10"), ("3.10.1", ">=3.9,<3.11", True, False, "~3.10"), ("3.10.1", "3.9", False, False, "3.10"), ("2", "2.0", False, True, "2.0")]
    for base, text, tilde, ok, right in cases:
        r = spark.range(1).select(fn.version_conformance(F.lit(base), F.lit(text), tilde).alias("v")).first().v
        assert (r.ok, r.correct) == (ok, right)
    forms = {">=3.9": (">=", "3.9"), ">=3.9,<=3.11": ("<=", "3.11"), "===3.9": ("===", "3.9"), "<3.11,>=3.9": (">=", "3.9"), "~=3": ("~=", "3"), "3.1": ("", "3.1"), "": ("", "")}
    for text, want in forms.items():
        assert tuple(spark.range(1).select(fn.constraint(F.lit(text)).alias("v")).first().v) == want


def test_repeated_headers_and_keys_keep_the_last(spark):
    r = spark.range(1).select(content.http_request(F.lit("GET / HTTP/1.1\r\nCookie: a=1\r\nCookie: b=2\r\n\r\n")).alias("r"), content.cef_event(F.lit("CEF:0|a|b|c|d|e|f|k=1 k=2")).alias("c")).first()
    assert r.r.headers == {"cookie": "b=2"} and r.c.extension == {"k": "2"}
    r = spark.range(1).select(content.http_request(F.lit("GET / HTTP/1.1")).alias("r"), content.http_request(F.lit("no request")).alias("n"), content.cef_event(F.lit("plain")).alias("c")).first()
    assert r.r.headers == {} and r.n is None and r.c.extension == {}


def test_users_add_signatures_decoders_and_protocols(spark):
    rows = spark.createDataFrame([("f", "a", "b", 0, b"MAGIC one END and 2f")], "file string, ip_src string, ip_dst string, first_us long, data binary")
    own = (*content.SIGNATURES, ("own", (("MAGIC", "END"),), "own", "Other"))
    assert [bytes(r.carved) for r in content.carve(rows, "data", own).filter("format = 'own'").collect()] == [b"MAGIC one END"]
    content.register_decoder("upper", 5, lambda c: F.upper(F.decode(c, "ISO-8859-1")).cast("binary"))
    content.register_dissector("magic", 1, lambda line: F.startswith(line, F.lit("MAGIC")), lambda data: F.array(F.substring(data, 7, 3)))
    try:
        assert [(r.ord, r.decoder, bytes(r.decoded)) for r in content.decoded(rows, "data").collect()][:2] == [(0, "upper", b"MAGIC ONE END AND 2F"), (1, "plain", b"MAGIC one END and 2f")]
        assert [(r.protocol, bytes(r.payload)) for r in content.dissected(rows, "data").collect()] == [("magic", b"one")]
    finally:
        del content.DECODERS["upper"], content.DISSECTORS["magic"]


def test_truncated_captures(spark):
    whole, short = capture([b"x" * 20]), bytearray(capture([b"x" * 20]))
    short[36:40] = struct.pack("<I", 60)
    rows = captures.parse_captures(spark.createDataFrame([("a", bytes(whole)), ("b", bytes(short)), ("c", None)], "path string, content binary"))
    assert {r.file: r.truncated for r in captures.truncated(rows).collect()} == {"a": False, "b": True}


def test_internal_branches_and_devonly(spark):
    from flintglass.operators import images

    branches = spark.createDataFrame([("origin/autoupdate/org/python3_img_1.2.3",), ("origin/autoupdate/org/python3_img_9.2.3",), ("origin/other",), (None,)], "branch string")
    bases = spark.createDataFrame([("org", "python3", "2.0.0"), ("org", "python", "2.0.0")], "repo string, image string, latest string")
    assert [tuple(r) for r in images.superseded_branches(branches, bases, external=False).collect()] == [("org/python3", "origin/autoupdate/org/python3_img_1.2.3")]
    rows = spark.createDataFrame([("a", None, "true", "1"), ("b", "true", None, "1"), ("c", None, None, None)], "image string, deprecated string, devonly string, tag string")
    assert [r.image for r in images.active(rows, devonly=True).collect()] == ["a"] and images.active(rows).count() == 0


def test_streams_close_by_watermark_and_idle_time(spark, tmp_path):
    from flintglass.streaming import live

    hour = 3_600_000_000
    rows = [("f", "a", 1, "b", 2, i, i * 1_000_000 + at, 6, seq, syn, 0, 10) for at, part in ((0, ((1, 0, 1), (2, 10, 0))), (9 * hour, ((3, 0, 1), (4, 30, 0)))) for i, seq, syn in part]
    kinds = "file string, ip_src string, sport long, ip_dst string, dport int, pkt_no long, ts_us long, ip_proto int, seq long, syn int, fin int, len int"
    found = live.replay(spark.createDataFrame(rows, kinds), live.tcp_streams_live).collect()
    # both streams reach the operator in one batch and are one open stream until its idle time; the gap makes it invalid
    assert found == []
    found = live.replay(spark.createDataFrame(rows[:2], kinds), live.tcp_streams_live).collect()
    assert [(r.n_packets, r.first_us, r.last_us) for r in found] == [(2, 1_000_000, 2_000_000)]


def _summed(data):
    data += b"\0" * (len(data) % 2)
    total = sum(struct.unpack(f">{len(data) // 2}H", data))
    while total >> 16:
        total = (total & 0xFFFF) + (total >> 16)
    return struct.pack(">H", 0xFFFF ^ total)


def test_messages(spark):
    bodies = [b"plain", zlib.compress(b"deflated"), gzip.compress(b"zipped"), b"broken"]
    codings = [b"", b"Content-Encoding: deflate\r\n", b"content-encoding: x\r\nTransfer-Encoding: gzip\r\n", b"Content-Encoding: gzip\r\n"]
    http = b"GET / HTTP/1.1\r\nHost: a\r\n\r\n" + b"".join(b"HTTP/1.1 200 OK\r\n" + c + b"Content-Length: %d\r\n\r\n" % len(b) + b for b, c in zip(bodies, codings, strict=True))
    question = struct.pack(">6H", 7, 0x8180, 1, 3, 0, 0) + b"\x03www\x01a\x00" + b"\0\1\0\1"
    answers = b"\xc0\x0c\0\5\0\1\0\0\0\x3c\0\4\1b\xc0\x10" + b"\xc0\x10\0\1\0\1\0\0\0\x3c\0\4\1\2\3\4" + b"\xc0\x0c\0\x10\0\1\0\0\0\x3c\0\1\0"
    loop = struct.pack(">6H", 7, 0x8180, 0, 1, 0, 0) + b"\xc0\x0c"
    rows = spark.createDataFrame([(1, http, question + answers), (2, None, None), (3, b"", loop), (4, b"\r\n\r\n", question[:3]), (5, b"x", question[:2] + b"\x01\x80" + (question + answers)[4:])], "id int, h binary, d binary")
    found = {r.id: r for r in rows.select("id", messages.http_bodies("h").alias("h"), messages.dns_answers("d").alias("d")).collect()}
    assert [bytes(b) for b in found[1].h] == [b"plain", b"deflated", b"zipped", b"broken"]
    assert [tuple(a) for a in found[1].d] == [("CNAME", "www.a", "b.a"), ("A", "a", "1.2.3.4")]
    assert all(not found[i].h and not found[i].d for i in (2, 3, 4, 5))

    raw = frame("10.0.0.1", "10.0.0.2", 5, 6, b"odd", proto=6)
    ip = raw[14:24] + _summed(raw[14:34]) + raw[26:34]
    segment = raw[34:]
    right = segment[:16] + _summed(ip[12:20] + struct.pack(">HH", 6, len(segment)) + segment) + segment[18:]
    frames = [raw, raw[:14] + ip + segment, raw[:14] + ip + right, raw[:20], None]
    got = [r.ok for r in spark.createDataFrame(list(enumerate(frames)), "id int, frame binary").select("id", messages.checksum_ok("frame").alias("ok")).orderBy("id").collect()]
    assert got == [False, False, True, None, None]


def test_base_closure_has_no_depth_or_row_limit(spark):
    from flintglass.operators import images

    def levels(pairs, roots=(0,)):
        edges = spark.createDataFrame(pairs, "base long, dependent long")
        return {r.image: r.level for r in images.base_closure(spark, edges, spark.createDataFrame([(r,) for r in roots], "base long")).collect()}

    assert levels([(i, i + 1) for i in range(55)]) == {i: i for i in range(56)}, "deeper than 50 levels"
    # shared bases: 3 ** 13 paths, more than a recursive query may hold
    assert levels([(3 * k + i, 3 * k + 3 + j) for k in range(13) for i in range(3) for j in range(3)], (0, 1, 2)) == {i: i // 3 for i in range(42)}
    cyclic = [(0, 1), (1, 2), (0, 2), (2, 3), (3, 4), (4, 3), (4, 5), (1, 1), (8, 9), (0, 0)]
    assert levels(cyclic) == {0: 0, 1: 1, 2: 2, 3: None, 4: None, 5: None}
    assert levels(cyclic, ()) == {}
