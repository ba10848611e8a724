"""Queries over captures, contents, addresses and image catalogues with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as fn
from .operators import content, enrich, images, intervals, messages, packets, rules
from .plans.registered import ORACLE_SQL, QUERIES, query
from .plans.segments import numbered
from .plans.views import edges, frames, named, packets as packets_v, table, tags
from .sources import captures
from .streaming import live

# ---- packets

_COUNTS = "SELECT file, count(*) AS n_packets, count(*) FILTER (dport IN (80, 443)) AS n_http, count(*) FILTER (sport = 53 OR dport = 53) AS n_dns FROM packets_v GROUP BY file"
_FLOWS = "SELECT file, concat(ip_src, '/', sport, '=>', ip_dst, '/', dport) AS flow, min(pkt_no) AS first_pkt FROM packets_v GROUP BY ALL"
_SKIPPED = "((dport IN (80, 443) AND k % 3 = 0) OR (dport = 53 AND k % 4 = 0))"
_KEPT_FLOWS = _FLOWS.replace("FROM packets_v", f"FROM packets_v WHERE NOT {_SKIPPED}")
_KEY = "file, ip_src, sport, ip_dst, dport"
_SEGMENTS = f"""WITH ep AS (SELECT *, coalesce(sum(fin) OVER (PARTITION BY {_KEY} ORDER BY pkt_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS epoch FROM packets_v WHERE ip_proto = 6),
 op AS (SELECT *, max(syn) OVER (PARTITION BY {_KEY}, epoch ORDER BY pkt_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS opened FROM ep),
 fi AS (SELECT *, row_number() OVER (PARTITION BY {_KEY}, epoch, seq ORDER BY pkt_no) AS rn FROM op WHERE opened = 1 AND len > 0),
 seg AS (SELECT *, coalesce(lag(seq + len) OVER (PARTITION BY {_KEY}, epoch ORDER BY seq) = seq, true) AS joined FROM fi WHERE rn = 1)"""
_TCP = _SEGMENTS + f" SELECT {_KEY}, CAST(epoch AS BIGINT) AS epoch, count(*) AS n_packets, min(ts_us) AS first_us, max(ts_us) AS last_us, bool_and(joined) AS valid FROM seg GROUP BY ALL"
_UDP = f"""WITH g AS (SELECT *, CASE WHEN ts_us - lag(ts_us) OVER w > 21600000000 THEN 1 ELSE 0 END AS new FROM packets_v WHERE ip_proto = 17 AND len > 0 WINDOW w AS (PARTITION BY {_KEY} ORDER BY pkt_no)),
 s AS (SELECT *, sum(new) OVER (PARTITION BY {_KEY} ORDER BY pkt_no ROWS UNBOUNDED PRECEDING) AS session FROM g)
 SELECT {_KEY}, CAST(session AS BIGINT) AS session, count(*) AS n_packets, min(ts_us) AS first_us, max(ts_us) AS last_us FROM s GROUP BY ALL"""
SESSION_US = 6 * 3600 * 1_000_000


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packet counts of each capture with its number of distinct flows."""
    p = packets_v(spark, sf_dir)
    return packets.packet_counts(p).join(packets.all_flows(p).groupBy("file").agg(F.count("*").alias("n_flows")), "file")


@query(_COUNTS)
def packet_counts(spark, sf_dir):
    return packets.packet_counts(packets_v(spark, sf_dir))


@query("SELECT file, role, ip, min(pkt_no) AS first_pkt FROM (SELECT file, pkt_no, 'src' AS role, ip_src AS ip FROM packets_v UNION ALL SELECT file, pkt_no, 'dst', ip_dst FROM packets_v) GROUP BY ALL")
def distinct_ips(spark, sf_dir):
    return packets.distinct_ips(packets_v(spark, sf_dir))


def _outcomes(spark, sf_dir):
    """The captures' frames, dissected, with what their payload bytes say."""
    return packets.outcomes(named(captures.dissect(frames(spark, sf_dir))))


@query(_KEPT_FLOWS)
def distinct_flows(spark, sf_dir):
    return packets.distinct_flows(_outcomes(spark, sf_dir))


@query(_FLOWS)
def all_flows(spark, sf_dir):
    return packets.all_flows(packets_v(spark, sf_dir))


@query("SELECT file, pkt_no, ip_src AS source_ip, ip_dst AS destination_ip, 'GET' AS method, '1.1' AS version, concat('/', event_type, '/', k) AS uri, concat('h', k) AS host, concat('/', event_type, '/', k) AS uri_field, 6 AS n_fields FROM packets_v WHERE dport IN (80, 443) AND k % 3 > 0")
def http_requests(spark, sf_dir):
    """Requests from frame bytes; the header `uri` gives way to the request's own."""
    found = packets.http_requests(_outcomes(spark, sf_dir))
    return found.select("file", "pkt_no", *packets.OVERLAID, F.col("fields")["host"].alias("host"), F.col("fields")["uri"].alias("uri_field"), F.size("fields").alias("n_fields"))


@query("SELECT file, 'A' AS type, concat(event_type, '.com') AS request, ip_dst AS response, min(pkt_no) AS pkt_no FROM packets_v WHERE dport = 53 AND k % 4 > 0 GROUP BY ALL")
def dns_from_frames(spark, sf_dir):
    """First answer by type, name and value, from frame bytes."""
    return packets.first_by_key(packets.dns_requests(_outcomes(spark, sf_dir)), ["file", "type", "request", "response"], "pkt_no", [])


@query("SELECT file, ip_src, ip_dst, concat('/', event_type, '/', k) AS uri, min(pkt_no) AS pkt_no, arg_min(sport, pkt_no) AS sport FROM packets_v WHERE dport IN (80, 443) GROUP BY ALL")
def distinct_http(spark, sf_dir):
    rows = packets_v(spark, sf_dir).filter(packets.is_http(F.col("dport"))).withColumn("uri", F.concat(F.lit("/"), "event_type", F.lit("/"), F.col("k").cast("string")))
    return packets.first_by_key(rows, ["file", "ip_src", "ip_dst", "uri"], "pkt_no", ["sport"])


@query("SELECT file, CASE k % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'CNAME' ELSE 'PTR' END AS type, event_type AS request, k AS response, min(pkt_no) AS pkt_no, arg_min(ip_src, pkt_no) AS ip_src FROM packets_v WHERE sport = 53 OR dport = 53 GROUP BY ALL")
def distinct_dns(spark, sf_dir):
    kind = F.when(F.col("k") % 3 == 0, "A").when(F.col("k") % 3 == 1, "CNAME").otherwise("PTR")
    rows = packets_v(spark, sf_dir).filter(packets.is_dns(F.col("sport"), F.col("dport"))).select("*", kind.alias("type"), F.col("event_type").alias("request"), F.col("k").alias("response"))
    return packets.first_by_key(rows, ["file", "type", "request", "response"], "pkt_no", ["ip_src"])


@query(_SEGMENTS + f" SELECT {_KEY}, CAST(epoch AS BIGINT) AS epoch, count(*) AS n_packets FROM op WHERE opened = 1 GROUP BY ALL")
def tcp_epochs(spark, sf_dir):
    return packets.tcp_epochs(packets_v(spark, sf_dir)).groupBy(*packets.STREAM, F.col("epoch").cast("long").alias("epoch")).agg(F.count("*").alias("n_packets"))


@query("SELECT * FROM (" + _TCP + ") WHERE valid")
def tcp_valid_streams(spark, sf_dir):
    return tcp_stream_stats(spark, sf_dir).filter("valid")


@query(_TCP)
def tcp_stream_stats(spark, sf_dir):
    return packets.tcp_streams(packets_v(spark, sf_dir)).withColumn("epoch", F.col("epoch").cast("long"))


@query(_UDP)
def udp_sessions(spark, sf_dir):
    return packets.udp_sessions(packets_v(spark, sf_dir), SESSION_US).withColumn("session", F.col("session").cast("long"))


@query(_SEGMENTS + f" SELECT {_KEY}, CAST(epoch AS BIGINT) AS epoch, string_agg(concat('<', k, '>'), '' ORDER BY seq) AS data, substr(string_agg(concat('<', k, '>'), '' ORDER BY seq), 1, 8) AS head FROM seg GROUP BY ALL HAVING bool_and(joined)")
def stream_bytes(spark, sf_dir):
    rows = packets.tcp_segments(packets_v(spark, sf_dir)).withColumn("payload", F.concat(F.lit("<"), F.col("k").cast("string"), F.lit(">")))
    found = packets.stream_bytes(rows, "payload", first=8)
    return found.select(*packets.STREAM, F.col("epoch").cast("long").alias("epoch"), F.col("data").cast("string").alias("data"), F.col("head").cast("string").alias("head"))


@query("SELECT file, 'A' AS type, concat(event_type, '.com') AS request, ip_dst AS response, min(pkt_no) AS pkt_no FROM packets_v WHERE sport = 53 OR dport = 53 GROUP BY ALL")
def dns_answers(spark, sf_dir):
    """First answer by type, name and value; each DNS packet carries a response with one compressed answer."""
    wire = """unhex(concat('000081800001000100000000', lpad(hex(length(event_type)), 2, '0'), hex(event_type), '03636F6D00', '00010001',
     'C00C', '00010001', '0000003C', '0004', 'C00002', lpad(hex(CAST(substring_index(ip_dst, '.', -1) AS INT)), 2, '0')))"""
    rows = packets_v(spark, sf_dir).filter(packets.is_dns(F.col("sport"), F.col("dport"))).select("file", "pkt_no", F.explode(messages.dns_answers(F.expr(wire))).alias("a"))
    return packets.first_by_key(rows.select("file", "pkt_no", "a.*"), ["file", "type", "request", "response"], "pkt_no", [])


@query("SELECT doc_id, CAST(0 AS INT) AS place, md5(text) AS digest FROM documents WHERE text <> '' UNION ALL SELECT doc_id, CASE WHEN text <> '' THEN 1 ELSE 0 END, md5(lang) FROM documents WHERE lang <> ''")
def http_payloads(spark, sf_dir):
    """Bodies of two pipelined messages a document, its text and its language."""
    head = lambda c: F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Length: "), F.octet_length(c).cast("string"), F.lit("\r\n\r\n"), c)
    text, lang = (F.coalesce(F.col(c), F.lit("")) for c in ("text", "lang"))
    stream = F.concat(head(text), head(lang)).cast("binary")
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(messages.http_bodies(stream)).alias("place", "body")).select("doc_id", "place", F.md5("body").alias("digest"))


@query("SELECT pkt_no, CAST(row_number() OVER (PARTITION BY file, ip_src, ip_dst, event_type ORDER BY pkt_no) AS INT) AS number FROM packets_v")
def file_numbering(spark, sf_dir):
    return messages.number_files(packets_v(spark, sf_dir), ["file", "ip_src", "ip_dst", "event_type"], ["pkt_no"]).select("pkt_no", "number")


_DNS = "SELECT file, CASE k % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'CNAME' ELSE 'PTR' END AS type, event_type AS request, k AS response, min(pkt_no) AS pkt_no FROM packets_v WHERE sport = 53 OR dport = 53 GROUP BY ALL"
_HTTP = "SELECT file, ip_src, ip_dst, concat('/', event_type, '/', k) AS uri, min(pkt_no) AS pkt_no FROM packets_v WHERE dport IN (80, 443) GROUP BY ALL"
_DSTS = "SELECT file, ip_dst AS ip, min(pkt_no) AS first_pkt FROM packets_v GROUP BY ALL"


_DNS_ROWS = "SELECT DISTINCT file, 'A' AS type, concat(event_type, '.com') AS request, ip_dst AS response FROM packets_v WHERE dport = 53 AND k % 4 > 0"
_HTTP_ROWS = "SELECT DISTINCT file, ip_src AS source_ip, ip_dst AS destination_ip, 'GET' AS method, '1.1' AS version, concat('/', event_type, '/', k) AS uri FROM packets_v WHERE dport IN (80, 443) AND k % 3 > 0"


def _items(section: str, sql: str, fields: str) -> str:
    return f"SELECT file, '{section}' AS section, CAST(to_json(struct_pack({fields})) AS VARCHAR) AS item FROM ({sql})"


@query(" UNION ALL ".join([
    _items("counts", _COUNTS, "n_packets, n_http, n_dns"), _items("flows", _KEPT_FLOWS, "flow, first_pkt"), _items("dns_data", _DNS_ROWS, "type, request, response"),
    _items("http_requests", _HTTP_ROWS, "source_ip, destination_ip, method, version, uri"), _items("destination_ip_details", _DSTS, "ip, first_pkt"),
]))
def capture_summary(spark, sf_dir):
    """The five sections of a capture's document, one JSON item a row, from the frames."""
    p, dns, http = _outcomes(spark, sf_dir), ["type", "request", "response"], list(packets.OVERLAID)
    return messages.summary_items(
        F.col("file"), counts=(packets.packet_counts(p), ["n_packets", "n_http", "n_dns"]), flows=(packets.distinct_flows(p), ["flow", "first_pkt"]),
        dns_data=(packets.dns_requests(p).select("file", *dns).distinct(), dns), http_requests=(packets.http_requests(p).select("file", *http).distinct(), http),
        destination_ip_details=(packets.distinct_ips(p).filter("role = 'dst'"), ["ip", "first_pkt"]),
    )


@query(f"SELECT {_KEY}, CAST(epoch AS BIGINT) AS epoch, CAST(pos AS BIGINT) AS pos, CAST(len AS BIGINT) AS len FROM (SELECT *, sum(len) OVER (PARTITION BY {_KEY}, epoch ORDER BY seq ROWS UNBOUNDED PRECEDING) - len AS pos, bool_and(joined) OVER (PARTITION BY {_KEY}, epoch) AS valid FROM ({_SEGMENTS} SELECT * FROM seg)) WHERE valid")
def stream_chunks(spark, sf_dir):
    found = packets.stream_chunks(packets.tcp_segments(packets_v(spark, sf_dir)))
    return found.select(*packets.STREAM, F.col("epoch").cast("long").alias("epoch"), "pos", F.col("len").cast("long").alias("len"))


@query(f"SELECT {_KEY}, CAST(session AS BIGINT) AS session, string_agg(concat('<', k, '>'), '' ORDER BY pkt_no) AS data FROM ({_UDP.split(' SELECT file, ip_src')[0]} SELECT * FROM s) GROUP BY ALL")
def udp_stream_bytes(spark, sf_dir):
    rows = packets.udp_numbered(packets_v(spark, sf_dir), SESSION_US).withColumn("payload", F.concat(F.lit("<"), F.col("k").cast("string"), F.lit(">")))
    return packets.stream_bytes(rows.withColumn("joined", F.lit(True)), "payload", "pkt_no", part="session").select(*packets.STREAM, F.col("session").cast("long").alias("session"), F.col("data").cast("string").alias("data"))


@query(f"SELECT 'tcp' AS proto, {_KEY}, epoch AS number, n_packets, first_us, last_us FROM ({_TCP}) WHERE valid UNION ALL SELECT 'udp', {_KEY}, session, n_packets, first_us, last_us FROM ({_UDP})")
def all_streams(spark, sf_dir):
    return packets.all_streams(packets_v(spark, sf_dir), SESSION_US)


@query(f"SELECT *, row_number() OVER (ORDER BY file, ip_src, ip_dst, uri, pkt_no) - 1 AS place FROM ({_HTTP})")
def http_sorted(spark, sf_dir):
    """The rows with their place in the sorted table."""
    order = ["file", "ip_src", "ip_dst", "uri", "pkt_no"]
    return numbered(distinct_http(spark, sf_dir).select(*order), [], [F.col(c) for c in order], "place")


@query(f"SELECT *, row_number() OVER (ORDER BY file, type, request, response, pkt_no) - 1 AS place FROM ({_DNS})")
def dns_sorted(spark, sf_dir):
    order = ["file", "type", "request", "response", "pkt_no"]
    return numbered(distinct_dns(spark, sf_dir).select(*order), [], [F.col(c) for c in order], "place")


@query("SELECT file, ip_proto, count(*) AS n, CAST(sum(len(p)) AS BIGINT) AS n_bytes FROM (SELECT *, concat('<', k, '>') AS p FROM packets_v WHERE pkt_no % 7 > 0 AND pkt_no % 11 > 0 AND dport = 4242) GROUP BY ALL")
def transport_split(spark, sf_dir):
    """Frames of IPv6 and of ICMP are dropped; the others by transport."""
    other = F.when(F.col("pkt_no") % 7 == 0, F.lit(b"\x86\xdd")).otherwise(F.lit(b"\x08\x00"))
    proto = F.when(F.col("pkt_no") % 11 == 0, F.lit(b"\x01")).otherwise(F.substring("frame", 24, 1))
    changed = F.concat(F.substring("frame", 1, 12), other, F.substring("frame", 15, 9), proto, F.substring("frame", 25, 100_000))
    rows = captures.dissect(frames(spark, sf_dir).withColumn("frame", changed)).filter("dport = 4242")
    return rows.groupBy("file", "ip_proto").agg(F.count("*").alias("n"), F.sum("payload_len").cast("long").alias("n_bytes"))


@query("SELECT pkt_no, CASE WHEN pkt_no % 7 > 0 THEN pkt_no % 2 = 0 END AS ok FROM packets_v")
def checksum_ok(spark, sf_dir):
    """Header sums of fragments: right for even packets, one off for odd ones; frames of IPv6 have none."""
    word = lambda at: F.conv(F.hex(F.substring("frame", at, 2)), 16, 10).cast("long")
    part = F.concat(F.substring("frame", 1, 20), F.lit(b"\x00\x01"), F.substring("frame", 23, 100_000))
    rows = frames(spark, sf_dir).withColumn("frame", part)
    total = sum((word(15 + 2 * i) for i in range(10)), F.lit(0).cast("long"))
    folded = total % 65_536 + F.floor(total / 65_536)
    due = (65_535 - (folded % 65_536 + F.floor(folded / 65_536)) + F.col("pkt_no") % 2) % 65_536
    due = F.unhex(F.lpad(F.hex(due.cast("long")), 4, "0"))
    kind = F.when(F.col("pkt_no") % 7 == 0, F.lit(b"\x86\xdd")).otherwise(F.lit(b"\x08\x00"))
    summed = F.concat(F.substring("frame", 1, 12), kind, F.substring("frame", 15, 10), due, F.substring("frame", 27, 100_000))
    return rows.select("pkt_no", messages.checksum_ok(summed).alias("ok"))


@query("SELECT page_id, md5(url) AS digest FROM pages WHERE url <> '' AND page_id % 4 < 3 UNION ALL SELECT page_id, md5(concat('no gzip ', url)) FROM pages WHERE page_id % 4 = 3")
def content_decode(spark, sf_dir):
    """Bodies by their codings: none, deflate (a stored block), a transfer coding over an unknown one, a broken one."""
    size = F.octet_length("url")
    little = lambda c: F.concat(F.lpad(F.hex(c % 256), 2, "0"), F.lpad(F.hex(F.floor(c / 256)), 2, "0"))
    stored = F.unhex(F.concat(F.lit("01"), little(size.cast("long")), little((65_535 - size).cast("long")), F.hex("url")))
    kind = F.col("page_id") % 4
    body = F.when((kind == 1) | (kind == 2), stored).when(kind == 3, F.concat(F.lit("no gzip "), "url").cast("binary")).otherwise(F.col("url").cast("binary"))
    coding = F.when(kind == 1, "Content-Encoding: Deflate\r\n").when(kind == 2, "content-encoding: br\r\nTransfer-Encoding: deflate\r\n").when(kind == 3, "Content-Encoding: gzip\r\n").otherwise("")
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\n"), coding, F.lit("Content-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n")).cast("binary")
    rows = table(spark, sf_dir, "pages").select("page_id", F.explode(messages.http_bodies(F.concat(head, body))).alias("body"))
    return rows.select("page_id", F.md5("body").alias("digest"))


@query("SELECT s_suppkey, CAST(0 AS INT) AS ord, 'plain' AS decoder, s_name AS decoded FROM supplier UNION ALL SELECT s_suppkey, CAST(1 AS INT), 'upper', upper(s_name) FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT s_suppkey, CAST(2 AS INT), 'late', 'late' FROM supplier")
def plugin_order(spark, sf_dir):
    """Decoders that a user adds stand in their order among the others and may decline."""
    content.register_decoder("upper", 20, lambda c: F.when(F.right(F.decode(c, "UTF-8"), F.lit(1)).isin("0", "2", "4", "6", "8"), F.upper(F.decode(c, "UTF-8")).cast("binary")))
    content.register_decoder("late", 60, lambda c: F.lit(b"late"))
    plain, decoders = content.DECODERS["base64"], content.DECODERS
    try:
        del decoders["base64"]
        rows = content.decoded(table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").cast("binary").alias("payload")), "payload")
    finally:
        decoders["base64"] = plain
        del decoders["upper"], decoders["late"]
    return rows.select("s_suppkey", "ord", "decoder", F.decode("decoded", "UTF-8").alias("decoded"))


@query("SELECT flow, first_pkt, ip_src, CAST(sport AS INT) AS sport, ip_dst, CAST(dport AS INT) AS dport FROM (" + _FLOWS.replace("AS flow,", "AS flow, ip_src, sport, ip_dst, dport,").replace("GROUP BY ALL", "GROUP BY file, ip_src, sport, ip_dst, dport") + ")")
def flow_split(spark, sf_dir):
    return packets.all_flows(packets_v(spark, sf_dir)).withColumn("s", packets.split_flow_key(F.col("flow"))).select("flow", "first_pkt", "s.*")


# ---- contents

_HEX = "WITH h AS (SELECT doc_id, substr(hex(encode(text)), 1, 204800) AS x FROM documents WHERE text <> ''), b AS (SELECT doc_id, substr(x, 2 * CAST(i AS BIGINT) + 1, 2) AS v FROM (SELECT doc_id, x, unnest(range(length(x) // 2)) AS i FROM h)), c AS (SELECT doc_id, v, count(*) AS c FROM b GROUP BY ALL), n AS (SELECT doc_id, CAST(sum(c) AS BIGINT) AS n, CAST(sum(c * c) AS DOUBLE) AS q FROM c GROUP BY ALL), e AS (SELECT doc_id, n, -sum(c / n * log2(c / n)) AS entropy, max(q) * 256 / n - n AS chi_square FROM c JOIN n USING (doc_id) GROUP BY doc_id, n)"


@query(_HEX + " SELECT doc_id, n, round(entropy, 6) AS entropy, round(chi_square, 3) AS chi_square, CASE WHEN n < 1280 THEN 'uncategorized' WHEN entropy < 7.9 THEN 'plain' WHEN chi_square > 206 AND chi_square < 311 THEN 'encrypted' ELSE 'compressed' END AS entropy_class FROM e")
def entropy_class(spark, sf_dir):
    found = content.entropy_classes(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")
    return found.withColumn("entropy", F.round("entropy", 6)).withColumn("chi_square", F.round("chi_square", 3))


@query("SELECT page_id, len(s) AS n_spans, CAST(list_sum(list_transform(s, lambda x: length(x))) AS BIGINT) AS n_chars FROM (SELECT page_id, regexp_extract_all(html, '(?s)<p>.*?</p>') AS s FROM pages) WHERE len(s) > 0")
def carve_spans(spark, sf_dir):
    s = content.spans(F.col("html"), ("<p>", "</p>"))
    found = table(spark, sf_dir, "pages").select("page_id", s.alias("s")).filter("size(s) > 0")
    return found.select("page_id", F.size("s").cast("long").alias("n_spans"), F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("n_chars"))


@query("SELECT page_id, 'GET' AS method, regexp_extract(url, '^[a-z]+://[^/]+(/[^#]*)', 1) AS uri, '1.1' AS version, lower(regexp_extract(url, '^[a-z]+://([^/:]+)', 1)) AS host, 'http11' AS protocol, 'b=2' AS cookie FROM pages WHERE regexp_matches(url, '^[a-z]+://[^/]+/[^# ]+')")
def http_parse(spark, sf_dir):
    u = F.col("url")
    raw = F.concat(F.lit("GET "), F.regexp_extract(u, r"^[a-z]+://[^/]+(/[^#]*)", 1), F.lit(" HTTP/1.1\r\nHost: "), F.lower(F.regexp_extract(u, r"^[a-z]+://([^/:]+)", 1)), F.lit("\r\nCookie: a=1\r\nAccept: a:b\r\nbad line\r\ncookie: b=2\r\n\r\n"))
    rows = table(spark, sf_dir, "pages").filter(u.rlike(r"^[a-z]+://[^/]+/[^# ]+")).select("page_id", content.http_request(raw).alias("r"), content.protocol(F.split(raw, "\r\n")[0]).alias("protocol"))
    return rows.select("page_id", "r.method", "r.uri", "r.version", F.col("r.headers")["host"].alias("host"), "protocol", F.col("r.headers")["cookie"].alias("cookie"))


@query("SELECT doc_id, 'plain' AS decoder, CAST(length(base64(encode(text))) AS BIGINT) AS n FROM documents WHERE text <> '' UNION ALL SELECT doc_id, 'base64', CAST(octet_length(encode(text)) AS BIGINT) FROM documents WHERE text <> ''")
def base64_decode(spark, sf_dir):
    coded = table(spark, sf_dir, "documents").filter("text <> ''").select("doc_id", F.regexp_replace(F.base64(F.encode("text", "UTF-8")), r"[\r\n]", "").cast("binary").alias("payload"))
    return content.decoded(coded, "payload").select("doc_id", "decoder", F.octet_length("decoded").cast("long").alias("n"))


_RULES = [("mit_line", "license", "Released under the MIT License."), ("apache_line", "license", "Licensed under the Apache License"), ("token", "secret", "token = "), ("insult", "", "stupid"), ("mail", "personal", "example.com"), ("e", "", "e")]


@query("SELECT doc_id, rule, tags FROM documents, (VALUES " + ", ".join(f"('{n}', '{t}', '{p}')" for n, t, p in _RULES) + ") r(rule, tags, pattern) WHERE contains(text, pattern)")
def rule_match(spark, sf_dir):
    rows = spark.createDataFrame([(n, [t] if t else [], p) for n, t, p in _RULES], "name string, tags array<string>, pattern string")
    return rules.rule_matches(table(spark, sf_dir, "documents"), "doc_id", "text", rows).withColumn("tags", F.array_join("tags", ","))


@query(f"SELECT o_orderkey, concat('customer', c_custkey) AS rule, concat('t', c_custkey % 3, ',all') AS tags FROM orders JOIN customer ON contains(concat('Order of ', lpad(CAST(o_custkey AS VARCHAR), 9, '0'), '.'), lpad(CAST(c_custkey AS VARCHAR), 9, '0'))")
def rule_match_table(spark, sf_dir):
    """A rule for each customer: a table of rules that grows with the data, met through the index of their grams."""
    made = table(spark, sf_dir, "customer").selectExpr("concat('customer', c_custkey) AS name", "array(concat('t', c_custkey % 3), 'all') AS tags", "lpad(CAST(c_custkey AS STRING), 9, '0') AS pattern")
    notes = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "concat('Order of ', lpad(CAST(o_custkey AS STRING), 9, '0'), '.') AS note")
    return rules.rule_matches(notes, "o_orderkey", "note", made).withColumn("tags", F.array_join("tags", ","))


@query("SELECT event_type, k, count(*) AS n FROM (SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY ALL")
def json_path_project(spark, sf_dir):
    k = F.from_json("props", "k long")["k"]
    return table(spark, sf_dir, "events").select("event_type", k.alias("k")).groupBy("event_type", "k").agg(F.count("*").alias("n"))


@query("SELECT 'pro|duct' AS product, event_type AS name, CAST(user_id % 10 AS VARCHAR) AS severity, CAST(user_id AS VARCHAR) AS suser, count(*) AS n FROM events GROUP BY ALL")
def cef_events(spark, sf_dir):
    line = F.concat(F.lit("Jan 1 host CEF:0|acme|pro\\|duct|1.0|"), F.col("event_id").cast("string"), F.lit("|"), "event_type", F.lit("|"), (F.col("user_id") % 10).cast("string"), F.lit("|suser=0 msg=some text here suser="), F.col("user_id").cast("string"))
    c = F.col("c")
    rows = table(spark, sf_dir, "events").select(content.cef_event(line).alias("c")).select(c["product"].alias("product"), c["name"].alias("name"), c["severity"].alias("severity"), c["extension"]["suser"].alias("suser"))
    return rows.groupBy("product", "name", "severity", "suser").agg(F.count("*").alias("n"))


@query("""WITH h AS (SELECT DISTINCT lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS host FROM pages), s AS (SELECT DISTINCT regexp_extract(host, '([^.]+)$', 1) AS suffix FROM h WHERE host <> '')
 SELECT host, regexp_extract(host, '([^.]+)$', 1) AS suffix, regexp_extract(host, '([^.]+\\.[^.]+)$', 1) AS domain, regexp_replace(regexp_extract(host, '^(.*\\.)[^.]+\\.[^.]+$', 1), '\\.$', '') AS subdomain FROM h WHERE host LIKE '%.%'""")
def registered_domain(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    suffixes = pages.select(F.regexp_extract(F.lower("url"), r"^[a-z]+://[^/:?#]*?([^./:?#]+)(?:[/:?#]|$)", 1).alias("suffix")).filter("suffix <> ''").distinct()
    return content.registered_domains(pages, "url", suffixes).filter("domain IS NOT NULL")


# ---- addresses and feeds

_IP = "16777216 + c_custkey * 7919"
_RANGES = "SELECT 16777216 + n_nationkey * 400000 AS first_ip, 16777216 + n_nationkey * 400000 + 299999 AS last_ip, 12 AS prefix_len, n_name AS owner FROM {0} UNION ALL SELECT 16777216 + n_nationkey * 400000 + 1000, 16777216 + n_nationkey * 400000 + 90999, 15, concat(n_name, '-inner') FROM {0}"
_OWNER = f"WITH r AS ({_RANGES.format('nation')}), c AS (SELECT c_custkey, {_IP} AS ip FROM customer), m AS (SELECT c_custkey, ip, arg_max(owner, prefix_len) AS owner FROM c JOIN r ON ip BETWEEN first_ip AND last_ip GROUP BY ALL)"


def _ranged(spark, sf_dir):
    ranges = spark.sql(_RANGES.replace("{0}", "{n}"), n=table(spark, sf_dir, "nation")).selectExpr("CAST(first_ip AS LONG) AS first_ip", "CAST(last_ip AS LONG) AS last_ip", "prefix_len", "owner")
    points = table(spark, sf_dir, "customer").selectExpr("c_custkey", f"{_IP} AS ip")
    return enrich.range_join(points, ranges, "ip")


@query(_OWNER + " SELECT c_custkey, c.ip, coalesce(owner, '') AS owner FROM c LEFT JOIN m USING (c_custkey)")
def ip_owner(spark, sf_dir):
    return _ranged(spark, sf_dir).select("c_custkey", "ip", F.coalesce("owner", F.lit("")).alias("owner"))


_BLOCKS = """SELECT concat(10 + n_nationkey, '.0.0.0/8') AS block, n_nationkey AS asn, n_name AS owner FROM {0} UNION ALL SELECT concat(10 + n_nationkey, '.', 16 * (n_nationkey % 8), '.0.0/12'), CASE WHEN n_nationkey % 3 > 0 THEN 100 + n_nationkey END, concat(n_name, '-inner') FROM {0}
 UNION ALL SELECT '0.0.0.0/0', 0, 'rest' FROM {0} WHERE n_nationkey = 0 UNION ALL SELECT concat('2001:db8:', n_nationkey, '::/48'), 200 + n_nationkey, n_name FROM {0} UNION ALL SELECT concat('2001:db8:', n_nationkey, ':8000::/49'), 300 + n_nationkey, concat(n_name, '-upper') FROM {0}"""
_ADDRESS = "CASE WHEN c_custkey % 4 = 0 THEN concat('2001:db8:', c_custkey % 30, ':', CASE WHEN c_custkey % 8 = 0 THEN 'c000' ELSE '1' END, '::', c_custkey % 7) WHEN c_custkey % 41 = 1 THEN 'none' ELSE concat(c_custkey % 50, '.', c_custkey % 256, '.1.', c_custkey % 9) END"


@query(f"""WITH c AS (SELECT c_custkey, {_ADDRESS} AS ip, c_custkey % 50 AS a, c_custkey % 256 AS b, c_custkey % 30 AS g FROM customer)
 SELECT c_custkey, ip, CASE WHEN c_custkey % 4 = 0 THEN CASE WHEN n_name IS NULL THEN '' WHEN c_custkey % 8 = 0 THEN concat('2001:db8:', g, ':8000::/49') ELSE concat('2001:db8:', g, '::/48') END
  WHEN ip = 'none' THEN '' WHEN n_name IS NULL THEN '0.0.0.0/0' WHEN b // 16 = n_nationkey % 8 THEN concat(a, '.', 16 * (n_nationkey % 8), '.0.0/12') ELSE concat(a, '.0.0.0/8') END AS block,
 CASE WHEN c_custkey % 4 = 0 THEN CASE WHEN n_name IS NULL THEN '' WHEN c_custkey % 8 = 0 THEN CAST(300 + n_nationkey AS VARCHAR) ELSE CAST(200 + n_nationkey AS VARCHAR) END
  WHEN ip = 'none' THEN '' WHEN n_name IS NULL THEN '0' WHEN b // 16 = n_nationkey % 8 THEN CASE WHEN n_nationkey % 3 > 0 THEN CAST(100 + n_nationkey AS VARCHAR) ELSE '' END ELSE CAST(n_nationkey AS VARCHAR) END AS asn,
 CASE WHEN c_custkey % 4 = 0 THEN CASE WHEN n_name IS NULL THEN '' WHEN c_custkey % 8 = 0 THEN concat(n_name, '-upper') ELSE n_name END
  WHEN ip = 'none' THEN '' WHEN n_name IS NULL THEN 'rest' WHEN b // 16 = n_nationkey % 8 THEN concat(n_name, '-inner') ELSE n_name END AS owner
 FROM c LEFT JOIN nation ON n_nationkey = CASE WHEN c_custkey % 4 = 0 THEN g WHEN ip = 'none' THEN -1 ELSE a - 10 END""")
def block_owner(spark, sf_dir):
    """Block, asn and owner of IPv4 and IPv6 addresses; blocks stand in blocks, one holds all of IPv4."""
    blocks = spark.sql(_BLOCKS.replace("{0}", "{n}"), n=table(spark, sf_dir, "nation"))
    return intervals.block_owners(table(spark, sf_dir, "customer").selectExpr("c_custkey", f"{_ADDRESS} AS ip"), "ip", blocks)


_PLACES = "SELECT 16777216 + n_nationkey * 400000 AS first_ip, 16777216 + n_nationkey * 400000 + 299999 AS last_ip, 12 AS prefix_len, n_nationkey * 1.5E0 AS latitude, n_nationkey * -2.5E0 AS longitude, CASE WHEN n_nationkey % 4 > 0 THEN concat('r', n_regionkey) END AS region, n_name AS country FROM {0}"


@query(f"SELECT c_custkey, latitude, longitude, CASE WHEN country IS NOT NULL THEN coalesce(region, 'Unknown') END AS region, country FROM customer LEFT JOIN ({_PLACES.format('nation')}) ON {_IP} BETWEEN first_ip AND last_ip")
def ip_location(spark, sf_dir):
    places = spark.sql(_PLACES.replace("{0}", "{n}"), n=table(spark, sf_dir, "nation")).withColumns({c: F.col(c).cast("long") for c in ("first_ip", "last_ip")})
    return enrich.ip_locations(table(spark, sf_dir, "customer").selectExpr("c_custkey", f"{_IP} AS ip"), places, "ip").drop("ip")


_ONE = "SELECT c_custkey % 50 AS ip, CASE WHEN c_custkey % 50 < 45 THEN c_mktsegment END AS host, CASE WHEN c_custkey % 50 >= 45 THEN 'down' END AS error FROM {c}"
_TWO = "SELECT s_suppkey % 50 AS ip, CASE WHEN s_suppkey % 50 < 40 OR s_suppkey % 50 = 47 THEN concat('host', s_nationkey) END AS host, CASE WHEN s_suppkey % 50 >= 40 AND s_suppkey % 50 <> 47 THEN 'timeout' END AS error FROM {s}"


@query("WITH n AS (" + _ONE.format(c="customer") + " UNION ALL " + _TWO.format(s="supplier") + ") SELECT DISTINCT ip, host, CAST(NULL AS VARCHAR) AS error FROM n WHERE host IS NOT NULL UNION ALL SELECT ip, NULL, min(error) FROM n GROUP BY ip HAVING count(host) = 0 AND count(error) > 0")
def host_names(spark, sf_dir):
    """Names of two providers: some addresses have both, some one with the other's error, some only errors of both."""
    one, two = spark.sql(_ONE, c=table(spark, sf_dir, "customer")), spark.sql(_TWO, s=table(spark, sf_dir, "supplier"))
    return enrich.merge_host_names(one, two)


@query("SELECT md5(concat('ind', event_id)) AS value, 'MD5' AS kind, CAST(ts AS DATE) AS day FROM events UNION ALL SELECT concat(event_id % 223 + 1, '.', (event_id // 223) % 256, '.', (event_id // 57088) % 256, '.', event_id // 14614528), 'IP', CAST(ts AS DATE) FROM events UNION ALL SELECT concat('host', event_id, '.example.com'), 'Domain', CAST(ts AS DATE) FROM events UNION ALL SELECT concat('http://host', event_id, '.example.com/', event_id % 97), 'URL', CAST(ts AS DATE) FROM events")
def synthetic_indicators(spark, sf_dir):
    from .sources.feeds import indicators

    return indicators(table(spark, sf_dir, "events"), "event_id", "ts")


# ---- image catalogue


@query("WITH v AS (SELECT image, name, string_split(name, '.') AS p FROM tags_v) SELECT image, arg_max(name, CAST(p[1] AS BIGINT) * 1000000000000 + CAST(p[2] AS BIGINT) * 10000000000 + CAST(p[3] AS BIGINT) * 100000000 + CAST(p[4] AS BIGINT)) AS latest FROM v GROUP BY ALL")
def latest_tag_by_version(spark, sf_dir):
    return images.latest_tag_by_version(tags(spark, sf_dir), ["image"])


_FAMILY = "WITH cur AS (SELECT image, arg_min(name, ord) AS current FROM tags_v GROUP BY ALL), f AS (SELECT t.image, t.name, c.current FROM tags_v t JOIN cur c USING (image) WHERE starts_with(t.name, regexp_replace(c.current, '[0-9]+$', '')) AND regexp_matches(t.name, '^[0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+$'))"


def _current(spark, sf_dir):
    return tags(spark, sf_dir).groupBy("image").agg(F.min_by("name", "ord").alias("current"))


@query(_FAMILY + " SELECT image, current, count(*) AS n_tags FROM f GROUP BY ALL")
def tag_family(spark, sf_dir):
    return images.in_family(tags(spark, sf_dir), _current(spark, sf_dir), ["image"]).groupBy("image", "current").agg(F.count("*").alias("n_tags"))


@query(_FAMILY + " SELECT image, current, arg_max(name, CAST(regexp_extract(name, '([0-9]+)$', 1) AS BIGINT)) AS latest FROM f GROUP BY ALL HAVING max(CAST(regexp_extract(name, '([0-9]+)$', 1) AS BIGINT)) > max(CAST(regexp_extract(current, '([0-9]+)$', 1) AS BIGINT))")
def outdated_images(spark, sf_dir):
    current = _current(spark, sf_dir)
    return images.outdated(current, images.latest_tag_by_version(images.in_family(tags(spark, sf_dir), current, ["image"]), ["image"]), ["image"])


_TIMED = "SELECT o_custkey AS image, o_orderkey AS ord, CASE WHEN o_orderkey % 7 = 0 THEN md5(CAST(o_orderkey AS {s})) ELSE concat('v', o_orderkey) END AS name, o_orderdate AS last_updated FROM {o}"


@query("SELECT image, arg_max(name, CAST(epoch_us(last_updated) AS HUGEINT) * 100000000 - ord) AS latest FROM (" + _TIMED.format(s="VARCHAR", o="orders") + ") WHERE length(name) < 20 GROUP BY ALL")
def latest_tag_by_time(spark, sf_dir):
    return images.latest_tag_by_time(spark.sql(_TIMED.format(s="STRING", o="{o}"), o=table(spark, sf_dir, "orders")), ["image"])


@query("SELECT base, count(*) AS n_dependents, string_agg(CAST(dependent AS VARCHAR), ',' ORDER BY dependent) AS dependents FROM edges_v GROUP BY ALL")
def dependents_by_base(spark, sf_dir):
    return images.dependents_by_base(edges(spark, sf_dir)).withColumn("dependents", F.array_join(F.transform("dependents", lambda d: d.cast("string")), ","))


_CLOSURE = "WITH RECURSIVE edges_v AS (SELECT p_partkey AS dependent, CAST(floor(p_partkey / 3) AS BIGINT) AS base FROM part WHERE p_partkey > 0), reach(image, level) AS (SELECT CAST(1 AS BIGINT), 0 UNION ALL SELECT e.dependent, r.level + 1 FROM reach r JOIN edges_v e ON e.base = r.image)"


def _closure(spark, sf_dir):
    e = edges(spark, sf_dir)
    return images.base_closure(spark, e, e.filter("dependent = 1").selectExpr("dependent AS base"))


@query()
def base_closure(spark, sf_dir):
    return _closure(spark, sf_dir)


ORACLE_SQL["base_closure"] = _CLOSURE + " SELECT image, CAST(max(level) AS BIGINT) AS level FROM reach GROUP BY ALL"


@query()
def update_waves(spark, sf_dir):
    old = table(spark, sf_dir, "part").filter("p_size < 25").selectExpr("p_partkey AS image")
    return _closure(spark, sf_dir).join(old, "image").groupBy("level").agg(F.count("*").alias("n_images"), F.min("image").alias("first_image"))


ORACLE_SQL["update_waves"] = _CLOSURE + ", l AS (SELECT image, CAST(max(level) AS BIGINT) AS level FROM reach GROUP BY ALL) SELECT level, count(*) AS n_images, min(image) AS first_image FROM l JOIN part ON p_partkey = image WHERE p_size < 25 GROUP BY ALL"


@query("WITH a AS (SELECT DISTINCT s_nationkey AS name FROM supplier WHERE s_acctbal < 0), b AS (SELECT DISTINCT c_nationkey AS name FROM customer WHERE c_acctbal > 9000) SELECT name, 'first' AS side FROM a WHERE name NOT IN (SELECT name FROM b) UNION ALL SELECT name, 'second' FROM b WHERE name NOT IN (SELECT name FROM a)")
def deprecation_diff(spark, sf_dir):
    a = table(spark, sf_dir, "supplier").filter("s_acctbal < 0").selectExpr("s_nationkey AS name")
    return images.list_difference(a, table(spark, sf_dir, "customer").filter("c_acctbal > 9000").selectExpr("c_nationkey AS name"), "name")


@query("SELECT s_suppkey AS name, s_name AS reason FROM supplier UNION ALL SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment <> '' AND c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def insert_if_absent(spark, sf_dir):
    old = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS name", "s_name AS reason")
    return images.insert_if_absent(old, table(spark, sf_dir, "customer").selectExpr("c_custkey AS name", "c_mktsegment AS reason"), "name")


@query("SELECT c_custkey AS name, CASE WHEN s_suppkey IS NULL THEN 'now' ELSE concat('s', s_nationkey) END AS created FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey")
def carry_created_time(spark, sf_dir):
    new = table(spark, sf_dir, "customer").selectExpr("c_custkey AS name")
    return images.carry_created(new, table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS name", "concat('s', s_nationkey) AS created"), "name", F.lit("now"))


@query("SELECT o_custkey AS name, count(*) AS n FROM orders GROUP BY ALL HAVING count(*) > 1")
def duplicate_entries(spark, sf_dir):
    return images.duplicate_entries(table(spark, sf_dir, "orders").selectExpr("o_custkey AS name"), "name")


@query("SELECT p_partkey AS name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45) AND p_size >= 5 AND p_partkey NOT IN (SELECT base FROM edges_v)")
def unused_images(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    used = table(spark, sf_dir, "lineitem").filter("l_quantity > 45").selectExpr("l_partkey AS name")
    dev = part.filter("p_size < 5").selectExpr("p_partkey AS name")
    return images.without(part.selectExpr("p_partkey AS name"), "name", used, dev, edges(spark, sf_dir).selectExpr("base AS name"))


@query("SELECT DISTINCT l_suppkey AS name FROM lineitem WHERE l_quantity > 10 AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def missing_expected(spark, sf_dir):
    wanted = table(spark, sf_dir, "lineitem").filter("l_quantity > 10").selectExpr("l_suppkey AS name").distinct()
    return images.without(wanted, "name", table(spark, sf_dir, "supplier").filter("s_acctbal > 0").selectExpr("s_suppkey AS name"))


@query("SELECT p_partkey AS name FROM part WHERE p_type LIKE '%E%' AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40)")
def uncovered_manifests(spark, sf_dir):
    have = table(spark, sf_dir, "part").filter("p_type LIKE '%E%'").selectExpr("p_partkey AS name")
    return images.without(have, "name", table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R' AND l_quantity > 40").selectExpr("l_partkey AS name"))


@query("SELECT image, name, CAST((row_number() OVER (PARTITION BY image ORDER BY ord) - 1) // 7 AS BIGINT) AS batch FROM tags_v")
def update_batches(spark, sf_dir):
    return images.batches(tags(spark, sf_dir), "image", "ord", 7).select("image", "name", "batch")


@query("SELECT image, name, rn FROM (SELECT image, name, row_number() OVER (PARTITION BY image ORDER BY ord) AS rn FROM tags_v) WHERE rn <= 30")
def first_n_per_base(spark, sf_dir):
    return images.first_per_base(tags(spark, sf_dir), "image", "ord", 30).select("image", "name", "rn")


@query("SELECT o_orderpriority AS run, count(*) AS n_total, count(*) FILTER (o_orderstatus <> 'F') AS n_ok, count(*) FILTER (o_orderstatus = 'F') AS n_failed, CAST(min(o_orderdate) AS DATE) AS first_day, CAST(max(o_orderdate) AS DATE) AS last_day, CAST(date_diff('second', min(CAST(o_orderdate AS TIMESTAMP)), max(CAST(o_orderdate AS TIMESTAMP))) AS BIGINT) AS seconds FROM orders GROUP BY ALL")
def build_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderpriority AS run", "o_orderstatus <> 'F' AS ok", "CAST(o_orderdate AS TIMESTAMP) AS at")
    return images.build_summary(rows, "run")


@query("""SELECT o_custkey AS run, concat('{', coalesce(string_agg(concat('"', o_orderkey, '":{"step":"', o_orderpriority, '"}'), ',' ORDER BY CAST(o_orderkey AS VARCHAR)) FILTER (o_orderstatus = 'F'), ''), '}') AS report FROM orders GROUP BY ALL""")
def failure_report(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").selectExpr("o_custkey AS run", "o_orderstatus <> 'F' AS ok", "CAST(o_orderkey AS STRING) AS image", "o_orderpriority AS step")
    return images.failure_report(rows, "run")


@query("SELECT base, CAST((rn - 1) // 2 AS BIGINT) AS chunk, string_agg(CAST(dependent AS VARCHAR), ',' ORDER BY dependent) AS dependents FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY dependent) AS rn FROM edges_v) GROUP BY base, chunk")
def dependents_in_chunks(spark, sf_dir):
    return images.dependents_in_chunks(edges(spark, sf_dir), 2).withColumn("dependents", F.array_join(F.transform("dependents", lambda d: d.cast("string")), ","))


@query("""WITH f AS (SELECT o_custkey AS run, o_orderkey, o_orderpriority AS step, row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderkey AS VARCHAR)) - 1 AS i FROM orders WHERE o_orderstatus = 'F')
 SELECT run, CAST(i // 3 AS BIGINT) AS chunk, concat('{', string_agg(concat('"', o_orderkey, '":{"step":"', step, '"}'), ',' ORDER BY i), '}') AS report FROM f GROUP BY run, chunk
 UNION ALL SELECT o_custkey, 0, '{}' FROM orders GROUP BY o_custkey HAVING count(*) FILTER (o_orderstatus = 'F') = 0""")
def failure_chunks(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").selectExpr("o_custkey AS run", "o_orderstatus <> 'F' AS ok", "CAST(o_orderkey AS STRING) AS image", "o_orderpriority AS step")
    return images.failure_chunks(rows, "run", 3)


# ---- licences and versions

_LINES = "WITH f AS (SELECT source AS image, doc_id, unnest(regexp_extract_all(text, '(?:Licensed|Released|licensed) under [^.\\n]*')) AS license FROM documents)"
_APPROVED = [("Apache", "Apache License"), ("MIT", "MIT"), ("GPL", "GNU General Public License")]
_CASE = "CASE " + " ".join(f"WHEN license LIKE '%{p}%' THEN '{n}'" for n, p in _APPROVED) + " END"


def _license_lines(spark, sf_dir):
    lines = F.explode(F.regexp_extract_all("text", F.lit(r"(?:Licensed|Released|licensed) under [^.\n]*"), F.lit(0)))
    return table(spark, sf_dir, "documents").select(F.col("source").alias("image"), "doc_id", lines.alias("license"))


@query(_LINES + f" SELECT image, doc_id, license, {_CASE} AS approved FROM f")
def license_match(spark, sf_dir):
    return enrich.license_matches(_license_lines(spark, sf_dir), _APPROVED, ["image", "doc_id"])


@query(f"SELECT p_brand AS image, p_partkey AS pkg FROM part WHERE NOT (p_partkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) OR (p_partkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal >= 0) AND contains(p_brand, '#1')))")
def license_exclusion(spark, sf_dir):
    rows = table(spark, sf_dir, "part").selectExpr("p_brand AS image", "p_partkey AS pkg")
    return enrich.apply_exclusions(rows, table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS pkg", "CASE WHEN s_acctbal >= 0 THEN array('#1') END AS docker_images"))


@query(_LINES + f", m AS (SELECT image, license, {_CASE} AS approved FROM f) SELECT image, bool_and(approved IS NOT NULL) AS passes, count(*) FILTER (approved IS NULL) AS n_failed, min(license) FILTER (approved IS NULL) AS first_failed FROM m GROUP BY ALL")
def compliance_verdict(spark, sf_dir):
    return enrich.compliance(license_match(spark, sf_dir), "image")


_CONSTRAINTS = [(">=3.9,<=3.11", "<=", "3.11"), ("===3.9", "===", "3.9"), ("<3.11,>=3.9", ">=", "3.9"), ("~=3.1", "~=", "3.1"), ("!=3.10", "!=", "3.10"), ("^3.8.1", "^", "3.8.1"), ("3.10", "", "3.10"), ("=3.1", "=", "3.1"), ("3.7 < x", "<", " x"), ("~3.12", "~", "3.12"), ("==2", "==", "2")]
_NTH = "CASE p_partkey % " + str(len(_CONSTRAINTS)) + " {} END"
_WHENS = [" ".join(f"WHEN {i} THEN '{c[k]}'" for i, c in enumerate(_CONSTRAINTS)) for k in range(3)]


@query(f"SELECT p_partkey, {_NTH.format(_WHENS[1])} AS operator, {_NTH.format(_WHENS[2])} AS version FROM part")
def constraint_operator(spark, sf_dir):
    text = F.expr(_NTH.format(_WHENS[0]))
    return table(spark, sf_dir, "part").select("p_partkey", fn.constraint(text).alias("c")).select("p_partkey", "c.operator", "c.version")


@query("SELECT p_partkey, tilde, CASE WHEN p_size % 5 = 0 THEN true ELSE CASE WHEN tilde THEN p_size % 5 = 2 ELSE p_size % 5 = 1 END END AS ok, concat(CASE WHEN tilde THEN '~' ELSE '' END, CASE WHEN p_size % 5 = 0 THEN '.0' ELSE concat('3.', p_size) END) AS correct FROM part, (VALUES (true), (false)) t(tilde)")
def version_conformance(spark, sf_dir):
    base = F.expr("CASE WHEN p_size % 5 = 0 THEN '' ELSE concat('3.', p_size, '.', p_partkey) END")
    text = F.expr("CASE p_size % 5 WHEN 1 THEN concat('3.', p_size) WHEN 2 THEN concat('~3.', p_size) WHEN 3 THEN concat('^3.', p_size, ',<4') ELSE '3.*' END")
    part = table(spark, sf_dir, "part")
    both = [part.select("p_partkey", F.lit(t).alias("tilde"), fn.version_conformance(base, text, t).alias("v")) for t in (True, False)]
    return both[0].union(both[1]).select("p_partkey", "tilde", "v.ok", "v.correct")


# ---- streams


@query("SELECT file, CAST(epoch_us(time_bucket(INTERVAL '1 day', ts)) AS BIGINT) AS window_us, count(*) AS n_packets, count(*) FILTER (dport IN (80, 443)) AS n_http, count(*) FILTER (sport = 53 OR dport = 53) AS n_dns FROM packets_v GROUP BY ALL")
def packet_counts_live(spark, sf_dir):
    return live.replay(packets_v(spark, sf_dir), lambda rows: live.packet_counts_live(rows, "1 day"))


@query(_UDP.replace(f"SELECT {_KEY}, CAST(session AS BIGINT) AS session, count", f"SELECT {_KEY}, count").replace("GROUP BY ALL", f"GROUP BY {_KEY}, session"))
def udp_sessions_live(spark, sf_dir):
    return live.replay(packets_v(spark, sf_dir).filter("ip_proto = 17 AND len > 0"), lambda rows: live.udp_sessions_live(rows, SESSION_US))


@query(f"SELECT {_KEY}, n_packets, first_us, last_us FROM (" + _TCP + ") WHERE valid")
def tcp_streams_live(spark, sf_dir):
    return live.replay(packets_v(spark, sf_dir).filter("ip_proto = 6"), live.tcp_streams_live)


from . import catalogue_landed  # noqa: E402, F401  registers its queries too
