"""Packet tables: counts, first-seen sets, TCP stream rebuilding and UDP sessions.

Streams are rebuilt by running aggregates over runs of packet or sequence numbers, so that a flow with a large part of all
packets is worked on by many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.segments import running, same
from .content import http_request
from .messages import good_response

STREAM = ["file", "ip_src", "sport", "ip_dst", "dport"]
HTTP_PORTS, DNS_PORT = (80, 443), 53
#: Packet numbers, and sequence numbers, of one run of a flow.
RUN, SEQ_RUN = 1 << 20, 1 << 24


def is_http(dport: Column) -> Column:
    return dport.isin(*HTTP_PORTS)


def is_dns(sport: Column, dport: Column) -> Column:
    return (sport == DNS_PORT) | (dport == DNS_PORT)


def packet_counts(packets: DataFrame) -> DataFrame:
    """Packets, HTTP-port and DNS-port packets of each capture."""
    http, dns = is_http(F.col("dport")), is_dns(F.col("sport"), F.col("dport"))
    return packets.groupBy("file").agg(F.count("*").alias("n_packets"), F.count_if(http).alias("n_http"), F.count_if(dns).alias("n_dns"))


def distinct_ips(packets: DataFrame) -> DataFrame:
    """Each capture's source and destination addresses with the packet that showed them first."""
    sides = F.explode(F.array(F.struct(F.lit("src").alias("role"), F.col("ip_src").alias("ip")), F.struct(F.lit("dst").alias("role"), F.col("ip_dst").alias("ip"))))
    return packets.select("file", "pkt_no", sides.alias("s")).groupBy("file", "s.role", "s.ip").agg(F.min("pkt_no").alias("first_pkt"))


def flow_key() -> Column:
    return F.concat("ip_src", F.lit("/"), F.col("sport").cast("string"), F.lit("=>"), "ip_dst", F.lit("/"), F.col("dport").cast("string"))


def split_flow_key(flow: Column) -> Column:
    sides = F.split(flow, "=>")
    part = lambda side, i: F.element_at(F.split(F.element_at(sides, side), "/"), i)
    return F.struct(part(1, 1).alias("ip_src"), part(1, 2).cast("int").alias("sport"), part(2, 1).alias("ip_dst"), part(2, 2).cast("int").alias("dport"))


def outcomes(packets: DataFrame, payload: str = "payload") -> DataFrame:
    """Adds what a packet's payload bytes say: `request` (method, uri, version, headers) of a packet to an HTTP port,
    `answers` of one from or to the DNS port, and `skipped`: a packet to an HTTP port that is no request, or a DNS packet
    that is no good response.

    Only the payloads of DNS ports reach Python; a packet that is skipped as a request is not read as an answer."""
    http, dns = is_http(F.col("dport")), is_dns(F.col("sport"), F.col("dport"))
    rows = packets.withColumn("request", F.when(http, http_request(F.decode(F.col(payload), "ISO-8859-1"))))
    rows = rows.withColumn("_dns", F.when(dns & ~(http & F.col("request").isNull()), F.col(payload)))
    rows = rows.withColumn("answers", F.when(dns, good_response("_dns"))).drop("_dns")
    bad = (http & F.col("request").isNull()) | (dns & F.col("answers").isNull())
    return rows.withColumn("skipped", F.coalesce(bad, F.lit(False)))


#: Keys that a request's own values take, whatever its headers say.
OVERLAID = ("source_ip", "destination_ip", "method", "version", "uri")


def http_requests(outcomes: DataFrame) -> DataFrame:
    """One row for each parsed request: the packet, the five overlaid values and `fields`, the headers with these on top."""
    own = (F.col("ip_src"), F.col("ip_dst"), F.col("request.method"), F.col("request.version"), F.col("request.uri"))
    rows = outcomes.filter("request IS NOT NULL").select("file", "pkt_no", *(c.alias(n) for c, n in zip(own, OVERLAID, strict=True)), F.col("request.headers").alias("_h"))
    others = F.map_filter("_h", lambda k, _: ~k.isin(*OVERLAID))
    return rows.withColumn("fields", F.map_concat(others, F.create_map(*(x for n in OVERLAID for x in (F.lit(n), F.col(n)))))).drop("_h")


def dns_requests(outcomes: DataFrame) -> DataFrame:
    """One row for each answer of a good response."""
    return outcomes.select("file", "pkt_no", F.explode("answers").alias("a")).select("file", "pkt_no", "a.*")


def all_flows(packets: DataFrame) -> DataFrame:
    """Each capture's flows with the packet that showed them first."""
    first = packets.groupBy(*STREAM).agg(F.min("pkt_no").alias("first_pkt"))
    return first.select("file", flow_key().alias("flow"), "first_pkt")


def distinct_flows(outcomes: DataFrame) -> DataFrame:
    """The flows of packets that are not skipped."""
    return all_flows(outcomes.filter(~F.col("skipped")))


def first_by_key(rows: DataFrame, keys: list[str], order: str, keep: list[str]) -> DataFrame:
    """The row of smallest `order` for each key: requests of one uri, equal DNS answers."""
    return rows.groupBy(*keys).agg(F.min_by(F.struct(order, *keep), order).alias("r")).select(*keys, "r.*")


def _runs(packets: DataFrame, width: int | None = None) -> DataFrame:
    """The packets with `_run`: the run of packet numbers that they belong to, which bounds what a task holds of a flow."""
    return packets.withColumn("_run", F.floor(F.col("pkt_no") / F.lit(width or RUN)))


def tcp_epochs(packets: DataFrame) -> DataFrame:
    """TCP packets that stand in an open stream, with its number: SYN opens, FIN closes, others outside are dropped.

    A stream is open if its last SYN came no earlier than the end that the last FIN before the packet made."""
    fin, syn = F.col("fin") == 1, F.col("syn") == 1
    values = {"epoch": ("sum", "fin", "before"), "_syn": ("max", F.when(syn, F.col("pkt_no"))), "_fin": ("max", F.when(fin, F.col("pkt_no")), "before")}
    rows = running(_runs(packets.filter("ip_proto = 6")), STREAM, "_run", ["pkt_no"], values)
    opened = rows.filter("_syn IS NOT NULL AND (_fin IS NULL OR _fin < _syn)")
    return opened.withColumn("epoch", F.coalesce("epoch", F.lit(0))).drop("_run", "_syn", "_fin")


def tcp_segments(packets: DataFrame) -> DataFrame:
    """Payload packets of open streams, the first arrival of each sequence number, with `joined`: it continues the one before.

    The one before is the largest sequence number so far, over runs of sequence numbers."""
    first = Window.partitionBy(*STREAM, "epoch", "seq").orderBy("pkt_no")
    kept = tcp_epochs(packets).filter("len > 0").withColumn("rn", F.row_number().over(first)).filter("rn = 1").drop("rn")
    kept = kept.withColumn("_run", F.floor(F.col("seq") / SEQ_RUN))
    before = F.struct("seq", (F.col("seq") + F.col("len")).alias("end"))
    rows = running(kept, [*STREAM, "epoch"], "_run", ["seq"], {"_before": ("max", before, "before")})
    return rows.withColumn("joined", F.coalesce(F.col("_before.end") == F.col("seq"), F.lit(True))).drop("_run", "_before")


def tcp_streams(packets: DataFrame) -> DataFrame:
    """One row a stream: packets, times and whether its sequence is contiguous."""
    return tcp_segments(packets).groupBy(*STREAM, "epoch").agg(
        F.count("*").alias("n_packets"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"), F.bool_and("joined").alias("valid")
    )


def stream_chunks(segments: DataFrame, order: str = "seq") -> DataFrame:
    """The segments of valid streams with `pos`, their place in the stream's bytes: a stream of any length stays many rows."""
    key = [*STREAM, "epoch"]
    broken = segments.filter(~F.col("joined")).select(*key).distinct()
    whole = segments.join(broken, same(segments, broken, key), "left_anti").withColumn("_run", F.floor(F.col(order) / SEQ_RUN))
    rows = running(whole, key, "_run", [order], {"pos": ("sum", "len")})
    return rows.withColumn("pos", F.col("pos") - F.col("len")).drop("_run")


def stream_bytes(segments: DataFrame, payload: str, order: str = "seq", first: int | None = None, part: str = "epoch") -> DataFrame:
    """The payloads of each stream in order as one value, and its first bytes, in time that grows with the bytes; for
    streams that fit in a row (see stream_chunks)."""
    rows = segments.withColumn("_part", F.col(payload).cast("binary"))
    whole = F.expr(f"listagg(_part) WITHIN GROUP (ORDER BY `{order}`)")
    rows = rows.groupBy(*STREAM, part).agg(F.bool_and("joined").alias("valid"), F.coalesce(whole, F.lit(b"")).alias("data"))
    rows = rows.filter("valid").drop("valid")
    return rows if first is None else rows.withColumn("head", F.substring("data", 1, first))


def udp_numbered(packets: DataFrame, timeout_us: int = 120_000_000) -> DataFrame:
    """UDP packets with the number of their session: a gap strictly greater than the time-out opens the next one."""
    rows = _runs(packets.filter("ip_proto = 17 AND len > 0"))
    rows = running(rows, STREAM, "_run", ["pkt_no"], {"_before": ("max", F.struct("pkt_no", "ts_us"), "before")})
    rows = rows.withColumn("_new", F.coalesce((F.col("ts_us") - F.col("_before.ts_us") > timeout_us).cast("int"), F.lit(0)))
    return running(rows, STREAM, "_run", ["pkt_no"], {"session": ("sum", "_new")}).drop("_run", "_before", "_new")


def udp_sessions(packets: DataFrame, timeout_us: int = 120_000_000) -> DataFrame:
    return udp_numbered(packets, timeout_us).groupBy(*STREAM, "session").agg(F.count("*").alias("n_packets"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"))


def all_streams(packets: DataFrame, timeout_us: int = 120_000_000) -> DataFrame:
    """Valid TCP streams and UDP sessions as one table."""
    tcp = tcp_streams(packets).filter("valid").select(F.lit("tcp").alias("proto"), *STREAM, F.col("epoch").cast("long").alias("number"), "n_packets", "first_us", "last_us")
    udp = udp_sessions(packets, timeout_us).select(F.lit("udp").alias("proto"), *STREAM, F.col("session").cast("long").alias("number"), "n_packets", "first_us", "last_us")
    return tcp.unionByName(udp)
