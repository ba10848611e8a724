"""Packet operators on streams with event time.

Each takes a streaming (or batch) table of packets with the columns of `packets` and an event time `ts`; a watermark
closes windows, sessions and idle TCP streams, so that state does not grow for ever. `replay` runs one over a finished
table and returns what it gives.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.packets import STREAM, is_dns, is_http
from ..plans.shared import fresh_folder

_KEPT = [*STREAM, "pkt_no", "ts_us", "ip_proto", "seq", "syn", "fin", "len"]
#: How late a packet may come; a TCP stream without a packet for so long is closed.
LATE, IDLE_MS = "10 minutes", 3_600_000
STORE = "spark.sql.streaming.stateStore.providerClass"


def replay(packets: DataFrame, operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Writes a table as files, streams them through the operator to the end and reads the sink.

    A last row of no capture, years later, moves the watermark past all others, so that everything closes."""
    spark = packets.sparkSession
    folder = fresh_folder(spark, "live")
    rows = packets.select(*_KEPT).withColumn("ts", F.timestamp_micros("ts_us"))
    late = {"file": F.lit(None), "ts": F.max("ts") + F.expr("INTERVAL 3650 DAYS"), "ts_us": F.max("ts_us"), "ip_proto": F.max("ip_proto"), "len": F.lit(1)}
    end = rows.agg(*(late.get(f.name, F.lit(0)).cast(f.dataType).alias(f.name) for f in rows.schema))
    rows.unionByName(end).write.parquet(f"{folder}/in")
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = operator(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"))
        stream.writeStream.format("parquet").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/out").start().awaitTermination()
    finally:
        spark.conf.set(STORE, before)
    return spark.read.schema(stream.schema).parquet(f"{folder}/out").filter("file IS NOT NULL")


def packet_counts_live(packets: DataFrame, window: str, late: str = LATE) -> DataFrame:
    """Packet, HTTP-port and DNS-port counts of each capture and window, when the window is over."""
    counted = packets.withWatermark("ts", late).groupBy("file", F.window("ts", window).alias("w")).agg(
        F.count("*").alias("n_packets"), F.count_if(is_http(F.col("dport"))).alias("n_http"), F.count_if(is_dns(F.col("sport"), F.col("dport"))).alias("n_dns")
    )
    return counted.select("file", F.unix_micros("w.start").alias("window_us"), "n_packets", "n_http", "n_dns")


def udp_sessions_live(packets: DataFrame, timeout_us: int, late: str = LATE) -> DataFrame:
    """Session statistics of directional UDP flows by event-time session windows, when the session is over."""
    found = packets.withWatermark("ts", late).groupBy(*STREAM, F.session_window("ts", f"{timeout_us // 1_000_000} seconds").alias("w"))
    return found.agg(F.count("*").alias("n_packets"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us")).drop("w")


class _TcpStreams(StatefulProcessor):
    """Segments of the open stream; a FIN, or no packet for IDLE_MS, emits the stream if it is contiguous.

    The rows of a batch come in any order and are taken by packet number, those between two FINs at once; the state of a
    key holds the segments of one open stream in order of arrival."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "started boolean")
        self.segments = handle.getListState("segments", "seq long, len long, ts_us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch, found = pd.concat(list(rows)).sort_values("pkt_no"), []
        is_open = self.open.exists()
        for _, part in batch.groupby(batch["fin"].cumsum() - batch["fin"]):
            started = (part["syn"].cummax() > 0) | is_open
            own = part.loc[started & (part["len"] > 0), ["seq", "len", "ts_us"]]
            is_open = bool(started.iloc[-1])
            if part["fin"].iloc[-1]:
                if is_open:
                    found += self._close(key, own)
                is_open = False
            elif is_open:
                self.open.update((True,))
                if len(own):
                    self.segments.appendList(list(own.astype("int64").itertuples(index=False, name=None)))
        if is_open:
            self._forget_timers()
            self.handle.registerTimer(max(int(batch["ts_us"].max()) // 1000, timerValues.getCurrentWatermarkInMs()) + IDLE_MS)
        if found:
            yield self._rows(found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        found = self._close(key)
        if found:
            yield self._rows(found)

    def _forget_timers(self) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)

    def _rows(self, found: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(found, columns=[*STREAM, "n_packets", "first_us", "last_us"])

    def _close(self, key, last: pd.DataFrame | None = None) -> list[tuple]:
        earlier = pd.DataFrame(list(self.segments.get()) if self.segments.exists() else [], columns=["seq", "len", "ts_us"])
        self.segments.clear()
        self.open.clear()
        parts = pd.concat([earlier, last]) if last is not None and len(earlier) else earlier if last is None else last
        parts = parts.drop_duplicates("seq").sort_values("seq")  # the first arrival of a number stays
        ends, starts = (parts["seq"] + parts["len"]).to_numpy()[:-1], parts["seq"].to_numpy()[1:]
        whole = len(parts) and (ends == starts).all()
        return [(*key, len(parts), int(parts["ts_us"].min()), int(parts["ts_us"].max()))] if whole else []

    def close(self) -> None:
        pass


def tcp_streams_live(packets: DataFrame, late: str = LATE) -> DataFrame:
    """Contiguous TCP streams as they close. The end of a capture, which closes what is open, is an idle time here."""
    schema = "file string, ip_src string, sport long, ip_dst string, dport int, n_packets long, first_us long, last_us long"
    keyed = packets.withWatermark("ts", late).groupBy(*STREAM)
    return keyed.transformWithStateInPandas(_TcpStreams(), outputStructType=schema, outputMode="Append", timeMode="EventTime")
