"""Rates, losses, hints and tool choice of a flow; columns over the flow table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LONG_LIVED_SECONDS = 180
SMALL_SMB_BYTES = 64 * 1024
STALL_MS = 1000


def duration_s() -> Column:
    micros = F.timestamp_diff("MICROSECOND", F.col("first_seen"), F.col("last_seen"))
    return F.greatest(F.coalesce(micros, F.lit(0)) / F.lit(1e6), F.lit(0.0))


def with_duration(fl: DataFrame) -> DataFrame:
    return fl.withColumn("duration_s", duration_s())


def _per_second(amount: Column, idle: Column) -> Column:
    return F.when(F.col("duration_s") > 0, amount / F.col("duration_s")).otherwise(idle)


def packet_rates() -> dict[str, Column]:
    none = F.lit(None).cast("double")
    return {f"{way}_packets_per_s": _per_second(F.col(f"{way}_packets"), none)
            for way in ("a_to_b", "b_to_a")}


def throughput_mbps() -> dict[str, Column]:
    none = F.lit(None).cast("double")
    return {f"{way}_mbps": _per_second(F.col(f"{way}_bytes") * 8, none) / F.lit(1e6)
            for way in ("a_to_b", "b_to_a")}


def total_rates() -> dict[str, Column]:
    zero = F.lit(0.0)
    return {
        "packets_per_s": _per_second(F.col("packet_count"), zero),
        "bytes_per_s": _per_second(F.col("byte_count"), zero),
        "mbps": _per_second(F.col("byte_count"), zero) * 8 / F.lit(1e6),
    }


def rate(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def _tcp_rates(tag: str, out: str) -> dict[str, Column]:
    return {
        out: rate(F.col(tag), F.col("packet_count")),
        f"a_to_b_{out}": rate(F.col(f"a_to_b_{tag}"), F.col("a_to_b_packets")),
        f"b_to_a_{out}": rate(F.col(f"b_to_a_{tag}"), F.col("b_to_a_packets")),
    }


def retransmission_rates() -> dict[str, Column]:
    return _tcp_rates("tcp_retransmission", "retransmission_rate")


def esp_totals(esp: DataFrame) -> DataFrame:
    """ESP sequence results added up per flow and direction."""
    def ways(name: str, value: Column) -> list[Column]:
        return [F.sum(value).alias(f"esp_{name}"),
                F.coalesce(F.sum(F.when(F.col("is_forward"), value)), F.lit(0)).alias(
                    f"a_to_b_esp_{name}"),
                F.coalesce(F.sum(F.when(F.col("is_reverse"), value)), F.lit(0)).alias(
                    f"b_to_a_esp_{name}")]

    return esp.groupBy("flow_key").agg(
        F.count(F.lit(1)).alias("esp_streams"),
        *ways("missing", F.col("missing")),
        *ways("expected", F.col("distinct_sequences") + F.col("missing")),
        *ways("out_of_order", F.col("out_of_order")),
        *ways("sequenced", F.col("packets")),
        F.bool_or((F.col("missing") > 0) | (F.col("out_of_order") > 0) | (F.col("duplicates") > 0)
                  | (F.col("largest_gap") > 0)).alias("esp_anomaly"))


def with_esp(fl: DataFrame, esp: DataFrame) -> DataFrame:
    return fl.join(esp_totals(esp), "flow_key", "left")


def _sequenced() -> Column:
    return (F.col("protocol") == "ESP") & (F.coalesce(F.col("esp_streams"), F.lit(0)) > 0)


def loss_rates() -> dict[str, Column]:
    """Missing share of the expected ESP numbers, else lost segments per packet."""
    tcp = _tcp_rates("tcp_lost_segment", "loss_rate")
    esp = {
        "loss_rate": F.when(F.col("esp_expected") > 0, F.col("esp_missing") / F.col("esp_expected"))
        .otherwise(tcp["loss_rate"]),
        **{f"{way}_loss_rate": rate(F.col(f"{way}_esp_missing"), F.col(f"{way}_esp_expected"))
           for way in ("a_to_b", "b_to_a")},
    }
    return {name: F.when(_sequenced(), esp[name]).otherwise(tcp[name]) for name in tcp}


def out_of_order() -> dict[str, Column]:
    tcp = _tcp_rates("tcp_out_of_order", "out_of_order_rate")
    count = F.when(_sequenced(), F.col("esp_out_of_order")).otherwise(F.col("tcp_out_of_order"))
    return {
        "out_of_order_count": count,
        "out_of_order_rate": rate(count, F.col("packet_count")),
        **{f"{way}_out_of_order_rate": F.when(_sequenced(), rate(
            F.col(f"{way}_esp_out_of_order"), F.col(f"{way}_esp_sequenced"))).otherwise(
                tcp[f"{way}_out_of_order_rate"]) for way in ("a_to_b", "b_to_a")},
    }


def is_one_way() -> Column:
    return (F.col("a_to_b_packets") == 0) | (F.col("b_to_a_packets") == 0)


def _texts(rules: list[tuple[Column, str]]) -> Column:
    return F.array_compact(F.array(*[
        F.when(F.coalesce(test, F.lit(False)), F.lit(text)) for test, text in rules]))


def smb_hints() -> Column:
    c = F.col
    seen = ((c("smb_commands") > 0) | (c("smb_statuses") > 0) | (c("smb_named") > 0)
            | (c("smb_encrypted_packets") > 0))
    ops = F.coalesce(c("read_ops"), F.lit(0)) + F.coalesce(c("write_ops"), F.lit(0))
    moved = F.coalesce(c("read_bytes"), F.lit(0)) + F.coalesce(c("write_bytes"), F.lit(0))
    mbps = _per_second(moved * 8, F.lit(0.0)) / F.lit(1e6)
    return _texts([
        (seen & (c("smb_encrypted_packets") > 0),
         "smb encrypted transform traffic observed; filenames and read/write details are hidden"),
        (seen & (c("smb_errors") > 0), "smb errors observed"),
        (seen & (ops > 0) & (moved > 0) & (moved / ops < SMALL_SMB_BYTES),
         "small average smb read/write size"),
        (seen & (c("duration_s") >= LONG_LIVED_SECONDS) & (mbps < 10),
         "low smb transfer throughput for long-lived flow"),
        (seen & (c("max_interarrival_ms") >= STALL_MS),
         "smb transfer stalls or idle gaps observed"),
    ])


def transport_hints() -> Column:
    c = F.col
    long_lived = c("duration_s") >= LONG_LIVED_SECONDS
    return _texts([
        (is_one_way() & (c("packet_count") > 1), "one-way traffic observed"),
        (long_lived & (total_rates()["mbps"] < 2), "low average throughput for long-lived flow"),
        (retransmission_rates()["retransmission_rate"] >= 0.01,
         "tcp retransmission rate above 1 percent"),
        (c("tcp_zero_window") > 0, "tcp receiver window pressure observed"),
        (c("tcp_reset") > 0, "tcp reset observed"),
        (c("tls_fatal_alert") > 0, "tls fatal alert observed"),
        ((c("tls_fatal_alert") == 0) & (c("tls_alert") > 0), "tls alert observed"),
        (c("esp_anomaly"), "esp sequence anomaly observed"),
        (c("dns_errors") > 0, "dns error responses observed"),
        ((c("dhcp_messages") > 0) & (c("dhcp_acks") == 0),
         "dhcp exchange lacks ack in observed packets"),
        (c("protocol").isin("ESP", "UDP") & long_lived,
         "encrypted or datagram flow limits direct loss/latency proof"),
    ])


def diagnostic_hints() -> Column:
    """Rules in a fixed order. Needs ESP totals, SMB transfers and waiting times on the flow."""
    return F.concat(transport_hints(), smb_hints())


def with_hint_inputs(fl: DataFrame, esp: DataFrame, transfers: DataFrame, waits: DataFrame
                     ) -> DataFrame:
    return with_duration(with_esp(fl, esp)).join(transfers, "flow_key", "left").join(
        waits, "flow_key", "left")
