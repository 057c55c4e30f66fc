"""SIP calls per flow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.functions.names import sip_class, sip_status
from packetloom.functions.parse import filled
from packetloom.operators.keys import endpoint_label
from packetloom.operators.ordered import ordered_distinct, place_in_packet

CALL = ["flow_key", "sip_call_id"]


def sip_rows(pk: DataFrame) -> DataFrame:
    c = F.col
    return pk.where(filled(c("sip_call_id")) | filled(c("sip_method"))
                    | c("sip_status_code").isNotNull() | filled(c("sip_from"))
                    | filled(c("sip_to"))).select(
        "flow_key", "frame_number", F.nullif("sip_call_id", F.lit("")).alias("sip_call_id"),
        F.nullif("sip_method", F.lit("")).alias("sip_method"), "sip_status_code",
        sip_status(c("sip_status_code"), c("sip_reason")).alias("status"),
        F.nullif("sip_from", F.lit("")).alias("sip_from"),
        F.nullif("sip_to", F.lit("")).alias("sip_to"),
        F.unix_micros(c("timestamp").cast("timestamp")).alias("time_us"),
        endpoint_label(c("src_ip"), c("src_port")).alias("from_endpoint"),
        endpoint_label(c("dst_ip"), c("dst_port")).alias("to_endpoint"))


def sip_calls(pk: DataFrame) -> DataFrame:
    """One row per flow and call: caller, callee and totals."""
    c = F.col

    def first(name: str):
        return F.min(F.when(c(name).isNotNull(), F.struct("frame_number", c(name).alias("x"))))["x"]

    return sip_rows(pk).where("sip_call_id IS NOT NULL").groupBy(*CALL).agg(
        F.count(F.lit(1)).alias("packets"), F.min("frame_number").alias("first_at"),
        first("sip_from").alias("caller"), first("sip_to").alias("callee"),
        F.count("sip_method").alias("methods"), F.count("status").alias("statuses"),
        F.count_if(sip_class(c("sip_status_code")).isNotNull()).alias("failures"))


def sip_call_counts(pk: DataFrame) -> DataFrame:
    """(flow, call, kind, value, n, first_at): methods, statuses and failure classes of a call."""
    c = F.col
    return sip_rows(pk).where("sip_call_id IS NOT NULL").select(
        *CALL, "frame_number", F.inline(F.array(
            F.struct(F.lit("method").alias("kind"), c("sip_method").alias("value")),
            F.struct(F.lit("status").alias("kind"), c("status").alias("value")),
            F.struct(F.lit("issue").alias("kind"), sip_class(c("sip_status_code")).alias("value")),
        ))).where("value IS NOT NULL").groupBy(*CALL, "kind", "value").agg(
            F.count(F.lit(1)).alias("n"), F.min("frame_number").alias("first_at"))


def sip_trace(pk: DataFrame) -> DataFrame:
    """Distinct messages of a call in order: time, both endpoints, method or status."""
    message = F.coalesce("sip_method", "status")
    rows = sip_rows(pk).withColumn("message", message).where(
        "sip_call_id IS NOT NULL AND message IS NOT NULL")
    event = ["time_us", "from_endpoint", "to_endpoint", "message"]
    distinct = rows.groupBy(*CALL, *event).agg(F.min("frame_number").alias("first_at"))
    from packetloom.operators.ordered import scan

    return scan(distinct, CALL, "first_at", position="position").drop("first_at")


def sip_summary(pk: DataFrame) -> DataFrame:
    rows = sip_rows(pk)
    calls = rows.where("sip_call_id IS NOT NULL").select(*CALL).distinct().groupBy("flow_key").agg(
        F.count(F.lit(1)).alias("calls"))
    return rows.groupBy("flow_key").agg(
        F.count("sip_method").alias("methods"), F.count("status").alias("statuses")).join(
            calls, "flow_key", "left").na.fill(0)


def sip_flow_counts(pk: DataFrame) -> DataFrame:
    """(flow, kind, value, n) of methods and statuses, with or without a call."""
    c = F.col
    return sip_rows(pk).select("flow_key", F.inline(F.array(
        F.struct(F.lit("method").alias("kind"), c("sip_method").alias("value")),
        F.struct(F.lit("status").alias("kind"), c("status").alias("value")),
    ))).where("value IS NOT NULL").groupBy("flow_key", "kind", "value").agg(
        F.count(F.lit(1)).alias("n"))


def sip_participants(pk: DataFrame) -> DataFrame:
    """Callers and callees of a flow in order of appearance, the sender of a packet first."""
    c = F.col
    listed = sip_rows(pk).select("flow_key", F.inline(F.array(
        F.struct(place_in_packet(F.lit(0)).alias("at"), c("sip_from").alias("participant")),
        F.struct(place_in_packet(F.lit(1)).alias("at"), c("sip_to").alias("participant")))))
    return ordered_distinct(listed, ["flow_key"], "participant", "at").select(
        "flow_key", "participant", "position")
