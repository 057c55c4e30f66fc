"""DHCP exchanges per flow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.functions.parse import filled

LISTS = {
    "transaction_ids": "dhcp_transaction_id", "client_macs": "dhcp_client_mac",
    "hostnames": "dhcp_hostname", "requested_ips": "dhcp_requested_ip",
    "offered_ips": "dhcp_your_ip", "server_ids": "dhcp_server_id",
    "lease_times": "dhcp_lease_time",
}


def first_distinct(df: DataFrame, keys: list[str], lists: dict[str, str], cap: int | None = None,
                   order: str = "frame_number") -> DataFrame:
    """(keys, list, value, position): distinct values of several columns; `cap` keeps the first ones."""
    from packetloom.operators.ordered import ordered_distinct

    entries = F.array(*[F.struct(F.lit(name).alias("list"), F.col(column).alias("value"))
                        for name, column in lists.items()])
    return ordered_distinct(df.select(*keys, order, F.inline(entries)), [*keys, "list"], "value",
                            order, cap).select(*keys, "list", "value", "position")


def dhcp_messages(pk: DataFrame) -> DataFrame:
    return pk.where(filled(F.col("dhcp_message_type"))).groupBy(
        "flow_key", "dhcp_message_type").agg(F.count(F.lit(1)).alias("n"))


def dhcp_lists(pk: DataFrame, cap: int | None = None) -> DataFrame:
    return first_distinct(pk, ["flow_key"], LISTS, cap)


def dhcp_summary(pk: DataFrame, cap: int | None = None) -> DataFrame:
    """One row per flow: message total, whether an ACK was seen, and the seven lists with their totals.

    The lists are whole unless `cap` keeps the first values; `n_` columns count all distinct ones.
    """
    ack = F.upper("dhcp_message_type").contains("ACK")
    messages = dhcp_messages(pk).groupBy("flow_key").agg(
        F.sum("n").alias("messages"), F.bool_or(ack).alias("has_ack"))
    entry = F.struct("position", "value")
    kept = F.lit(True) if cap is None else F.col("position") <= cap
    lists = dhcp_lists(pk).groupBy("flow_key").agg(
        *[F.transform(F.array_sort(F.collect_list(F.when((F.col("list") == name) & kept, entry))),
                      lambda e: e["value"]).alias(name) for name in LISTS],
        *[F.count_if(F.col("list") == name).alias(f"n_{name}") for name in LISTS])
    return messages.join(lists, "flow_key", "full")


def dhcp_incomplete(pk: DataFrame) -> DataFrame:
    """Flows with DHCP messages and no acknowledgement."""
    return dhcp_messages(pk).groupBy("flow_key").agg(
        (~F.bool_or(F.upper("dhcp_message_type").contains("ACK"))).alias("incomplete"))
