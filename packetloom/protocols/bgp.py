"""BGP messages per flow and direction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.schemas import field

# Exported BGP fields.
FIELDS = [
    "bgp.type", "bgp.length", "bgp.open.version", "bgp.open.myas", "bgp.open.holdtime",
    "bgp.open.identifier", "bgp.cap.type", "bgp.cap.4as", "bgp.cap.mp.afi", "bgp.cap.mp.safi",
    "bgp.notify.major_error", "bgp.notify.minor_error", "bgp.notify.minor_error_open",
    "bgp.notify.minor_error_update", "bgp.notify.minor_error_expired",
    "bgp.notify.minor_error_state", "bgp.notify.minor_error_cease",
    "bgp.notify.minor_error_route_refresh", "bgp.notify.minor_error_unknown",
    "bgp.nlri_prefix", "bgp.withdrawn_prefix", "bgp.prefix_length",
    "bgp.update.path_attribute.origin", "bgp.update.path_attribute.next_hop",
    "bgp.update.path_attribute.local_pref", "bgp.update.path_attribute.multi_exit_disc",
    "bgp.update.path_attribute.as_path_segment.as2",
    "bgp.update.path_attribute.as_path_segment.as4", "bgp.route_refresh.afi",
    "bgp.route_refresh.safi", "bgp.route_refresh.subtype",
]


def field_map(names: list[str]) -> Column:
    """Map of the listed header fields that are set, each a list of its repeated values."""
    return F.map_from_entries(F.filter(F.array(*[
        F.struct(F.lit(n).alias("key"), F.split(field(n), ",").alias("value")) for n in names]),
        lambda e: e["value"].isNotNull()))


def field_values(pk: DataFrame, column: str, keys: list[str]) -> DataFrame:
    return pk.select(*keys, F.explode(column).alias("field", "values")).select(
        *keys, "field", F.explode("values").alias("value"))


def bgp_summary(pk: DataFrame) -> DataFrame:
    """(flow, direction, field, value, n)."""
    return field_values(pk, "bgp_fields", ["flow_key", "a_to_b"]).groupBy(
        "flow_key", "a_to_b", "field", "value").agg(F.count(F.lit(1)).alias("n"))


def bgp_packets(pk: DataFrame) -> DataFrame:
    return pk.where(F.size("bgp_fields") > 0).groupBy("flow_key").agg(
        F.count(F.lit(1)).alias("packets"), F.count_if("a_to_b").alias("a_to_b_packets"),
        F.count_if(~F.col("a_to_b")).alias("b_to_a_packets"))
