"""IKEv1 and IKEv2 sessions per flow, version and SPI pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.functions.names import ike_exchange, ike_notification
from packetloom.functions.parse import plain_int
from packetloom.schemas import IKE, field

# Header and proposal fields below the dissector's name.
HEADER_NAMES = ["version", "ispi", "rspi", "exchangetype", "messageid", "flags", "nextpayload",
                "length", "notify.msgtype", "frag.number", "frag.total", "frag.packetid",
                "frag.seq", "frag.last"]
PROPOSAL_NAMES = [
    "prop.number", "prop.protoid", "prop.transforms", "trans.number", "trans.id",
    "ike.attr.encryption_algorithm", "ike.attr.hash_algorithm", "ike.attr.authentication_method",
    "ike.attr.group_description", "ike.attr.key_length", "key_exchange.dh_group", "tf.type",
    "tf.id.encr", "tf.id.prf", "tf.id.integ", "tf.id.dh", "tf.id.esn",
]
FIELDS = ["frame.number", "frame.time_relative", "frame.time_epoch", "frame.len", "ip.src",
          "ipv6.src", "ip.dst", "ipv6.dst", "udp.srcport", "udp.dstport",
          *[f"isakmp.{n}" for n in HEADER_NAMES + PROPOSAL_NAMES]]
SESSION = ["flow_key", "version", "initiator_spi", "responder_spi"]


def ike_metadata() -> Column:
    """IKE header of one row whose fields repeat as comma lists; null unless major 1 or 2."""
    def values(name: str) -> Column:
        return F.filter(F.split(F.coalesce(field(f"isakmp.{name}"), F.lit("")), ","),
                        lambda v: v != "")

    def first(name: str) -> Column:
        return F.get(values(name), F.lit(0))

    def number(*names: str) -> Column:
        return plain_int(F.coalesce(*[first(n) for n in names]))

    def spi(name: str) -> Column:
        return F.lower(F.replace(first(name), F.lit(":"), F.lit("")))

    version = number("version")
    proposals = F.map_from_entries(F.filter(F.array(*[
        F.struct(F.lit(n).alias("key"), values(n).alias("value")) for n in PROPOSAL_NAMES]),
        lambda e: F.size(e["value"]) > 0))
    header = F.struct(
        version.cast("int").alias("version"), spi("ispi").alias("initiator_spi"),
        spi("rspi").alias("responder_spi"), number("exchangetype").alias("exchange_type"),
        number("messageid").alias("message_id"), number("flags").alias("flags"),
        number("nextpayload").alias("next_payload"), number("length").alias("length"),
        F.filter(F.transform(values("notify.msgtype"), plain_int),
                 lambda n: n.isNotNull()).alias("notify_types"),
        number("frag.number", "frag.seq").alias("fragment_number"),
        number("frag.total").alias("fragment_total"),
        number("frag.packetid").alias("fragment_id"), number("frag.last").alias("fragment_last"),
        proposals.alias("proposal_fields"))
    return F.when(F.shiftright(version, 4).isin(1, 2), header).cast(IKE)


def ike_rows(pk: DataFrame) -> DataFrame:
    c = F.col
    forward = (c("src_ip") == c("endpoint_a")) & c("src_port").eqNullSafe(c("port_a"))
    return pk.where(c("ike").isNotNull()).select(
        "flow_key", "frame_number", forward.alias("forward"), "ike.*").withColumn(
            "major", F.shiftright("version", 4))


def ike_sessions(pk: DataFrame) -> DataFrame:
    """One row per session: packets by direction, protected and fragmented packets, v2 roles."""
    c = F.col
    flags = c("flags")
    v2 = c("major") == 2
    protected = ((c("major") == 1) & (flags.bitwiseAND(F.lit(1)) != 0)) | (
        v2 & c("next_payload").isin(46, 53))
    return ike_rows(pk).groupBy(*SESSION).agg(
        F.min("frame_number").alias("first_at"),
        F.count_if("forward").alias("a_to_b_packets"),
        F.count_if(~c("forward")).alias("b_to_a_packets"),
        F.count_if(protected).alias("encrypted_packets"),
        F.count("fragment_number").alias("fragmented_packets"),
        F.count_if(v2 & (flags.bitwiseAND(F.lit(0x20)) == 0)).alias("v2_requests"),
        F.count_if(v2 & (flags.bitwiseAND(F.lit(0x20)) != 0)).alias("v2_responses"))


def ike_counts(pk: DataFrame) -> DataFrame:
    """(session, kind, value, n): exchanges, notifications and proposal values by field."""
    c = F.col

    def entry(kind: Column, value: Column) -> Column:
        return F.struct(kind.alias("kind"), value.alias("value"))

    exchanges = F.array(entry(F.lit("exchange"), ike_exchange(c("major"), c("exchange_type"))))
    notifications = F.transform("notify_types", lambda n: entry(
        F.lit("notification"), ike_notification(c("major"), n)))
    proposals = F.flatten(F.transform(F.map_entries("proposal_fields"), lambda e: F.transform(
        e["value"], lambda v: entry(e["key"], v))))
    return ike_rows(pk).select(*SESSION, F.inline(F.concat(
        exchanges, notifications, proposals))).groupBy(*SESSION, "kind", "value").agg(
            F.count(F.lit(1)).alias("n"))
