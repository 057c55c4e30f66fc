"""MACsec and EAPOL headers per flow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.functions.parse import plain_int
from packetloom.protocols.bgp import field_values

# Exported fields, and the ones read as numbers.
MACSEC_FIELDS = [
    "macsec.TCI", "macsec.TCI.V", "macsec.TCI.ES", "macsec.TCI.SC", "macsec.TCI.SCB",
    "macsec.TCI.E", "macsec.TCI.C", "macsec.AN", "macsec.SL", "macsec.PN",
    "macsec.SCI.system_identifier", "macsec.SCI.port_identifier", "macsec.etype",
]
EAPOL_FIELDS = [
    "eapol.version", "eapol.type", "eapol.len", "eapol.keydes.type", "eapol.keydes.key_len",
    "eapol.keydes.replay_counter", "wlan_rsna_eapol.keydes.msgnr",
    "wlan_rsna_eapol.keydes.key_info", "eap.code", "eap.id", "eap.len", "eap.type",
    "mka.version_id", "mka.ks_prio", "mka.key_server", "mka.macsec_desired",
    "mka.macsec_capability", "mka.sci", "mka.cak_name", "mka.actor_mi", "mka.actor_mn",
    "mka.algo_agility", "mka.latest_key_an", "mka.latest_key_tx", "mka.latest_key_rx",
    "mka.old_key_an", "mka.old_key_tx", "mka.old_key_rx", "mka.distributed_an",
    "mka.confidentiality_offset", "mka.macsec_cipher_suite",
]
LINK_FIELDS = ["frame.number", "frame.time_relative", "frame.time_epoch", "frame.len", "eth.src",
               "eth.dst", "wlan.sa", "wlan.da", "vlan.id"]
NUMBER_FIELDS = ["macsec.PN", "eapol.keydes.replay_counter", "mka.actor_mn"]
COLUMNS = {"MACSEC": "macsec_fields", "EAPOL": "eapol_fields"}


def link_counts(pk: DataFrame, protocol: str) -> DataFrame:
    """(flow, field, value, n) of the fields that are not numbers."""
    return field_values(pk, COLUMNS[protocol], ["flow_key"]).where(
        ~F.col("field").isin(NUMBER_FIELDS)).groupBy("flow_key", "field", "value").agg(
            F.count(F.lit(1)).alias("n"))


def link_ranges(pk: DataFrame, protocol: str) -> DataFrame:
    """(flow, field, low, high) of the number fields; the MKA counter is hexadecimal with colons."""
    value = F.col("value")
    bare = F.replace(value, F.lit(":"), F.lit(""))
    number = F.when(F.col("field") == "mka.actor_mn", F.when(
        bare.rlike("^(0[xX])?[0-9a-fA-F]+$"),
        F.conv(F.regexp_replace(bare, "^0[xX]", ""), 16, 10).try_cast("bigint"))).otherwise(
            plain_int(value))
    return field_values(pk, COLUMNS[protocol], ["flow_key"]).where(
        F.col("field").isin(NUMBER_FIELDS)).select("flow_key", "field", number.alias("number")).where(
            "number IS NOT NULL").groupBy("flow_key", "field").agg(
                F.min("number").alias("low"), F.max("number").alias("high"))


def link_summary(pk: DataFrame, protocol: str) -> DataFrame:
    return pk.where(F.size(COLUMNS[protocol]) > 0).groupBy("flow_key").agg(
        F.count(F.lit(1)).alias("packets"))
