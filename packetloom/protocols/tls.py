"""TLS and DTLS names, alerts and certificates per flow."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.functions.names import tls_alert_label
from packetloom.functions.parse import comma_items, filled
from packetloom.operators.keys import endpoint_label
from packetloom.operators.ordered import ordered_distinct, place_in_packet, scan
from packetloom.schemas import field

# Fields that name an algorithm, for either prefix.
ALGORITHMS = [
    "handshake.ciphersuites", "handshake.ciphersuite", "handshake.ciphersuite.undecoded",
    "handshake.extensions_supported_groups", "handshake.extensions_supported_group",
    "handshake.extensions_key_share_group", "handshake.extensions_key_share_selected_group",
    "handshake.sig_hash_alg", "handshake.sig_hash_hash", "handshake.sig_hash_sig",
    "handshake.server_curve_type", "handshake.server_named_curve", "compress_certificate.algorithm",
    "esni.suite", "ech.hpke.keyconfig.cipher_suite", "ech.hpke.keyconfig.cipher_suite.kdf_id",
    "ech.hpke.keyconfig.cipher_suite.aead_id", "ech.cipher_suite",
]
# Exported header fields of the tool, in the order of the export.
FIELDS = [
    "frame.number", "frame.time_relative", "frame.time_epoch", "ip.src", "ipv6.src", "ip.dst",
    "ipv6.dst", "tcp.srcport", "tcp.dstport", "tcp.seq", "tcp.ack", "tcp.len",
    "tcp.window_size_value", "tcp.flags", "tcp.analysis.retransmission",
    "tcp.analysis.lost_segment", "tcp.analysis.out_of_order", "tcp.analysis.zero_window",
    "udp.srcport", "udp.dstport", "udp.length", "udp.checksum.status",
    "tls.record.content_type", "tls.record.version", "tls.handshake.type", "tls.handshake.version",
    "tls.handshake.extensions_server_name", "tls.handshake.cipher_suites_length",
    "tls.handshake.ciphersuites", "tls.handshake.ciphersuite",
    "tls.handshake.ciphersuite.undecoded", "tls.handshake.extensions_supported_groups",
    "tls.handshake.extensions_supported_group", "tls.handshake.extensions_key_share_group",
    "tls.handshake.extensions_key_share_selected_group", "tls.handshake.sig_hash_alg",
    "tls.handshake.sig_hash_hash", "tls.handshake.sig_hash_sig", "tls.handshake.server_curve_type",
    "tls.handshake.server_named_curve", "tls.handshake.client_cert_vrfy.sig",
    "tls.compress_certificate.algorithm", "tls.esni.suite", "tls.ech.hpke.keyconfig.cipher_suite",
    "tls.ech.hpke.keyconfig.cipher_suite.kdf_id", "tls.ech.hpke.keyconfig.cipher_suite.aead_id",
    "tls.ech.cipher_suite", "tls.handshake.certificate", "tls.alert_message.level",
    "tls.alert_message.desc",
    "x509af.subject", "x509af.issuer", "x509af.serialNumber", "x509af.notBefore", "x509af.notAfter",
    "x509ce.dNSName",
    "dtls.record.content_type", "dtls.record.version", "dtls.handshake.type",
    "dtls.handshake.version", "dtls.handshake.extensions_server_name",
    "dtls.handshake.cipher_suites_length", "dtls.handshake.ciphersuites",
    "dtls.handshake.ciphersuite", "dtls.handshake.ciphersuite.undecoded",
    "dtls.handshake.extensions_supported_groups", "dtls.handshake.extensions_supported_group",
    "dtls.handshake.extensions_key_share_group",
    "dtls.handshake.extensions_key_share_selected_group", "dtls.handshake.sig_hash_alg",
    "dtls.handshake.sig_hash_hash", "dtls.handshake.sig_hash_sig",
    "dtls.handshake.server_curve_type", "dtls.handshake.server_named_curve",
    "dtls.handshake.client_cert_vrfy.sig", "dtls.compress_certificate.algorithm", "dtls.esni.suite",
    "dtls.ech.hpke.keyconfig.cipher_suite", "dtls.ech.hpke.keyconfig.cipher_suite.kdf_id",
    "dtls.ech.hpke.keyconfig.cipher_suite.aead_id", "dtls.ech.cipher_suite",
    "dtls.handshake.certificate", "dtls.alert_message.level", "dtls.alert_message.desc",
]
LIKELY_TCP_PORTS = [443, 853, 8443]
LIKELY_UDP_PORTS = [443, 853, 4433]
CERTIFICATE_KEY = ["presenter_ip", "presenter_port", "subject", "issuer", "serial"]


def common_name(subject: Column) -> Column:
    """The first CN part of a comma-separated subject."""
    parts = F.filter(F.transform(F.split(subject, ","), lambda p: F.trim(p)),
                     lambda p: F.lower(p).startswith("cn="))
    return F.trim(F.substring(F.get(parts, F.lit(0)), 4, 1 << 20))


def certificate_rows(df: DataFrame, lists: dict[str, Column], keys: list[str]) -> DataFrame:
    """Rows of certificates zipped from parallel value lists, without exact repeats in a packet.

    `lists` holds arrays for subject, issuer, serial, not_before, not_after, san and
    fingerprint_sha256; a shorter list leaves its later values null.
    """
    names = ["subject", "issuer", "serial", "not_before", "not_after", "san", "fingerprint_sha256"]
    empty = F.array().cast("array<string>")
    zipped = F.arrays_zip(*[F.coalesce(lists[n], empty).alias(n) for n in names])
    rows = df.select(*keys, F.posexplode(zipped).alias("slot", "c")).select(
        *keys, "slot", *[F.col("c")[n].alias(n) for n in names]).withColumns({
            "san_dns": comma_items(F.col("san")),
            "subject_cn": common_name(F.col("subject")),
            "issuer_cn": common_name(F.col("issuer"))}).drop("san")
    used = rows.where(filled(F.col("subject")) | filled(F.col("issuer")) | filled(F.col("serial"))
                      | (F.size("san_dns") > 0))
    same = ["fingerprint_sha256", "serial", "subject", "issuer", "subject_cn", "issuer_cn"]
    return used.groupBy(*keys, *same).agg(F.min(F.struct(
        "slot", "not_before", "not_after", "san_dns")).alias("c")).select(*keys, *same, "c.*")


def packet_certificates(pk: DataFrame) -> DataFrame:
    """One row per certificate of a packet, presented by the sender."""
    listed = pk.select("flow_key", "frame_number", "src_ip", "src_port",
                       F.posexplode("tls_certificates").alias("slot", "c"))
    return listed.select(
        "flow_key", place_in_packet(F.col("slot")).alias("at"),
        F.coalesce("c.presenter_ip", "src_ip").alias("presenter_ip"),
        F.coalesce("c.presenter_port", "src_port").alias("presenter_port"),
        *[F.col(f"c.{n}").alias(n) for n in (
            "presenter_role", "subject", "subject_cn", "issuer", "issuer_cn", "serial",
            "not_before", "not_after", "san_dns", "fingerprint_sha256")])


def certificate_roles(certs: DataFrame) -> DataFrame:
    """Role of each presenter of a flow by first appearance: server, client, then peers."""
    presenter = ["flow_key", "presenter_ip", "presenter_port"]
    first = certs.groupBy(*presenter).agg(
        F.min("at").alias("first_at"),
        F.min(F.when(F.col("presenter_role").isNotNull(), F.struct("at", "presenter_role")))[
            "presenter_role"].alias("given"))
    placed = scan(first, ["flow_key"], "first_at", position="place")
    return placed.select(*presenter, F.coalesce("given", F.when(F.col("place") == 1, "server").when(
        F.col("place") == 2, "client").otherwise("peer")).alias("role"))


def tls_certificates(pk: DataFrame) -> DataFrame:
    """First certificate of each (presenter, subject, issuer, serial) of a flow, with its role."""
    certs = packet_certificates(pk)
    kept = ["presenter_role", "subject_cn", "issuer_cn", "not_before", "not_after", "san_dns",
            "fingerprint_sha256"]
    first = certs.groupBy("flow_key", *CERTIFICATE_KEY).agg(
        F.min(F.struct("at", *kept)).alias("c")).select("flow_key", *CERTIFICATE_KEY, "c.*")
    roles = certificate_roles(certs)
    same = reduce(lambda a, b: a & b, [
        F.col("c.flow_key") == F.col("r.flow_key"),
        F.col("c.presenter_ip").eqNullSafe(F.col("r.presenter_ip")),
        F.col("c.presenter_port").eqNullSafe(F.col("r.presenter_port"))])
    return first.alias("c").join(roles.alias("r"), same).select("c.*", "r.role").drop(
        "presenter_role")


def certificate_time(text: Column) -> Column:
    """ISO text with or without an offset; UTC where none is given."""
    plain = F.replace(F.trim(text), F.lit("Z"), F.lit("+00:00"))
    stated = plain.rlike(r"[+-]\d\d:\d\d$")
    return F.when(plain.rlike(r"^\d{4}-\d\d-\d\d([T ]\d\d:\d\d(:\d\d(\.\d+)?)?)?([+-]\d\d:\d\d)?$"),
                  F.when(stated, plain).otherwise(F.concat(
                      plain, F.when(plain.rlike(r"^\d{4}-\d\d-\d\d$"), F.lit("T00:00:00+00:00"))
                      .otherwise(F.lit("+00:00")))).try_cast("timestamp"))


def certificate_issues(not_before: Column, not_after: Column, as_of: Column) -> Column:
    """Validity problems of a certificate at a given instant."""
    return F.array_compact(F.array(
        F.when(certificate_time(not_after) < as_of,
               F.concat(F.lit("certificate expired "), not_after)),
        F.when(certificate_time(not_before) > as_of,
               F.concat(F.lit("certificate not valid until "), not_before))))


def tls_sni_list(pk: DataFrame, per_sender: bool = False) -> DataFrame:
    """Server names of a flow, or of each sender in it, in order of appearance."""
    keys = ["flow_key", "endpoint"] if per_sender else ["flow_key"]
    rows = pk.withColumn("endpoint", endpoint_label(F.col("src_ip"), F.col("src_port")))
    return ordered_distinct(rows.select(*keys, "tls_sni", "frame_number"), keys, "tls_sni").select(
        *keys, "tls_sni", "position")


def tls_alerts(pk: DataFrame, per_sender: bool = False) -> DataFrame:
    keys = ["flow_key", "endpoint"] if per_sender else ["flow_key"]
    level, description = F.col("tls_alert_level"), F.col("tls_alert_description")
    return pk.where(filled(level) | filled(description)).select(
        "flow_key", "frame_number",
        endpoint_label(F.col("src_ip"), F.col("src_port")).alias("endpoint"),
        tls_alert_label(level, description).alias("alert")).groupBy(*keys, "alert").agg(
            F.count(F.lit(1)).alias("n"), F.min("frame_number").alias("first_at"))


def tls_summary(pk: DataFrame) -> DataFrame:
    names = pk.where(filled(F.col("tls_sni"))).select("flow_key", "tls_sni").distinct().groupBy(
        "flow_key").agg(F.count(F.lit(1)).alias("snis"))
    alerts = tls_alerts(pk).groupBy("flow_key").agg(
        F.sum("n").alias("alerts"), F.count(F.lit(1)).alias("alert_kinds"))
    return names.join(alerts, "flow_key", "full").na.fill(0)


def tls_issue_texts(pk: DataFrame, fl: DataFrame) -> DataFrame:
    """Issues per flow and endpoint, and for the flow as a whole (endpoint null), in order.

    A flow without any certificate says so, and an endpoint without alerts of its own names the
    alert its peer sent.
    """
    alerts = tls_alerts(pk, per_sender=True)
    certified = packet_certificates(pk).select("flow_key").distinct().withColumn(
        "certified", F.lit(True))
    flow_alerts = tls_alerts(pk)
    seen = fl.select("flow_key", F.explode(F.array(
        endpoint_label(F.col("endpoint_a"), F.col("port_a")),
        endpoint_label(F.col("endpoint_b"), F.col("port_b")))).alias("endpoint"))
    own = alerts.select("flow_key", "endpoint", F.col("first_at").alias("at"), F.concat(
        F.lit("sent tls alert: "), "alert", F.lit(" (x"), F.col("n").cast("string"), F.lit(")")
    ).alias("issue"))
    whole = flow_alerts.select("flow_key", F.lit(None).cast("string").alias("endpoint"),
                               F.col("first_at").alias("at"), F.concat(
        F.lit("tls alert: "), "alert", F.lit(" (x"), F.col("n").cast("string"), F.lit(")")
    ).alias("issue"))
    open_flows = flow_alerts.select("flow_key").distinct().join(certified, "flow_key", "left_anti")
    quiet = seen.join(open_flows, "flow_key", "left_semi").join(
        alerts.select("flow_key", "endpoint"), ["flow_key", "endpoint"], "left_anti").select(
            "flow_key", "endpoint", F.lit(1 << 60).alias("at"),
            F.lit("tls alert sent by peer").alias("issue"))
    bare = seen.join(open_flows, "flow_key", "left_semi").unionByName(
        open_flows.withColumn("endpoint", F.lit(None).cast("string"))).select(
            "flow_key", "endpoint", F.lit((1 << 60) + 1).alias("at"),
            F.lit("tls observed but certificate not extracted").alias("issue"))
    return own.unionByName(whole).unionByName(quiet).unionByName(bare)


def tls_counts(fr: DataFrame, keys: list[str] = ("flow_key",)) -> DataFrame:
    """Handshake, alert, certificate and transport counters over header rows.

    Any text counts, "0" too.
    """
    def has(*names: str) -> Column:
        return reduce(lambda a, b: a | b, [filled(field(n)) for n in names])

    def certificates(prefix: str) -> Column:
        value = field(f"{prefix}.handshake.certificate")
        return F.when(filled(value), F.size(F.split(value, r"\|"))).otherwise(0)

    counters = {
        "tls_packets": has("tls.record.content_type", "tls.handshake.type"),
        "dtls_packets": has("dtls.record.content_type", "dtls.handshake.type"),
        "tls_handshake_packets": has("tls.handshake.type"),
        "dtls_handshake_packets": has("dtls.handshake.type"),
        "tls_alert_packets": has("tls.alert_message.level", "tls.alert_message.desc"),
        "dtls_alert_packets": has("dtls.alert_message.level", "dtls.alert_message.desc"),
        "tcp_transport_packets": has("tcp.srcport", "tcp.dstport"),
        "udp_transport_packets": has("udp.srcport", "udp.dstport"),
        "tcp_loss_or_retransmission_packets": has("tcp.analysis.lost_segment",
                                                  "tcp.analysis.retransmission"),
        "algorithm_field_packets": has(*[f"{p}.{n}" for p in ("tls", "dtls") for n in ALGORITHMS]),
    }
    return fr.groupBy(*keys).agg(
        *[F.count_if(test).alias(name) for name, test in counters.items()],
        F.sum(certificates("tls") + certificates("dtls")).alias("tls_certificate_fields"))
