"""Packets related by a call, a redirect, or an address."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.functions.parse import filled
from packetloom.operators.filters import digits

IPV4_TEXT = r"\b((?:\d{1,3}\.){3}\d{1,3})\b"
OCTET = r"(?:0|[1-9]\d?|1\d\d|2[0-4]\d|25[0-5])"
IPV4 = rf"^{OCTET}(?:\.{OCTET}){{3}}$"


def calls_by_phone(pk: DataFrame, number: str) -> DataFrame:
    """Every packet of the calls whose caller or callee carries the digits.

    Packets outside any call match on their own fields. No digits keep everything.
    """
    wanted = re.sub(r"\D", "", number)
    if not wanted:
        return pk
    named = (digits(F.col("sip_from")).contains(wanted) | digits(F.col("sip_to")).contains(wanted))
    in_call = filled(F.col("sip_call_id"))
    calls = pk.where(in_call & named).select("sip_call_id").distinct()
    return pk.where(in_call).join(calls, "sip_call_id", "left_semi").select(*pk.columns).unionByName(
        pk.where(~in_call & named))


def url_host(url: Column) -> Column:
    """The host of a URL with an authority, lower-cased, without user, port and brackets.

    Found by pattern, as names that no strict URI allows occur in redirects.
    """
    authority = F.regexp_extract(url, r"^\s*(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1)
    place = F.regexp_replace(authority, r"^.*@", "")
    host = F.when(place.startswith("["), F.regexp_extract(place, r"^\[([^\]]*)\]", 1)).otherwise(
        F.regexp_extract(place, r"^([^:]*)", 1))
    return F.nullif(F.lower(F.trim(host)), F.lit(""))


def is_ip(text: Column) -> Column:
    """Dotted quad, or hexadecimal groups with colons."""
    return text.rlike(IPV4) | (text.rlike("^[0-9a-f:.]+$") & text.rlike(":.*:"))


def plain_name(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, r"\.+$", ""))


def redirect_targets(pk: DataFrame, seed: DataFrame) -> DataFrame:
    """(kind, value) of the hosts a seed redirects to and of the addresses they resolve to."""
    hosts = seed.where(filled(F.col("http_location"))).select(
        url_host(F.col("http_location")).alias("value")).where("value IS NOT NULL").distinct()
    answers = pk.where(filled(F.col("dns_query"))).select(
        plain_name(F.col("dns_query")).alias("value"), F.explode("dns_answers").alias("answer")
    ).join(hosts, "value", "left_semi").select(F.col("answer").alias("value"))
    addresses = answers.unionByName(hosts.where(is_ip(F.col("value")))).distinct()
    return hosts.select(F.lit("name").alias("kind"), "value").unionByName(
        addresses.select(F.lit("address").alias("kind"), "value"))


def with_redirects(pk: DataFrame, seed: DataFrame) -> DataFrame:
    """Seed packets and every packet that names or addresses a redirect target, each once.

    Packets are matched by narrow (frame, value) rows, so only frame numbers cross the joins.
    """
    targets = redirect_targets(pk, seed)

    def entry(kind: str, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), value.alias("value"))

    marks = pk.select("frame_number", F.inline(F.array(
        *[entry("name", plain_name(F.col(n))) for n in ("dns_query", "http_host", "tls_sni")],
        entry("address", F.col("src_ip")), entry("address", F.col("dst_ip")),
    ))).where(F.col("value").isNotNull())
    related = marks.join(targets, ["kind", "value"], "left_semi").select("frame_number")
    return seed_or_related(pk, seed.select("frame_number"), related)


def seed_or_related(pk: DataFrame, seed: DataFrame, related: DataFrame) -> DataFrame:
    """Packets whose frame is in either set; capture order is the frame number."""
    frames = seed.select("frame_number").unionByName(related.select("frame_number")).distinct()
    return pk.join(frames, "frame_number", "left_semi")


def ipv4_mentions(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Distinct valid dotted quads mentioned in each text."""
    found = F.regexp_extract_all(F.col(text), F.lit(IPV4_TEXT), F.lit(1))
    return texts.select(key, F.explode(F.array_distinct(found)).alias("address")).where(
        F.col("address").rlike(IPV4))


def observed_addresses(pk: DataFrame) -> DataFrame:
    """Every address packets show: endpoints, DNS answers, DHCP offers and requests, hosts of redirects."""
    host = url_host(F.col("http_location"))
    shown = F.array("src_ip", "dst_ip", "dhcp_your_ip", "dhcp_requested_ip", "dhcp_server_id", "http_host", host)
    return pk.select(F.explode(F.concat(shown, F.coalesce(
        "dns_answers", F.array().cast("array<string>")))).alias("address")).where(
            is_ip(F.col("address"))).distinct()


def unverified_addresses(texts: DataFrame, key: str, text: str, inventory: DataFrame) -> DataFrame:
    """Mentions that occur nowhere in the inventory of observed addresses (column `address`)."""
    return ipv4_mentions(texts, key, text).join(
        inventory.select("address").distinct(), "address", "left_anti").select(key, "address")
