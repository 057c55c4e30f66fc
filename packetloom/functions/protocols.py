"""Protocol names of packets and flows, apart from the transport a flow is keyed by."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from packetloom.functions.parse import filled, has_items

# Other names of a protocol, and the protocol a more specific one belongs to.
ALIASES = {"ISAKMP": "IKE", "IPV4": "IP", "ICMP6": "ICMPV6", "BOOTP": "DHCP", "SSL": "TLS"}
BELONGS_TO = {"IKEV1": "IKE", "IKEV2": "IKE", "SRTP": "RTP", "MKA": "EAPOL", "SMB2": "SMB"}

# Names with a bit of their own in a protocol mask; all others are kept as texts beside it.
KNOWN = (
    "ARP AH BGP DATA DHCP DHCPV6 DNS DTLS EAP EAPOL ESP ETH FRAME HTTP HTTP2 ICMP ICMPV6 IGMP IKE IKEV1 IKEV2 IP "
    "IPV6 LLC MACSEC MKA NBNS NBSS NTP QUIC RTCP RTP SCTP SDP SIP SMB SMB2 SRTP SSH TCP TLS UDP UNKNOWN VLAN X509AF"
).split()
BITS = {name: 1 << k for k, name in enumerate(KNOWN)}


def mask_of(*names: str) -> int:
    """Bits of canonical names and of the protocols they belong to."""
    mask = 0
    for name in names:
        mask |= BITS[name] | BITS.get(BELONGS_TO.get(name, ""), 0)
    return mask


#: The mask of every spelling of a known name.
MASKS = {name: mask_of(name) for name in KNOWN} | {alias: mask_of(name) for alias, name in ALIASES.items()}


def _masks() -> Column:
    return F.create_map(*[F.lit(x) for name, mask in MASKS.items() for x in (name, mask)])


def known_mask(names: Column) -> Column:
    """Bits of the known names of an array, however they are spelled."""
    nothing = F.lit(0).cast("bigint")
    return F.aggregate(names, nothing, lambda mask, name: mask.bitwiseOR(
        F.coalesce(F.try_element_at(_masks(), F.upper(F.trim(name))).cast("bigint"), nothing)))


def other_names(names: Column) -> Column:
    """The names of an array that have no bit."""
    standard = F.transform(F.filter(names, lambda n: filled(n)), lambda n: F.upper(F.trim(n)))
    return F.array_sort(F.array_distinct(F.filter(standard, lambda n: F.try_element_at(_masks(), n).isNull())))


def names_of(mask: Column, others: Column) -> Column:
    """Sorted names of a mask and of the texts beside it."""
    known = F.array_compact(F.array(*[
        F.when(mask.bitwiseAND(F.lit(bit)) != 0, F.lit(name)) for name, bit in BITS.items()]))
    return F.array_sort(F.array_distinct(F.concat(known, others)))


def canonical(name: Column) -> Column:
    text = F.upper(F.trim(name))
    result = F
    for alias, standard in ALIASES.items():
        result = result.when(text == alias, F.lit(standard))
    return result.otherwise(text)


def canonical_text(name: str) -> str:
    text = name.strip().upper()
    return ALIASES.get(text, text)


def _parents(names: Column) -> Column:
    return F.array_compact(F.array(*[
        F.when(F.array_contains(names, child), F.lit(parent))
        for child, parent in BELONGS_TO.items()]))


def expanded(names: Column) -> Column:
    standard = F.transform(F.filter(names, lambda n: filled(n)), canonical)
    return F.array_sort(F.array_distinct(F.concat(standard, _parents(standard))))


def _secure_transport(protocol: Column) -> Column:
    return F.when(protocol == "UDP", F.lit("DTLS")).otherwise(F.lit("TLS"))


def _any(*tests: Column) -> Column:
    result = tests[0]
    for test in tests[1:]:
        result = result | test
    return result


def _true(flag: Column) -> Column:
    return F.coalesce(flag, F.lit(False))


def layer_names() -> Column:
    """Transport and layers of a packet as decoded."""
    return F.concat(F.array(F.col("protocol")),
                    F.coalesce(F.col("decoded_protocols"), F.array().cast("array<string>")))


def field_evidence() -> list[tuple[Column, Column]]:
    """(test, name) of the protocols that populated fields show, whatever the layers say."""
    c = F.col
    mka = F.exists(F.map_keys(c("eapol_fields")), lambda k: k.startswith("mka."))
    eap = F.exists(F.map_keys(c("eapol_fields")), lambda k: k.startswith("eap."))
    ike = c("ike").isNotNull()
    media = c("rtp_ssrc").isNotNull() | _true(c("srtp"))
    return [
        (has_items(c("macsec_fields")), F.lit("MACSEC")),
        (has_items(c("eapol_fields")), F.lit("EAPOL")),
        (_true(mka), F.lit("MKA")),
        (_true(eap), F.lit("EAP")),
        (has_items(c("bgp_fields")), F.lit("BGP")),
        (ike, F.lit("IKE")),
        (ike, F.concat(F.lit("IKEV"), F.shiftright(c("ike.version"), 4).cast("string"))),
        (media, F.lit("RTP")),
        (_true(c("srtp")), F.lit("SRTP")),
        (_any(filled(c("dns_query")), filled(c("dns_response_code")), has_items(c("dns_answers"))),
         F.lit("DNS")),
        (_any(filled(c("dhcp_message_type")), filled(c("dhcp_transaction_id"))), F.lit("DHCP")),
        (_any(filled(c("sip_call_id")), filled(c("sip_method")), _true(c("sip_status_code") != 0)),
         F.lit("SIP")),
        (_any(filled(c("smb_command")), has_items(c("smb_commands_seen")), filled(c("smb_status")),
              _true(c("smb_encrypted"))), F.lit("SMB")),
        (_any(filled(c("tls_sni")), filled(c("tls_alert_level")), filled(c("tls_alert_description")),
              has_items(c("tls_certificates"))), _secure_transport(c("protocol"))),
        (_any(filled(c("http_host")), filled(c("http_location"))), F.lit("HTTP")),
    ]


def field_names() -> Column:
    return F.array_compact(F.array(*[F.when(test, name) for test, name in field_evidence()]))


def packet_protocols() -> Column:
    """Sorted protocol names of a packet, from its layers and from its populated fields."""
    return F.array_sort(F.array_distinct(F.concat(expanded(layer_names()), field_names())))


def shows_any(wanted: list[str]) -> Column:
    """Whether a packet shows one of the canonical names, without building its list of names."""
    def spellings(name: str) -> set[str]:
        own = {name, *[alias for alias, standard in ALIASES.items() if standard == name]} - set(ALIASES)
        return own | {alias for alias, standard in ALIASES.items() if standard == name}

    names = {w for name in wanted for w in (name, *[c for c, p in BELONGS_TO.items() if p == name])}
    texts = sorted({t for name in names for t in spellings(name)})
    in_layers = F.exists(layer_names(), lambda n: F.upper(F.trim(n)).isin(texts))
    in_fields = [test & name.isin(wanted) for test, name in field_evidence()]
    return _any(_true(in_layers), *[_true(t) for t in in_fields])
