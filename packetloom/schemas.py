"""Fixed schemas: packet observations, saved flow summaries and header rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CERTIFICATE = (
    "struct<presenter_ip:string,presenter_port:int,presenter_role:string,subject:string,"
    "subject_cn:string,issuer:string,issuer_cn:string,serial:string,not_before:string,"
    "not_after:string,san_dns:array<string>,fingerprint_sha256:string>"
)
IKE = (
    "struct<version:int,initiator_spi:string,responder_spi:string,exchange_type:bigint,"
    "message_id:bigint,flags:bigint,next_payload:bigint,length:bigint,notify_types:array<bigint>,"
    "fragment_number:bigint,fragment_total:bigint,fragment_id:bigint,fragment_last:bigint,"
    "proposal_fields:map<string,array<string>>>"
)
FIELD_MAP = "map<string,array<string>>"

PACKET_COLUMNS: dict[str, str] = {
    "src_mac": "string", "dst_mac": "string", "link_type": "string", "vlan_ids": "array<int>",
    "macsec_fields": FIELD_MAP, "eapol_fields": FIELD_MAP,
    "decoded_protocols": "array<string>", "bgp_fields": FIELD_MAP, "ike": IKE,
    "timestamp": "timestamp_ntz", "frame_number": "bigint", "timestamp_epoch": "string",
    "time_relative": "string", "src_ip": "string", "dst_ip": "string", "src_port": "int",
    "dst_port": "int", "protocol": "string", "length": "bigint", "rtt_seconds": "double",
    "initial_rtt_seconds": "double", "issue_tags": "array<string>",
    "rtp_ssrc": "string", "rtp_sequence": "bigint", "rtp_timestamp": "bigint",
    "rtp_payload_type": "bigint", "rtp_marker": "int", "srtp": "boolean",
    "esp_spi": "string", "esp_sequence": "bigint",
    "dns_query": "string", "dns_query_type": "string", "dns_response_code": "string",
    "dns_answers": "array<string>",
    "dhcp_message_type": "string", "dhcp_transaction_id": "string", "dhcp_client_mac": "string",
    "dhcp_hostname": "string", "dhcp_requested_ip": "string", "dhcp_your_ip": "string",
    "dhcp_server_id": "string", "dhcp_lease_time": "string",
    "http_host": "string", "http_location": "string",
    "tls_sni": "string", "tls_alert_level": "string", "tls_alert_description": "string",
    "tls_certificates": f"array<{CERTIFICATE}>",
    "sip_call_id": "string", "sip_method": "string", "sip_status_code": "int",
    "sip_reason": "string", "sip_from": "string", "sip_to": "string",
    "smb_command": "string", "smb_commands_seen": "array<string>", "smb_status": "string",
    "smb_message_id": "string", "smb_is_response": "boolean", "smb_session_id": "string",
    "smb_tree_id": "string", "smb_file_id": "string", "smb_filename": "string",
    "smb_create_desired_access": "bigint", "smb_create_file_attributes": "bigint",
    "smb_read_length": "bigint", "smb_write_length": "bigint", "smb_file_offset": "bigint",
    "smb_encrypted": "boolean", "smb_capabilities": "array<string>",
}
PACKETS = ", ".join(f"{n} {t}" for n, t in PACKET_COLUMNS.items())


def conform(df: DataFrame) -> DataFrame:
    """Every packet column in its type; measurements that are not there stay null."""
    present = set(df.columns)
    extra = [c for c in df.columns if c not in PACKET_COLUMNS]
    return df.select(
        *[(F.col(n) if n in present else F.lit(None)).cast(t).alias(n)
          for n, t in PACKET_COLUMNS.items()], *extra)


def field(name: str) -> Column:
    """A header field column by its dissector name, dots included."""
    return F.col(f"`{name}`")
