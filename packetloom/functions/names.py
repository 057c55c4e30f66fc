"""Names of protocol codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from packetloom.functions.parse import filled

# SMB1 commands by code.
SMB1_COMMANDS = {
    0: "SMBmkdir", 1: "SMBrmdir", 2: "SMBopen", 3: "SMBcreate", 4: "SMBclose", 5: "SMBflush",
    6: "SMBunlink", 7: "SMBmv", 8: "SMBgetatr", 9: "SMBsetatr", 10: "SMBread", 11: "SMBwrite",
    12: "SMBlock", 13: "SMBunlock", 14: "SMBctemp", 15: "SMBmknew", 16: "SMBchkpth",
    17: "SMBexit", 18: "SMBlseek", 19: "SMBlockread", 20: "SMBwriteunlock", 37: "SMBtrans",
    45: "SMBopenX", 46: "SMBreadX", 47: "SMBwriteX", 50: "SMBtrans2", 114: "SMBnegprot",
    115: "SMBsesssetupX", 117: "SMBtconX", 162: "SMBntcreateX",
}
# SMB2 commands in code order from 0.
SMB2_COMMANDS = [
    "SMB2negprot", "SMB2sesssetup", "SMB2logoff", "SMB2tcon", "SMB2tdis", "SMB2create",
    "SMB2close", "SMB2flush", "SMB2read", "SMB2write", "SMB2lock", "SMB2ioctl", "SMB2cancel",
    "SMB2echo", "SMB2querydir", "SMB2changenotify", "SMB2queryinfo", "SMB2setinfo",
    "SMB2oplockbreak",
]
# NT status codes.
NT_STATUSES = {
    "0": "STATUS_SUCCESS",
    "0x00000000": "STATUS_SUCCESS",
    "0x00000103": "STATUS_PENDING",
    "0x0000010b": "STATUS_NOTIFY_CLEANUP",
    "0x0000010c": "STATUS_NOTIFY_ENUM_DIR",
    "0x4000000f": "STATUS_BUFFER_OVERFLOW",
    "0x80000005": "STATUS_BUFFER_OVERFLOW",
    "0x80000006": "STATUS_NO_MORE_FILES",
    "0x8000000d": "STATUS_PARTIAL_COPY",
    "0xc0000001": "STATUS_UNSUCCESSFUL",
    "0xc0000002": "STATUS_NOT_IMPLEMENTED",
    "0xc0000008": "STATUS_INVALID_HANDLE",
    "0xc000000d": "STATUS_INVALID_PARAMETER",
    "0xc0000010": "STATUS_INVALID_DEVICE_REQUEST",
    "0xc0000011": "STATUS_END_OF_FILE",
    "0xc0000022": "STATUS_ACCESS_DENIED",
    "0xc0000034": "STATUS_OBJECT_NAME_NOT_FOUND",
    "0xc0000035": "STATUS_OBJECT_NAME_COLLISION",
    "0xc000003a": "STATUS_OBJECT_PATH_NOT_FOUND",
    "0xc0000043": "STATUS_SHARING_VIOLATION",
    "0xc0000054": "STATUS_FILE_LOCK_CONFLICT",
    "0xc000006d": "STATUS_LOGON_FAILURE",
    "0xc00000bb": "STATUS_NOT_SUPPORTED",
    "0xc00000cc": "STATUS_BAD_NETWORK_NAME",
    "0xc00000d0": "STATUS_REQUEST_NOT_ACCEPTED",
    "0xc00000e5": "STATUS_INTERNAL_ERROR",
    "0xc0000120": "STATUS_CANCELLED",
    "0xc0000205": "STATUS_INSUFF_SERVER_RESOURCES",
    "0xc0000225": "STATUS_NOT_FOUND",
    "0xc0000234": "STATUS_ACCOUNT_LOCKED_OUT",
    "0xc0000257": "STATUS_PATH_NOT_COVERED",
    "0xc000035c": "STATUS_NETWORK_SESSION_EXPIRED",
}
# TLS alert levels and descriptions.
TLS_ALERT_LEVELS = {1: "warning", 2: "fatal"}
TLS_ALERT_DESCRIPTIONS = {
    0: "close_notify", 10: "unexpected_message", 20: "bad_record_mac",
    21: "decryption_failed_RESERVED", 22: "record_overflow", 30: "decompression_failure",
    40: "handshake_failure", 41: "no_certificate_RESERVED", 42: "bad_certificate",
    43: "unsupported_certificate", 44: "certificate_revoked", 45: "certificate_expired",
    46: "certificate_unknown", 47: "illegal_parameter", 48: "unknown_ca", 49: "access_denied",
    50: "decode_error", 51: "decrypt_error", 60: "export_restriction_RESERVED",
    70: "protocol_version", 71: "insufficient_security", 80: "internal_error",
    86: "inappropriate_fallback", 90: "user_canceled", 100: "no_renegotiation",
    109: "missing_extension", 110: "unsupported_extension",
    111: "certificate_unobtainable_RESERVED", 112: "unrecognized_name",
    113: "bad_certificate_status_response", 114: "bad_certificate_hash_value_RESERVED",
    115: "unknown_psk_identity", 116: "certificate_required", 120: "no_application_protocol",
}
# IKE exchanges and notifications by (major version, code).
IKE_EXCHANGES = {
    1: {1: "Base", 2: "Main Mode", 4: "Aggressive Mode", 5: "Informational", 6: "Transaction",
        32: "Quick Mode", 33: "New Group Mode"},
    2: {34: "IKE_SA_INIT", 35: "IKE_AUTH", 36: "CREATE_CHILD_SA", 37: "INFORMATIONAL",
        43: "IKE_INTERMEDIATE"},
}
IKE_NOTIFICATIONS = {
    1: {14: "NO-PROPOSAL-CHOSEN", 24: "AUTHENTICATION-FAILED", 36136: "R-U-THERE",
        36137: "R-U-THERE-ACK"},
    2: {14: "NO_PROPOSAL_CHOSEN", 17: "INVALID_KE_PAYLOAD", 24: "AUTHENTICATION_FAILED",
        38: "TS_UNACCEPTABLE", 16388: "NAT_DETECTION_SOURCE_IP",
        16389: "NAT_DETECTION_DESTINATION_IP", 16390: "COOKIE",
        16430: "IKEV2_FRAGMENTATION_SUPPORTED"},
}
# SMB2 capability bits, lowest first.
SMB2_CAPABILITY_BITS = [
    "DFS", "leasing", "large MTU", "multi-channel", "persistent handles", "directory leasing",
    "encryption", "notifications",
]
# DNS response codes with the words that also name them.
DNS_EXPLANATIONS = [
    ("nxdomain", "3", "NXDOMAIN: queried name does not exist"),
    ("servfail", "2", "SERVFAIL: DNS server failed to answer"),
    ("refused", "5", "REFUSED: DNS server refused the query"),
    ("notimp", "4", "NOTIMP: DNS server does not support the requested operation"),
    ("formerr", "1", "FORMERR: DNS server could not understand the query"),
]

# SMB codes appear as decimal text or as hexadecimal text of a fixed width.
SMB1_NAMES = {t: n for c, n in SMB1_COMMANDS.items() for t in (str(c), f"0x{c:02x}")}
SMB2_NAMES = {t: n for c, n in enumerate(SMB2_COMMANDS) for t in (str(c), f"0x{c:04x}")}


def _table(names: dict) -> Column:
    return F.expr("map(" + ", ".join(f"{key!r}, {name!r}" for key, name in names.items()) + ")")


def _lookup(names: dict, key: Column) -> Column:
    return F.try_element_at(_table(names), key)


def smb_name(code: Column, names: dict[str, str]) -> Column:
    return _lookup(names, F.lower(code))


def smb_command(code: Column, smb2: bool) -> Column:
    """SMB2 commands are stored by name, SMB1 commands keep their code."""
    return F.coalesce(smb_name(code, SMB2_NAMES), code) if smb2 else code


def smb1_label(command: Column) -> Column:
    return F.coalesce(smb_name(command, SMB1_NAMES), command)


def smb_command_text(command: Column) -> Column:
    name = smb_name(command, SMB1_NAMES)
    return F.when(name.isNotNull(), F.concat(name, F.lit("("), command, F.lit(")"))).otherwise(
        command)


def smb_status_text(status: Column) -> Column:
    shown = F.trim(F.get(F.split(status, r"\("), F.lit(0)))
    return F.when(F.upper(shown).startswith("STATUS_"), shown).otherwise(F.coalesce(
        smb_name(status, NT_STATUSES),
        F.when(F.lower(status).rlike("^0x[0-9a-f]+$"),
               F.concat(F.lit("NTSTATUS_UNKNOWN("), status, F.lit(")"))),
        status))


def smb_failed(status: Column) -> Column:
    # The texts of a successful status.
    return F.coalesce(filled(status) & ~F.upper(status).isin(
        "0", "0X00000000", "STATUS_SUCCESS", "SUCCESS"), F.lit(False))


def _alert_part(value: Column, names: dict[int, str]) -> Column:
    digits = F.regexp_extract(value, r"(\d+)", 1)
    code = digits.try_cast("int")
    named = F.coalesce(_lookup(names, code), F.concat(F.lit("unknown_alert_"), code.cast("string")))
    return F.when(filled(value), F.when(digits == "", value).otherwise(
        F.concat(named, F.lit(" ("), code.cast("string"), F.lit(")"))))


def tls_alert_label(level: Column, description: Column) -> Column:
    text = F.concat_ws(" ", _alert_part(level, TLS_ALERT_LEVELS),
                       _alert_part(description, TLS_ALERT_DESCRIPTIONS))
    return F.when(text == "", F.lit("alert")).otherwise(text)


def _versioned(tables: dict[int, dict[int, str]], major: Column, code: Column) -> Column:
    key = code.cast("int")
    name = F.when(major == 1, _lookup(tables[1], key)).otherwise(_lookup(tables[2], key))
    return F.concat(F.coalesce(code.cast("string"), F.lit("None")), F.lit(": "),
                    F.coalesce(name, F.lit("Unknown")))


def ike_exchange(major: Column, code: Column) -> Column:
    return _versioned(IKE_EXCHANGES, major, code)


def ike_notification(major: Column, code: Column) -> Column:
    return _versioned(IKE_NOTIFICATIONS, major, code)


def smb_mask_labels(mask: Column) -> Column:
    return F.array_compact(F.array(*[
        F.when(mask.bitwiseAND(F.lit(1 << bit)) != 0, F.lit(name))
        for bit, name in enumerate(SMB2_CAPABILITY_BITS)]))


def dns_success(code: Column) -> Column:
    text = F.lower(code)
    return text.isin("0", "noerror", "no error") | text.startswith("0 ")


def dns_explain(code: Column) -> Column:
    text = F.lower(code)
    result = F
    for word, digit, explanation in DNS_EXPLANATIONS:
        result = result.when(text.contains(word) | text.startswith(digit), F.lit(explanation))
    return result.otherwise(F.concat(F.lit("DNS error response: "), code))


def sip_status(code: Column, reason: Column) -> Column:
    return F.when(code.isNotNull(), F.concat_ws(
        " ", code.cast("string"), F.nullif(reason, F.lit(""))))


def sip_class(code: Column) -> Column:
    return (F.when(code.between(400, 499), "client failure response")
            .when(code.between(500, 599), "server failure response")
            .when(code.between(600, 699), "global failure response"))


def smb_create_intents(access: Column, attributes: Column) -> Column:
    directory = F.coalesce(attributes.bitwiseAND(F.lit(0x10)) != 0, F.lit(False))
    usable = access.isNotNull() & ~directory
    return F.array_compact(F.array(
        F.when(usable & (access.bitwiseAND(F.lit(1)) != 0), F.lit("read")),
        F.when(usable & (access.bitwiseAND(F.lit(6)) != 0), F.lit("write"))))
