"""SMB commands, file names, transfers and credits per flow."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.functions.names import (
    SMB2_NAMES, smb1_label, smb_create_intents, smb_failed, smb_mask_labels, smb_name)
from packetloom.functions.parse import filled, first_filled, first_row_int, marked, safe_int
from packetloom.operators.ordered import ordered_distinct, place_in_packet, scan
from packetloom.protocols.dhcp import first_distinct
from packetloom.schemas import field
from packetloom.settings import settle

LARGE_FILE_BYTES = 1 << 20
LARGE_FILES = 10
SERVER_PORTS = [139, 445]
UNKNOWN_FILE = "<unknown>"
LISTS = {"session_ids": "smb_session_id", "tree_ids": "smb_tree_id", "filenames": "smb_filename"}
# Exported header fields of the tool.
FIELDS = [
    "frame.number", "frame.time_relative", "frame.time_epoch", "ip.src", "ipv6.src", "ip.dst",
    "ipv6.dst", "tcp.srcport", "tcp.dstport", "tcp.seq", "tcp.ack", "tcp.len",
    "tcp.analysis.retransmission", "tcp.analysis.lost_segment", "tcp.analysis.out_of_order",
    "tcp.analysis.zero_window", "smb2.cmd", "smb2.flags.response", "smb2.msg_id", "smb2.sesid",
    "smb2.session_id", "smb2.tid", "smb2.nt_status", "smb2.credit.charge",
    "smb2.credit.request_response", "smb2.credits.requested", "smb2.credits.granted",
    "smb2.read_length", "smb2.read.length", "smb2.write_length", "smb2.write.count",
    "smb2.write.length", "smb2.data_length", "smb2.data_offset", "smb2.file_offset",
    "smb2.offset", "smb2.file_id", "smb2.filename",
]
# Header fields of a transfer length, of an offset, and of the encrypted transform.
SHARED_LENGTH_FIELDS = ["data_length", "data_len", "data_len_low", "data_size", "file_rw_length",
                        "count", "count_low", "dc", "tdc", "bcc"]
LENGTH_FIELDS = {
    "read": ["read_length", "read_count", "read_data_len", "read_data_length",
             *SHARED_LENGTH_FIELDS],
    "write": ["write_length", "write_count", "write_data_len", "write_data_length",
              *SHARED_LENGTH_FIELDS],
}
OFFSET_FIELDS = ["file_offset", "file_rw_offset", "offset", "offset_low"]
TRANSFORM_FIELDS = ["transform_header", "transform_session_id", "transform_signature",
                    "transform_nonce", "transform_original_message_size"]
# Capability flags of each version with the name they are listed by.
CAPABILITY_FLAGS = {
    "smb2": [
        ("capabilities_dfs", "DFS"), ("capabilities_leasing", "leasing"),
        ("capabilities_large_mtu", "large MTU"), ("capabilities_multi_channel", "multi-channel"),
        ("capabilities_persistent_handles", "persistent handles"),
        ("capabilities_directory_leasing", "directory leasing"),
        ("capabilities_encryption", "encryption"),
        ("capabilities_notifications", "notifications"),
        ("sec_mode_sign_enabled", "signing enabled"),
        ("sec_mode_sign_required", "signing required"),
        ("ses_flags_encrypt", "session encryption"),
        ("share_flags_encrypt_data", "share encryption required"),
        ("share_flags_compress_data", "compressed IO"),
    ],
    "smb": [
        ("server_cap_large_readx", "large ReadX"), ("server_cap_large_writex", "large WriteX"),
        ("flags2_compressed", "compression requested"),
        ("unix_capability_large_read", "unix large read"),
        ("unix_capability_large_write", "unix large write"),
        ("unix_capability_encryption", "unix encryption"),
        ("unix_capability_mandatory_crypto", "unix mandatory encryption"),
    ],
}
ENCRYPTION_FIELDS = ["encryption_capabilities", "encryption_capabilities_ciphers",
                     "encryption_context", "negotiate_context_encryption_capabilities",
                     "neg_context_encryption_capabilities"]


# --- header fields of one packet, given as a map of short name → text -------------------------

def _read(fields: Column, name: str) -> Column:
    return F.nullif(F.try_element_at(fields, F.lit(name)), F.lit(""))


def _wide(fields: Column, names: list[str]) -> Column:
    """First field that is a number, with its high word where one is given."""
    def words(name: Column) -> Column:
        high = F.concat(F.regexp_replace(name, "_low$", ""), F.lit("_high"))
        return F.struct(safe_int(F.try_element_at(fields, name)).alias("low"),
                        F.coalesce(safe_int(F.try_element_at(fields, high)), F.lit(0)).alias("high"))

    numbers = F.filter(F.transform(F.array(*[F.lit(n) for n in names]), words),
                       lambda w: w["low"].isNotNull())
    first = F.get(numbers, F.lit(0))
    return first["low"] + F.shiftleft(first["high"], 32)


def smb_length(fields: Column, kind: str) -> Column:
    return _wide(fields, LENGTH_FIELDS[kind])


def smb_offset(fields: Column) -> Column:
    return _wide(fields, OFFSET_FIELDS)


def smb_encrypted(smb2_fields: Column) -> Column:
    """Any transform header field of the SMB2 layer that is set."""
    transform = F.map_filter(smb2_fields, lambda k, v: F.lower(k).contains("transform") & marked(v))
    return F.coalesce(F.size(F.map_keys(transform)) > 0, F.lit(False))


def smb_capabilities(smb2_fields: Column, smb_fields: Column) -> Column:
    """Capability names of a packet from flags, masks, dialect and security mode, each once."""
    def flags(fields: Column, version: str) -> list[Column]:
        return [F.when(marked(_read(fields, name)), F.lit(label))
                for name, label in CAPABILITY_FLAGS[version]]

    empty = F.array().cast("array<string>")

    def mask(name: str) -> Column:
        return F.coalesce(smb_mask_labels(safe_int(_read(smb2_fields, name))), empty)

    offered = reduce(lambda a, b: a | b, [marked(_read(smb2_fields, n)) for n in ENCRYPTION_FIELDS])
    negotiated = F.coalesce(F.size(F.map_keys(F.map_filter(smb2_fields, lambda k, v: (
        F.concat(F.lower(k), F.lit(" "), F.lower(v)).contains("encryption")
        & F.concat(F.lower(k), F.lit(" "), F.lower(v)).rlike("capabil|cipher"))))) > 0,
        F.lit(False))
    dialect = F.coalesce(_read(smb2_fields, "dialect"), _read(smb_fields, "dialect"),
                         _read(smb2_fields, "dialect_name"), _read(smb_fields, "dialect_name"))
    security = F.coalesce(_read(smb2_fields, "sec_mode"), _read(smb_fields, "sec_mode"),
                          _read(smb2_fields, "sm"), _read(smb_fields, "sm"))
    return F.array_distinct(F.concat(
        F.array_compact(F.array(*flags(smb2_fields, "smb2"))), mask("capabilities"),
        mask("server_cap"),
        F.array_compact(F.array(F.when(offered | negotiated, F.lit("encryption")),
                                *flags(smb_fields, "smb"),
                                F.concat(F.lit("dialect="), dialect),
                                F.concat(F.lit("security_mode="), security)))))


# --- commands, statuses, lists ----------------------------------------------------------------

def packet_commands() -> Column:
    """Distinct commands of a packet: the ones seen, else its single command."""
    seen = F.filter(F.coalesce(F.col("smb_commands_seen"), F.array().cast("array<string>")),
                    lambda c: filled(c))
    single = F.array_compact(F.array(F.nullif(F.col("smb_command"), F.lit(""))))
    return F.array_distinct(F.when(F.size(F.coalesce(
        F.col("smb_commands_seen"), F.array().cast("array<string>"))) > 0, seen).otherwise(single))


def _labels() -> Column:
    return F.lower(F.array_join(F.transform(packet_commands(), smb1_label), " "))


def smb_counts(pk: DataFrame) -> DataFrame:
    """(flow, kind, value, n): commands and statuses."""
    empty = F.array().cast("array<string>")
    status = F.array_compact(F.array(F.nullif(F.col("smb_status"), F.lit(""))))
    entries = F.concat(
        F.transform(packet_commands(), lambda v: F.struct(F.lit("command").alias("kind"),
                                                          v.alias("value"))),
        F.transform(F.coalesce(status, empty), lambda v: F.struct(
            F.lit("status").alias("kind"), v.alias("value"))))
    return pk.select("flow_key", "frame_number", F.inline(entries)).groupBy(
        "flow_key", "kind", "value").agg(
            F.count(F.lit(1)).alias("n"), F.min("frame_number").alias("first_at"))


def smb_lists(pk: DataFrame, cap: int | None = None) -> DataFrame:
    """Session ids, tree ids and file names of a flow; `cap` keeps the first ones."""
    return first_distinct(pk, ["flow_key"], LISTS, cap)


def smb_summary(pk: DataFrame, cap: int | None = None) -> DataFrame:
    """Totals and lists per flow; lists are whole unless `cap` keeps the first values."""
    counts = smb_counts(pk).groupBy("flow_key").agg(
        F.coalesce(F.sum(F.when(F.col("kind") == "command", F.col("n"))), F.lit(0)).alias("commands"),
        F.coalesce(F.sum(F.when(F.col("kind") == "status", F.col("n"))), F.lit(0)).alias("statuses"))
    flags = pk.groupBy("flow_key").agg(
        F.count_if("smb_encrypted").alias("encrypted_packets"),
        F.count_if(smb_failed(F.col("smb_status"))).alias("errors"))
    entry = F.struct("position", "value")
    kept = F.lit(True) if cap is None else F.col("position") <= cap
    lists = smb_lists(pk).groupBy("flow_key").agg(
        *[F.transform(F.array_sort(F.collect_list(F.when((F.col("list") == name) & kept, entry))),
                      lambda e: e["value"]).alias(name) for name in LISTS],
        *[F.count_if(F.col("list") == name).alias(f"n_{name}") for name in LISTS])
    return counts.join(flags, "flow_key").join(lists, "flow_key", "left")


def smb_capability_sides(pk: DataFrame, cap: int | None = None) -> DataFrame:
    """Capabilities each side of a flow announced; the side with a server port serves."""
    side = F.when(F.col("src_port").isin(SERVER_PORTS), "server").otherwise("client")
    listed = pk.select("flow_key", side.alias("side"), "frame_number",
                       F.posexplode("smb_capabilities").alias("slot", "capability"))
    return ordered_distinct(
        listed.withColumn("at", place_in_packet(F.col("slot"))),
        ["flow_key", "side"], "capability", "at", cap).select(
            "flow_key", "side", "capability", "position")


# --- file names and transfers -----------------------------------------------------------------

def _smb_rows(pk: DataFrame) -> DataFrame:
    c = F.col
    commands = F.size(packet_commands())
    return pk.where((commands > 0) | filled(c("smb_status")) | filled(c("smb_filename"))
                    | filled(c("smb_file_id")) | c("smb_is_response").isNotNull()).select(
        "flow_key", "frame_number", _labels().alias("labels"), commands.alias("commands"),
        *[F.nullif(c(n), F.lit("")).alias(n) for n in (
            "smb_message_id", "smb_file_id", "smb_filename", "smb_status")],
        "smb_is_response", "smb_read_length", "smb_write_length", "smb_file_offset",
        smb_create_intents(c("smb_create_desired_access"), c("smb_create_file_attributes")).alias(
            "intents"))


def _intended(kind: str) -> Column:
    return F.array_contains("intents", kind)


def _or_own(column: str) -> Column:
    """A key column; rows without a value get a key of their own."""
    return F.coalesce(F.concat(F.lit("="), F.col(column)),
                      F.concat(F.lit("#"), F.col("frame_number").cast("string")))


def _bound_rows(rows: DataFrame) -> DataFrame:
    """Names that a row binds to its file id: the pending create of its message, else its own."""
    c = F.col
    create = c("labels").contains("create") & c("smb_filename").isNotNull() & c(
        "smb_message_id").isNotNull()
    own = {"any": F.lit(True), "read": _intended("read"), "write": _intended("write")}
    pending = {kind: F.when(create & test, c("smb_filename")) for kind, test in own.items()}
    direct = {kind: F.when(test, c("smb_filename")) for kind, test in own.items()}
    found = scan(rows.withColumn("_message", _or_own("smb_message_id")), ["flow_key", "_message"],
                 "frame_number", latest={f"_{kind}": value for kind, value in pending.items()})
    return found.withColumns({f"bound_{kind}": F.when(
        c("smb_file_id").isNotNull(), F.coalesce(pending[kind], c(f"_{kind}"), direct[kind]))
        for kind in own}).drop("_message", *[f"_{kind}" for kind in own])


def smb_create_bindings(pk: DataFrame) -> DataFrame:
    """(flow, file id, name, frame) for every row that names a file id."""
    return _bound_rows(_smb_rows(pk)).where("bound_any IS NOT NULL").select(
        "flow_key", "smb_file_id", F.col("bound_any").alias("filename"), "frame_number")


def smb_transfer_names(pk: DataFrame) -> DataFrame:
    """SMB rows with the file each would read or write: the latest name bound to the file id for
    that use, else the row's own name when it carries a single command."""
    c = F.col
    bound = _bound_rows(_smb_rows(pk)).withColumn("_file", _or_own("smb_file_id"))
    named = scan(bound, ["flow_key", "_file"], "frame_number", latest={
        "_read": c("bound_read"), "_write": c("bound_write")})
    own = F.when(c("commands") <= 1, c("smb_filename"))
    return named.withColumns({
        "read_filename": F.coalesce("bound_read", "_read", own),
        "write_filename": F.coalesce("bound_write", "_write", own),
    }).drop("_file", "_read", "_write", "bound_any", "bound_read", "bound_write", "intents")


def smb_transfer_ops(pk: DataFrame) -> DataFrame:
    """One row per possible transfer: whether it counts as an operation, and its length.

    A message counts once. Without a stated length, the step from the previous offset in the file
    stands for it.
    """
    c = F.col

    def use(kind: str) -> Column:
        return F.struct(F.lit(kind).alias("kind"), c(f"smb_{kind}_length").alias("length"),
                        c(f"{kind}_filename").alias("filename"),
                        c("labels").contains(kind).alias("used"))

    answered = F.coalesce(c("smb_is_response"), F.lit(False))
    rows = settle(smb_transfer_names(pk).where(~(answered & smb_failed(c("smb_status")))), "smb")
    eligible = rows.select(
        "flow_key", "frame_number", "commands", "smb_message_id", "smb_file_id", "smb_file_offset",
        answered.alias("answered"), F.inline(F.array(use("read"), use("write"))),
    ).where(c("used") & ((c("commands") <= 1) | c("length").isNotNull()
                         | c("smb_file_offset").isNotNull() | c("smb_file_id").isNotNull()))
    first = scan(eligible.withColumn("_message", _or_own("smb_message_id")),
                 ["flow_key", "kind", "_message"], "frame_number", position="_nth")
    counts = F.when(c("smb_message_id").isNotNull(), c("_nth") == 1).otherwise(
        ~c("answered") | c("length").isNotNull())
    counted = first.withColumns({
        "counts_op": counts,
        "file_key": F.coalesce("filename", "smb_file_id", F.lit(UNKNOWN_FILE))})
    step = c("smb_file_offset") - c("_before")
    return scan(counted, ["flow_key", "kind", "file_key"], "frame_number",
                latest={"_before": c("smb_file_offset")}).withColumn(
        "inferred_length", F.when(c("length").isNull() & (step > 0), step)).drop(
            "_before", "_nth", "_message")


def _moved() -> Column:
    return F.coalesce("length", "inferred_length")


def smb_transfers(ops: DataFrame) -> DataFrame:
    """(flow, read/write): operations, bytes, operations of unknown or inferred length."""
    return ops.groupBy("flow_key", "kind").agg(
        F.count_if("counts_op").alias("ops"),
        F.coalesce(F.sum(_moved()), F.lit(0)).alias("bytes"),
        F.count_if(F.col("counts_op") & _moved().isNull()).alias("unknown_ops"),
        F.count("inferred_length").alias("inferred_ops"))


def transfers_by_flow(ops: DataFrame) -> DataFrame:
    per_kind = smb_transfers(ops)
    return per_kind.groupBy("flow_key").agg(*[
        F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col(name))), F.lit(0)).alias(
            f"{kind}_{name}")
        for kind in ("read", "write") for name in ("ops", "bytes", "unknown_ops", "inferred_ops")])


def smb_file_bytes(ops: DataFrame) -> DataFrame:
    return ops.where((_moved() > 0) & F.col("filename").isNotNull()).groupBy(
        "flow_key", "kind", "filename").agg(
            F.sum(_moved()).alias("bytes"), F.min("frame_number").alias("first_at"))


def large_files(files: DataFrame, min_bytes: int = LARGE_FILE_BYTES, k: int | None = LARGE_FILES
                ) -> DataFrame:
    """The k largest files of `min_bytes` or more of each flow and direction; all of them, without
    ranks, if k is None. Each chunk of a group is ranked on its own first.
    """
    from pyspark.sql import Window

    from packetloom.operators.ordered import chunk_of

    large = files.where(F.col("bytes") >= min_bytes)
    if k is None:
        return large.withColumn("rank", F.lit(None).cast("int"))
    big = large.withColumn("_chunk", chunk_of("first_at"))
    best = (F.col("bytes").desc(), F.col("first_at").asc(), F.col("filename").asc())
    group = ["flow_key", "kind"]
    local = Window.partitionBy(*group, "_chunk").orderBy(*best)
    near = big.withColumn("_at", F.row_number().over(local)).where(F.col("_at") <= k)
    return near.withColumn("rank", F.row_number().over(
        Window.partitionBy(*group).orderBy(*best))).where(F.col("rank") <= k).drop("_chunk", "_at")


# --- header rows ------------------------------------------------------------------------------

def smb2_credits(fr: DataFrame, keys: list[str] = ("flow_key",)) -> DataFrame:
    """Credit charge, request and grant counters with reads, writes, errors and TCP symptoms."""
    charge = first_row_int(field("smb2.credit.charge"))
    shared = field("smb2.credit.request_response")
    asked_text = first_filled(field("smb2.credits.requested"), shared)
    granted_text = first_filled(field("smb2.credits.granted"), shared)
    response = marked(field("smb2.flags.response"))
    asked = F.when(~response, first_row_int(asked_text))
    granted = F.when(response, first_row_int(granted_text))
    command = F.lower(F.coalesce(smb_name(field("smb2.cmd"), SMB2_NAMES), F.lit("")))
    any_credit = (filled(field("smb2.cmd")) | filled(field("smb2.credit.charge"))
                  | asked_text.isNotNull() | granted_text.isNotNull())

    def total(value: Column, name: str) -> list[Column]:
        return [F.coalesce(F.sum(value), F.lit(0)).alias(f"credit_{name}_total"),
                F.greatest(F.coalesce(F.max(value), F.lit(0)), F.lit(0)).alias(f"credit_{name}_max")]

    return fr.groupBy(*keys).agg(
        F.count_if(any_credit).alias("smb2_packets"),
        F.count_if(~response).alias("smb2_requests"),
        F.count_if(response).alias("smb2_responses"),
        *total(charge, "charge"), *total(asked, "request"), *total(granted, "grant"),
        F.count_if(granted == 0).alias("credit_grant_zero_packets"),
        F.count_if(command.contains("read")).alias("read_packets"),
        F.count_if(command.contains("write")).alias("write_packets"),
        F.count_if(smb_failed(field("smb2.nt_status"))).alias("status_error_packets"),
        F.count_if(filled(field("tcp.analysis.lost_segment"))
                   | filled(field("tcp.analysis.retransmission"))).alias(
                       "tcp_loss_or_retransmission_packets"),
        F.count_if(filled(field("tcp.analysis.zero_window"))).alias("tcp_zero_window_packets"))
