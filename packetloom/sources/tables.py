"""Stored tables: packets, saved summaries and detailed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.operators.ordered import scan
from packetloom.schemas import PACKETS, conform

# Sections of a saved flow, and the names their fields had before.
SECTIONS = {
    "esp": {"spis": "array<string>"},
    "tls": {"snis": "array<string>", "alerts": "map<string,bigint>"},
    "sip": {"call_ids": "array<string>", "methods": "map<string,bigint>",
            "statuses": "map<string,bigint>", "participants": "array<string>"},
    "smb": {"commands": "map<string,bigint>", "statuses": "map<string,bigint>",
            "filenames": "array<string>", "read_ops": "bigint", "write_ops": "bigint",
            "read_bytes": "bigint", "write_bytes": "bigint", "error_count": "bigint",
            "encrypted_packets": "bigint"},
    "dns": {"queries": "map<string,bigint>", "query_types": "map<string,bigint>",
            "response_codes": "map<string,bigint>", "answers": "array<string>",
            "error_count": "bigint"},
    "dhcp": {"message_types": "map<string,bigint>", "transaction_ids": "array<string>",
             "client_macs": "array<string>", "hostnames": "array<string>",
             "offered_ips": "array<string>", "server_ids": "array<string>"},
}
KEY = ("struct<address_type:string,link_type:string,vlan_ids:array<int>,endpoint_a:string,"
       "endpoint_b:string,port_a:int,port_b:int,protocol:string>")
WINDOW = ("struct<tool:string,sample_offset:bigint,issue_packet_index:bigint,frame_number:bigint,"
          "direction:string,reasons:array<string>,events:array<struct<issue_packet_index:bigint,"
          "frame_number:bigint,direction:string,reason_indices:array<int>>>>")
FLOW_FIELDS = {
    "key": KEY, "packet_count": "bigint", "byte_count": "bigint", "first_seen": "string",
    "last_seen": "string", "src_to_dst_packets": "bigint", "dst_to_src_packets": "bigint",
    "src_to_dst_bytes": "bigint", "dst_to_src_bytes": "bigint",
    "issue_counts": "map<string,bigint>", "src_to_dst_issue_counts": "map<string,bigint>",
    "dst_to_src_issue_counts": "map<string,bigint>", "decoded_protocols": "array<string>",
    "protocols_a_to_b": "array<string>", "protocols_b_to_a": "array<string>",
    "initial_rtt_ms": "double", "max_interarrival_ms": "double",
    "redirect_locations": "array<string>", "names": "array<string>",
    "recommended_evidence_offsets": f"array<{WINDOW}>",
}


def _flow_type() -> str:
    fields = [f"{n}:{t}" for n, t in FLOW_FIELDS.items()]
    for section, inner in SECTIONS.items():
        fields.append(f"{section}:struct<" + ",".join(f"{n}:{t}" for n, t in inner.items()) + ">")
        fields += [f"{section}_{n}:{t}" for n, t in inner.items()]
    return "struct<" + ",".join(fields) + ">"


SUMMARY_FIELDS = f"packet_count bigint, total_bytes bigint, flow_count bigint, flows array<{_flow_type()}>"


def read_packets(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A packet table in the fixed schema; columns a file does not have are null."""
    return conform(spark.read.schema(PACKETS).format(fmt).load(path))


def packet_limit(pk: DataFrame, first: int) -> DataFrame:
    """The first captured packets, counted in capture order before any packet is left out, whatever their numbers."""
    placed = scan(pk.where(F.col("frame_number").isNotNull()), [], "frame_number", position="_place")
    return placed.where(F.col("_place") <= first).select(*pk.columns)


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """One row per flow of saved summaries, bare or wrapped in `summary`.

    Sections read their older flat field where it is given. Flow ids are list positions.
    """
    wrapped = SUMMARY_FIELDS.replace("packet_count bigint", "packet_count:bigint", 1).replace(
        ", total_bytes bigint", ",total_bytes:bigint").replace(
        ", flow_count bigint", ",flow_count:bigint").replace(", flows array", ",flows:array")
    saved = spark.read.schema(
        f"{SUMMARY_FIELDS}, summary struct<{wrapped}>, source_capture_path string"
    ).json(path, multiLine=True)
    flows = saved.select(
        F.input_file_name().alias("file"), "source_capture_path",
        F.posexplode(F.coalesce("summary.flows", "flows")).alias("at", "f"))

    def section(name: str, inner: dict[str, str]) -> Column:
        return F.struct(*[F.coalesce(F.col(f"f.{name}_{n}"), F.col(f"f.{name}.{n}")).alias(n)
                          for n in inner]).alias(name)

    return flows.select(
        "file", "source_capture_path", (F.col("at") + 1).cast("bigint").alias("flow_id"),
        *[F.col(f"f.key.{n}").alias(n) for n in (
            "address_type", "link_type", "vlan_ids", "endpoint_a", "endpoint_b", "port_a",
            "port_b", "protocol")],
        *[F.col(f"f.{n}").alias(n) for n in FLOW_FIELDS if n != "key"],
        *[section(n, inner) for n, inner in SECTIONS.items()])


def flows_of_summary(saved: DataFrame) -> DataFrame:
    """Saved flows with the columns of a fresh rollup: counters by direction, issues by tag, protocol sets.

    Filters, metrics, ranks and summaries of chosen flows take them as they take `flow_rollup`. The key text
    is made anew from the key columns; times read as timestamps without zone.
    """
    from packetloom.operators.keys import flow_key_text
    from packetloom.operators.rollup import ISSUE_TAGS

    c = F.col

    def counted(column: str, tag: str) -> Column:
        return F.coalesce(F.element_at(column, F.lit(tag)), F.lit(0)).cast("bigint")

    ways = (("a_to_b", "src_to_dst"), ("b_to_a", "dst_to_src"))
    return saved.select(
        "file", "source_capture_path", "flow_id", flow_key_text().alias("flow_key"), "address_type",
        "link_type", "vlan_ids", "protocol", "endpoint_a", "port_a", "endpoint_b", "port_b",
        "packet_count", "byte_count",
        *[c(n).cast("timestamp_ntz").alias(n) for n in ("first_seen", "last_seen")],
        c("flow_id").alias("first_frame"),
        *[F.coalesce(c(f"{saved_way}_{n}"), F.lit(0)).alias(f"{way}_{n}")
          for n in ("packets", "bytes") for way, saved_way in ways],
        *[column for tag in ISSUE_TAGS for column in (
            counted("issue_counts", tag).alias(tag),
            *[counted(f"{saved_way}_issue_counts", tag).alias(f"{way}_{tag}") for way, saved_way in ways])],
        "initial_rtt_ms", "max_interarrival_ms", "decoded_protocols", "protocols_a_to_b",
        "protocols_b_to_a", "names", "redirect_locations")


def write_summary(flows: DataFrame, path: str, flows_in_document: int = 10_000) -> None:
    """Save flows (a rollup with `flow_id`; protocol sets, names and redirects if there) in the nested shape
    that `read_summary` reads.

    A document holds the flows of `flows_in_document` consecutive ids, in order, and is a file of its own,
    so none grows with the capture. Nothing is replaced, and readers see only complete output.
    """
    from packetloom.operators.rollup import ISSUE_TAGS

    c, there = F.col, set(flows.columns)

    def tags(prefix: str) -> Column:
        pairs = [F.when(c(f"{prefix}{tag}") > 0, F.struct(F.lit(tag).alias("key"), c(f"{prefix}{tag}").alias("value")))
                 for tag in ISSUE_TAGS if f"{prefix}{tag}" in there]
        return F.map_from_entries(F.array_compact(F.array(*pairs))) if pairs else F.lit(None)

    key = F.struct("address_type", "link_type", "vlan_ids", "endpoint_a", "endpoint_b", "port_a", "port_b", "protocol")
    optional = [n for n in ("decoded_protocols", "protocols_a_to_b", "protocols_b_to_a", "initial_rtt_ms",
                            "max_interarrival_ms", "names", "redirect_locations") if n in there]
    flow = F.struct(
        key.alias("key"), "packet_count", "byte_count",
        *[c(n).cast("string").alias(n) for n in ("first_seen", "last_seen")],
        *[c(f"{way}_{n}").alias(f"{saved}_{n}") for n in ("packets", "bytes")
          for way, saved in (("a_to_b", "src_to_dst"), ("b_to_a", "dst_to_src"))],
        tags("").alias("issue_counts"), tags("a_to_b_").alias("src_to_dst_issue_counts"),
        tags("b_to_a_").alias("dst_to_src_issue_counts"), *optional)
    documents = flows.select(
        F.floor((c("flow_id") - 1) / flows_in_document).alias("document"), "packet_count", "byte_count",
        F.struct("flow_id", flow.alias("flow")).alias("one")).groupBy("document").agg(
            F.sum("packet_count").alias("packet_count"), F.sum("byte_count").alias("total_bytes"),
            F.count(F.lit(1)).alias("flow_count"),
            F.transform(F.array_sort(F.collect_list("one"), lambda a, b: F.when(
                a["flow_id"] < b["flow_id"], -1).otherwise(1)), lambda x: x["flow"]).alias("flows"))
    documents.drop("document").write.mode("errorifexists").option("maxRecordsPerFile", 1).json(path)


def saved_triggers(flows: DataFrame) -> DataFrame:
    """Triggers of saved windows, merged or single, ready to be merged again."""
    c = F.col
    listed = flows.select("file", "flow_id", F.explode("recommended_evidence_offsets").alias("w"))
    single = F.array(F.struct(
        c("w.issue_packet_index").alias("issue_packet_index"),
        c("w.frame_number").alias("frame_number"), c("w.direction").alias("direction"),
        F.transform(F.sequence(F.lit(0), F.size("w.reasons") - 1), lambda i: i).alias(
            "reason_indices")))
    events = F.when(F.size("w.events") > 0, c("w.events")).otherwise(single)
    return listed.select(
        F.concat_ws("#", "file", c("flow_id").cast("string")).alias("flow_key"), "w.tool",
        F.explode(events).alias("e"), c("w.reasons").alias("_reasons")).select(
            "flow_key", "tool", c("e.issue_packet_index").alias("position"),
            c("e.frame_number").alias("frame_number"),
            (c("e.direction") == "A_to_B").alias("a_to_b"),
            F.transform("e.reason_indices", lambda i: F.get("_reasons", i)).alias("reasons"))


def write_new(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write a table that is not there yet; an existing one is never replaced, and readers see the
    rows only once all of them are committed."""
    df.write.format(fmt).mode("errorifexists").save(path)


def write_details(pk: DataFrame, headers: DataFrame, path: str) -> None:
    """All packets and all header rows, each row with its flow, in two tables."""
    write_new(pk, f"{path}/packets")
    write_new(headers, f"{path}/headers")
