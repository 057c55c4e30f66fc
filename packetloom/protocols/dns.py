"""DNS queries, response codes and answers per flow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.functions.names import dns_explain, dns_success
from packetloom.functions.parse import comma_items, filled
from packetloom.operators.ordered import ordered_distinct, place_in_packet

KINDS = {"query": "dns_query", "query_type": "dns_query_type", "rcode": "dns_response_code"}


def dns_answers(a: Column, aaaa: Column, address: Column) -> Column:
    """Addresses of the three comma-list fields, in that order."""
    return F.concat(comma_items(a), comma_items(aaaa), comma_items(address))


def dns_counts(pk: DataFrame) -> DataFrame:
    """(flow, kind, value, n): queries, query types and response codes."""
    entries = F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(column).alias("value"))
                        for kind, column in KINDS.items()])
    return pk.select("flow_key", "frame_number", F.inline(entries)).where(
        filled(F.col("value"))).groupBy("flow_key", "kind", "value").agg(
            F.count(F.lit(1)).alias("n"), F.min("frame_number").alias("first_at"))


def dns_answer_list(pk: DataFrame) -> DataFrame:
    """Distinct answers of a flow in order of appearance."""
    listed = pk.select("flow_key", "frame_number", F.posexplode("dns_answers").alias("slot", "answer"))
    return ordered_distinct(
        listed.withColumn("at", place_in_packet(F.col("slot"))),
        ["flow_key"], "answer", "at").select("flow_key", "answer", "position")


def dns_summary(pk: DataFrame) -> DataFrame:
    """Totals per flow; the values themselves are in `dns_counts` and `dns_answer_list`."""
    counts = dns_counts(pk).groupBy("flow_key").agg(
        *[F.count_if(F.col("kind") == kind).alias(f"distinct_{kind}") for kind in KINDS],
        *[F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0)).alias(f"{kind}_count")
          for kind in KINDS],
        F.coalesce(F.sum(F.when((F.col("kind") == "rcode") & ~dns_success(F.col("value")),
                                F.col("n"))), F.lit(0)).alias("error_count"))
    answers = pk.select("flow_key", F.explode("dns_answers").alias("answer")).where(
        filled(F.col("answer"))).distinct().groupBy("flow_key").agg(
            F.count(F.lit(1)).alias("distinct_answers"))
    return counts.join(answers, "flow_key", "full").na.fill(0)


def dns_issues(pk: DataFrame) -> DataFrame:
    """Explanations of the failing codes of a flow, each once, in order of the codes."""
    failing = dns_counts(pk).where((F.col("kind") == "rcode") & ~dns_success(F.col("value")))
    return ordered_distinct(failing.withColumn("issue", dns_explain(F.col("value"))),
                            ["flow_key"], "issue", "first_at").select(
        "flow_key", "issue", "position")
