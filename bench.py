"""Time the headline queries and print one JSON line.

Every query runs twice; the second, warm run counts. `packet_table` is the time to derive and store the
packets all queries read.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from packetloom.plans.catalog import Tables, load  # noqa: E402

HEADLINE = [
    "g01_top_flows", "a06_flow_rollup", "a02_protocol_counts", "a04_name_counts", "a09_rtt_stats",
    "a12_flow_names", "w01_packet_gap_stats", "w02_max_interarrival", "w03_sequence_anomalies",
    "a13_esp_sequences", "a14_rtp_streams", "a22_smb_transfers", "a18_dns_summary", "a20_sip_calls",
    "a24_tls_alerts", "j01_calls_by_phone", "j02_with_redirects", "j07_unverified_addresses",
    "f09_flows_in_one_direction", "a30_smb2_credits", "a32_esp_direction_stats", "g03_page",
    "w06_evidence_positions", "w07_evidence_triggers", "w09_evidence_windows",
    "m09_diagnostic_hints",
]


def run(query, spark, folder) -> float:
    start = time.perf_counter()
    query.build(Tables(spark, folder)).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    catalog = load()
    start = time.perf_counter()
    Tables(spark, folder).packets.count()
    times = {"packet_table": round(time.perf_counter() - start, 3)}
    for name in wanted:
        run(catalog[name], spark, folder)
        times[name] = round(run(catalog[name], spark, folder), 3)
    total = sum(v for k, v in times.items() if k != "packet_table")
    print(json.dumps({
        "metric": "total warm seconds of the headline queries", "value": round(total, 3),
        "unit": "sec", "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
