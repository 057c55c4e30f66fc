import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def small_chunks(spark):
    """Cut capture order every few rows, so that a key spans many chunks."""
    spark.conf.set("packetloom.chunkRows", "7")
    yield 7
    spark.conf.unset("packetloom.chunkRows")


@pytest.fixture
def packets(spark):
    """Build packets from partial records; frame numbers follow the list."""
    from pyspark.sql import functions as F

    from packetloom.operators.keys import analysable, with_flow
    from packetloom.schemas import PACKET_COLUMNS, PACKETS

    def build(records):
        defaults = {"protocol": "UNKNOWN", "length": 0, "issue_tags": [], "decoded_protocols": [],
                    "dns_answers": [], "tls_certificates": [], "smb_commands_seen": [],
                    "smb_capabilities": [], "srtp": False, "smb_encrypted": False}
        rows = []
        for number, record in enumerate(records, 1):
            full = {**dict.fromkeys(PACKET_COLUMNS), **defaults, "frame_number": number, **record}
            rows.append(tuple(full[c] for c in PACKET_COLUMNS))
        df = spark.createDataFrame(rows, PACKETS).withColumn("frame_number", F.col("frame_number"))
        return with_flow(analysable(df))
    return build
