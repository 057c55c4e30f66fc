"""Running flow totals over a stream of packets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from packetloom.operators.keys import analysable, with_flow
from packetloom.operators.rollup import flow_rollup
from packetloom.schemas import PACKET_COLUMNS


def packet_stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    """Packets of the files that arrive in a folder, with their flow and direction."""
    stream = spark.readStream.schema(schema).parquet(folder)
    return with_flow(analysable(stream.select(*PACKET_COLUMNS)))


def stream_flow_rollup(stream: DataFrame) -> DataFrame:
    """The flow rollup, kept up to date. Late packets count: no watermark drops them."""
    return flow_rollup(stream)


def start_rollup(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Write the flows that changed in each batch below its own batch number.

    A batch that is repeated after a failure replaces its own rows.
    """
    def keep(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{folder}/batch={batch}")

    return (stream_flow_rollup(stream).writeStream.outputMode("update").foreachBatch(keep)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def current_flows(spark: SparkSession, folder: str) -> DataFrame:
    """The last state of every flow: its newest row, found in one pass over the batches."""
    rows = spark.read.parquet(folder)
    own = [c for c in rows.columns if c not in ("flow_key", "batch")]
    return rows.groupBy("flow_key").agg(F.max_by(F.struct(*own), "batch").alias("last")).select("flow_key", "last.*")
