"""Packet counts of capture files by walking their record headers, one row per file."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

# File magics, and the block types that hold a packet.
CLASSIC = {b"\xd4\xc3\xb2\xa1": "<", b"\x4d\x3c\xb2\xa1": "<",
           b"\xa1\xb2\xc3\xd4": ">", b"\xa1\xb2\x3c\x4d": ">"}
SECTION = b"\x0a\x0d\x0d\x0a"
ORDERS = {b"\x4d\x3c\x2b\x1a": "<", b"\x1a\x2b\x3c\x4d": ">"}
PACKET_BLOCKS = (3, 6)


def _records(data: bytes, order: str) -> int | None:
    at, found = 24, 0
    while at < len(data):
        if at + 16 > len(data):
            return None
        at += 16 + struct.unpack_from(f"{order}I", data, at + 8)[0]
        found += 1
    return found


def _blocks(data: bytes) -> int | None:
    at, found, order = 0, 0, "<"
    while at < len(data):
        if at + 8 > len(data):
            return None
        section = data[at:at + 4] == SECTION
        if section:
            order = ORDERS.get(data[at + 8:at + 12])
            if order is None:
                return None
        kind, size = struct.unpack_from(f"{order}II", data, at)
        if size < 12 or size - (12 if section else 8) < 4:
            return None
        found += not section and kind in PACKET_BLOCKS
        at += size
    return found


def count_packets(data: bytes) -> int | None:
    """Packets in one capture; null when the file is of another kind or cut inside a header."""
    magic = data[:4]
    if magic == SECTION:
        return _blocks(data)
    return _records(data, CLASSIC[magic]) if magic in CLASSIC else None


def capture_counts(spark: SparkSession, folder: str) -> DataFrame:
    """(path, packets) of every capture file below a folder, files spread over tasks."""
    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            counts = [count_packets(bytes(c)) for c in files["content"]]
            yield pd.DataFrame({"path": files["path"],
                                "packets": pd.array(counts, dtype="Int64")})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "content").mapInPandas(walk, "path string, packets bigint")
