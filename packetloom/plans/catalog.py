"""Registered queries: a Spark job over the given tables with its SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from packetloom.operators.rollup import CORE_COLUMNS, flow_rollup, rank_flows
from packetloom.schemas import PACKET_COLUMNS
from packetloom.sources import derived


class Tables:
    """The tables a query starts from."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def given(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def packets(self) -> DataFrame:
        return derived.packets(self.spark, self.sf_dir)

    @cached_property
    def captured(self) -> DataFrame:
        """Packets as captured, without flow columns."""
        return self.packets.select(*PACKET_COLUMNS)

    @cached_property
    def control(self) -> DataFrame:
        return derived.control_packets(self.spark, self.sf_dir)

    @cached_property
    def flows(self) -> DataFrame:
        return flow_rollup(self.packets)

    @cached_property
    def ranked(self) -> DataFrame:
        """Flow ids with the counters most queries need."""
        return rank_flows(self.flows.select(*CORE_COLUMNS))

    @cached_property
    def ranked_facts(self) -> DataFrame:
        """Flow ids with every counter of the rollup."""
        return rank_flows(self.flows)

    @cached_property
    def headers(self) -> DataFrame:
        from packetloom.sources.headers import header_rows

        return header_rows(self.packets)

    @cached_property
    def control_headers(self) -> DataFrame:
        from packetloom.sources.headers import control_header_rows

        return control_header_rows(self.control)


@dataclass(frozen=True)
class Query:
    build: Callable[[Tables], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    def register(build: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = Query(build, sql)
        return build
    return register


def load() -> dict[str, Query]:
    from packetloom.plans import (  # noqa: F401
        deep, flows, packets, protocols, related, sequences, streams)

    return QUERIES
