"""Extension points: custom sources, notification targets, health checks."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

POINT_SCHEMA = "name string, labels map<string,string>, value double, ts_ms bigint, seq bigint"


class Part(InputPartition):
    def __init__(self, value):
        self.value = value


class MetricSource(DataSource, ABC):
    """A user-written metric source, read with `spark.read.format(cls.name()).load()`.

    Subclasses name themselves, list their partitions (shards, hosts, files) and yield
    `(name, labels, value, ts_ms)` for one partition; Spark runs the partitions in parallel.
    """

    def schema(self):
        return POINT_SCHEMA

    @abstractmethod
    def parts(self) -> Sequence[object]: ...

    @abstractmethod
    def collect(self, part: object) -> Iterable[tuple]: ...

    def reader(self, schema):
        return _Reader(self)


class _Reader(DataSourceReader):
    def __init__(self, source: MetricSource):
        self.source = source

    def partitions(self):
        return [Part(p) for p in self.source.parts()]

    def read(self, partition):
        for i, (name, labels, value, ts_ms) in enumerate(self.source.collect(partition.value)):
            yield name, labels, float(value), int(ts_ms), i


def register_source(spark: SparkSession, source: type[MetricSource]) -> None:
    spark.dataSource.register(source)


Send = Callable[[DataFrame, int], None]


def notification_sink(targets: dict[str, Send]) -> Callable[[DataFrame, int], None]:
    """`foreachBatch` callback that hands each target the routed rows of its channel type."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for kind, send in targets.items():
                send(batch.filter(F.col("channel_type") == kind), batch_id)
        finally:
            batch.unpersist()
    return write


@dataclass
class HealthCheck:
    """A named aggregate over a table that yields healthy, degraded or unhealthy."""
    name: str
    table: DataFrame
    status: Column


def run_checks(checks: Sequence[HealthCheck]) -> DataFrame:
    parts = [c.table.agg(c.status.alias("status")).select(F.lit(c.name).alias("name"), "status") for c in checks]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
