"""Burst limits: leaky buckets per key, which drain at a steady rate and refuse what would overflow them.

A bucket holds ``burst + 1`` requests and loses one every ``period_us`` microseconds. A request that finds room is
allowed and adds one; a refused one changes nothing. In integers: ``due`` is when the bucket will be empty; a request at
``t`` is allowed if max(due, t) - t <= burst * period, and sets due to max(due, t) + period.

Each decision depends on the one before, but only within a run: after ``(burst + 1) * period`` without a request the
bucket is surely empty. Runs are found without sorting a key's whole time line: requests fall into cells of that width,
no gap so long lies within a cell, and only the cells' first and last times, one row a cell after partial aggregation,
meet by key. Requests are then dealt by (zone, key, run), so a busy key is split at its pauses, and each run streams
through one task in order; nothing is gathered. A key that never pauses is one run, since its decisions are a chain.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructType
from pyspark.sql.window import Window


@dataclass(frozen=True)
class Zone:
    """One request every ``period_us`` microseconds, and ``burst`` more at once."""

    period_us: int
    burst: int

    @property
    def pause_us(self) -> int:
        """After so long without a request the bucket is empty."""
        return (self.burst + 1) * self.period_us


def by_zone(zone: Column, zones: dict[str, Zone], value: str) -> Column:
    out = F.lit(None).cast("long")
    for name, z in zones.items():
        out = F.when(zone == name, F.lit(getattr(z, value))).otherwise(out)
    return out


def with_runs(requests: DataFrame, zones: dict[str, Zone]) -> DataFrame:
    """Adds ``_run`` to rows with ``_zone, _key, _at``: when the run that a request belongs to began."""
    rows = requests.withColumn("_cell", F.floor(F.col("_at") / by_zone(F.col("_zone"), zones, "pause_us")))
    cells = rows.groupBy("_zone", "_key", "_cell").agg(F.min("_at").alias("_low"), F.max("_at").alias("_high"))
    w = Window.partitionBy("_zone", "_key").orderBy("_cell")
    pause = F.col("_low") - F.lag("_high").over(w)
    begins = F.when(pause.isNull() | (pause >= by_zone(F.col("_zone"), zones, "pause_us")), F.col("_low"))
    cells = cells.withColumn("_begins", begins).withColumn("_run", F.last("_begins", True).over(w)).select("_zone", "_key", "_cell", "_run")
    return rows.join(cells, ["_zone", "_key", "_cell"]).drop("_cell")


def burst_limited(requests: DataFrame, zones: dict[str, Zone], zone: str, key: str, at: str, tie: str) -> DataFrame:
    """Adds ``allowed`` and ``level_us``, what the bucket then takes to drain. Requests of one key go by ``at``, then
    ``tie``. Without a key, a time or a known zone a request isn't limited: allowed, with a null level."""
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    rows = requests.withColumns({"_zone": F.col(zone).cast("string"), "_key": F.col(key), "_at": micros})
    known = F.col("_zone").isin(*zones) & F.col("_key").isNotNull() & F.col("_at").isNotNull()
    known = F.coalesce(known, F.lit(False))
    free = requests.filter(~F.coalesce(F.col(zone).cast("string").isin(*zones) & F.col(key).isNotNull() & F.col(at).isNotNull(), F.lit(False)))
    dealt = with_runs(rows.filter(known), zones).repartition("_zone", "_key", "_run").sortWithinPartitions("_zone", "_key", "_run", "_at", tie)
    columns = requests.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, due, period, room = None, 0, 0, 0
        for batch in batches:
            allowed, level = [], []
            for z, k, r, t in zip(*(batch.column(c).to_pylist() for c in ("_zone", "_key", "_run", "_at")), strict=True):
                if (z, k, r) != before:
                    before, due = (z, k, r), t
                    period, room = zones[z].period_us, zones[z].burst * zones[z].period_us
                start = max(due, t)
                fits = start - t <= room
                if fits:
                    due = start + period
                allowed.append(fits)
                level.append(max(due - t, 0))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(allowed, pa.bool_()), pa.array(level, pa.int64())], names=[*columns, "allowed", "level_us"])

    schema = StructType([*requests.schema.fields]).add("allowed", BooleanType()).add("level_us", LongType())
    return dealt.mapInArrow(run, schema).unionByName(free.withColumns({"allowed": F.lit(True), "level_us": F.lit(None).cast("long")}))
