"""A partitioned Parquet table that is replaced partition by partition, version by version.

A partition has two slots. A new version of it is written to the slot that the current version does not use, and counts
once the version's manifest is there; until then readers see the version before, whole. Manifests alternate between two
folders in the same way. A manifest names how many rows it has, so one that is cut short, or missing, is no version. A write that
dies leaves files that nothing refers to; the next one replaces them. Nothing has to be deleted or compacted, a partition's files
come from one write, and reading costs the same after any number of versions.

There must be one writer at a time, as a streaming query is; readers may go on while one version is written, and must begin
anew if two are. The number of partitions must be bounded, because the manifest passes through the driver.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

SLOT = "slot"
_MANIFEST = "version bigint, batch bigint, total bigint, part string, slot int"
NO_BATCH = -1


@dataclass(frozen=True)
class Version:
    """Number, last micro-batch that went in, and the slot of every partition by its values."""

    number: int = 0
    batch: int = NO_BATCH
    slots: dict[tuple, int] = field(default_factory=dict)


@dataclass(frozen=True)
class VersionedTable:
    """``schema`` has all columns, with the ``partitions`` among them (text, whole numbers or dates as text)."""

    spark: SparkSession
    root: str
    schema: T.StructType
    partitions: list[str]

    def _manifest(self, slot: int) -> Version | None:
        try:
            rows = self.spark.read.schema(_MANIFEST).json(f"{self.root}/versions/{SLOT}={slot}").collect()
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return None
        if not rows or len(rows) != rows[0]["total"]:
            return None
        slots = {tuple(json.loads(r["part"])): r["slot"] for r in rows if r["part"] is not None}
        return Version(rows[0]["version"], rows[0]["batch"], slots)

    def current(self) -> Version:
        """The newest complete version; number 0 and no partitions before the first."""
        found = [v for v in (self._manifest(0), self._manifest(1)) if v]
        return max(found, key=lambda v: v.number, default=Version())

    def read(self, version: Version | None = None, parts: list[tuple] | None = None) -> DataFrame:
        """All rows of a version (the current one), or of those of its partitions that are in ``parts``."""
        version = version or self.current()
        wanted = version.slots if parts is None else {p: version.slots[p] for p in parts if p in version.slots}
        if not wanted:
            return self.spark.createDataFrame([], self.schema)
        data = f"{self.root}/data"
        paths = [f"{data}/{self._folder(p)}/{SLOT}={slot}" for p, slot in sorted(wanted.items(), key=str)]
        rows = self.spark.read.schema(self.schema).option("basePath", data).parquet(*paths)
        return rows.select(*self.schema.fieldNames())

    def _folder(self, part: tuple) -> str:
        return "/".join(f"{c}={v}" for c, v in zip(self.partitions, part, strict=True))

    def parts_of(self, rows: DataFrame) -> list[tuple]:
        """The partitions that rows belong to."""
        return [tuple(r) for r in rows.select(*self.partitions).distinct().collect()]

    def replace(self, rows: DataFrame, parts: list[tuple], batch: int | None = None, drop: list[tuple] = ()) -> Version:
        """The next version: ``parts``, in each of which ``rows`` has at least one row, are replaced.

        Those in ``drop`` are gone; all others stay.
        """
        before = self.current()
        slots = {p: 1 - before.slots.get(p, 1) for p in parts}
        if parts:
            self._write(rows, slots)
        kept = {p: s for p, s in before.slots.items() if p not in set(drop)}
        after = Version(before.number + 1, before.batch if batch is None else batch, {**kept, **slots})
        self._publish(after)
        return after

    def _write(self, rows: DataFrame, slots: dict[tuple, int]) -> None:
        types = [self.schema[c].dataType for c in self.partitions]
        schema = T.StructType([T.StructField(c, t) for c, t in zip(self.partitions, types, strict=True)]).add(SLOT, T.IntegerType())
        where = self.spark.createDataFrame([(*p, s) for p, s in slots.items()], schema)
        placed = rows.select(*self.schema.fieldNames()).join(where.hint("broadcast"), self.partitions)  # a row per partition
        # A partition's rows come together in few files; adaptive execution splits one that is too large for a task.
        writer = placed.hint("rebalance", *self.partitions).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy(*self.partitions, SLOT).parquet(f"{self.root}/data")

    def _publish(self, version: Version) -> None:
        parts = [(json.dumps(p), slot) for p, slot in version.slots.items()] or [(None, None)]
        rows = [(version.number, version.batch, len(parts), *p) for p in parts]
        manifest = self.spark.createDataFrame(rows, _MANIFEST).coalesce(1)
        manifest.write.mode("overwrite").json(f"{self.root}/versions/{SLOT}={version.number % 2}")
