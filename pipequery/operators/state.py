"""Keyed state tables: versions of Parquet files with a pointer to the one that counts.

A change writes a new version and then moves the pointer by renaming one file, so readers see all
of a change or none. The pointer also has the last batch that was applied: a batch that comes again
after a failure changes nothing.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Files:
    """Small files and folders in any store that Hadoop reaches."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark._jvm
        self.path = self.jvm.org.apache.hadoop.fs.Path(root)
        self.fs = self.path.getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.path, name)

    def read(self, name: str) -> str | None:
        if not self.fs.exists(self.at(name)):
            return None
        stream = self.fs.open(self.at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def replace(self, name: str, text: str) -> None:
        """Written beside, then renamed over: whoever reads sees the old or the new text."""
        new = self.at(f".{name}.{uuid.uuid4().hex}")
        out = self.fs.create(new, True)
        out.write(bytearray(text.encode()))
        out.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path.toUri(), self.fs.getConf())
        overwrite = self.jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        renames = self.jvm.java.lang.reflect.Array.newInstance(overwrite.getClass(), 1)
        renames[0] = overwrite
        context.rename(new, self.at(name), renames)

    def delete(self, name: str) -> None:
        self.fs.delete(self.at(name), True)


@dataclass
class StateTable:
    """``keys``: the columns of its unique key; empty if rows are only added."""

    spark: SparkSession
    name: str
    root: str
    schema: T.StructType
    keys: list[str] = field(default_factory=list)
    defaults: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        self.files = Files(self.spark, self.root)
        if self.files.read("current") is None:
            self.files.fs.mkdirs(self.files.path)
            self._point(0, {}, None)

    def _pointer(self) -> dict:
        return json.loads(self.files.read("current"))

    def _point(self, version: int, batches: dict, folder: str | None, before: str | None = None) -> None:
        self.files.replace("current", json.dumps({"version": version, "batches": batches, "folder": folder, "before": before}))

    def reset(self) -> None:
        """Empty, and no batch applied."""
        self._point(0, {}, None)

    @property
    def version(self) -> int:
        return self._pointer()["version"]

    def read(self) -> DataFrame:
        folder = self._pointer()["folder"]
        if folder is None:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.root}/{folder}")

    def view(self) -> None:
        self.read().createOrReplaceTempView(self.name)

    def _swap(self, df: DataFrame, batch: tuple[str, int] | None) -> None:
        now = self._pointer()
        folder = f"v{now['version'] + 1}-{uuid.uuid4().hex[:8]}"
        df.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in self.schema)).write.parquet(f"{self.root}/{folder}")
        batches = now["batches"] | ({batch[0]: batch[1]} if batch else {})
        self._point(now["version"] + 1, batches, folder, now["folder"])
        if now.get("before"):  # two versions back: readers of the last one can end
            self.files.delete(now["before"])
        self.view()

    def applied(self, batch: tuple[str, int] | None) -> bool:
        """Whether ``(query, batch id)`` or a later one of that query is in the table already."""
        return batch is not None and self._pointer()["batches"].get(batch[0], -1) >= batch[1]

    def _fit(self, rows: DataFrame, by_name: bool) -> DataFrame:
        """Rows with the table's columns: by name, missing ones by default, or by place."""
        names = self.schema.names
        if by_name:
            missing = {n: F.expr(self.defaults[n]) if n in self.defaults else F.lit(None) for n in names if n not in rows.columns}
            return rows.withColumns(missing).select(*names) if missing else rows.select(*names)
        if len(rows.columns) != len(names):
            raise ValueError(f"{self.name} has {len(names)} columns, not {len(rows.columns)}")
        return rows.toDF(*names)

    def append(self, rows: DataFrame, by_name: bool = False, batch: tuple[str, int] | None = None) -> None:
        if not self.applied(batch):
            self._swap(self.read().unionByName(self._fit(rows, by_name)), batch)

    def upsert(self, rows: DataFrame, updates: dict[str, str], keys: list[str] | None = None, by_name: bool = True, batch: tuple[str, int] | None = None) -> None:
        """Insert, and where a key is there already set ``{column: expression}``; in it plain names are the table's, ``EXCLUDED.`` ones the new row's."""
        if self.applied(batch):
            return
        keys = keys or self.keys
        if not keys:
            raise ValueError(f"{self.name} has no unique key")
        old, new = self.read().alias("t"), self._fit(rows, by_name).alias("excluded")
        same = F.lit(True)
        for k in keys:
            same = same & F.col(f"t.{k}").eqNullSafe(F.col(f"excluded.{k}"))
        old = old.withColumn("_old", F.lit(True)).alias("t")
        new = new.withColumn("_new", F.lit(True)).alias("excluded")
        both = old.join(new, same, "full")
        met = F.col("t._old").isNotNull() & F.col("excluded._new").isNotNull()
        out = []
        for f in self.schema:
            kept = F.when(F.col("t._old").isNotNull(), F.col(f"t.`{f.name}`")).otherwise(F.col(f"excluded.`{f.name}`"))
            if f.name in updates:
                kept = F.when(met, F.expr(self._qualified(updates[f.name]))).otherwise(kept)
            out.append(kept.alias(f.name))
        self._swap(both.select(*out), batch)

    def _qualified(self, expression: str) -> str:
        """Bare column names as the table's own."""
        names = "|".join(re.escape(n) for n in self.schema.names)
        return re.sub(rf"(?i)(?<![\w.`'])`?({names})`?(?![\w(.'])", lambda m: f"t.`{m[1]}`", re.sub(rf"(?i)\bexcluded\s*\.\s*`?({names})`?", lambda m: f"excluded.`{m[1]}`", expression))

    def delete(self, condition: Column | str) -> int:
        """Delete the rows that meet the condition; how many those are."""
        rows = self.read()
        condition = F.expr(condition) if isinstance(condition, str) else condition
        n = rows.where(condition).count()
        if n:
            self._swap(rows.where(~F.coalesce(condition, F.lit(False))), None)
        return n


def upsert_additive(state: DataFrame, batch: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """The state after a batch whose sums are added to it, as one union and one aggregate."""
    columns = [*keys, *sums]
    return state.select(*columns).unionByName(batch.select(*columns)).groupBy(*keys).agg(*(F.sum(s).alias(s) for s in sums))


def newer_than_stored(batch: DataFrame, offsets: DataFrame, keys: list[str], offset: str) -> DataFrame:
    """The rows of a batch beyond the stored offset of their key, or of a key that has none."""
    known = offsets.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col(offset).alias("_stored"))
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(k) == F.col(f"_{k}"))
    # one row per topic and partition
    found = batch.join(F.broadcast(known) if known.limit(100_001).count() <= 100_000 else known, same, "left")
    return found.where(F.col("_stored").isNull() | (F.col(offset) > F.col("_stored"))).drop("_stored", *(f"_{k}" for k in keys))
