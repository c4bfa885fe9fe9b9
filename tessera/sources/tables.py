"""Tables that are rewritten atomically (S19, S20, M8): staged files and a manifest for each version.

A table's rows lie in ``buckets`` folders by the hash of its keys. A change reads and rewrites only
the buckets it touches, into new folders; the others are taken over by name. A version is
one small file, the manifest, that appears whole or not at all; readers take the latest one and so never
see half a change, and a second writer that started from the same version fails. Old folders stay
until :meth:`Table.vacuum`, so readers of earlier versions go on.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.operators import state
from tessera.sources.staging import Files


class ConflictError(RuntimeError):
    """Another writer has published the version meanwhile."""


class Table:
    """A table under a folder, keyed by ``keys`` (rows of one key, null-safe, replace each other)."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.files = Files(spark, root)

    @classmethod
    def create(cls, df: DataFrame, root: str, keys: list[str], buckets: int = 32) -> Table:
        """A new table of the rows of ``df``; fails where there is one."""
        own = cls(df.sparkSession, root)
        if own.files.names("manifests"):
            raise FileExistsError(root)
        own._publish(1, {"keys": keys, "buckets": buckets, "schema": df.schema.json(), "folders": own._staged(df, keys, buckets)})
        return own

    def versions(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self.files.names("manifests")]

    def manifest(self, version: int | None = None) -> dict:
        """The manifest of a version, by default the latest."""
        held = self.versions()
        if not held:
            raise FileNotFoundError(self.root)
        number = held[-1] if version is None else version
        return {"version": number} | json.loads(self.files.read(f"manifests/{number:020d}.json"))

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version. The files are settled when this returns."""
        own = self.manifest(version)
        return self._rows(own, list(own["folders"].values()))

    def upsert(self, delta: DataFrame, version: str | None = None) -> int:
        """Rows of ``delta`` take the place of those of equal keys, or are added (``version`` orders several of one key)."""
        own = self.manifest()
        columns = StructType.fromJson(json.loads(own["schema"])).names
        extra = [] if version is None else [version]
        return self._changed(own, delta.select(*dict.fromkeys([*columns, *extra])), lambda old, new: state.upsert(old, new, own["keys"], version))

    def replace(self, delta: DataFrame, by: str) -> int:
        """M8: all rows of the values of ``by``, a key column, that the delta names are replaced by the delta's."""
        own = self.manifest()
        if own["keys"] != [by]:
            raise ValueError(f"rows lie by {own['keys']}, not by {by}")
        columns = StructType.fromJson(json.loads(own["schema"])).names
        return self._changed(own, delta.select(*columns), lambda old, new: state.replace_rows(old, new, by))

    def update(self, keys: DataFrame, **columns: Column) -> int:
        """Set columns of the rows whose keys are listed."""
        own = self.manifest()
        marked = keys.select(*own["keys"]).distinct()

        def merge(old: DataFrame, new: DataFrame) -> DataFrame:
            hit = old.join(new.withColumn("__hit", F.lit(True)), _same(old, new, own["keys"]), "left").select(*[old[c] for c in old.columns], "__hit")
            return hit.select(*[F.when(F.col("__hit"), columns[c].cast(old.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in old.columns])

        return self._changed(own, marked, merge)

    def delete(self, keys: DataFrame) -> int:
        """Remove the rows whose keys are listed."""
        own = self.manifest()
        return self._changed(own, keys.select(*own["keys"]).distinct(), lambda old, new: old.join(new, _same(old, new, own["keys"]), "left_anti"))

    def vacuum(self, keep: int = 1) -> None:
        """Remove all but the last ``keep`` versions and the folders that none of those names."""
        held = self.versions()
        kept = held[-keep:]
        named = {f.split("/")[1] for v in kept for f in self.manifest(v)["folders"].values()}
        for v in held[:-keep]:
            self.files.delete(f"manifests/{v:020d}.json")
        for folder in self.files.names("data"):
            if folder not in named:
                self.files.delete(f"data/{folder}")

    def _rows(self, own: dict, folders: list[str]) -> DataFrame:
        schema = StructType.fromJson(json.loads(own["schema"]))
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], schema)

    def _staged(self, df: DataFrame, keys: list[str], buckets: int) -> dict[str, str]:
        """Folders of the buckets that ``df`` fills, by bucket. Tasks take ranges of (bucket, hash), so that a task writes
        few buckets and a large bucket is written by many tasks."""
        folder = f"data/{uuid.uuid4().hex}"
        df.withColumn("__bucket", _bucket(keys, buckets)).repartitionByRange("__bucket", F.xxhash64(*keys)).write.partitionBy("__bucket").parquet(f"{self.root}/{folder}")
        return {n.removeprefix("__bucket="): f"{folder}/{n}" for n in self.files.names(folder) if n.startswith("__bucket=")}

    def _changed(self, own: dict, delta: DataFrame, merge) -> int:
        """Rewrite the buckets that ``delta`` touches (at most as many as the table has) and publish the next version."""
        bucket = _bucket(own["keys"], own["buckets"])
        touched = [str(r.b) for r in delta.select(bucket.alias("b")).distinct().collect()]
        if not touched:
            return own["version"]
        old = self._rows(own, [own["folders"][b] for b in touched if b in own["folders"]])
        new = self._staged(merge(old, delta), own["keys"], own["buckets"])
        kept = {b: f for b, f in own["folders"].items() if b not in touched}
        self._publish(own["version"] + 1, {k: own[k] for k in ("keys", "buckets", "schema")} | {"folders": kept | new})
        return own["version"] + 1

    def _publish(self, version: int, manifest: dict) -> None:
        if not self.files.publish(f"manifests/{version:020d}.json", json.dumps(manifest)):
            raise ConflictError(f"version {version} of {self.root} is there already")


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _same(old: DataFrame, new: DataFrame, keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & old[k].eqNullSafe(new[k])
    return out
