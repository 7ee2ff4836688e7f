"""Stored tables that are changed by key: buckets of keys, of which a change rewrites those that it touches, and versions.

A version is a small manifest file that names the folder of each bucket. A change writes new folders beside the old ones and then
puts the next manifest in place by a rename, which fails where another writer was first: until then readers see the version before,
and if the writer dies they go on seeing it. Older versions stay readable. A writer that numbers its changes, as a stream
does its micro-batches, may repeat one: a number that is not above its last one changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brinework.sources.store import written

class Conflict(RuntimeError):
    """Another writer has put the next version in place."""


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # --- files ---

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _names(self, folder: str) -> list[str]:
        fs, p = self._fs(folder)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def _manifest(self, version: int) -> dict:
        fs, p = self._fs(f"{self.path}/versions/{version:012d}.json")
        stream = fs.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, manifest: dict) -> None:
        fs, draft = self._fs(f"{self.path}/versions/.{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        _, final = self._fs(f"{self.path}/versions/{manifest['version']:012d}.json")
        if fs.exists(final) or not fs.rename(draft, final):
            fs.delete(draft, False)
            raise Conflict(f"version {manifest['version']} of {self.path} is there already")

    # --- reading ---

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._names(f"{self.path}/versions") if n.endswith(".json") and not n.startswith("."))

    def exists(self) -> bool:
        return bool(self.versions())

    def latest(self) -> dict:
        return self._manifest(self.versions()[-1])

    def _rows(self, manifest: dict, buckets: list[str] | None = None) -> DataFrame:
        paths = [d for b, d in sorted(manifest["buckets"].items()) if buckets is None or b in buckets]
        schema = T.StructType.fromJson(manifest["schema"])
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{d}" for d in paths]) if paths else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the latest if none is given."""
        return self._rows(self.latest() if version is None else self._manifest(version))

    # --- writing ---

    def create(self, schema: T.StructType | str, keys: list[str], buckets: int = 16) -> VersionedTable:
        """An empty table, unless there is one. Buckets should grow with the rows that are expected, so that one fits a task."""
        if not self.exists():
            kind = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
            self._commit({"version": 0, "schema": kind.jsonValue(), "keys": keys, "n": buckets, "buckets": {}, "writers": {}})
        return self

    def change(self, rows: DataFrame, how: Callable[[DataFrame, DataFrame], DataFrame], writer: str | None = None, number: int | None = None) -> int:
        """The version after a change: how(old rows of the touched buckets, rows) gives all their new rows, whose keys stay in their buckets."""
        now = self.latest()
        if writer is not None and number is not None and number <= now["writers"].get(writer, -1):
            return now["version"]
        rows = written(rows, "changed-rows")  # they are read several times
        bucket = F.pmod(F.xxhash64(*[F.col(k) for k in now["keys"]]), F.lit(now["n"])).cast("int")
        touched = sorted(str(r[0]) for r in rows.select(bucket).distinct().collect())  # at most as many as there are buckets
        folder = f"data/{uuid.uuid4().hex}"
        columns = [f["name"] for f in now["schema"]["fields"]]
        kinds = {f.name: f.dataType for f in T.StructType.fromJson(now["schema"])}
        place = f"bucket_{uuid.uuid4().hex[:8]}"  # no column of the table
        made = how(self._rows(now, touched), rows).select(*[F.col(c).cast(kinds[c]).alias(c) for c in columns]).withColumn(place, bucket)
        if touched:
            made.repartition(max(1, len(touched)), place).write.partitionBy(place).parquet(f"{self.path}/{folder}")
        wrote = {n.partition("=")[2]: f"{folder}/{n}" for n in self._names(f"{self.path}/{folder}") if n.startswith(f"{place}=")}
        if not set(wrote) <= set(touched):
            raise ValueError("a change may not make rows of other buckets")
        kept = {b: d for b, d in now["buckets"].items() if b not in touched}
        writers = now["writers"] | ({writer: number} if writer is not None and number is not None else {})
        self._commit(now | {"version": now["version"] + 1, "buckets": kept | wrote, "writers": writers})
        return now["version"] + 1

    def upsert(self, rows: DataFrame, keys: list[str] | None = None, **by) -> int:
        """Rows replace those of equal keys. Of several new rows with one key, any single one is taken."""
        keys = keys or self.latest()["keys"]
        rows = rows.dropDuplicates(keys)
        return self.change(rows, lambda old, new: _without(old, new, keys).unionByName(new.select(*old.columns)), **by)

    def insert_if_absent(self, rows: DataFrame, keys: list[str] | None = None, **by) -> int:
        keys = keys or self.latest()["keys"]
        rows = rows.dropDuplicates(keys)
        return self.change(rows, lambda old, new: old.unionByName(_without(new, old, keys).select(*old.columns)), **by)

    def forget(self, keep: int = 2) -> None:
        """Removes all but the latest versions, and the folders that none of those names."""
        kept = self.versions()[-keep:]
        used = {d for v in kept for d in self._manifest(v)["buckets"].values()}
        for v in self.versions()[:-keep]:
            fs, p = self._fs(f"{self.path}/versions/{v:012d}.json")
            fs.delete(p, False)
        for folder in self._names(f"{self.path}/data"):
            for part in self._names(f"{self.path}/data/{folder}"):
                if f"data/{folder}/{part}" not in used and "=" in part:
                    fs, p = self._fs(f"{self.path}/data/{folder}/{part}")
                    fs.delete(p, True)


def _without(rows: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    """rows whose keys others lack; null keys are equal."""
    names = {k: f"other_{i}" for i, k in enumerate(keys)}
    there = others.select(*[F.col(k).alias(n) for k, n in names.items()])
    test = F.lit(True)
    for k, n in names.items():
        test = test & rows[k].eqNullSafe(there[n])
    return rows.join(there, test, "left_anti")
