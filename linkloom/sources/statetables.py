"""State tables that are changed key by key: a change rewrites only the parts whose keys it touches.

A table is dealt into parts by a hash of its key. Every commit is a manifest that tells, for each part, the version that
wrote it; parts that a change did not touch are carried over by the manifest alone. A manifest appears as a whole or not at all
and exists once per version, so of two writers one has to try again; jobs that may be repeated give each change a number, and a number
that was committed before changes nothing.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

Resolve = Callable[[DataFrame, DataFrame], DataFrame]


class StateTable:
    """A keyed table below ``path``: ``schema`` is a DDL string that includes the column ``key``."""

    def __init__(self, spark: SparkSession, path: str, key: str, schema: str, parts: int = 64, keep: int = 3):
        self.spark, self.path, self.key, self.parts, self.keep = spark, path.rstrip("/"), key, parts, keep
        self.schema = StructType.fromDDL(schema)

    # Manifests.

    def _store(self, *below: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *below]))
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def versions(self) -> list[int]:
        """Committed versions, oldest first."""
        store, where = self._store("manifest")
        if not store.exists(where):
            return []
        names = [entry.getPath().getName() for entry in store.listStatus(where)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def manifest(self, version: int | None = None) -> dict:
        """``parts``: part to the folder that holds it; ``applied``: job to its last number. Empty before the first commit."""
        found = self.versions() if version is None else [version]
        if not found:
            return {"version": 0, "parts": {}, "applied": {}}
        rows = self.spark.read.text(f"{self.path}/manifest/{found[-1]:020d}.json", wholetext=True).collect()  # one small file
        return json.loads(rows[0][0])

    def _commit(self, manifest: dict) -> bool:
        """Write a manifest under a name of its own, then give it its number; false if another writer has that already."""
        version = manifest["version"]
        if version in self.versions():
            return False
        jvm = self.spark._jvm
        store, draft = self._store("manifest", f".{jvm.java.util.UUID.randomUUID().toString()}")
        out = store.create(draft, False)
        out.write(json.dumps(manifest).encode())
        out.close()
        _, final = self._store("manifest", f"{version:020d}.json")
        if store.exists(final) or not store.rename(draft, final):
            store.delete(draft, False)
            return False
        return True

    # Data.

    def part_of(self, column: str | None = None):
        return F.pmod(F.xxhash64(F.col(column or self.key)), F.lit(self.parts)).cast("int")

    def _folders(self, manifest: dict, wanted: set[int] | None = None) -> list[str]:
        return [f"{self.path}/data/{f}/part={p}" for p, f in manifest["parts"].items() if wanted is None or int(p) in wanted]

    def _rows(self, manifest: dict, wanted: set[int] | None = None) -> DataFrame:
        folders = self._folders(manifest, wanted)
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of the newest version, or of an older one that is still kept."""
        return self._rows(self.manifest(version))

    def near(self, rows: DataFrame) -> DataFrame:
        """The table's rows in the parts that the keys of ``rows`` fall in; other parts are not read."""
        return self._rows(self.manifest(), self._touched(rows))

    def _touched(self, rows: DataFrame) -> set[int]:
        found = rows.filter(F.col(self.key).isNotNull()).select(self.part_of().alias("part")).distinct()
        return {r["part"] for r in found.collect()}  # at most ``parts`` numbers

    def applied(self, job: str) -> int:
        """The last number that a job has committed; -1 before the first."""
        return self.manifest()["applied"].get(job, -1)

    def output(self, path: str, schema: str) -> DataFrame:
        """What jobs have written to ``path``/batch=n, for the numbers n that ``path`` has committed here."""
        jvm, done = self.spark._jvm, self.applied(path)
        where = jvm.org.apache.hadoop.fs.Path(path)
        store = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [e.getPath().getName() for e in store.listStatus(where)] if store.exists(where) else []
        numbers = [int(n.removeprefix("batch=")) for n in names if n.startswith("batch=")]
        folders = [f"{path}/batch={n}" for n in sorted(numbers) if n <= done]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def upsert(self, changes: DataFrame, resolve: Resolve, job: str = "", number: int | None = None, tries: int = 5) -> int:
        """Bring ``changes`` in and return the version that holds them.

        ``resolve(old, changes)`` gives the new rows of the touched parts from their old rows and the changes; rows with a NULL
        key are left out. A ``number`` that ``job`` has committed before, or one below it, changes nothing. ``changes`` is
        read several times.
        """
        changes = changes.filter(F.col(self.key).isNotNull())
        touched = self._touched(changes)
        for _ in range(tries):
            old = self.manifest()
            if number is not None and old["applied"].get(job, -1) >= number:
                return old["version"]
            version, parts = old["version"] + 1, dict(old["parts"])
            if touched:
                folder = f"{version:020d}-{self.spark._jvm.java.util.UUID.randomUUID().toString()}"
                new = resolve(self._rows(old, touched), changes).select(*self.schema.names)
                new.withColumn("part", self.part_of()).hint("rebalance", "part").write.partitionBy("part").parquet(f"{self.path}/data/{folder}")
                parts = {p: f for p, f in parts.items() if int(p) not in touched} | {str(p): folder for p in sorted(self._parts_below("data", folder))}
            applied = old["applied"] | ({job: number} if number is not None else {})
            if self._commit({"version": version, "parts": parts, "applied": applied}):
                self._forget()
                return version
        raise RuntimeError(f"other writers kept changing {self.path}")

    def _parts_below(self, *below: str) -> set[int]:
        store, where = self._store(*below)
        names = [entry.getPath().getName() for entry in store.listStatus(where)]
        return {int(n.removeprefix("part=")) for n in names if n.startswith("part=")}

    def _forget(self) -> None:
        """Drop manifests beyond the newest ``keep``, and data of their time that none of the kept ones refers to."""
        found = self.versions()
        kept, old = found[-self.keep:], found[:-self.keep]
        for v in old:
            store, where = self._store("manifest", f"{v:020d}.json")
            store.delete(where, False)
        used = {f for k in kept for f in self.manifest(k)["parts"].values()}
        store, where = self._store("data")
        for entry in store.listStatus(where) if store.exists(where) else []:
            name = entry.getPath().getName()
            if name not in used and int(name.split("-")[0]) <= kept[0]:
                store.delete(entry.getPath(), True)
