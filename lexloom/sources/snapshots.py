"""Tables with atomic changes: immutable files, and a manifest for each version that appears in one rename.

A table is a folder with ``data/`` (a folder of Parquet files a change, never written again) and ``versions/`` (one JSON manifest a
version). Rows are dealt to buckets by a hash of their key; a manifest names for each bucket the data folder that holds it. A change
rewrites the buckets that hold its keys, and no other, into a new folder; then its manifest is renamed into place. Until that rename
every reader sees the version before; a writer that dies before it leaves files that no manifest names (``vacuum`` deletes them); of two writers
that start from the same version one finds the next number taken and raises ``Conflict``, and may try again.

A reader is pinned to the version it asked for (or the newest there was), whatever is written meanwhile.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

_BUCKET = "__bucket"


class Conflict(RuntimeError):
    """Another writer has made the next version."""


class Snapshots:
    """A keyed table at ``path``; ``keys`` are the columns by which rows are replaced and deleted."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm.org.apache.hadoop.fs  # Spark's own readers and writers have no rename
        self._at = jvm.Path
        self._files = jvm.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # versions

    def versions(self) -> list[int]:
        """The numbers of all versions, oldest first."""
        folder = self._at(f"{self.path}/versions")
        if not self._files.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._files.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith("."))

    def manifest(self, version: int | None = None) -> dict:
        found = self.versions()
        if not found or version is not None and version not in found:
            raise LookupError(f"{self.path} has no version {'' if version is None else version}".rstrip())
        at = self._at(f"{self.path}/versions/{found[-1] if version is None else version:020d}.json")
        stream = self._files.open(at)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, manifest: dict) -> int:
        """One rename makes the version visible; it fails where the number is taken."""
        final = self._at(f"{self.path}/versions/{manifest['version']:020d}.json")
        draft = self._at(f"{self.path}/versions/.{uuid.uuid4().hex}")
        stream = self._files.create(draft, False)
        try:
            stream.write(bytearray(json.dumps(manifest).encode()))
        finally:
            stream.close()
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri() if final.toUri().getScheme() else self._files.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            none = self.spark._sc._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
            context.rename(draft, final, none)
        except Exception as error:
            self._files.delete(draft, False)
            if "already exists" in str(error) or "FileAlreadyExists" in str(error):
                raise Conflict(f"version {manifest['version']} of {self.path} was made by another writer") from error
            raise
        return manifest["version"]

    # changes

    def _bucket(self, keys: list[str], buckets: int):
        return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")

    def _write(self, rows: DataFrame, keys: list[str], buckets: int) -> str:
        """A new data folder, a partition a bucket. Rows are dealt by bucket and salt, so that one key with most rows is not one task."""
        name = uuid.uuid4().hex
        salted = rows.withColumn(_BUCKET, self._bucket(keys, buckets)).repartition(_BUCKET, F.pmod(F.xxhash64(*rows.columns), F.lit(8)))
        salted.write.partitionBy(_BUCKET).parquet(f"{self.path}/data/{name}")
        return name

    def create(self, rows: DataFrame, keys: list[str], buckets: int = 16) -> int:
        """The first version (or a new one with all rows replaced)."""
        found = self.versions()
        name = self._write(rows, keys, buckets)
        return self._commit({"version": found[-1] + 1 if found else 1, "keys": keys, "buckets": buckets, "schema": rows.schema.json(), "holds": {str(b): name for b in range(buckets)}})

    def _change(self, gone: DataFrame, rows: DataFrame | None, base: int | None) -> int:
        before = self.manifest(base)
        keys, buckets = before["keys"], before["buckets"]
        touched = [r[0] for r in gone.select(self._bucket(keys, buckets)).distinct().collect()]  # at most ``buckets`` numbers
        if not touched:
            return before["version"]
        names = gone.select(*(F.col(k).alias(f"__gone_{k}") for k in keys)).distinct()
        same = None
        for k in keys:
            one = F.col(k).eqNullSafe(F.col(f"__gone_{k}"))
            same = one if same is None else same & one
        after = self._read(before, touched).join(names, same, "left_anti")
        if rows is not None:
            after = after.unionByName(rows.select(*after.columns))
        name = self._write(after, keys, buckets)
        return self._commit(before | {"version": before["version"] + 1, "holds": before["holds"] | {str(b): name for b in touched}})

    def replace(self, rows: DataFrame, base: int | None = None) -> int:
        """All rows whose key is in ``rows`` give way to ``rows``; other rows stay. With one row a key this is an upsert."""
        return self._change(rows, rows, base)

    def delete(self, gone: DataFrame, base: int | None = None) -> int:
        """All rows whose key is in ``gone`` go."""
        return self._change(gone, None, base)

    # reading

    def _read(self, manifest: dict, buckets: list[int] | None = None) -> DataFrame:
        schema = StructType.fromJson(json.loads(manifest["schema"]))
        folders: dict[str, list[int]] = {}
        for b, name in manifest["holds"].items():
            if buckets is None or int(b) in buckets:
                folders.setdefault(name, []).append(int(b))
        out = self.spark.createDataFrame([], schema)
        for name, own in sorted(folders.items()):
            part = self.spark.read.schema(StructType([*schema.fields, StructField(_BUCKET, IntegerType())])).parquet(f"{self.path}/data/{name}")
            out = out.unionByName(part.filter(F.col(_BUCKET).isin(own)).drop(_BUCKET))
        return out

    def read(self, version: int | None = None, key: dict | None = None) -> DataFrame:
        """The rows of a version (the newest). With ``key`` (a value for each key column) only its bucket is read."""
        manifest = self.manifest(version)
        if key is None:
            return self._read(manifest)
        literals = self.spark.range(1).select(*(F.lit(key[k]).cast(t).alias(k) for k, t in ((f.name, f.dataType) for f in StructType.fromJson(json.loads(manifest["schema"])).fields) if k in manifest["keys"]))
        bucket = literals.select(self._bucket(manifest["keys"], manifest["buckets"])).first()[0]
        found = self._read(manifest, [bucket])
        for k in manifest["keys"]:
            found = found.filter(F.col(k).eqNullSafe(F.lit(key[k])))
        return found

    def vacuum(self, keep: int = 2) -> list[str]:
        """Delete all but the newest ``keep`` versions, and the data folders that no version names. Not while others write."""
        old = self.versions()[:-keep]
        for v in old:
            self._files.delete(self._at(f"{self.path}/versions/{v:020d}.json"), False)
        used = {name for v in self.versions() for name in self.manifest(v)["holds"].values()}
        every = [s.getPath().getName() for s in self._files.listStatus(self._at(f"{self.path}/data"))]
        gone = [n for n in every if n not in used]
        for n in gone:
            self._files.delete(self._at(f"{self.path}/data/{n}"), True)
        return gone
