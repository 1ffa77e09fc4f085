"""Tables in versions: what a writer leaves counts as a whole, from the moment its manifest is there, or not at all.

Rows lie in folders that never change once written, and a version is a manifest, a small JSON file, of the folders that
belong to it. A commit writes its folders first and its manifest last, under the next number, by a rename that fails where
another writer took that number; then it is tried again on top of that one's version. So two writers never lose or double
rows, a reader of a version sees it unchanged, and what a broken writer left is in no manifest.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

Rows = DataFrame | Callable[[dict[str, DataFrame]], DataFrame]


class Conflict(RuntimeError):
    """Another writer's version stands where this one was to go."""


@dataclass(frozen=True)
class Store:
    """Tables under a path that all executors share."""

    spark: SparkSession
    path: str

    # The folder of manifests.

    def _files(self):
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        return hadoop, hadoop.Path(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The last version, 0 before the first."""
        hadoop, fs = self._files()
        folder = hadoop.Path(posixpath.join(self.path, "manifests"))
        if not fs.exists(folder):
            return 0
        names = [f.getPath().getName() for f in fs.listStatus(folder)]
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith((".", "_"))), default=0)

    def manifest(self, version: int | None = None) -> dict:
        """version, parts (table, path, version) and tags of a version, the last unless told."""
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "parts": [], "tags": []}
        return json.loads(self.spark.read.text(posixpath.join(self.path, "manifests", f"{version}.json"), wholetext=True).first()[0])

    def _publish(self, manifest: dict) -> None:
        hadoop, fs = self._files()
        jvm = self.spark.sparkContext._jvm
        made = hadoop.Path(posixpath.join(self.path, "manifests", f".{uuid.uuid4().hex}"))
        out = fs.create(made, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        final = hadoop.Path(posixpath.join(self.path, "manifests", f"{manifest['version']}.json"))
        none = self.spark.sparkContext._gateway.new_array(getattr(jvm, "org.apache.hadoop.fs.Options$Rename"), 1)
        none[0] = getattr(jvm, "org.apache.hadoop.fs.Options$Rename").NONE
        context = hadoop.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(fs.makeQualified(made), fs.makeQualified(final), none)
        except Exception as e:
            fs.delete(made, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {manifest['version']} of {self.path} is another writer's") from e
            raise

    # Reading.

    def parts(self, table: str, version: int | None = None) -> list[dict]:
        return [p for p in self.manifest(version)["parts"] if p["table"] == table]

    def _read(self, parts: list[dict]) -> DataFrame:
        """Rows of parts, with the version that each was committed in."""
        rows = self.spark.read.parquet(*[posixpath.join(self.path, p["path"]) for p in parts])
        known = self.spark.createDataFrame([(p["path"], p["version"]) for p in parts], "__part string, __version long")
        return rows.join(F.broadcast(known), "__part").drop("__part")  # a row a part, of which compaction leaves one

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """All rows of a table, as appended."""
        if not (parts := self.parts(table, version)):
            raise ValueError(f"{self.path} has no table {table}")
        return self._read(parts).drop("__version")

    def latest(self, table: str, key: str, version: int | None = None) -> DataFrame:
        """The row of each key that was committed last."""
        if not (parts := self.parts(table, version)):
            raise ValueError(f"{self.path} has no table {table}")
        return self._latest(self._read(parts), key).drop("__version")

    def _latest(self, rows: DataFrame, key: str) -> DataFrame:
        rest = [c for c in rows.columns if c not in (key, "__version")]
        last = rows.groupBy(key).agg(F.max_by(F.struct(*rest, "__version"), "__version").alias("r"))
        return last.select(*[F.col(key) if c == key else F.col(f"r.{c}").alias(c) for c in rows.columns])

    # Writing.

    def _write(self, tables: dict[str, Rows], folder: str) -> list[dict]:
        """Folders of tables; one that is a function is made of those before it as they were written."""
        parts, written = [], {}
        for table, rows in tables.items():
            rows = rows(written) if callable(rows) else rows
            path = posixpath.join("data", folder, table)
            rows.withColumn("__part", F.lit(path)).write.mode("overwrite").option("compression", "zstd").parquet(posixpath.join(self.path, path))
            written[table] = self.spark.read.schema(rows.schema).parquet(posixpath.join(self.path, path))
            parts.append({"table": table, "path": path})
        return parts

    def commit(self, tables: dict[str, Rows], tag: str | None = None, base: int | None = None, tries: int = 20) -> int:
        """Appends rows to tables, to all or to none, and returns the version.

        A tag that a version has is not written again; what a broken writer left under it is overwritten. With base, a version
        of another writer since then is a Conflict; without, this one goes on top.
        """
        now = self.manifest()
        if tag is not None and tag in now["tags"]:
            return now["version"]
        parts = self._write(tables, uuid.uuid4().hex if tag is None else tag)
        return self._add(parts, tag, base, tries)

    def _add(self, parts: list[dict], tag: str | None = None, base: int | None = None, tries: int = 20) -> int:
        for _ in range(tries):
            now = self.manifest(base)
            if tag is not None and tag in now["tags"]:
                return now["version"]
            version = now["version"] + 1
            try:
                self._publish({"version": version, "parts": now["parts"] + [p | {"version": version} for p in parts], "tags": now["tags"] + ([tag] if tag is not None else [])})
                return version
            except Conflict:
                if base is not None:
                    raise
        raise Conflict(f"{tries} writers were faster at {self.path}")

    def upsert(self, table: str, rows: DataFrame, key: str, order: str | None = None) -> int:
        """Commits one row a key, the greatest by order, and by all columns where that is equal: from now on the key's latest."""
        rest = [c for c in rows.columns if c != key]
        one = rows.groupBy(key).agg(F.max(F.struct(*([F.col(order).alias("__order")] if order else []), *rest)).alias("r"))
        return self.commit({table: one.select(*[F.col(key) if c == key else F.col(f"r.{c}").alias(c) for c in rows.columns])})

    def insert_new(self, table: str, rows: DataFrame, key: str, tries: int = 20) -> int:
        """Commits the rows whose key isn't there yet, the least of each key; keys that another writer commits meanwhile are his."""
        rest = [c for c in rows.columns if c != key]
        one = rows.groupBy(key).agg(F.min(F.struct(*rest)).alias("r")).select(*[F.col(key) if c == key else F.col(f"r.{c}").alias(c) for c in rows.columns])
        seen: set[str] = set()
        for _ in range(tries):
            base = self.version()
            fresh = [p for p in self.parts(table, base) if p["path"] not in seen]
            seen |= {p["path"] for p in fresh}
            if fresh:
                one = one.join(self._read(fresh).select(key), key, "left_anti")
            parts = self._write({table: one}, uuid.uuid4().hex)
            one = self.spark.read.parquet(posixpath.join(self.path, parts[0]["path"])).drop("__part")
            try:
                return self._add(parts, base=base)
            except Conflict:
                continue
        raise Conflict(f"{tries} writers were faster at {self.path}")

    def compact(self, table: str, key: str | None = None, tries: int = 20) -> int:
        """Puts a table's parts into one, with a key its latest rows alone; parts committed meanwhile stay as they are."""
        now = self.manifest()
        old = [p for p in now["parts"] if p["table"] == table]
        if len(old) < 2:
            return now["version"]
        rows = self._read(old)
        rows = (self._latest(rows, key) if key else rows).drop("__version")
        new = self._write({table: rows}, uuid.uuid4().hex)[0] | {"version": max(p["version"] for p in old)}
        gone = {p["path"] for p in old}
        for _ in range(tries):
            now = self.manifest()
            if not gone <= {p["path"] for p in now["parts"]}:
                raise Conflict("another writer compacted the same parts")
            try:
                self._publish({"version": now["version"] + 1, "parts": [new] + [p for p in now["parts"] if p["path"] not in gone], "tags": now["tags"]})
                return now["version"] + 1
            except Conflict:
                continue
        raise Conflict(f"{tries} writers were faster at {self.path}")

    def clean(self, keep: int = 1) -> list[str]:
        """Deletes folders that none of the last `keep` versions has, when nobody writes: those of older versions alone and those
        that broken writers left. Returns their names; older versions can't be read from then on."""
        hadoop, fs = self._files()
        last = self.version()
        used = {posixpath.dirname(p["path"]).split("/", 1)[1] for v in range(max(1, last - keep + 1), last + 1) for p in self.manifest(v)["parts"]}
        folder = hadoop.Path(posixpath.join(self.path, "data"))
        found = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
        gone = sorted(n for n in found if n not in used)
        for name in gone:
            fs.delete(hadoop.Path(posixpath.join(self.path, "data", name)), True)
        return gone
