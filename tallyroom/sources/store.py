"""Tables that change as a whole: data is written beside what stands, then one manifest takes the place of the last.

A store is a folder of Parquet files and numbered manifests.  A manifest names, table by table and bucket by bucket, the
folders that count; readers see the files of one manifest and no others.  A change writes its files first and then
publishes the next number, which only one writer can take: a writer that dies before leaves the old tables whole, and
one that comes second starts again from what the first left.  An upsert rewrites the buckets of the keys that it
touches, not the table.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKET = "__bucket"


class Conflict(RuntimeError):
    """Another writer has published the version that was to follow."""


class Transaction:
    """Tables as of one version, and what is to be changed; files that it writes count once it is committed."""

    def __init__(self, store: Store, version: int, manifest: dict) -> None:
        self.store, self.version, self.manifest = store, version, manifest

    def create(self, name: str, schema: T.StructType | str, key: list[str], buckets: int = 16) -> None:
        """A table, if there is none of that name; its rows are dealt to buckets by a hash of the key."""
        kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        self.manifest["tables"].setdefault(name, {"schema": kind.json(), "key": key, "buckets": buckets, "files": {}})

    def read(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        table = self.manifest["tables"][name]
        files = [f for b, some in table["files"].items() if buckets is None or int(b) in buckets for f in some]
        schema = T.StructType.fromJson(json.loads(table["schema"]))
        spark = self.store.spark
        return spark.read.schema(schema).parquet(*[f"{self.store.path}/{f}" for f in files]) if files else spark.createDataFrame([], schema)

    def append(self, name: str, rows: DataFrame) -> None:
        for bucket, folder in self._write(name, rows).items():
            self.manifest["tables"][name]["files"].setdefault(bucket, []).append(folder)

    def replace(self, name: str, rows: DataFrame) -> None:
        """All rows of the table are these."""
        self.manifest["tables"][name]["files"] = {b: [f] for b, f in self._write(name, rows).items()}

    def upsert(self, name: str, changes: DataFrame, order: list[str], gone: str | None = None) -> None:
        """One row a key, the one of the largest ``order``; of equal ones the changed row.  ``gone``: a column of the changes, true where the key's row is to go.

        Rewrites the buckets of the changed keys.
        """
        table = self.manifest["tables"][name]
        key, columns = table["key"], T.StructType.fromJson(json.loads(table["schema"])).names
        files = table["files"]
        delta = self._bucketed(changes.select(*columns, (F.col(gone) if gone else F.lit(False)).alias("__gone")), table)
        # at most as many as the table has buckets
        touched = [r[0] for r in delta.select(BUCKET).distinct().collect()]
        old = self.read(name, touched).withColumns({"__gone": F.lit(False), "__side": F.lit(0)})
        both = old.unionByName(delta.drop(BUCKET).withColumn("__side", F.lit(1)))
        rest = [c for c in columns if c not in key]
        last = both.groupBy(*key).agg(F.max_by(F.struct(*rest, "__gone"), F.struct(*order, "__side")).alias("r")).where("NOT r.__gone")
        written = self._write(name, last.select(*[F.col(c) if c in key else F.col(f"r.{c}").alias(c) for c in columns]))
        for b in map(str, touched):
            files.pop(b, None)
        files.update({b: [f] for b, f in written.items()})

    def _bucketed(self, rows: DataFrame, table: dict) -> DataFrame:
        return rows.withColumn(BUCKET, F.pmod(F.xxhash64(*table["key"]), F.lit(table["buckets"])).cast("int"))

    def _write(self, name: str, rows: DataFrame) -> dict[str, str]:
        """{bucket: folder} of the rows; a bucket's files are few, and a large bucket is written by many tasks."""
        table = self.manifest["tables"][name]
        names = T.StructType.fromJson(json.loads(table["schema"])).names
        folder = f"data/{name}-{uuid.uuid4().hex}"
        self._bucketed(rows.select(*names), table).hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(f"{self.store.path}/{folder}")
        return {d.split("=")[1]: f"{folder}/{d}" for d in self.store._children(folder) if d.startswith(BUCKET)}


class Store:
    """Tables in a folder that Spark can reach, with versions.  Reading and writing need no lock."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._children("manifests") if n.endswith(".json"))

    def transaction(self, version: int | None = None) -> Transaction:
        """The tables as of a version, the last by default."""
        known = self.versions()
        at = version if version is not None else known[-1] if known else 0
        return Transaction(self, at, json.loads(self._load(f"manifests/{at:012d}.json")) if at else {"tables": {}, "ledger": {}})

    def read(self, name: str, version: int | None = None) -> DataFrame:
        return self.transaction(version).read(name)

    def transact(self, change: Callable[[Transaction], None], writer: str | None = None, batch: int | None = None, tries: int = 5) -> bool:
        """Runs ``change`` on the last version and publishes the next; again from the start if another writer was first.

        writer, batch: a batch of a writer that has already counted, or an earlier one, is left out: then False.  The
        ledger is in the manifest, so a batch and the note that it counted are published together.
        """
        for _ in range(tries):
            tx = self.transaction()
            if writer is not None and batch is not None:
                if batch <= tx.manifest["ledger"].get(writer, -1):
                    return False
                tx.manifest["ledger"][writer] = batch
            change(tx)
            try:
                self._publish(tx.version + 1, tx.manifest)
            except Conflict:
                continue
            return True
        raise Conflict(f"{self.path}: {tries} attempts met other writers")

    def vacuum(self, keep: int = 2) -> int:
        """Deletes data folders that the last ``keep`` manifests don't name, and older manifests; how many folders.

        Not while a writer is between its files and its manifest.
        """
        known = self.versions()
        manifests = [self.transaction(v).manifest for v in known[-keep:]]
        named = {f.split("/")[1] for m in manifests for t in m["tables"].values() for some in t["files"].values() for f in some}
        old = [d for d in self._children("data") if d not in named]
        for f in [*[f"data/{d}" for d in old], *[f"manifests/{v:012d}.json" for v in known[:-keep]]]:
            self._fs().delete(self._at(f), True)
        return len(old)

    # --- files, by the file system of the folder

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _fs(self):
        return self._at("x").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _children(self, name: str) -> list[str]:
        return [s.getPath().getName() for s in self._fs().listStatus(self._at(name))] if self._fs().exists(self._at(name)) else []

    def _load(self, name: str) -> str:
        stream = self._fs().open(self._at(name))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _publish(self, version: int, manifest: dict) -> None:
        """Written under another name, then renamed to its number, which fails if that exists."""
        from py4j.protocol import Py4JJavaError

        jvm = self.spark._jvm
        new, final = self._at(f"manifests/.{uuid.uuid4().hex}"), self._at(f"manifests/{version:012d}.json")
        stream = self._fs().create(new, False)
        stream.write(json.dumps(manifest).encode())
        stream.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(new, final, none)
        except Py4JJavaError as failed:
            self._fs().delete(new, False)
            if "FileAlreadyExists" in str(failed.java_exception):
                raise Conflict(f"version {version} of {self.path}") from failed
            raise
