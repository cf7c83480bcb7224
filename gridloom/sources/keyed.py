"""Keyed tables: rows lie in buckets by a hash of their key, and an upsert rewrites the buckets that it touches.

A table's folder has a folder for each write, with one for each bucket in it, and manifests. A manifest is a version of the table: it names
the folder of every bucket. A write puts the new rows of touched buckets into a folder of its own, enters the next manifest, which fails if another
writer was first, and points the table's view at it by one ALTER VIEW. Readers of the view see one version, whole, and untouched buckets keep their files.
What breaks off before the manifest leaves the table as it was; what breaks off after it is finished by the next write.

Folders of the last ``KEEP`` versions stay for readers at work. A bucket's rows are read and written by as many tasks as its size asks for.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gridloom.operators.keys import duplicate_keys, latest_per_key
from gridloom.sources.scratch import delete_quietly, materialise

#: Of a table that an upsert creates, unless it asks for more: a large table wants as many as make a bucket a few GB.
BUCKETS = 16
KEEP = 2


class WrittenMeanwhile(Exception):
    """Another writer entered the version that this one was about to."""


@dataclass(frozen=True)
class Manifest:
    version: int
    keys: list[str]
    buckets: int
    schema: str
    folders: dict[str, str]  #: bucket to folder, below the table's


class Keyed:
    """The keyed table behind a view of this name."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name = spark, name
        *schema, table = name.replace("`", "").split(".")
        place = spark.catalog.getDatabase(".".join(f"`{s}`" for s in schema)).locationUri
        self.root = f"{place.rstrip('/')}/{table}.keyed"
        self._jvm = spark._jvm
        self._files = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, text: str):
        return self._jvm.org.apache.hadoop.fs.Path(text)

    def versions(self) -> list[int]:
        folder = self._path(f"{self.root}/manifests")
        if not self._files.exists(folder):
            return []
        return sorted(int(n.removesuffix(".json")) for s in self._files.listStatus(folder) if (n := s.getPath().getName()).endswith(".json") and not n.startswith("."))

    def manifest(self, version: int | None = None) -> Manifest | None:
        """A version, the newest by default; None where there is no table."""
        if version is None and not (there := self.versions()):
            return None
        stream = self._files.open(self._path(f"{self.root}/manifests/{there[-1] if version is None else version:010d}.json"))
        try:
            return Manifest(**json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        finally:
            stream.close()

    def enter(self, m: Manifest) -> None:
        """Make m the newest version: a file comes into being under its name whole, and only if there is none."""
        begun, done = self._path(f"{self.root}/manifests/.{uuid.uuid4().hex}"), self._path(f"{self.root}/manifests/{m.version:010d}.json")
        out = self._files.create(begun)
        out.write(bytearray(json.dumps(asdict(m)).encode()))
        out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(begun.getFileSystem(self.spark._jsc.hadoopConfiguration()).getUri(), self.spark._jsc.hadoopConfiguration())
        full = self._files.makeQualified
        try:
            context.rename(full(begun), full(done), self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as e:
            self._files.delete(begun, False)
            if "already exists" in str(e):
                raise WrittenMeanwhile(f"{self.name}: version {m.version} is there already") from None
            raise

    def point(self, m: Manifest) -> None:
        """The view shows m from now on."""
        schema = StructType.fromJson(json.loads(m.schema))
        if m.folders:
            columns = ", ".join(f"`{f.name}`" for f in schema)
            text = f"SELECT {columns} FROM parquet.`{self.root}/{{{','.join(sorted(set(m.folders.values())))}}}`"
        else:
            text = f"SELECT {', '.join(f'CAST(NULL AS {f.dataType.simpleString()}) AS `{f.name}`' for f in schema)} WHERE false"
        kind = self.kind()
        if kind == "VIEW":
            self.spark.sql(f"ALTER VIEW {self.name} AS {text}")
            return
        if kind:  # a plain table that becomes a keyed one, or did when a call broke off
            self.spark.sql(f"DROP TABLE {self.name}")
        self.spark.sql(f"CREATE VIEW {self.name} AS {text}")

    def kind(self) -> str | None:
        try:
            return "VIEW" if self.spark.catalog.getTable(self.name).tableType == "VIEW" else "TABLE"
        except AnalysisException as e:
            if e.getCondition() not in ("TABLE_OR_VIEW_NOT_FOUND", "SCHEMA_NOT_FOUND"):
                raise
            return None

    def rows(self, m: Manifest, buckets: Sequence[str] | None = None) -> DataFrame:
        """The rows of a version, or of some of its buckets, whose files alone are listed."""
        schema = StructType.fromJson(json.loads(m.schema))
        folders = [f"{self.root}/{f}" for b, f in m.folders.items() if buckets is None or b in buckets]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def forget(self, keep: int = KEEP) -> None:
        """Drop all versions but the last ones, and folders that only those named."""
        old, kept = self.versions()[:-keep], self.versions()[-keep:]
        used = {f for v in kept for f in self.manifest(v).folders.values()}
        for v in old:
            for folder in set(self.manifest(v).folders.values()) - used:
                delete_quietly(self.spark, f"{self.root}/{folder}")
            delete_quietly(self.spark, f"{self.root}/manifests/{v:010d}.json")

    def drop(self) -> None:
        if self.kind() == "VIEW":
            self.spark.sql(f"DROP VIEW {self.name}")
        delete_quietly(self.spark, self.root)


def is_keyed(spark: SparkSession, name: str) -> bool:
    t = Keyed(spark, name)
    return t.kind() == "VIEW" and bool(t.versions())


def upsert(spark: SparkSession, df: DataFrame, name: str, keys: Sequence[str], newest_first: Sequence[Column] | None = None, repeated: bool = False, buckets: int = BUCKETS) -> None:
    """Rows of df replace those with equal keys (null equals null) and join the others; nothing else is deleted.

    df is written once to scratch, and everything else reads that. With newest_first a key keeps the first row in that order, of df or of the
    table, so what arrives late doesn't overwrite what is newer. Without it keys that df repeats raise, unless repeated: then all rows of df with a key stand
    for it together, in place of all that the table has.
    """
    t = Keyed(spark, name)
    m = t.manifest()
    plain = spark.table(name) if m is None and t.kind() else None
    schema = StructType.fromJson(json.loads(m.schema)) if m else plain.schema if plain is not None else df.schema
    count = m.buckets if m else buckets
    typed = df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema))
    bucket = F.pmod(F.xxhash64(*keys), F.lit(count)).cast("int").alias("_bucket")
    given, path = materialise(typed.select("*", bucket), "upsert")
    try:
        if newest_first:
            given = latest_per_key(given, keys, newest_first)
        elif not repeated and not duplicate_keys(given, keys).limit(1).isEmpty():
            raise ValueError(f"{name}: rows to upsert repeat a key of {', '.join(keys)}")
        touched = [str(r[0]) for r in given.select("_bucket").distinct().collect()]  # no more than there are buckets
        old = (plain if plain is not None else t.rows(m, touched) if m else spark.createDataFrame([], schema)).select("*", bucket)
        if newest_first:
            out = latest_per_key(old.unionByName(given), keys, newest_first)
        else:
            same = reduce(lambda a, b: a & b, (F.col(f"t.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys))
            out = old.alias("t").join(given.select(*keys).alias("s"), same, "left_anti").select(*given.columns).unionByName(given)
        write = f"write-{uuid.uuid4().hex[:12]}"
        out.hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(f"{t.root}/{write}")
        if m and touched or m is None:
            written = {f.split("=")[1]: f"{write}/{f}" for s in t._files.listStatus(t._path(f"{t.root}/{write}")) if (f := s.getPath().getName()).startswith("_bucket=")}
            m = Manifest((m.version if m else 0) + 1, list(keys), count, schema.json(), (m.folders if m else {}) | written)
            t.enter(m)
        t.point(m)
        t.forget()
    finally:
        delete_quietly(spark, path)
