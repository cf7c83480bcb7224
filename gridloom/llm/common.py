"""What the operators of this folder share: tables, scratch space, Arrow batches, size checks."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.sources.scratch import delete_quietly, materialise, scratch_path  # noqa: F401  for the operators

#: A side is broadcast only if its measured bytes stay below this; beyond it the join shuffles.
BROADCAST_LIMIT = 48 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship_package(spark: SparkSession) -> None:
    """Give Python workers this package, unless their path has it already."""
    package = Path(__file__).resolve().parents[1]
    if str(package.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(spark.sparkContext, "_gridloom_shipped", False):
        return
    held = tempfile.mkdtemp(prefix="gridloom-package-")
    atexit.register(shutil.rmtree, held, True)
    with zipfile.ZipFile(f"{held}/gridloom.zip", "w") as z:
        for source in package.rglob("*.py"):
            z.write(source, source.relative_to(package.parent))
    spark.sparkContext.addPyFile(f"{held}/gridloom.zip")
    spark.sparkContext._gridloom_shipped = True


def small_arrow_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds, in rows and bytes, so that long texts don't pile up in a worker."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(24 << 20))


def bytes_at(spark: SparkSession, path: str) -> int:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(target).getLength()


def checked_join(left: DataFrame, right: DataFrame, path: str, on: str | list[str], how: str = "inner") -> DataFrame:
    """Join with a table written at path: broadcast if its bytes stay small, else by a shuffle whose skew Spark splits."""
    small = 4 * bytes_at(left.sparkSession, path) < BROADCAST_LIMIT
    return left.join(F.broadcast(right) if small else right, on, how)


def packed_texts(documents: DataFrame, key: str) -> DataFrame:
    """(key, packed): each key's text, compressed; once for each scan task at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        seen: set[bytes] = set()
        press = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            keys, texts = [], []
            for k, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1))):
                if k not in seen:
                    seen.add(k)
                    keys.append(k)
                    texts.append(press(text))
            if len(seen) > 200_000:
                seen.clear()
            yield pa.record_batch([pa.array(keys, pa.binary()), pa.array(texts, pa.binary())], [key, "packed"])

    return documents.select(key, "text").mapInArrow(run, f"{key} binary, packed binary")


def slices(sizes, limit: int) -> Iterator[tuple[int, int]]:
    """Cut a list of sizes into runs [i, j) whose sum stays under limit, one item at least."""
    i = total = 0
    for j, size in enumerate(sizes):
        if j > i and total + size > limit:
            yield i, j
            i, total = j, 0
        total += size
    if i < len(sizes):
        yield i, len(sizes)


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
