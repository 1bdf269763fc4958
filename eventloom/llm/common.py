"""Helpers that the text operators share: the shared folder, Arrow batches, hashing of words."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that the numpy helpers expand at a time; a longer document is a block of its own.
BLOCK_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir, or in local mode a temporary one where that is unset."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="eventloom-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with files in the shared folder, which outlive any executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, kind: str) -> str:
    """A new name in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate data, wherever Spark can write."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def written(df: DataFrame, kind: str) -> DataFrame:
    """The rows as Parquet files in the shared folder: smaller than a checkpoint, and as safe from lost executors."""
    path = scratch(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python, once an application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    top = Path(__file__).resolve().parents[1]
    path = os.path.join(tempfile.mkdtemp(prefix="eventloom-"), "eventloom_package.zip")
    with zipfile.ZipFile(path, "w") as out:
        for file in sorted(top.rglob("*.py")):
            out.write(file, file.relative_to(top.parent))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def blocks(batches: Iterator[pa.RecordBatch], column: int = 1, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows with about ``limit`` bytes in a column; every row comes out once, whole."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        run = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            base = run[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(run, base + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


_LETTERS: np.ndarray | None = None


def letter_table() -> np.ndarray:
    """True at every code point that is a letter."""
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _LETTERS


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts, each followed by a line feed, and the index of the text that each belongs to."""
    points = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    return points, np.repeat(np.arange(len(texts)), lengths)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over 64 bits."""
    x = x.astype(np.uint64)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def filter_rows(docs: DataFrame, verdict, limit: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` whose text ``verdict`` (list of texts to array of booleans) keeps; all columns stay, nothing is shuffled.

    The text of a row that is null is given as an empty one."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks(batches, at, limit):
            keep = verdict([x or "" for x in part.column(at).to_pylist()])
            yield part.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
