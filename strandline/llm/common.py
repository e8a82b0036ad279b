"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

ROWS_PER_BATCH = 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS_PER_BATCH) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows, so that a Python task works on a bounded piece; Spark itself bounds their bytes."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a local one only where driver and executors are one process."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return given or tempfile.mkdtemp(prefix="spark-")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a table written to the shared folder. (A checkpoint would carry the plan's constraints on, which multiply in loops.)"""
    path = f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each value, null as empty."""
    return pc.fill_null(pc.cast(column, pa.binary()), b"").to_pylist()


def word_table(extra: bytes = b"") -> bytes:
    """bytes.translate table: A-Z to a-z; digits, a-z, bytes of non-ASCII characters and ``extra`` stay; the rest become a space."""
    keep = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100)) | set(extra)
    return bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in keep else 0x20 for b in range(256))
