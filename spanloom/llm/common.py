"""Helpers that several corpus operators share."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
BATCH_BYTES = 8 << 20  # of an Arrow batch between the JVM and a worker
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session without that setting (a unit test) gets a temporary folder of its own; a
    cluster without it is an error, since executors share no local folder.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint()


def texts(column: pa.Array) -> list[str]:
    """A string column as Python strings, null as the empty string."""
    return [t or "" for t in column.to_pylist()]


def map_texts(df: DataFrame, scan: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` for rows with whole texts, in batches of ``BATCH_BYTES`` and a row at most.

    The JVM of an executor and each worker hold a batch or two of each task; Spark's 10 000 rows or 64 MB would
    be most of a worker's memory. The bound is a setting of the session; a lower one stays.
    """
    conf = df.sparkSession.conf
    number, unit = re.fullmatch(r"\s*(-?\d+)\s*([kmgtp]?)i?b?\s*", conf.get(BATCH_SETTING).lower()).groups()
    if not 0 < int(number) << (10 * " kmgtp".index(unit or " ")) <= BATCH_BYTES:
        conf.set(BATCH_SETTING, f"{BATCH_BYTES}b")
    return df.mapInArrow(scan, schema)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``: bounds what a worker holds unpacked."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
