"""Shared plumbing: the shared scratch folder, written cut points, and Arrow batch helpers."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`; where it is unset, an own one in local mode alone."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        found = _OWN[app] = _OWN.get(app) or f"file://{tempfile.mkdtemp(prefix='panelwright-')}"
    return found.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/panelwright/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """Cut the lineage: write `df` as Parquet to the shared folder and read it back. Survives lost executors.

    Shuffle files of what was written go as soon as the driver has collected its garbage, which it is asked to here:
    else they would lie on the disk until its heap happens to be full.
    """
    spark = df.sparkSession
    path = scratch(spark, what)
    df.write.parquet(path)
    spark._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out._panelwright_path = path
    return out


def drop_written(df: DataFrame) -> None:
    """Delete what written() stored, once nothing reads it any more."""
    if path := getattr(df, "_panelwright_path", None):
        spark = df.sparkSession
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the values of `column` take about `most_bytes` at a time; a longer value stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = size = 0
        for i, n in enumerate(lengths):
            if size and size + n > most_bytes:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        yield batch.slice(start)


def tidied(f: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """`f` over a task's batches; what it held is freed and given back when the task is done."""

    def run(batches: Iterator) -> Iterator:
        yield from f(batches)
        tidy()

    return run


def keep_where(docs: DataFrame, judge: Callable[[], Callable[[list], np.ndarray]], most_bytes: int) -> DataFrame:
    """The rows of `docs`, with all their columns, whose text is kept by a judge that each task makes for itself.

    Only texts go to Python, a slice of about `most_bytes` being judged at a time, and only booleans come back.
    """

    def verdicts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kept = judge()
        for texts in batches:
            batch = pa.RecordBatch.from_arrays([texts], ["text"])
            yield pa.array(np.concatenate([np.zeros(0, bool), *(kept(part.column("text").to_pylist()) for part in slices(iter([batch]), "text", most_bytes))]))

    @F.arrow_udf("boolean")
    def keeps(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from tidied(verdicts)(batches)

    return docs.where(keeps(docs["text"]))


def tidy() -> None:
    """Give a worker's free memory back to the system: workers are kept between tasks, and several kinds of them at once."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


try:
    _TRIM = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):  # another C library
    _TRIM = None
