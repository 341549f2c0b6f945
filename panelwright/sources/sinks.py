"""Sinks: committed tables by suffix, with a sidecar that names rows and an order-free hash of them."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def content_hash(df: DataFrame) -> DataFrame:
    """rows, content_hash: a sum of row hashes, whatever the order of rows."""
    row = F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in sorted(df.columns)])
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(row.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("content_hash"))


def write_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Parquet, JSON lines or gzipped CSV by the path's suffix; the committer makes the result appear whole."""
    writer = df.write.mode(mode)
    if path.endswith((".csv", ".csv.gz")):
        writer.csv(path, header=True, compression="gzip" if path.endswith(".gz") else "none")
    elif path.endswith((".json", ".jsonl")):
        writer.json(path)
    else:
        writer.parquet(path)


def write_with_sidecar(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write, and name rows and hash beside the table as it can be read again (CSV holds no difference of null and empty)."""
    write_table(df, path, mode)
    reader = df.sparkSession.read.schema(df.schema)
    back = reader.csv(path, header=True) if path.endswith((".csv", ".csv.gz")) else reader.json(path) if path.endswith((".json", ".jsonl")) else reader.parquet(path)
    content_hash(back).coalesce(1).write.mode("overwrite").json(f"{path}.manifest")


def append_journal(df: DataFrame, path: str) -> None:
    """Terminal records of attempts, appended."""
    df.write.mode("append").json(path)


def _bundle_hash(record: dict) -> str:
    return hashlib.sha256(json.dumps(record, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def write_bundle(tables: dict[str, DataFrame], path: str, config: dict, parents: tuple[str, ...] = ()) -> str:
    """Tables of one run, each in its folder under `path`, and a status record, which comes last; returns its hash.

    The hash covers the configuration, every table's rows and content as read back, and the hashes of the bundles it
    rests on, which are verified first. A table that exists already is never overwritten.
    """
    if not tables:
        raise ValueError("a bundle needs a table")
    spark = next(iter(tables.values())).sparkSession
    record = {"config": config, "parents": {p: verify_bundle(spark, p) for p in parents}, "tables": {}}
    for name, df in sorted(tables.items()):
        write_table(df, f"{path}/{name}")
        record["tables"][name] = content_hash(spark.read.schema(df.schema).parquet(f"{path}/{name}")).first().asDict()
    digest = _bundle_hash(record)
    spark.createDataFrame([(json.dumps(record), digest)], "record string, hash string").coalesce(1).write.json(f"{path}/status")
    return digest


def verify_bundle(spark: SparkSession, path: str) -> str:
    """The bundle's hash, if its tables, its record and the bundles it rests on are still what was written."""
    status = spark.read.schema("record string, hash string").json(f"{path}/status").first()
    record = json.loads(status["record"])
    if _bundle_hash(record) != status["hash"]:
        raise ValueError(f"{path}: the record doesn't have the hash it was written with")
    for name, stated in record["tables"].items():
        if content_hash(spark.read.parquet(f"{path}/{name}")).first().asDict() != stated:
            raise ValueError(f"{path}: table {name} has changed")
    for parent, stated in record["parents"].items():
        if verify_bundle(spark, parent) != stated:
            raise ValueError(f"{path}: {parent} is another bundle now")
    return status["hash"]
