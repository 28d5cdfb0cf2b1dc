"""Versioned Parquet folders: an index of several tables is published at once."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm.org.apache.hadoop.fs.Path


def versions(spark: SparkSession, root: str) -> list[int]:
    """Versions that were written whole, ascending; none where the folder is missing."""
    fs, p, make = _fs(spark, root)
    if not fs.exists(p):
        return []
    found = [int(m[1]) for s in fs.listStatus(p) if (m := re.fullmatch(r"v=(\d+)", s.getPath().getName()))]
    return sorted(v for v in found if fs.exists(make(f"{root}/v={v}/_PUBLISHED")))


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame], per_file: int = 0) -> int:
    """Write all tables as the next version; readers see it when its marker exists, so never in part."""
    fs, _, make = _fs(spark, root)
    v = max([0, *versions(spark, root)]) + 1
    fs.delete(make(f"{root}/v={v}"), True)  # what a failed run left
    for name, df in tables.items():
        w = df.write.mode("overwrite")
        (w.option("maxRecordsPerFile", per_file) if per_file else w).parquet(f"{root}/v={v}/{name}")
    fs.create(make(f"{root}/v={v}/_PUBLISHED"), True).close()
    return v


def read(spark: SparkSession, root: str, name: str, version: int | None = None) -> DataFrame:
    """A table of the newest (or the named) version; an error where nothing was published."""
    have = versions(spark, root)
    if not have or (version is not None and version not in have):
        raise FileNotFoundError(f"no published version {version or ''} in {root}")
    return spark.read.parquet(f"{root}/v={version or have[-1]}/{name}")


def drop_versions(spark: SparkSession, root: str, keep: int = 1) -> dict[int, bool]:
    """Delete all but the newest ``keep`` versions; {version: deleted}."""
    fs, _, make = _fs(spark, root)
    have = versions(spark, root)
    return {v: bool(fs.delete(make(f"{root}/v={v}"), True)) for v in have[: len(have) - keep if keep else None]}


def artifacts(spark: SparkSession, root: str) -> DataFrame:
    """(name, files, bytes, modified) of the tables of the newest version, from file metadata only."""
    have = versions(spark, root)
    if not have:
        return spark.createDataFrame([], "name string, files long, bytes long, modified timestamp")
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(f"{root}/v={have[-1]}")
    return f.groupBy(F.regexp_extract("path", r"/v=\d+/([^/]+)/", 1).alias("name")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"), F.max("modificationTime").alias("modified"))


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def replace_books(df: DataFrame, path: str) -> None:
    """Overwrite the book_id partitions that ``df`` has; others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("book_id").parquet(path)


def catalogue(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """(name, rows, columns) of the given tables."""
    one = [df.agg(F.count("*").alias("rows")).select(F.lit(n).alias("name"), "rows", F.lit(",".join(df.columns)).alias("columns")) for n, df in tables.items()]
    out = one[0]
    for x in one[1:]:
        out = out.unionByName(x)
    return out


def missing(wanted: list[str], have: list[str]) -> list[str]:
    return [w for w in wanted if w not in set(have)]
