"""Session helpers: shared folder, lineage cuts, checked broadcasts."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as ``spark.checkpoint.dir`` names it.

    Where the session names none, a master on this machine alone gets a temporary folder; on a
    cluster that is an error, as its executors don't see the driver's disk.
    """
    sc = spark.sparkContext
    at = sc._jsc.sc().getCheckpointDir()
    if at.isDefined():
        return at.get()
    sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir") or _own_folder(sc.master))
    return sc._jsc.sc().getCheckpointDir().get()


def _own_folder(master: str) -> str:
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="quire-")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_staged: list[str] = []

#: Spark's setting by which an execution deletes its shuffle files when it ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def release(spark: SparkSession) -> int:
    """Delete the tables staged so far; results that were not written yet can't be read after it."""
    jvm, n = spark.sparkContext._jvm, 0
    while _staged:
        p = jvm.org.apache.hadoop.fs.Path(_staged.pop())
        n += bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True))
    return n


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder that :func:`release` deletes."""
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _staged.append(at)
    return at


@atexit.register
def _release_at_exit() -> None:
    try:
        spark = SparkSession.getActiveSession()
        if spark is not None and _staged:
            release(spark)
    except Exception:  # the JVM may be gone
        pass


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back.

    Unlike :func:`cut` later reads prune columns and push filters; it survives lost executors. The
    table stays until :func:`discard` or :func:`release`, or until the driver's process ends. Shuffle
    files of the write go as soon as it is done, not when the driver collects its garbage.
    """
    spark = df.sparkSession
    at = scratch(spark, "stage")
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(at)
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)
    out = _mark(spark.read.schema(df.schema).parquet(at))
    out._quire_at = at
    return out


def discard(*staged: DataFrame) -> None:
    """Delete tables of :func:`stage` that nothing reads any more."""
    for df in staged:
        spark, at = df.sparkSession, df._quire_at
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        _staged.remove(at)


def _mark(df: DataFrame) -> DataFrame:
    df._quire_staged = True
    return df


#: Bytes of a broadcast side, counted as JSON text, that no call exceeds.
BROADCAST_BYTES = 48 << 20


def fits(df: DataFrame, most_rows: int) -> tuple[DataFrame, bool]:
    """``df`` as a staged table, and whether it has at most ``most_rows`` rows and BROADCAST_BYTES.

    What is not staged yet is staged, so its plan runs once. The rows are counted from the footers;
    only a table within ``most_rows`` is read for its bytes.
    """
    df = df if getattr(df, "_quire_staged", False) else stage(df)
    if df.count() > most_rows:
        return df, False
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct(*df.columns))))).first()[0] or 0
    return df, size <= BROADCAST_BYTES


def small(df: DataFrame, most_rows: int) -> DataFrame:
    """``df``, staged, with a broadcast hint only where :func:`fits` has counted that it is small.

    Beyond the bounds it comes back without the hint and the join shuffles.
    """
    df, few = fits(df, most_rows)
    return F.broadcast(df) if few else df


def slots(spark: SparkSession) -> int:
    """Reduce-side parallelism of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame, *key: str) -> DataFrame:
    """``df`` hash-partitioned by ``key`` where its input makes fewer partitions than the session has slots.

    For steps that need far more CPU than a shuffle of their input. The size is the optimizer's
    estimate, known without running anything.
    """
    spark = df.sparkSession
    n, size = slots(spark), int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    per = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return df if size >= n * per else df.repartition(n, *key)


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per Spark context.

    Needed where the executors have no copy of it on their path; Spark serves the archive to them.
    """
    sc = spark.sparkContext
    if getattr(sc, "_quire_shipped", False):
        return
    here = Path(__file__).resolve().parent
    at = Path(tempfile.mkdtemp(prefix="quire-code-")) / "quire.zip"
    with zipfile.ZipFile(at, "w") as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, p.relative_to(here.parent))
    sc.addPyFile(str(at))
    sc._quire_shipped = True
