"""Session helpers: shipping the package to executors and materialising tables where every executor can read them."""

from __future__ import annotations

import atexit
import math
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()
BATCH_BYTES, _BATCH_KEY, _BATCH_DEFAULT = "4m", "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
_CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Partitions that one task writes one after the other, where few files are wanted.
_IN_TURN = 32


def ship(spark: SparkSession) -> None:
    """Make this package importable in every Python worker, once per application.

    Arrow batches are held to ``BATCH_BYTES`` unless the session sets its own bound: a batch is held on both sides of the pipe.
    """
    context = spark.sparkContext
    if spark.conf.get(_BATCH_KEY) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH_KEY, BATCH_BYTES)
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    # Code, no data: the driver serves it to executors as long as it runs.
    folder = tempfile.mkdtemp(prefix="keyloom-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = Path(folder) / "keyloom_pkg.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or (local sessions without one) a temporary folder."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file://{os.path.join(tempfile.gettempdir(), 'keyloom-shared-' + spark.sparkContext.applicationId)}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def work_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/keyloom/{spark.sparkContext.applicationId}"


def clear_work(spark: SparkSession) -> None:
    """Delete all that this application has materialised. Call it when no result is read any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(work_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def few_files(df: DataFrame) -> DataFrame:
    """All rows of ``df`` in about as many partitions, and so files, as there are cores.

    On a file system of the machine Hadoop starts three processes for each file that a task makes. While one starts, it shares
    the executor's memory, and who adds up the processes of an executor counts that memory twice.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.coalesce(max(spark.sparkContext.defaultParallelism, math.ceil(parts / _IN_TURN)))


def materialize(df: DataFrame, tag: str, few: bool = False) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back: cuts lineage, and survives lost executors.

    ``few``: in few files, and the write's shuffle files go with it; else they stay until the driver collects its garbage.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    if not few:
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    before = spark.conf.get(_CLEANUP_KEY, None)
    spark.conf.set(_CLEANUP_KEY, "true")
    try:
        few_files(df).write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP_KEY) if before is None else spark.conf.set(_CLEANUP_KEY, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files behind a materialised table that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for name in df.inputFiles():
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path.getParent(), True)
        break


def pick(df: DataFrame, **wanted: str) -> DataFrame:
    """Select ``new=old`` columns by exact name, then by name without case.

    Extra columns never matter, even when their names differ from a wanted one only in case or repeat it:
    the first exact match wins.
    """
    names = list(df.columns)
    plain = df.toDF(*[f"_k{i}" for i in range(len(names))])
    chosen = []
    for new, old in wanted.items():
        exact = [i for i, n in enumerate(names) if n == old] or [i for i, n in enumerate(names) if n.lower() == old.lower()]
        if not exact:
            raise ValueError(f"no column {old!r} among {names}")
        chosen.append(F.col(f"_k{exact[0]}").alias(new))
    return plain.select(*chosen)
