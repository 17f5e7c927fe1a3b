"""Session defaults and shared-folder handling used by every operator."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from threading import Event

from pyspark.sql import DataFrame, SparkSession

from framelake.errors import MediaError


def local_session(cores: str = "8", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benches; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("framelake")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@contextmanager
def cancellable(spark: SparkSession, name: str) -> Iterator[Callable[[], None]]:
    """Jobs started inside can be cancelled from another thread by what is yielded; what then fails raises as cancelled."""
    context, group, asked = spark.sparkContext, f"{name}-{uuid.uuid4().hex}", Event()
    before = [context.getLocalProperty(p) for p in ("spark.jobGroup.id", "spark.job.description")]

    def cancel() -> None:
        asked.set()
        context.cancelJobGroup(group)

    context.setJobGroup(group, name, interruptOnCancel=True)
    try:
        yield cancel
        if asked.is_set():
            raise MediaError("Cancelled", f"{name} was cancelled")
    except MediaError:
        raise
    except Exception as e:
        if asked.is_set():
            raise MediaError("Cancelled", f"{name} was cancelled") from e
        raise
    finally:
        context.setLocalProperty("spark.jobGroup.id", before[0])
        context.setLocalProperty("spark.job.description", before[1])


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which all executors share.

    Only a local master may fall back to a temporary folder, as tests do.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir is unset; name a folder that all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "framelake-shared")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


#: While a table is written: shuffle files go as soon as it stands, and batches for Python workers stay small.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}


@contextmanager
def _writing(spark: SparkSession) -> Iterator[None]:
    """``WRITING`` holds inside; settings are as before behind it."""
    before = {k: spark.conf.get(k) for k in WRITING}
    try:
        for k, v in WRITING.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def materialise(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts lineage and lets several consumers share one computation; it
    survives lost executors because the files are in shared storage. The shuffle
    files of the steps before are then of no use, and go at once.
    """
    return materialise_parts([df], purpose)


def materialise_parts(parts: Iterable[DataFrame], purpose: str) -> DataFrame:
    """Write tables of the same columns one after the other, and read them as one; each has its shuffle files gone before the next begins."""
    path, written = "", []
    for df in parts:
        spark, schema = df.sparkSession, df.schema
        path = path or shared_folder(spark, purpose)
        written.append(f"{path}/{len(written)}")
        with _writing(spark):
            df.write.option("compression", "zstd").parquet(written[-1])
        spark.sparkContext._jvm.System.gc()  # broadcasts, and shuffle files of what was collected
    found = spark.read.schema(schema).parquet(*written)
    found.framelake_path = path
    return found


def release(*tables: DataFrame) -> None:
    """Remove tables that ``materialise`` wrote, once all that reads them has been written itself."""
    for table in tables:
        spark = table.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table.framelake_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
