"""Session settings and lineage cuts."""

from __future__ import annotations

import functools
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: HotSpot compiles no method with more bytes of code than this.
COMPILED_BYTES = 8_000
#: Rows of a batch where rows hold whole texts.
TEXTS_PER_BATCH = 2_000


def recommended_conf() -> dict[str, str]:
    """Settings that hold on a cluster; the shuffle width is left to the submitter."""
    return {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
        "spark.sql.codegen.hugeMethodLimit": str(COMPILED_BYTES),
    }


def skip_huge_methods(spark: SparkSession) -> None:
    """Have plans whose generated methods are too long for the JVM's compiler run as separate expressions.

    Such a method is interpreted for ever: a scan of the accidents view took nine times as long.
    """
    key = "spark.sql.codegen.hugeMethodLimit"
    if int(spark.conf.get(key)) > COMPILED_BYTES:
        spark.conf.set(key, COMPILED_BYTES)


def small_batches(spark: SparkSession, rows: int = TEXTS_PER_BATCH, size: int | None = None) -> None:
    """Have texts reach Python workers in batches of at most ``rows``, and of about ``size`` bytes where given (one row at least).

    A batch is held several times over, by the JVM, by Arrow and as Python strings, in every task of an executor.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    known = spark.conf.get(key, None)  # a default given here must be a valid size, so there is none
    if size is not None and not (known and known.isdigit() and int(known) <= size):
        spark.conf.set(key, size)


def local_session(cpus: int = 8, memory: str = "12g", app: str = "tarmac") -> SparkSession:
    """A local session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
    )
    for key, value in recommended_conf().items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by the cluster.

    A temporary folder is used only where the session names none and runs in one process, as in
    tests; on a cluster each executor would write to a disk of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return named or scratch_dir(spark.sparkContext.master)


def scratch_dir(master: str) -> str:
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _scratch_dir()


@functools.cache
def _scratch_dir() -> str:
    return tempfile.mkdtemp(prefix="tarmac-")


def new_path(spark: SparkSession, name: str) -> str:
    return os.path.join(shared_dir(spark), f"tarmac-{name}-{uuid.uuid4().hex}")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to shared storage and go on from the written table.

    Lost executors then cost a re-read only. A table rather than an RDD checkpoint, because
    later steps read just the columns they use and know its size.
    """
    return cut_lineage_to(df, new_path(df.sparkSession, "stage"))


def cut_lineage_to(df: DataFrame, path: str) -> DataFrame:
    """``cut_lineage`` to a path of one's own, for tables that are discarded once a later one takes their place."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table that ``cut_lineage_to`` wrote and nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
