"""Session settings and the shared scratch folder."""

from __future__ import annotations

import gc
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession

# Settings the operators are written for. All can be overridden by the caller; none is needed for
# correct results except the UTC time zone.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Documents vary from a line to megabytes: bound Arrow batches by bytes as well as by rows. A Python worker holds
    # several forms of a batch at a time, and a machine one or two workers per core.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}


def build_session(app: str = "corpusflow", master: str | None = None, **conf) -> SparkSession:
    """A session with ``SETTINGS`` applied; keyword names use ``__`` for the dots of a setting."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, str(value))
    return builder.getOrCreate()


def bound_batches(spark: SparkSession) -> None:
    """Lowers the Arrow batches of a session that was built without ``SETTINGS`` to the bounds these have."""
    for key in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"):
        most, now = int(SETTINGS[key]), spark.conf.get(key)
        if not now.rstrip("b").isdigit() or not 0 < int(now.rstrip("b")) <= most:
            spark.conf.set(key, most)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Not needed where it is installed on every machine.
    """
    context = spark.sparkContext
    if getattr(context, "_corpusflow_shipped", False):
        return
    base = os.path.join(tempfile.mkdtemp(prefix="corpusflow-"), "corpusflow")
    archive = shutil.make_archive(base, "zip", Path(__file__).parent.parent, "corpusflow")
    context.addPyFile(archive)
    context._corpusflow_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, from ``spark.checkpoint.dir``.

    Where the setting is missing, a local master gets a temporary folder; a cluster gets an error, since a
    machine-local folder would lose data with its machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="corpusflow-")
        spark.conf.set("spark.checkpoint.dir", base)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return base


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh, not yet existing path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


# A row may hold a whole file. Parquet looks at its buffer every 100 rows only and a reader decodes up to 4096 rows of
# a row group at once; both are bounded by looking at every row and closing row groups early. Text is most of what is
# stored, and a third smaller so than by the default.
WIDE_ROWS = {"parquet.block.size": str(64 << 20), "parquet.block.size.row.check.min": "1", "compression": "zstd"}


def stage(path: str, rows):
    """``rows`` as written to ``path``, a scratch folder, from where they are read again. Whoever names it removes it."""
    rows.write.options(**WIDE_ROWS).parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder, such as a staged copy that has served; one that does not exist is no fault."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Lets go of the shuffle files that nothing can read any more.

    Spark deletes them when the driver's memory is collected, which may take half an hour; those of one shuffle of a large
    text are as large as a table. Only worth it after a step that moves such text.
    """
    gc.collect()
    spark._jvm.System.gc()


def truncate_lineage(df):
    """A reliable checkpoint of ``df`` in the shared folder: stable partitions that outlive an executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df, bytes_per_task: int = 32 << 20):
    """``df`` over all cores when it is small, unchanged otherwise.

    A small input often is one file with one row group, so one task, while the Python work after it is heavy. Large
    inputs have enough splits already; their size estimate rules the extra shuffle out.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    estimate = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if estimate < cores * bytes_per_task else df
