"""Shared folder for tables written in the middle of a job, and checked small frames."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession

_SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the cluster's checkpoint folder.

    Only a local session without the setting gets a folder of its own, once; a cluster has to
    name one, since executors cannot see each other's local disks.
    """
    context = spark.sparkContext
    base = spark.conf.get(_SETTING, None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local"):
            raise ValueError(f"{_SETTING} must name a folder all executors can reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="innsight-"))
        base = context.getCheckpointDir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Removes the shuffle files of a query when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextlib.contextmanager
def _set(spark: SparkSession, **settings: str) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stored(df: DataFrame, name: str, compression: str | None = None, batch_rows: int | None = None) -> DataFrame:
    """The frame written to the shared folder and read again: derived once, read often.

    What was shuffled to derive it goes at once. ``batch_rows`` bounds the Arrow batches of frames of blobs.
    """
    spark = df.sparkSession
    path = shared_folder(spark, name)
    with _set(spark, **{_CLEANUP: "true"} | ({_BATCH_ROWS: str(batch_rows)} if batch_rows else {})):
        df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def discarded(df: DataFrame) -> None:
    """Deletes the table that ``stored`` wrote for the frame; it must not be read any more."""
    jvm, configured = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(configured).delete(path, True)


def collect_small(df: DataFrame, max_rows: int, what: str) -> list[Row]:
    """Rows of a frame that must stay small; refuses instead of growing with the data."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"{what}: more than {max_rows} rows")
    return rows
