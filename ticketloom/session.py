"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid

from pyspark.sql import SparkSession


_SCOPE: contextvars.ContextVar[str | None] = contextvars.ContextVar("scratch", default=None)


def build_session(app: str = "ticketloom", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@contextlib.contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]):
    """Session settings for what is started inside."""
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


#: Shuffle files of a finished action go at once, not when the driver's memory is collected; a plan that
#: is run again after all writes them again.
DROP_SHUFFLES = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder of the cluster.

    Only on a local master without such a folder (tests) a temporary one is made and set for
    the rest of the session; on a cluster the executors would not share it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="ticketloom-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return f"{(_SCOPE.get() or base).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def scratch_scope(spark: SparkSession, name: str):
    """Scratch tables made inside live in one new folder, which goes away at the end.

    For streams: a micro-batch leaves nothing behind once its output is written.
    """
    folder = scratch_dir(spark, name)
    token = _SCOPE.set(folder)
    try:
        yield folder
    finally:
        _SCOPE.reset(token)
        remove(spark, folder)


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a scratch folder, if it is there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df, name: str, **options):
    """Write a table to the shared scratch folder and read it back.

    What follows may use it several times without computing it again, and a lost executor
    costs a re-read, not a re-run. The shuffles that made it are not kept beside it. ``options``
    are those of the writer.
    """
    return store(df, scratch_dir(df.sparkSession, name), **options)


def store(df, path: str, **options):
    """``materialise`` in a given folder."""
    with settings(df.sparkSession, DROP_SHUFFLES):
        df.write.options(**{"compression": "zstd", **options}).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
