"""Session helpers: local sessions for tests and benches, and lineage cuts that survive lost executors."""

from __future__ import annotations

import atexit
import contextlib
import gc
import re
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings the engine is tested under."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("platterkit")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a checkpoint in the shared folder, the session's ``spark.checkpoint.dir``."""
    _shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def _shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables. Only a session whose tasks are threads of this process makes one of its own where none is set; a cluster must name it."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and re.fullmatch(r"local(\[.*\])?", context.master):
            folder = tempfile.mkdtemp(prefix="platterkit-")
        if not folder:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_cleaning = threading.Lock()  # the setting is the session's: one table at a time is written under it


def shared_path(spark: SparkSession) -> str:
    """A new path in the shared folder, removed with all below it when the application ends."""
    path = f"{_shared_folder(spark)}/table-{uuid.uuid4().hex}"

    def remove() -> None:
        with contextlib.suppress(Exception):
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)

    atexit.register(remove)
    return path


#: Nothing is broadcast because Spark takes it for small: it sizes compressed files, and what arrays are unfolded to, far too low.
_NO_GUESSES = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}


def stash(df: DataFrame, settings: dict[str, str] | None = None) -> DataFrame:
    """``df`` written as a table to the shared folder and read back: like :func:`cut`, but compressed and with columns that can be pruned.

    The table is removed when the application ends. ``settings`` hold while it is written.
    """
    spark = df.sparkSession
    path = shared_path(spark)
    # the plan runs this once, so its shuffle files can go as soon as the table is written
    with _cleaning:
        settings = {_CLEANUP: "true"} | (settings or {})
        before = {k: spark.conf.get(k, None) for k in settings}
        try:
            for k, v in settings.items():
                spark.conf.set(k, v)
            df.write.parquet(path)
        finally:
            for k, v in before.items():
                if v is None:
                    spark.conf.unset(k)
                else:
                    spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def settle(df: DataFrame) -> DataFrame:
    """:func:`stash` for operators of many steps: lets go of what the step has left in the driver, as Spark frees broadcasts and
    shuffle files only once the driver's collectors find that nothing refers to them. Only tables that are said to be small are broadcast."""
    out = stash(df, _NO_GUESSES)
    gc.collect()
    df.sparkSession._jvm.System.gc()
    return out


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
