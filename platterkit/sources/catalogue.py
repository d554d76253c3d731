"""The catalogue on disk: versioned Parquet directories with enforced schemas, written anew and swapped, never in place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from platterkit.schema import TABLES, Catalog


def open_catalog(spark: SparkSession, root: str, version: int | None = None) -> Catalog:
    """The newest version of a catalogue (or the one named); tables that aren't there are empty."""
    at = latest_version(spark, root) if version is None else version
    tables = {}
    for name, schema in TABLES.items():
        path = f"{root}/v{at}/{name}"
        tables[name] = spark.read.schema(schema).parquet(path) if at is not None and _exists(spark, path) else spark.createDataFrame([], schema)
    return Catalog(**tables)


def save_catalog(cat: Catalog, root: str) -> int:
    """Writes a catalogue as the next version and returns its number.

    A version counts once its marker is written, after all tables; readers of earlier versions aren't disturbed.
    """
    spark = cat.releases.sparkSession
    at = (latest_version(spark, root) or 0) + 1
    for name, df in cat.tables().items():
        schema = TABLES[name]
        df.select(*[df[f.name].cast(f.dataType) for f in schema if f.name in df.columns]).write.mode("overwrite").parquet(f"{root}/v{at}/{name}")
    fs, path = _fs(spark, f"{root}/v{at}/_COMPLETE")
    fs.create(path, True).close()
    return at


def latest_version(spark: SparkSession, root: str) -> int | None:
    """The highest complete version, None if there is none."""
    fs, path = _fs(spark, root)
    if not fs.exists(path):
        return None
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    done = [int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and _exists(spark, f"{root}/{n}/_COMPLETE")]
    return max(done, default=None)


def migrate(spark: SparkSession, root: str, now_tables: dict[str, StructType] = TABLES) -> list[str]:
    """Creates what a catalogue lacks, in the order of ``now_tables``, and returns what it did, ``create <table>`` or ``add <table>.<column>``.

    A table that isn't there is created empty, a column that isn't there is null in old rows; everything else stays. The changed
    catalogue is a new version; where nothing is lacking, none is written, so the step can be repeated.
    """
    at = latest_version(spark, root)
    done, tables = [], {}
    for name, schema in now_tables.items():
        path = f"{root}/v{at}/{name}"
        if at is None or not _exists(spark, path):
            done.append(f"create {name}")
            tables[name] = spark.createDataFrame([], schema)
            continue
        old = spark.read.parquet(path)
        lacking = [f for f in schema if f.name not in old.columns]
        done += [f"add {name}.{f.name}" for f in lacking]
        tables[name] = old.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in lacking])
    if done:
        save_catalog(Catalog(**tables), root)
    return done


def register(cat: Catalog) -> None:
    """Makes the tables known to SQL under their names."""
    for name, df in cat.tables().items():
        df.createOrReplaceTempView(name)


def _fs(spark: SparkSession, at: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _exists(spark: SparkSession, at: str) -> bool:
    fs, path = _fs(spark, at)
    return fs.exists(path)


def empty_like(df: DataFrame) -> DataFrame:
    """No rows of a table's form."""
    return df.limit(0)
