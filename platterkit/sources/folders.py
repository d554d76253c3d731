"""Audio folders and downloads as tables, from file listings; contents are never read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AUDIO = ("flac", "mp3", "wav", "m4a", "aiff", "ogg")


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """The paths below a directory; none if it isn't there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], "path string")
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(F.regexp_replace("path", "^file:/*", "/").alias("path"))


def audio_folders(files: DataFrame) -> DataFrame:
    """Rows ``(path, files)``: every directory that directly holds an audio file, with its audio files in order."""
    audio = files.where(F.lower(F.substring_index("path", ".", -1)).isin(*AUDIO) & F.contains("path", F.lit(".")))
    own = audio.select(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder"), "path")
    return own.groupBy("folder").agg(F.sort_array(F.collect_list("path")).alias("files")).select(F.col("folder").alias("path"), "files")


def downloads(files: DataFrame) -> DataFrame:
    """Rows ``(release_id, stem, path)`` of files kept as ``<release id>/<stem>.<any suffix>``; of equal stems the first path."""
    p = r"/(\d+)/([^/]+?)(?:\.[^./]*)?$"
    own = files.where(F.col("path").rlike(p)).select(F.regexp_extract("path", p, 1).cast("long").alias("release_id"), F.regexp_extract("path", p, 2).alias("stem"), "path")
    return own.groupBy("release_id", "stem").agg(F.min("path").alias("path"))


def download_counts(files: DataFrame) -> DataFrame:
    """Rows ``(release_id, n)``: files kept of each release."""
    return downloads(files).groupBy("release_id").agg(F.count("*").alias("n"))
