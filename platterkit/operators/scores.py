"""Score maps, embeddings and sample arrays: aggregates that need no model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mean_vectors(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """Rows ``(<key>, dim, mean)``: the mean of a key's vectors in each dimension. Null vectors and values don't count."""
    return rows.select(key, F.posexplode(vector).alias("dim", "x")).where("x is not null").groupBy(key, "dim").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def arg_max(vector: Column) -> Column:
    """Index of the first highest value of an array, null for an empty one."""
    return F.array_position(vector, F.array_max(vector)).cast("int") - 1


def envelope(rows: DataFrame, key: str, samples: str, width: int = 2500, height: int = 250) -> DataFrame:
    """Rows ``(<key>, x, hi, lo, y1, y2)``: highest and lowest sample of each of ``width`` chunks and the line drawn for it.

    A chunk is a whole number of samples, at least one; samples beyond width chunks are left out, and no samples at all count as one of 0.
    """
    some = F.when(F.size(samples) > 0, F.col(samples)).otherwise(F.array(F.lit(0.0).cast("float")))
    chunked = rows.select(key, some.alias("s")).withColumn("chunk", F.greatest(F.lit(1), F.floor(F.size("s") / width)).cast("int"))
    points = chunked.select(key, "chunk", F.posexplode("s").alias("i", "v")).withColumn("x", F.floor(F.col("i") / F.col("chunk")).cast("int")).where(F.col("x") < width)
    drawn = points.groupBy(key, "x").agg(F.max("v").alias("hi"), F.min("v").alias("lo"))
    y = lambda c: F.lit(height // 2) - (F.col(c) * (height / 2)).cast("int")
    return drawn.withColumn("y1", y("hi")).withColumn("y2", F.when(y("hi") == y("lo"), y("lo") + 1).otherwise(y("lo")))


def audio_source(local: Column, kept: Column, url: Column) -> Column:
    """Where a track's audio comes from: a local file before a kept download before a new one; else an error."""
    pick = lambda kind, c: F.struct(F.lit(kind).alias("kind"), c.alias("at"))
    return F.when(local.isNotNull(), pick("local", local)).when(kept.isNotNull(), pick("download", kept)).when(url.isNotNull(), pick("fetch", url)).otherwise(pick("error", F.lit(None).cast("string")))


def class_report(rows: DataFrame, key: str, scores: str, most: int = 10) -> DataFrame:
    """Rows ``(<key>, head, class, score, place)``: all binary scores (class null), and of each multi-class head the highest, by score.

    A score map has a bounded number of classes, so it is ranked as an array and not by a window.
    """
    entries = rows.select(key, F.explode(scores).alias("k", "score")).select(key, F.substring_index("k", ":", 1).alias("head"), F.when(F.contains("k", F.lit(":")), F.regexp_replace("k", "^[^:]*:", "")).alias("class"), "score")
    ranked = entries.groupBy(key, F.when(F.col("class").isNull(), F.lit("")).otherwise(F.col("head")).alias("g")).agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("neg"), "head", "class"))).alias("all"))
    top = F.when(F.col("g") == "", F.col("all")).otherwise(F.slice("all", 1, most))
    return ranked.select(key, F.posexplode(top).alias("place", "e")).select(key, "e.head", "e.class", (-F.col("e.neg")).alias("score"), "place")


def analyze(tracks: DataFrame, analyse: Callable[[str], dict], schema: str) -> DataFrame:
    """Results of an injected analysis for tracks (columns ``id, path``): ``track_id``, the columns of ``schema`` and ``error``.

    One track's failure is its error. Python workers are processes of their own, so a callable may keep its models between calls.
    """
    names = ["track_id", *[part.strip().split()[0] for part in schema.split(",")], "error"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, path in zip(pdf["id"], pdf["path"]):
                try:
                    out.append({"track_id": i, **analyse(path), "error": None})
                except Exception as error:  # noqa: BLE001
                    out.append({"track_id": i, "error": f"{type(error).__name__}: {error}"})
            yield pd.DataFrame([[r.get(n) for n in names] for r in out], columns=names, dtype=object)

    return tracks.select("id", "path").mapInPandas(run, f"track_id long, {schema}, error string")


def download_status(wanted: DataFrame, kept: DataFrame, fetched: DataFrame) -> DataFrame:
    """Rows ``(track_id, status)``: already_downloaded, downloaded or failed.

    wanted: ``track_id, release_id, stem``; kept: as :func:`platterkit.sources.folders.downloads`; fetched: ``track_id, ok``.
    """
    there = wanted.join(kept.select("release_id", "stem", F.lit(True).alias("there")), ["release_id", "stem"], "left").join(fetched.groupBy("track_id").agg(F.max("ok").alias("ok")), "track_id", "left")
    return there.select("track_id", F.when(F.col("there"), "already_downloaded").when(F.coalesce("ok", F.lit(False)), "downloaded").otherwise("failed").alias("status"))
