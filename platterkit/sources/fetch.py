"""Remote sources as injected callables: fetched inside the executors, an error a column instead of a failed job."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from platterkit.schema import CHAPTER, RELEASE_DETAIL

VIDEO_METADATA = StructType(
    [
        StructField("video_id", LongType()), StructField("title", StringType()), StructField("duration", IntegerType()), StructField("uploader", StringType()),
        StructField("description", StringType()), StructField("tags", ArrayType(StringType())), StructField("chapters", ArrayType(CHAPTER)), StructField("error", StringType()),
    ]
)
CLASSIFIED = StructType(
    [StructField("video_id", LongType()), StructField("classification", StringType()), StructField("position", StringType()), StructField("confidence", DoubleType()), StructField("reasoning", StringType())]
)


def _mapped(df: DataFrame, schema: StructType, one: Callable[[Any], dict[str, Any]]) -> DataFrame:
    names = schema.fieldNames()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [one(row) for row in pdf.itertuples(index=False)]
            yield pd.DataFrame([[r.get(n) for n in names] for r in rows], columns=names, dtype=object)

    return df.mapInPandas(run, schema)


def collection_keys(spark: SparkSession, pages: int, page: Callable[[int], list[tuple[int, str]]]) -> DataFrame:
    """Rows ``(id, date_added)`` of a paged scan of the remote collection: pages 1 to ``pages`` are asked for inside the executors, each once.

    A page that fails fails the scan, as an incomplete one would remove releases.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for n in pdf["id"]:
                yield pd.DataFrame(list(page(int(n))), columns=["id", "date_added"], dtype=object)

    return spark.range(1, pages + 1, numPartitions=max(1, min(pages, 1000))).mapInPandas(run, "id long, date_added string")


def fetch_releases(keys: DataFrame, fetch: Callable[[int], dict[str, Any]]) -> DataFrame:
    """Nested records for a table of release ids (column ``id``); a release whose fetch raises has only id and error.

    The cover is the first image, a missing catalogue number is empty, and several artists of a track are joined by commas.
    """

    def one(row: Any) -> dict[str, Any]:
        try:
            r = dict(fetch(int(row.id)))
        except Exception as error:  # noqa: BLE001 - one record must not stop the others
            return {"id": int(row.id), "error": f"{type(error).__name__}: {error}"}
        r["labels"] = [{**x, "catalog_number": x.get("catalog_number") or ""} for x in r.get("labels") or []]
        r["tracks"] = [{**x, "artist": ", ".join(x["artists"]) if x.get("artists") else x.get("artist")} for x in r.get("tracks") or []]
        for t in r["tracks"]:
            t.pop("artists", None)
        return r

    return _mapped(keys.select("id"), RELEASE_DETAIL, one)


def fetch_video_metadata(videos: DataFrame, extract: Callable[[str], dict[str, Any] | None]) -> DataFrame:
    """Metadata for videos (columns ``id, url``); nothing extracted counts as an error. Chapters keep title and start."""

    def one(row: Any) -> dict[str, Any]:
        try:
            info = extract(row.url)
            if not info:
                raise ValueError("no metadata")
        except Exception as error:  # noqa: BLE001
            return {"video_id": int(row.id), "error": f"{type(error).__name__}: {error}"}
        chapters = [{"title": c.get("title"), "start_time": float(c.get("start_time") or 0)} for c in info.get("chapters") or []]
        duration = info.get("duration")
        return {"video_id": int(row.id), **{k: info.get(k) for k in ("title", "uploader", "description")}, "duration": int(duration) if duration is not None else None, "tags": list(info.get("tags") or []), "chapters": chapters}

    return _mapped(videos.select("id", "url"), VIDEO_METADATA, one)


def classify(prompts: DataFrame, call: Callable[[str], str]) -> DataFrame:
    """A model's verdict for each prompt (columns ``video_id, prompt``): the JSON reply, of a list its first object; all null if anything fails.

    A reply without classification means unrelated, one without confidence 0.
    """

    def one(row: Any) -> dict[str, Any]:
        try:
            reply = json.loads(call(row.prompt))
            reply = (reply[0] if reply else {}) if isinstance(reply, list) else reply
            return {
                "video_id": int(row.video_id), "classification": reply.get("classification", "unrelated"), "position": reply.get("matched_track_position"),
                "confidence": float(reply.get("confidence", 0.0)), "reasoning": reply.get("reasoning"),
            }
        except Exception:  # noqa: BLE001
            return {"video_id": int(row.video_id)}

    return _mapped(prompts.select("video_id", "prompt"), CLASSIFIED, one)
