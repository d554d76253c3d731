"""Incremental work: which releases, videos and tracks a run would still take up. All are semi-joins and plain filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platterkit.operators.search import active
from platterkit.schema import Catalog

# Fixed value: why a video whose fetch failed is unrelated.
FETCH_FAILED = "metadata fetch failed"


def _having(cat: Catalog, ids: DataFrame) -> DataFrame:
    return active(cat.releases).join(ids.select(F.col("release_id").alias("id")).distinct(), "id", "left_semi")


def with_unclassified_video(cat: Catalog) -> DataFrame:
    """Active releases with a video that has no type yet."""
    return _having(cat, cat.videos.where("video_type is null"))


def analyzable_tracks(cat: Catalog, only_new: bool = True) -> DataFrame:
    """Tracks with a selected video or a local file, in id order; by default those not analysed."""
    chosen = cat.matches.where("is_selected = 1").select(F.col("track_id").alias("id"), "video_id")
    urls = chosen.join(cat.videos.select(F.col("id").alias("video_id"), "url"), "video_id", "left").select("id", "url")
    rows = cat.tracks.join(urls, "id", "left").where("url is not null or local_audio_path is not null")
    return (rows.where("analyzed_at is null") if only_new else rows).orderBy("id")


def needing_analysis(cat: Catalog) -> DataFrame:
    """Active releases with a track that could be analysed and isn't."""
    open_tracks = cat.tracks.where("analyzed_at is null").join(cat.matches.where("is_selected = 1").select(F.col("track_id").alias("id"), F.lit(True).alias("hit")).distinct(), "id", "left")
    return _having(cat, open_tracks.where("hit or local_audio_path is not null"))


def pending(cat: Catalog) -> DataFrame:
    """Active releases with an unfetched video or a track to analyse, each once."""
    return with_unfetched_video(cat).unionByName(needing_analysis(cat)).dropDuplicates(["id"])


def with_unfetched_video(cat: Catalog) -> DataFrame:
    """Active releases with a video whose metadata was never fetched."""
    return _having(cat, cat.videos.where("yt_fetched_at is null"))


def count_pending(cat: Catalog) -> DataFrame:
    """One row with the three counts of pending releases: unclassified, unanalyzed and either kind of work."""
    one = lambda df, name: df.agg(F.count_distinct("id").alias(name))
    return one(with_unclassified_video(cat), "unclassified").crossJoin(one(needing_analysis(cat), "unanalyzed")).crossJoin(one(pending(cat), "pending"))  # one row each


def locally_covered(cat: Catalog) -> DataFrame:
    """Rows ``(release_id, total, covered)`` of releases all of whose tracks have a local file."""
    return cat.tracks.groupBy("release_id").agg(F.count("*").alias("total"), F.count("local_audio_path").alias("covered")).where("total = covered")


def stuck_fetches(cat: Catalog) -> DataFrame:
    """Release ids, removed ones too, with a video that was fetched without result or whose fetch failed."""
    empty = "(yt_fetched_at is not null and yt_title is null and video_type is null)"
    return cat.videos.where(f"{empty} or video_type_reasoning = '{FETCH_FAILED}'").select("release_id").distinct()


def to_check_locally(cat: Catalog, force: bool = False) -> DataFrame:
    """Active releases to match with local folders: the unmatched, or all."""
    return active(cat.releases) if force else active(cat.releases).where("local_matched_at is null")


def to_fetch(cat: Catalog, force: bool = False) -> DataFrame:
    """Videos whose metadata to fetch: the unfetched, or all."""
    return cat.videos if force else cat.videos.where("yt_fetched_at is null")


def to_match(cat: Catalog) -> DataFrame:
    """Videos that have a fetched title."""
    return cat.videos.where("yt_title is not null")


def downloadable(cat: Catalog) -> DataFrame:
    """Tracks with the video selected for each, in id order."""
    chosen = cat.matches.where("is_selected = 1").join(cat.videos.select(F.col("id").alias("video_id"), "url"), "video_id")
    return cat.tracks.join(chosen.select(F.col("track_id").alias("id"), "video_id", "url"), "id").orderBy("id")
