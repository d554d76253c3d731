"""Everything about releases as nested rows, and what pages derive from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platterkit.functions.text import nocase, strip_disambiguation
from platterkit.schema import Catalog


def _nest(rows: DataFrame, key: str, name: str, order: list[Column], columns: list[str]) -> DataFrame:
    """One row a key with its rows as an array of structs, in order."""
    keyed = F.struct(*[c.alias(f"__{i}") for i, c in enumerate(order)], F.struct(*columns).alias("v"))
    return rows.groupBy(F.col(key).alias("id")).agg(F.array_sort(F.collect_list(keyed)).alias(name)).select("id", F.transform(name, lambda x: x["v"]).alias(name))


def tracks_with_videos(cat: Catalog) -> DataFrame:
    """Tracks with the URL and scores of their selected video, if any."""
    chosen = cat.matches.where("is_selected = 1").join(cat.videos.select(F.col("id").alias("video_id"), "url", F.col("title").alias("video_title")), "video_id", "left")
    return cat.tracks.join(chosen.select(F.col("track_id").alias("id"), "video_id", "url", "video_title", "fuzzy_score", "llm_confidence"), "id", "left")


def candidates_of_videos(cat: Catalog) -> DataFrame:
    """Videos with every match they have and its track, selected or not; a video without one has one row."""
    m = cat.matches.select("video_id", "track_id", "fuzzy_score", "llm_confidence", "is_selected").join(cat.tracks.select(F.col("id").alias("track_id"), F.col("title").alias("track_title"), "position"), "track_id", "left")
    return cat.videos.join(m.withColumnRenamed("video_id", "id"), "id", "left")


def release_detail(cat: Catalog, ids: DataFrame | None = None) -> DataFrame:
    """Releases, removed ones too, with arrays artists, labels, tracks, videos and credits and the columns derived from them.

    ``ids`` (column ``id``) restricts the releases before any child table is joined. ai_genres and ai_styles are the tracks' own,
    each once in track order. tracks_have_distinct_artists says whether a track names another artist than the release.
    A release without children has empty arrays.

    Plan: each child is nested by release id once; the joins that follow are on that key and share its partitioning.
    """
    rel = cat.releases if ids is None else cat.releases.join(ids.select("id"), "id", "left_semi")
    own = lambda df, key="release_id": df if ids is None else df.join(ids.select(F.col("id").alias(key)), key, "left_semi")
    artists = own(cat.release_artists).join(cat.artists.withColumnRenamed("id", "artist_id"), "artist_id")
    labels = own(cat.release_labels).join(cat.labels.withColumnRenamed("id", "label_id"), "label_id")
    credits = own(cat.credits).join(cat.artists.select(F.col("id").alias("artist_id"), "name"), "artist_id")
    tracks = tracks_with_videos(cat) if ids is None else tracks_with_videos(Catalog(**{**cat.tables(), "tracks": own(cat.tracks)}))
    rows = rel
    for child in (
        _nest(artists, "release_id", "artists", [nocase(F.col("name")), F.col("artist_id")], ["artist_id", "name"]),
        _nest(labels, "release_id", "labels", [nocase(F.col("name")), F.col("label_id"), F.col("catalog_number")], ["label_id", "name", "catalog_number"]),
        _nest(tracks, "release_id", "tracks", [F.col("id")], ["id", "position", "title", "duration", "artist", "genre", "style", "url"]),
        _nest(own(cat.videos), "release_id", "videos", [F.col("id")], ["id", "title", "url", "duration", "video_type"]),
        _nest(credits, "release_id", "credits", [F.col("role"), nocase(F.col("name")), F.col("artist_id")], ["artist_id", "name", "role", "tracks"]),
    ):
        rows = rows.join(child, "id", "left")
    empty = {c: F.coalesce(F.col(c), F.from_json(F.lit("[]"), rows.schema[c].dataType)) for c in ("artists", "labels", "tracks", "videos", "credits")}
    rows = rows.withColumns(empty)
    distinct = lambda c: F.array_distinct(F.filter(F.transform("tracks", lambda t: t[c]), lambda g: g.isNotNull() & (g != "")))
    names = strip_disambiguation(F.array_join(F.array_sort(F.transform("artists", lambda a: a["name"])), ", "))
    return rows.withColumns(
        {
            "ai_genres": distinct("genre"),
            "ai_styles": distinct("style"),
            "tracks_have_distinct_artists": F.exists("tracks", lambda t: F.coalesce(t["artist"] != "", F.lit(False)) & (strip_disambiguation(t["artist"]) != names)),
        }
    )


def credits_by_role(cat: Catalog) -> DataFrame:
    """Rows ``(release_id, role, names)``: the credited artists of each role, in order without regard to case."""
    named = cat.credits.join(cat.artists.select(F.col("id").alias("artist_id"), "name"), "artist_id")
    grouped = named.groupBy("release_id", "role").agg(F.array_sort(F.collect_set(F.struct(nocase(F.col("name")).alias("k"), "name"))).alias("all"))
    return grouped.select("release_id", "role", F.transform("all", lambda x: x["name"]).alias("names"))


def release_log(cat: Catalog) -> DataFrame:
    """All releases in order of date added, removed ones marked."""
    mark = F.when(F.col("removed_from_discogs_at").isNotNull(), F.lit(" [removed]")).otherwise(F.lit(""))
    line = F.concat(F.coalesce(F.col("year").cast("string"), F.lit("----")), F.lit("  "), "title", mark)
    return cat.releases.select("id", "date_added", line.alias("line")).orderBy("date_added", "id")
