"""Schemas of the catalogue's tables, enforced on read; arrays and maps are real types, never text."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, MapType, StringType, StructField, StructType

_S, _L, _I, _D = StringType(), LongType(), IntegerType(), DoubleType()
_TEXTS = ArrayType(_S)


def _table(**columns) -> StructType:
    return StructType([StructField(name, kind, True) for name, kind in columns.items()])


IMAGE = _table(type=_S, uri=_S, uri150=_S, width=_I, height=_I)
CHAPTER = _table(title=_S, start_time=_D)
RELEASES = _table(
    id=_L, title=_S, year=_I, formats=_S, genres=_TEXTS, styles=_TEXTS, discogs_uri=_S, date_added=_S, cover_image_url=_S, country=_S, images=ArrayType(IMAGE),
    added_at=_S, last_synced_at=_S, removed_from_discogs_at=_S, local_folder_path=_S, local_folder_match_score=_D, local_matched_at=_S,
)
ARTISTS = LABELS = _table(id=_L, name=_S)
RELEASE_ARTISTS = _table(release_id=_L, artist_id=_L)
RELEASE_LABELS = _table(release_id=_L, label_id=_L, catalog_number=_S)
TRACKS = _table(
    id=_L, release_id=_L, position=_S, title=_S, duration=_S, artist=_S, bpm=_D, musical_key=_S, musical_key_scale=_S, mood=MapType(_S, _D), mood_summary=_S,
    waveform_path=_S, analyzed_at=_S, genre=_S, style=_S, local_audio_path=_S, local_match_score=_D,
)
VIDEOS = _table(
    id=_L, release_id=_L, title=_S, url=_S, duration=_I, description=_S, yt_title=_S, yt_duration=_I, yt_uploader=_S, yt_description=_S, yt_tags=_TEXTS,
    yt_chapters=ArrayType(CHAPTER), yt_fetched_at=_S, video_type=_S, video_type_reasoning=_S, best_fuzzy_score=_D, best_fuzzy_track_position=_S,
)
CREDITS = _table(id=_L, release_id=_L, artist_id=_L, role=_S, tracks=_S, name_variation=_S)
MATCHES = _table(track_id=_L, video_id=_L, fuzzy_score=_D, llm_confidence=_D, llm_reasoning=_S, is_selected=_I, created_at=_S)
CRATES = _table(id=_L, name=_S, created_at=_S)
CRATE_RELEASES = _table(crate_id=_L, release_id=_L, added_at=_S)
STICKERS = _table(release_id=_L, added_at=_S)

#: The record a detail fetch gives for a release, children nested.
RELEASE_DETAIL = StructType(
    [
        *_table(id=_L, title=_S, year=_I, country=_S, genres=_TEXTS, styles=_TEXTS, formats=_S, discogs_uri=_S, images=ArrayType(IMAGE)).fields,
        StructField("artists", ArrayType(_table(id=_L, name=_S))),
        StructField("labels", ArrayType(_table(id=_L, name=_S, catalog_number=_S))),
        StructField("tracks", ArrayType(_table(position=_S, title=_S, duration=_S, artist=_S))),
        StructField("videos", ArrayType(_table(title=_S, url=_S, duration=_I, description=_S))),
        StructField("credits", ArrayType(_table(artist_id=_L, artist_name=_S, role=_S, tracks=_S, name_variation=_S))),
        StructField("error", _S),
    ]
)

TABLES: dict[str, StructType] = {
    "releases": RELEASES, "artists": ARTISTS, "labels": LABELS, "release_artists": RELEASE_ARTISTS, "release_labels": RELEASE_LABELS, "tracks": TRACKS, "videos": VIDEOS,
    "credits": CREDITS, "matches": MATCHES, "crates": CRATES, "crate_releases": CRATE_RELEASES, "stickers": STICKERS,
}


@dataclass
class Catalog:
    """The catalogue's tables as DataFrames; operators read only the columns they name."""

    releases: DataFrame
    artists: DataFrame | None = None
    release_artists: DataFrame | None = None
    labels: DataFrame | None = None
    release_labels: DataFrame | None = None
    tracks: DataFrame | None = None
    videos: DataFrame | None = None
    credits: DataFrame | None = None
    matches: DataFrame | None = None
    crates: DataFrame | None = None
    crate_releases: DataFrame | None = None
    stickers: DataFrame | None = None

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: df for f in fields(self) if (df := getattr(self, f.name)) is not None}
