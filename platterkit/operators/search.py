"""Faceted search over releases: predicates as semi-joins, counts as decorrelated aggregates, stable paging."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platterkit.functions.music import bpm_band
from platterkit.functions.text import contains_folded, nocase, strip_disambiguation
from platterkit.schema import Catalog
from platterkit.session import stash

# Names of orders.
SORTS = ("date_added_desc", "date_added_asc", "title_asc", "year_desc", "year_asc", "artist_asc", "label_asc")


def active(releases: DataFrame) -> DataFrame:
    """Releases that aren't removed."""
    return releases.where(F.col("removed_from_discogs_at").isNull())


def _with_name(bridge: DataFrame, names: DataFrame, key: str, query: str) -> DataFrame:
    """Release ids of the bridge whose name holds the folded query."""
    wanted = names.where(contains_folded(F.col("name"), query)).select(F.col("id").alias(key))
    return bridge.join(wanted, key, "left_semi").select("release_id").distinct()


def filter_releases(
    cat: Catalog,
    *,
    q: str | None = None,
    genres: Sequence[str] = (),
    styles: Sequence[str] = (),
    year: int | None = None,
    label_name: str | None = None,
    artist_name: str | None = None,
    bpm: float | None = None,
    bpm_tolerance: float | None = None,
    crate_id: int | None = None,
    in_stickers: bool = False,
) -> DataFrame:
    """Active releases for which all given predicates hold; empty and zero values set none (but a crate 0 does).

    ``q`` is in the title or an artist's name, both folded. Genres and styles are any-of and exact. The tempo band needs both
    arguments and includes its bounds; a track without tempo never fits.

    Plan: title, genre, style and year filters stay in the scan's stage; every other predicate is a semi-join with a side
    filtered before it is shuffled, so a release comes out once however many rows fit.
    """
    out = active(cat.releases)
    if genres := [g for g in genres if g]:
        out = out.where(F.arrays_overlap("genres", F.array(*[F.lit(g) for g in genres])))
    if styles := [s for s in styles if s]:
        out = out.where(F.arrays_overlap("styles", F.array(*[F.lit(s) for s in styles])))
    if year:
        out = out.where(F.col("year") == year)
    semi = lambda df, ids: df.join(ids.select(F.col("release_id").alias("id")), "id", "left_semi")
    if q:
        by_artist = _with_name(cat.release_artists, cat.artists, "artist_id", q).select(F.col("release_id").alias("id"), F.lit(True).alias("__hit"))
        out = out.join(by_artist, "id", "left").where(contains_folded(F.col("title"), q) | F.col("__hit").isNotNull()).drop("__hit")
    if label_name:
        out = semi(out, _with_name(cat.release_labels, cat.labels, "label_id", label_name))
    if artist_name:
        out = semi(out, _with_name(cat.release_artists, cat.artists, "artist_id", artist_name))
    if bpm is not None and bpm_tolerance is not None:
        low, high = bpm_band(bpm, bpm_tolerance)
        out = semi(out, cat.tracks.where(F.col("bpm").between(low, high)).select("release_id"))
    if crate_id is not None:
        out = semi(out, cat.crate_releases.where(F.col("crate_id") == crate_id))
    if in_stickers:
        out = semi(out, cat.stickers)
    return out


def _within(rows: DataFrame, ids: DataFrame | None, key: str = "release_id") -> DataFrame:
    """Rows of some releases (column ``id``, a page at most), or all."""
    return rows if ids is None else rows.join(F.broadcast(ids.select(F.col("id").alias(key))), key, "left_semi")


def artist_text(cat: Catalog, ids: DataFrame | None = None) -> DataFrame:
    """Rows ``(id, artist_names)``: names joined by commas in order of artist id, without disambiguation numbers; of all releases or of a page's ``ids``."""
    named = _within(cat.release_artists, ids).join(cat.artists, F.col("artist_id") == cat.artists["id"]).select(F.col("release_id").alias("rid"), "artist_id", "name")
    joined = named.groupBy("rid").agg(F.array_sort(F.collect_set(F.struct("artist_id", "name"))).alias("all"))
    return joined.select(F.col("rid").alias("id"), strip_disambiguation(F.array_join(F.transform("all", lambda x: x["name"]), ", ")).alias("artist_names"))


def first_name(bridge: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """Rows ``(id, first_name)``: of each release the name that is first when case is ignored."""
    named = bridge.join(names.withColumnRenamed("id", key), key)
    return named.groupBy("release_id").agg(F.min(F.struct(nocase(F.col("name")).alias("k"), "name"))["name"].alias("first_name")).withColumnRenamed("release_id", "id")


def progress_counts(cat: Catalog, ids: DataFrame | None = None) -> DataFrame:
    """Rows ``(id, track_count, matched_count, analyzed_count, processed)`` of releases that have tracks or videos, of all or of a page's ``ids``."""
    tracks = _within(cat.tracks, ids)
    selected = cat.matches.where("is_selected = 1").select("track_id")
    if ids is not None:
        selected = selected.join(tracks.select(F.col("id").alias("track_id")), "track_id", "left_semi")
    matched = selected.groupBy("track_id").agg(F.count("*").alias("m"))
    per_track = tracks.join(matched, F.col("track_id") == F.col("id"), "left")
    counts = per_track.groupBy("release_id").agg(
        F.count("*").alias("track_count"), F.coalesce(F.sum("m"), F.lit(0)).alias("matched_count"), F.count("analyzed_at").alias("analyzed_count")
    )
    open_videos = _within(cat.videos, ids).groupBy("release_id").agg((F.count(F.when(F.col("video_type").isNull(), 1)) == 0).alias("processed"))
    return counts.join(open_videos, "release_id", "full").withColumnRenamed("release_id", "id")


def matching_status(matched: Column, total: Column, processed: Column) -> Column:
    """'' if never processed or without tracks, done if every track is matched, else partial."""
    return F.when(~F.coalesce(processed, F.lit(False)) | (total <= 0), F.lit("")).when(matched == total, F.lit("done")).otherwise(F.lit("partial"))


def availability_status(count: Column, available: Column, total: Column) -> Column:
    """'' if nothing is available or something is missing, done if that is every track, else partial."""
    return F.when((available <= 0) | (count < available), F.lit("")).when(available == total, F.lit("done")).otherwise(F.lit("partial"))


def order(cat: Catalog, rows: DataFrame, sort: str = "date_added_desc") -> DataFrame:
    """Rows in a named order (an unknown name means the first), ties by id."""
    keys: dict[str, list[Column]] = {
        "date_added_desc": [F.desc("date_added")], "date_added_asc": [F.asc("date_added")], "title_asc": [nocase(F.col("title"))],
        "year_desc": [F.desc("year")], "year_asc": [F.asc("year")], "artist_asc": [F.asc_nulls_first("first_name")], "label_asc": [F.asc_nulls_first("first_name")],
    }
    sort = sort if sort in keys else "date_added_desc"
    if sort in ("artist_asc", "label_asc"):
        side = first_name(cat.release_artists, cat.artists, "artist_id") if sort == "artist_asc" else first_name(cat.release_labels, cat.labels, "label_id")
        return rows.join(side, "id", "left").orderBy(*keys[sort], "id").drop("first_name")
    return rows.orderBy(*keys[sort], "id")


def list_releases(cat: Catalog, sort: str = "date_added_desc", limit: int | None = 48, offset: int = 0, **filters) -> DataFrame:
    """One page of release summaries: id, title, year, cover, artist_names, genres and progress counts with their statuses.

    The page is cut first and written once; its ids, at most ``limit``, are broadcast to the tables of artists, tracks and videos before
    anything of these is aggregated. Without a limit names and counts are those of all releases.
    """
    found = order(cat, filter_releases(cat, **filters), sort)
    if offset:
        found = found.offset(offset)
    if limit is not None:
        found = found.limit(limit)
    page = found.select("id", "title", "year", "cover_image_url", "genres", "date_added")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    ids = None
    if limit is not None:
        page = stash(page.withColumn("place", F.monotonically_increasing_id()))  # one partition in order; read five times
        ids = page.select("id")
    rows = page.join(artist_text(cat, ids), "id", "left").join(progress_counts(cat, ids), "id", "left")
    rows = rows.select(
        "id", "title", "year", "cover_image_url", F.coalesce("artist_names", F.lit("")).alias("artist_names"), F.coalesce("genres", F.array().cast("array<string>")).alias("genres"),
        "date_added", *(["place"] if limit is not None else []), zero("track_count"), zero("matched_count"), zero("analyzed_count"), F.coalesce("processed", F.lit(True)).alias("matching_processed"),
    )
    rows = rows.withColumns(
        {
            "matching_status": matching_status(F.col("matched_count"), F.col("track_count"), F.col("matching_processed")),
            "analysis_status": availability_status(F.col("analyzed_count"), F.col("matched_count"), F.col("track_count")),
        }
    )
    return order(cat, rows, sort) if limit is None else rows.orderBy("place").drop("place")


def count_releases(cat: Catalog, **filters) -> DataFrame:
    """One row ``n``: how many releases a search has."""
    return filter_releases(cat, **filters).agg(F.count("*").alias("n"))


def page_state(total: int, offset: int, shown: int) -> dict[str, int | bool]:
    """How many rows are loaded so far and whether there are more."""
    return {"loaded_count": offset + shown, "has_more": offset + shown < total}


def parse_filters(raw: dict[str, str | list[str] | None]) -> dict:
    """Search arguments from request texts: what isn't a number sets no filter, the widest tolerance counts, in percent."""

    def number(x, kind):
        try:
            return kind(x)
        except (TypeError, ValueError):
            return None

    many = lambda k: [x for x in (raw.get(k) or []) if x]
    tolerances = [t for t in (number(x, float) for x in raw.get("bpm_tolerance") or []) if t is not None]
    return {
        "q": raw.get("q") or None, "genres": many("genres"), "styles": many("styles"), "year": number(raw.get("year"), int), "label_name": raw.get("label_name") or None,
        "artist_name": raw.get("artist_name") or None, "bpm": number(raw.get("bpm"), float), "bpm_tolerance": max(tolerances) / 100 if tolerances else None,
    }
