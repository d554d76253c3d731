"""Upserts, reconciliation and result writes, as new versions of tables: joins of old and new rows, nothing in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from platterkit.operators.pending import FETCH_FAILED
from platterkit.schema import Catalog


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One whole row a key: the one with the highest ``order``, of equals the one whose values sort last. Null keys are dropped."""
    others = [c for c in rows.columns if c not in (key, order)]
    best = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(order, *others)).alias("v"))
    return best.select(key, *[F.col(f"v.{c}") for c in rows.columns if c != key]).select(*rows.columns)


def dedupe_first(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order, with aggregation instead of a window so that a hot key is reduced early."""
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("v"))
    return best.select("v.*")


def missing(wanted: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Keys of one table that another lacks."""
    return wanted.select(key).distinct().join(present.select(key), key, "left_anti")


def upsert_releases(old: DataFrame, new: DataFrame, now: str) -> DataFrame:
    """Releases after an upsert: new values win, ``added_at`` stays, a removal is undone.

    Columns the new rows lack keep their old value. Untouched releases stay as they are.
    """
    fresh = new.withColumn("last_synced_at", F.lit(now)).withColumn("__new", F.lit(True))
    o, n = old.alias("o"), fresh.alias("n")
    joined = o.join(n, F.col("o.id") == F.col("n.id"), "full")
    touched = F.col("n.__new").isNotNull()

    def value(c: str) -> Column:
        if c == "id":
            return F.coalesce("n.id", "o.id")
        if c == "added_at":
            return F.coalesce("o.added_at", F.lit(now))
        if c == "removed_from_discogs_at":
            return F.when(touched, F.lit(None)).otherwise(F.col(f"o.{c}"))
        return F.when(touched, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")) if c in fresh.columns else F.col(f"o.{c}")

    return joined.select(*[value(c).cast(old.schema[c].dataType).alias(c) for c in old.columns])


def upsert_names(old: DataFrame, new: DataFrame) -> DataFrame:
    """Artists or labels after an upsert: the last writer's name wins, nothing is deleted. ``new`` has a column ``seq``."""
    both = old.select("id", "name", F.lit(-1).cast("long").alias("seq")).unionByName(new.select("id", "name", F.col("seq").cast("long")))
    return both.where("id is not null").groupBy("id").agg(F.max(F.struct("seq", "name"))["name"].alias("name"))


def replace_children(old: DataFrame, new: DataFrame, touched: DataFrame, unique: list[str] | None = None) -> DataFrame:
    """A child table after its rows of the touched releases (column ``release_id``) were replaced; with ``unique``, repeats of these columns are dropped."""
    added = new.dropDuplicates(unique) if unique else new
    return old.join(touched.select("release_id").distinct(), "release_id", "left_anti").unionByName(added.select(*old.columns))


def children(detail: DataFrame, column: str) -> DataFrame:
    """Rows of a nested child of fetched records, with the release's id and their place."""
    rows = detail.where("error is null").select(F.col("id").alias("release_id"), F.posexplode(column).alias("place", "c"))
    return rows.select("release_id", "place", "c.*")


def first_per_url(videos: DataFrame) -> DataFrame:
    """Videos of fetched records, of equal URLs in a release the first."""
    return dedupe_first(videos, ["release_id", "url"], [F.col("place")])


#: Buckets of releases that are numbered side by side.
NUMBER_BUCKETS = 1024


def numbered(rows: DataFrame, start: int) -> DataFrame:
    """Rows (with ``release_id, place``) with new ids from ``start`` on, dense, in order of a hash bucket, release and place.

    An id depends on the rows alone, so a task that is run again gives the same ones. Each bucket is numbered for itself, and the buckets' counts give the offsets.
    """
    bucket = F.pmod(F.xxhash64("release_id"), F.lit(NUMBER_BUCKETS)).cast("int")
    placed = rows.withColumn("__b", bucket)
    counts = placed.groupBy("__b").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy(F.lit(0)).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # NUMBER_BUCKETS rows
    own = F.row_number().over(W.partitionBy("__b").orderBy("release_id", "place"))
    return placed.withColumn("__n", own).join(F.broadcast(counts.select("__b", before.alias("__before"))), "__b").withColumn("id", F.col("__n") + F.col("__before") - 1 + start).drop("__b", "__n", "__before")


def soft_delete_missing(releases: DataFrame, seen: DataFrame, now: str) -> DataFrame:
    """Releases after those not in ``seen`` (column ``id``) were marked as removed; earlier removals keep their time."""
    known = seen.select("id", F.lit(True).alias("__seen")).distinct()
    gone = F.col("removed_from_discogs_at").isNull() & F.col("__seen").isNull()
    kept = [c for c in releases.columns if c != "removed_from_discogs_at"]
    at = F.when(gone, F.lit(now).cast(releases.schema["removed_from_discogs_at"].dataType)).otherwise(F.col("removed_from_discogs_at"))
    return releases.join(known, "id", "left").select(*kept, at.alias("removed_from_discogs_at")).select(*releases.columns)


def sync(cat: Catalog, snapshot: DataFrame, detail: DataFrame, now: str, complete: bool = True) -> Catalog:
    """The catalogue after a sync: fetched records are upserted with their children, and, if the snapshot is complete, what it lacks is removed.

    ``snapshot`` has ``id, date_added`` (the last of equal ids counts by ``date_added``), ``detail`` the nested records of
    :func:`platterkit.sources.fetch.fetch_releases`. Records with an error change nothing.
    """
    good = detail.where("error is null")
    dates = snapshot.groupBy("id").agg(F.max("date_added").alias("date_added"))
    new = good.select(
        "id", "title", "year", "genres", "styles", "formats", "discogs_uri", "country", "images", F.get("images", F.lit(0))["uri"].alias("cover_image_url")
    ).join(dates, "id", "left")
    touched = good.select(F.col("id").alias("release_id"))
    artists, labels, credits = (children(good, c) for c in ("artists", "labels", "credits"))
    people = artists.select("id", "name", "release_id").unionByName(credits.select(F.col("artist_id").alias("id"), F.col("artist_name").alias("name"), "release_id"))
    seq = F.col("release_id").alias("seq")
    releases = upsert_releases(cat.releases, new, now)
    top = lambda df: df.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first()["m"] + 1  # noqa: E731 - one number
    fit = lambda rows, like: rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(like.schema[c].dataType).alias(c) for c in like.columns])
    return Catalog(
        **{
            **cat.tables(),
            "releases": soft_delete_missing(releases, snapshot, now) if complete else releases,
            "artists": upsert_names(cat.artists, people.select("id", "name", seq)),
            "labels": upsert_names(cat.labels, labels.select("id", "name", seq)),
            "release_artists": replace_children(cat.release_artists, artists.select("release_id", F.col("id").alias("artist_id")), touched, ["release_id", "artist_id"]),
            "release_labels": replace_children(cat.release_labels, labels.select("release_id", F.col("id").alias("label_id"), "catalog_number"), touched, ["release_id", "label_id", "catalog_number"]),
            "tracks": replace_children(cat.tracks, fit(numbered(children(good, "tracks"), top(cat.tracks)), cat.tracks), touched),
            "videos": replace_children(cat.videos, fit(numbered(first_per_url(children(good, "videos")), top(cat.videos)), cat.videos), touched),
            "credits": replace_children(cat.credits, fit(numbered(credits, top(cat.credits)), cat.credits), touched),
        }
    )


def _merge(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows with the columns of ``changes`` overwritten where its key occurs (also by null)."""
    new = [c for c in changes.columns if c != key]
    marked = changes.select(key, *[F.col(c).alias(f"__{c}") for c in new], F.lit(True).alias("__hit"))
    value = lambda c: F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in new else F.col(c)
    return rows.join(marked, key, "left").select(*[value(c) for c in rows.columns])


def write_matches(cat: Catalog, results: DataFrame, releases: DataFrame, now: str) -> Catalog:
    """The catalogue after matching: video types stored, all matches of the releases' tracks replaced by those with a track."""
    types = results.select(
        F.col("video_id").alias("id"), "video_type", F.col("llm_reasoning").alias("video_type_reasoning"), F.col("fuzzy_score").alias("best_fuzzy_score"), F.col("best_position").alias("best_fuzzy_track_position")
    )
    old = cat.tracks.join(releases.select("release_id").distinct(), "release_id", "left_semi").select(F.col("id").alias("track_id"))
    fresh = results.where("track_id is not null").select("track_id", "video_id", "fuzzy_score", "llm_confidence", "llm_reasoning", F.col("is_selected").cast("int").alias("is_selected"), F.lit(now).alias("created_at"))
    return Catalog(**{**cat.tables(), "videos": _merge(cat.videos, types, "id"), "matches": cat.matches.join(old, "track_id", "left_anti").unionByName(fresh.select(*cat.matches.columns))})


def backfill_durations(cat: Catalog) -> DataFrame:
    """Tracks whose length can't be read, with the length of their selected video, if it has one, as m:ss."""
    from platterkit.functions.text import format_duration, parse_duration

    lengths = cat.matches.where("is_selected = 1").join(cat.videos.select(F.col("id").alias("video_id"), F.col("yt_duration").alias("__s")), "video_id").where("__s > 0")
    one = lengths.groupBy(F.col("track_id").alias("id")).agg(F.max("__s").alias("__s"))
    keep = parse_duration(F.col("duration")).isNotNull() | F.col("__s").isNull()
    rows = cat.tracks.join(one, "id", "left").withColumn("duration", F.when(keep, F.col("duration")).otherwise(format_duration(F.col("__s"))))
    return rows.select(*cat.tracks.columns)


def stamp_metadata(videos: DataFrame, fetched: DataFrame, now: str) -> DataFrame:
    """Videos after a fetch: metadata stored, failures stamped as unrelated with the reason."""
    bad = F.col("error").isNotNull()
    changes = fetched.select(
        F.col("video_id").alias("id"), F.col("title").alias("yt_title"), F.col("duration").alias("yt_duration"), F.col("uploader").alias("yt_uploader"),
        F.col("description").alias("yt_description"), F.col("tags").alias("yt_tags"), F.col("chapters").alias("yt_chapters"), F.lit(now).alias("yt_fetched_at"),
    )
    failed = fetched.where(bad).select(F.col("video_id").alias("id"), F.lit("unrelated").alias("video_type"), F.lit(FETCH_FAILED).alias("video_type_reasoning"))
    return _merge(_merge(videos, changes, "id"), failed, "id")


def clear_matches(cat: Catalog, releases: DataFrame) -> Catalog:
    """Without the matches and classifications of some releases (column ``release_id``); fetched metadata stays."""
    ids = releases.select("release_id").distinct()
    tracks = cat.tracks.join(ids, "release_id", "left_semi").select(F.col("id").alias("track_id"))
    own = cat.videos.join(ids, "release_id", "left_semi").select("id", *[F.lit(None).alias(c) for c in ("video_type", "video_type_reasoning", "best_fuzzy_score", "best_fuzzy_track_position")])
    return Catalog(**{**cat.tables(), "matches": cat.matches.join(tracks, "track_id", "left_anti"), "videos": _merge(cat.videos, own, "id")})


def write_local_matches(cat: Catalog, folders: DataFrame, files: DataFrame, now: str, threshold: float = 0.75) -> Catalog:
    """After local matching: a release's folder only if confident, its score and stamp always; a track's file likewise."""
    sure = F.when(F.col("score") >= threshold, F.col("path"))
    rel = folders.select(F.col("release_id").alias("id"), sure.alias("local_folder_path"), F.col("score").alias("local_folder_match_score"), F.lit(now).alias("local_matched_at"))
    trk = files.select(F.col("track_id").alias("id"), F.when(F.col("score") >= threshold, F.col("file")).alias("local_audio_path"), F.col("score").alias("local_match_score"))
    return Catalog(**{**cat.tables(), "releases": _merge(cat.releases, rel, "id"), "tracks": _merge(cat.tracks, trk, "id")})


def _cleared(rows: DataFrame, key: str, ids: DataFrame, columns: list[str]) -> DataFrame:
    marked = ids.select(F.col("release_id").alias(key), F.lit(True).alias("__hit")).distinct()
    value = lambda c: F.when(F.col("__hit").isNull(), F.col(c)).alias(c) if c in columns else F.col(c)
    return rows.join(marked, key, "left").select(*[value(c) for c in rows.columns])


def clear_local_matches(cat: Catalog, releases: DataFrame) -> Catalog:
    """Without the local folders and files of some releases."""
    return Catalog(
        **{
            **cat.tables(),
            "releases": _cleared(cat.releases, "id", releases, ["local_folder_path", "local_folder_match_score", "local_matched_at"]),
            "tracks": _cleared(cat.tracks, "release_id", releases, ["local_audio_path", "local_match_score"]),
        }
    )


ANALYSIS = ["bpm", "musical_key", "musical_key_scale", "mood", "mood_summary", "waveform_path", "analyzed_at", "genre", "style"]


def write_analysis(tracks: DataFrame, results: DataFrame, now: str) -> DataFrame:
    """Tracks with analysis results (column ``track_id`` and the analysed values); of a waveform's path only the name is kept."""
    changes = results.select(
        F.col("track_id").alias("id"), *[c for c in ANALYSIS if c in results.columns and c not in ("waveform_path", "analyzed_at")],
        F.regexp_extract("waveform_path", r"([^/]*)$", 1).alias("waveform_path"), F.lit(now).alias("analyzed_at"),
    )
    return _merge(tracks, changes, "id")


def clear_analysis(tracks: DataFrame, releases: DataFrame) -> DataFrame:
    """Tracks without the analysis of some releases."""
    return _cleared(tracks, "release_id", releases, ANALYSIS)


def add_members(members: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """A membership table (crate or sticker set) with more members; one already there keeps its row."""
    return members.unionByName(new.dropDuplicates(keys).join(members.select(*keys), keys, "left_anti").select(*members.columns))


def remove_members(members: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """A membership table without some members."""
    return members.join(gone.select(*keys).distinct(), keys, "left_anti")


def delete_crates(cat: Catalog, ids: DataFrame) -> Catalog:
    """Without some crates (column ``crate_id``) and their memberships."""
    gone = ids.select("crate_id").distinct()
    return Catalog(**{**cat.tables(), "crates": cat.crates.join(gone.withColumnRenamed("crate_id", "id"), "id", "left_anti"), "crate_releases": cat.crate_releases.join(gone, "crate_id", "left_anti")})


def rename_crates(crates: DataFrame, names: DataFrame) -> DataFrame:
    """Crates with new names (columns ``id, name``)."""
    return _merge(crates, names.select("id", "name"), "id")


def first_n(keys: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """The first keys of a scan, as for a trial run (which never removes anything)."""
    return keys.orderBy(*order).limit(n)


def running_number(rows: DataFrame, within: list[str], order: list[Column], name: str) -> DataFrame:
    """Rows numbered from 0 within a key of bounded size, such as a release's tracks."""
    return rows.withColumn(name, F.row_number().over(W.partitionBy(*within).orderBy(*order)) - 1)
