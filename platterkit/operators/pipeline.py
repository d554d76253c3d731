"""Runs over the whole catalogue: sync with the remote collection, matching, local files, downloads and analysis, each as one plan over all releases."""

from __future__ import annotations

import os
import time
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field, fields, replace
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platterkit.functions.similarity import weighted_similarity
from platterkit.functions.text import audio_stem, parse_duration
from platterkit.operators import local_match, pending, resolve, scores, sync
from platterkit.operators.resolve import Similarity
from platterkit.schema import Catalog
from platterkit.session import stash
from platterkit.sources import fetch


@dataclass(frozen=True)
class Options:
    """Settings of a run; :meth:`read` takes them from texts, as an environment or a settings table gives them."""

    confident: float = resolve.CONFIDENT
    margin: float = resolve.MARGIN
    deviance: float = resolve.DEVIANCE
    terms: tuple[str, ...] = resolve.TERMS
    local_confident: float = local_match.CONFIDENT
    #: metadata is fetched again for videos that have it
    force: bool = False
    #: releases that are classified already are taken up again; None: as ``force``
    reprocess: bool | None = None
    #: attempts of a download and seconds between them
    attempts: int = 3
    delay: float = 2.0

    @classmethod
    def read(cls, *layers: Mapping[str, str | None], prefix: str = "PLATTERKIT_") -> Options:
        """Options from layers of texts, the first that has a name wins; absent and blank texts leave the default. Lists are divided by commas."""
        found = {}
        for f in fields(cls):
            text = next((t.strip() for layer in layers if (t := layer.get(prefix + f.name.upper())) and t.strip()), None)
            if text is None:
                continue
            if f.name == "terms":
                found[f.name] = tuple(t for t in (x.strip() for x in text.split(",")) if t)
            elif f.name in ("force", "reprocess"):
                found[f.name] = text.lower() in ("1", "true", "yes", "on")
            else:
                found[f.name] = int(text) if f.name == "attempts" else float(text)
        return cls(**found)

    @classmethod
    def from_environment(cls, **settings: str) -> Options:
        """Options from the environment, then from ``settings`` (names without prefix)."""
        return cls.read(os.environ, {f"PLATTERKIT_{k.upper()}": v for k, v in settings.items()})

    @property
    def again(self) -> bool:
        return self.force if self.reprocess is None else self.reprocess


@dataclass
class Run:
    """What a run leaves: the catalogue after it, and what failed, rows ``(step, id, error)``."""

    catalog: Catalog
    errors: DataFrame
    extra: dict[str, DataFrame] = field(default_factory=dict)


def _failed(spark: SparkSession, step: str, rows: DataFrame | None = None, key: str = "id") -> DataFrame:
    if rows is None:
        return spark.createDataFrame([], "step string, id long, error string")
    return rows.where("error is not null").select(F.lit(step).alias("step"), F.col(key).cast("long").alias("id"), "error")


def sync_collection(cat: Catalog, keys: DataFrame, detail: Callable[[int], dict[str, Any]], now: str, limit: int | None = None, force: bool = False) -> Run:
    """The catalogue after a sync with the collection's ``keys`` (``id, date_added``, as :func:`platterkit.sources.fetch.collection_keys` scans them).

    Details are fetched of the releases that aren't stored, or of all with ``force``. With ``limit``, a trial run over the first keys, nothing is removed, as
    the scan isn't complete. One release's error changes nothing of it and stops no other.
    """
    scan = stash(keys.where("id is not null").groupBy("id").agg(F.max("date_added").alias("date_added")))
    if limit is not None:
        scan = stash(sync.first_n(scan, limit, [F.col("id")]))
    wanted = scan.select("id") if force else sync.missing(scan, cat.releases.where("removed_from_discogs_at is null"), "id")
    fetched = stash(fetch.fetch_releases(wanted, detail))
    return Run(sync.sync(cat, scan, fetched, now, complete=limit is None), _failed(cat.releases.sparkSession, "sync", fetched))


def add_release(cat: Catalog, release_id: int, remote_add: Callable[[int], None], detail: Callable[[int], dict[str, Any]], now: str) -> Run:
    """One release added to the remote collection, then stored with ``now`` as its date; a remote failure is raised before anything is stored."""
    remote_add(release_id)
    spark = cat.releases.sparkSession
    fetched = stash(fetch.fetch_releases(spark.createDataFrame([(release_id,)], "id long"), detail))
    snapshot = spark.createDataFrame([(release_id, now)], "id long, date_added string")
    return Run(sync.sync(cat, snapshot, fetched, now, complete=False), _failed(spark, "add", fetched))


def remove_release(cat: Catalog, release_id: int, remote_remove: Callable[[int], None], now: str) -> Catalog:
    """One release removed from the remote collection, then marked as removed; one that isn't stored changes nothing."""
    remote_remove(release_id)
    at = F.when(F.col("id") == release_id, F.lit(now)).otherwise(F.col("removed_from_discogs_at"))
    return replace(cat, releases=cat.releases.withColumn("removed_from_discogs_at", at))


def releases_to_match(cat: Catalog, options: Options) -> DataFrame:
    """Rows ``(release_id)``: active releases with videos that a run takes up, those with an unclassified video or, if it goes through them again, all."""
    rows = pending.active(cat.releases).select(F.col("id").alias("release_id"))
    videos = cat.videos if options.again else cat.videos.where("video_type is null")
    return rows.join(videos.select("release_id").distinct(), "release_id", "left_semi")


def match_releases(
    cat: Catalog, releases: DataFrame, extract: Callable[[str], dict[str, Any] | None], now: str, options: Options = Options(), model: Callable[[str], str] | None = None,
    similarity: Similarity = weighted_similarity, force_model: bool = False,
) -> Run:
    """The catalogue after matching the videos of some releases (column ``release_id``): fetch missing metadata, resolve, write.

    Metadata is fetched of videos that were never fetched, or of all with ``options.force``. A failed fetch makes the video unrelated, with the reason, and
    is listed among the errors. Videos with a fetched title are resolved against their release's tracks; the matches of these tracks are replaced, and
    tracks of unknown length take that of their selected video.
    """
    ids = stash(releases.select("release_id").distinct())
    own = cat.videos.join(ids, "release_id", "left_semi")
    fetched = stash(fetch.fetch_video_metadata(own if options.force else own.where("yt_fetched_at is null"), extract))
    good, bad = fetched.where("error is null"), fetched.where("error is not null")
    videos = sync.stamp_metadata(cat.videos, fetched, now)
    videos = stash(videos)
    titled = videos.join(ids, "release_id", "left_semi").where("yt_title is not null")
    v = titled.select("id", "release_id", F.col("yt_title").alias("title"), F.col("yt_duration").alias("seconds"), F.coalesce("yt_chapters", F.array().cast("array<struct<title:string,start_time:double>>")).alias("chapters"), F.col("yt_description").alias("description"))
    t = cat.tracks.join(ids, "release_id", "left_semi").select("id", "release_id", "position", "title", "artist", parse_duration(F.col("duration")).alias("seconds"))
    names = cat.release_artists.join(ids, "release_id", "left_semi").join(cat.artists.withColumnRenamed("id", "artist_id"), "artist_id")
    lists = names.groupBy("release_id").agg(F.array_sort(F.collect_set("name")).alias("artists"))
    r = cat.releases.select(F.col("id").alias("release_id"), "title").join(ids, "release_id", "left_semi").join(lists, "release_id", "left").withColumnRenamed("release_id", "id")
    ask = None if model is None else lambda prompts: fetch.classify(prompts, model)
    results = stash(resolve.resolve(stash(t), stash(v), r, ask, similarity, options.confident, options.margin, options.terms, force_model))
    done = sync.write_matches(replace(cat, videos=videos), results, ids, now)
    selected = done.matches.where("is_selected = 1").join(t.select(F.col("id").alias("track_id")), "track_id", "left_semi")
    tracks = sync.backfill_durations(replace(done, matches=selected))
    return Run(replace(done, tracks=tracks), _failed(cat.releases.sparkSession, "fetch", fetched, "video_id"), {"fetched": good, "failed": bad, "results": results})


def match_videos(cat: Catalog, extract: Callable[[str], dict[str, Any] | None], now: str, options: Options = Options(), model: Callable[[str], str] | None = None, similarity: Similarity = weighted_similarity) -> Run:
    """:func:`match_releases` for all releases that a run takes up; ``force`` (fetch again) and ``reprocess`` (classify again) are independent."""
    return match_releases(cat, releases_to_match(cat, options), extract, now, options, model, similarity)


def retry_failed(cat: Catalog, extract: Callable[[str], dict[str, Any] | None], now: str, options: Options = Options(), model: Callable[[str], str] | None = None, similarity: Similarity = weighted_similarity) -> Run:
    """:func:`match_releases`, with metadata fetched again, for the releases with a video whose fetch is stuck or failed; removed releases count, too."""
    return match_releases(cat, pending.stuck_fetches(cat), extract, now, replace(options, force=True), model, similarity)


def match_local(cat: Catalog, folders: DataFrame, now: str, options: Options = Options()) -> Catalog:
    """The catalogue after matching active releases (the unmatched, or all with ``force``) with local folders ``(path, files)``; no folders change nothing."""
    if folders.isEmpty():
        return cat
    names = cat.release_artists.join(cat.artists.withColumnRenamed("id", "artist_id"), "artist_id").groupBy("release_id").agg(F.array_join(F.array_sort(F.collect_set("name")), ", ").alias("artists"))
    rel = pending.to_check_locally(cat, options.force).select("id", "title").join(names.withColumnRenamed("release_id", "id"), "id", "left")
    best, files = local_match.match_library(rel, cat.tracks, folders, options.local_confident)
    checked = rel.select(F.col("id").alias("release_id")).join(best, "release_id", "left")
    return sync.write_local_matches(cat, stash(checked), stash(files), now, options.local_confident)


def with_retries(one: Callable[[str, str], str], attempts: int = 3, delay: float = 2.0) -> Callable[[str, str], str]:
    """``one`` tried again after a failure, ``attempts`` times in all, ``delay`` seconds apart; the last failure is raised."""

    def run(url: str, stem: str) -> str:
        for attempt in range(1, max(1, attempts) + 1):
            try:
                return one(url, stem)
            except Exception:  # noqa: BLE001 - whatever a download raises
                if attempt >= attempts:
                    raise
                time.sleep(delay)
        raise AssertionError

    return run


def download(cat: Catalog, releases: DataFrame, kept: DataFrame, one: Callable[[str, str], str], options: Options = Options()) -> DataFrame:
    """Rows ``(track_id, position, title, path, status, error)`` for tracks of some releases that have a selected video.

    ``kept`` is :func:`platterkit.sources.folders.downloads`; a track that has a file there isn't downloaded. ``one`` takes a URL and ``<release>/<stem>``
    and gives the path; failures are tried again and, in the end, a status.
    """
    wanted = pending.downloadable(cat).join(releases.select("release_id").distinct(), "release_id", "left_semi")
    wanted = wanted.select(F.col("id").alias("track_id"), "release_id", "position", "title", "url", audio_stem(F.col("position"), F.col("title")).alias("stem"))
    there = wanted.join(kept.select("release_id", "stem", "path"), ["release_id", "stem"], "left")
    fetch_one = with_retries(one, options.attempts, options.delay)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                try:
                    out.append((r.track_id, r.position, r.title, fetch_one(r.url, f"{r.release_id}/{r.stem}"), "downloaded", None))
                except Exception as error:  # noqa: BLE001 - one track must not stop the others
                    out.append((r.track_id, r.position, r.title, None, "failed", f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(out, columns=["track_id", "position", "title", "path", "status", "error"], dtype=object)

    schema = "track_id long, position string, title string, path string, status string, error string"
    fresh = there.where("path is null").select("track_id", "release_id", "position", "title", "url", "stem").mapInPandas(run, schema)
    old = there.where("path is not null").select("track_id", "position", "title", "path", F.lit("already_downloaded").alias("status"), F.lit(None).cast("string").alias("error"))
    return old.unionByName(fresh)


def analyze_library(cat: Catalog, paths: DataFrame, analyse: Callable[[str], dict], schema: str, now: str, force: bool = False) -> Run:
    """The catalogue after an analysis of active releases' tracks that have a local file or a download (``paths``: ``track_id, path``).

    By default only tracks that aren't analysed are; a local file goes before a download. A track's failure leaves it as it is and is among the errors.
    """
    open_ = pending.analyzable_tracks(cat, not force).join(pending.active(cat.releases).select(F.col("id").alias("release_id")), "release_id", "left_semi")
    where = open_.join(paths.groupBy(F.col("track_id").alias("id")).agg(F.min("path").alias("kept")), "id", "left").select("id", F.coalesce("local_audio_path", "kept").alias("path")).where("path is not null")
    results = stash(scores.analyze(where, analyse, schema))
    good = results.where("error is null").drop("error")
    good = good if "waveform_path" in good.columns else good.withColumn("waveform_path", F.lit(None).cast("string"))
    return Run(replace(cat, tracks=sync.write_analysis(cat.tracks, good, now)), _failed(cat.releases.sparkSession, "analyze", results, "track_id"))


def match_and_download(
    cat: Catalog, extract: Callable[[str], dict[str, Any] | None], one: Callable[[str, str], str], kept: DataFrame, now: str, options: Options = Options(),
    model: Callable[[str], str] | None = None, folders: DataFrame | None = None, similarity: Similarity = weighted_similarity,
) -> Run:
    """The first pass over the library: local files, then matching, then downloads, for active releases with videos.

    Releases all of whose tracks have a local file are left out unless forced; matched are those that need it (an unclassified video), downloaded those with
    a track left to analyse, which is asked again after matching. ``extra`` has the ``downloads``.
    """
    if folders is not None:
        cat = match_local(cat, folders, now, options)
    base = pending.active(cat.releases).select(F.col("id").alias("release_id")).join(cat.videos.select("release_id").distinct(), "release_id", "left_semi")
    if not options.force:
        open_ = pending.with_unclassified_video(cat).unionByName(pending.pending(cat)).select(F.col("id").alias("release_id")).distinct()
        base = base.join(open_, "release_id", "left_semi").join(pending.locally_covered(cat), "release_id", "left_anti")
    base = stash(base)
    need = base if options.force else base.join(cat.videos.where("video_type is null or yt_fetched_at is null").select("release_id").distinct(), "release_id", "left_semi")
    matched = match_releases(cat, need, extract, now, options, model, similarity)
    still = base if options.force else base.join(pending.needing_analysis(matched.catalog).select(F.col("id").alias("release_id")), "release_id", "left_semi")
    got = stash(download(matched.catalog, still, kept, one, options))
    return Run(matched.catalog, matched.errors.unionByName(_failed(cat.releases.sparkSession, "download", got, "track_id")), {"downloads": got})


def run_all(
    cat: Catalog, extract, one, kept: DataFrame, analyse, schema: str, now: str, options: Options = Options(), model=None, folders: DataFrame | None = None, similarity: Similarity = weighted_similarity, stopped: Callable[[], bool] = lambda: False,
) -> Run:
    """Both passes, one after the other: everything is matched and downloaded before anything is analysed; a run that is stopped after the first leaves out the second."""
    first = match_and_download(cat, extract, one, kept, now, options, model, folders, similarity)
    if stopped():
        return first
    paths = first.extra["downloads"].where("path is not null").select("track_id", "path")
    second = analyze_library(first.catalog, paths, analyse, schema, now, options.force)
    return Run(second.catalog, first.errors.unionByName(second.errors), first.extra)


class Runs:
    """Runs of each kind, one at a time, whose Spark jobs can be stopped from another thread."""

    def __init__(self, spark: SparkSession):
        self._spark, self._going = spark, set()

    def start(self, kind: str, run: Callable[[], Any]) -> Any:
        """The result of ``run``, whose jobs form the group ``kind``; a second run of a kind is refused while one is going."""
        if kind in self._going:
            raise RuntimeError(f"{kind} is running")
        self._going.add(kind)
        try:
            self._spark.sparkContext.setJobGroup(kind, kind, interruptOnCancel=True)
            return run()
        finally:
            self._going.discard(kind)
            self._spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)

    def going(self) -> set[str]:
        return set(self._going)

    def stop(self, kind: str) -> None:
        """Cancels the jobs of a kind; a kind that isn't running is left alone."""
        if kind in self._going:
            self._spark.sparkContext.cancelJobGroup(kind)
