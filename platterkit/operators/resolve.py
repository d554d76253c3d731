"""Matching videos to tracks within releases: gated scores, best two, tie margin, denoised retry, escalation, selection.

Everything runs over all releases at once. The duration gate stands before the similarity, so that the kernel sees
only pairs that can count; similarity is any function of two columns that gives 0 to 100.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from platterkit.functions.similarity import weighted_similarity
from platterkit.functions.text import denoise, format_duration, has_content
from platterkit.session import stash

# The score of a sure match, its least distance to the next, the deviation of lengths that rules a pair out, and words that titles repeat.
CONFIDENT, MARGIN, DEVIANCE, TERMS = 0.8, 0.05, 0.2, ("Original Mix",)
#: Parts over which the tracks of a release are spread to meet its videos.
SPREAD = 4
Similarity = Callable[[Column, Column], Column]
TRACKLIST = "array<struct<id:bigint,position:string,title:string,artist:string,seconds:int>>"


def gap(track: Column, video: Column) -> Column:
    """Relative deviation of two lengths, null unless both are known and not 0."""
    return F.when((track > 0) & (video > 0), F.abs(track - video) / track)


def score_pairs(pairs: DataFrame, similarity: Similarity = weighted_similarity, deviance: float = DEVIANCE) -> DataFrame:
    """``pairs`` with ``score`` in [0, 1].

    Columns ``track_title, track_artist, track_seconds, video_title, video_seconds``. Lengths that deviate by more than the gate give 0; else
    the title's similarity, with the artist's name if that is better, makes 0.7 of the score and the lengths 0.3, or all if a length is unknown.
    """
    r = gap(F.col("track_seconds"), F.col("video_seconds"))
    gated = pairs.withColumn("__gap", r)
    shut = gated.where(F.col("__gap") > deviance).withColumn("score", F.lit(0.0)).drop("__gap")
    opened = gated.where(F.col("__gap").isNull() | (F.col("__gap") <= deviance))
    with_artist = F.concat_ws(" ", "track_title", "track_artist")
    title = F.greatest(similarity(F.col("track_title"), F.col("video_title")), F.when(F.coalesce("track_artist", F.lit("")) != "", similarity(with_artist, F.col("video_title"))).otherwise(F.lit(0.0)))
    scored = opened.withColumn("__title", title)
    both = (0.7 * F.col("__title") + 0.3 * F.greatest(F.lit(0.0), 100.0 - 100.0 * F.col("__gap"))) / 100
    return scored.withColumn("score", F.when(F.col("__gap").isNotNull(), both).otherwise(F.col("__title") / 100)).drop("__gap", "__title").unionByName(shut)


def best_two(scored: DataFrame, video: str = "video_id", track: str = "track_id") -> DataFrame:
    """Rows ``(<video>, best, best_score, runner_up)``: ties go to the earlier track, a best of 0 is none, a missing runner-up is 0.

    A track counts once for a video. Plan: windows that keep only the first two rows of a video are cut down before their shuffle and hold no more than these.
    """
    rank = F.row_number().over(W.partitionBy(video).orderBy(F.desc("score"), track))
    two = scored.select(video, F.col(track).alias("t"), "score", rank.alias("r")).where("r <= 2")
    best = F.max(F.when(F.col("r") == 1, F.col("score")))
    return two.groupBy(video).agg(F.max(F.when((F.col("r") == 1) & (F.col("score") > 0), F.col("t"))).alias("best"), best.alias("best_score"), F.coalesce(F.max(F.when(F.col("r") == 2, F.col("score"))), F.lit(0.0)).alias("runner_up"))


def is_confident(threshold: float = CONFIDENT, margin: float = MARGIN) -> Column:
    """Whether a best match can be trusted: high enough and clear of its runner-up."""
    return F.col("best").isNotNull() & (F.col("best_score") >= threshold) & (F.col("best_score") - F.col("runner_up") >= margin)


def pairs_within(tracks: DataFrame, videos: DataFrame, terms: Sequence[str] = TERMS) -> DataFrame:
    """All pairs of tracks and videos of a release, track titles without the terms.

    Tracks of releases without a video, such as an archive of loose sides, are left out before anything is computed of them. A release with many of both is a hot key, so its
    tracks are spread over SPREAD parts, to each of which its videos go.
    """
    tracks = tracks.join(videos.select("release_id").distinct(), "release_id", "left_semi")
    t = tracks.select("release_id", F.col("id").alias("track_id"), F.col("title").alias("raw_title"), denoise(F.col("title"), terms=terms).alias("track_title"), F.col("artist").alias("track_artist"), F.col("seconds").alias("track_seconds"), "position")
    v = videos.select("release_id", F.col("id").alias("video_id"), F.col("title").alias("video_title"), F.col("seconds").alias("video_seconds"))
    t = t.withColumn("__part", F.pmod(F.xxhash64("track_id"), F.lit(SPREAD)).cast("int"))
    v = v.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    return t.join(v, ["release_id", "__part"]).drop("__part")


def prompt(release: Column, artists: Column, tracklist: Column, title: Column, seconds: Column, chapters: Column, description: Column) -> Column:
    """What a model is asked about one video: the record with its artists, its tracks, each with its own artist or the record's, and what is known of the video."""
    names = F.array_join(F.coalesce(artists, F.array().cast("array<string>")), ", ")
    by = lambda t: F.concat(F.lit("by "), F.when(F.coalesce(t["artist"], F.lit("")) != "", t["artist"]).otherwise(names))
    place = lambda t: F.when(F.coalesce(t["position"], F.lit("")) != "", t["position"]).otherwise("?")
    lines = F.array_join(F.transform(F.coalesce(tracklist, F.array().cast(TRACKLIST)), lambda t: F.concat_ws(" ", place(t), t["title"], by(t), F.concat(F.lit("("), format_duration(t["seconds"]), F.lit(")")))), "\n")
    return F.concat(
        F.lit("Record: "), F.coalesce(release, F.lit("")), F.lit(" by "), names, F.lit("\nTracks:\n"), lines, F.lit("\n\nVideo: "), F.coalesce(title, F.lit("")), F.lit("\nLength: "), format_duration(seconds), F.lit("\nChapters: "),
        F.coalesce(chapters, F.lit(0)).cast("string"), F.lit("\nDescription: "), F.translate(F.coalesce(F.left(description, F.lit(300)), F.lit("")), "\n", " "),
        F.lit('\n\nReply in JSON: {"classification": "full_track, compilation_or_mix or unrelated", "matched_track_position": position or null, "confidence": 0 to 1, "reasoning": "short"}'),
    )


def resolve(
    tracks: DataFrame,
    videos: DataFrame,
    releases: DataFrame,
    classify: Callable[[DataFrame], DataFrame] | None = None,
    similarity: Similarity = weighted_similarity,
    threshold: float = CONFIDENT,
    margin: float = MARGIN,
    terms: Sequence[str] = TERMS,
    force_model: bool = False,
) -> DataFrame:
    """Rows ``(release_id, video_id, track_id, fuzzy_score, video_type, best_position, llm_confidence, llm_reasoning, is_selected)``, one a video.

    tracks: ``id, release_id, position, title, artist, seconds``; videos: ``id, release_id, title, seconds, chapters, description``; releases:
    ``id, title, artists`` (array). ``classify`` takes ``(video_id, prompt)`` and gives ``(video_id, classification, position, confidence, reasoning)``;
    without it, what is ambiguous stays unrelated. At most one video is selected for each track.
    """
    keep = ["release_id", "video_id", "video_title", "video_seconds"]
    pairs = pairs_within(tracks, videos, terms)
    listed = videos.select("release_id", F.col("id").alias("video_id"), F.col("title").alias("video_title"), F.col("seconds").alias("video_seconds"), "chapters", "description")
    raw = listed.join(best_two(score_pairs(pairs, similarity)), "video_id", "left").fillna(0.0, ["best_score", "runner_up"])
    raw = raw.withColumn("route", F.when(F.lit(force_model), "model").when(is_confident(threshold, margin), "sure").when(F.col("best").isNull(), "none").otherwise("retry"))
    raw = stash(raw)  # the scores are taken once, all that follows reads them
    # once more without the words an uploader repeats
    names = releases.select(F.col("id").alias("release_id"), F.concat(F.array("title"), F.coalesce("artists", F.array().cast("array<string>"))).alias("names"))
    retry = raw.where("route = 'retry'").join(names, "release_id", "left").withColumn("bare", denoise(F.col("video_title"), F.coalesce("names", F.array().cast("array<string>")), terms))
    changed = retry.where((F.col("bare") != "") & (F.col("bare") != F.coalesce("video_title", F.lit(""))) & has_content(F.col("bare")))
    again_pairs = pairs.drop("video_title").join(changed.select("video_id", F.col("bare").alias("video_title")), "video_id")
    again = best_two(score_pairs(again_pairs, similarity)).select("video_id", F.col("best").alias("b2"), F.col("best_score").alias("s2"), F.col("runner_up").alias("r2"))
    second = retry.join(changed.select("video_id", F.lit(True).alias("tried")), "video_id", "left").join(again, "video_id", "left")
    tried = F.coalesce("tried", F.lit(False))
    second = second.withColumns(
        {
            "best": F.when(tried, F.col("b2")).otherwise(F.col("best")),
            "best_score": F.when(tried, F.coalesce("s2", F.lit(0.0))).otherwise(F.col("best_score")),
            "runner_up": F.when(tried, F.coalesce("r2", F.lit(0.0))).otherwise(F.col("runner_up")),
            "video_title": F.when(tried, F.col("bare")).otherwise(F.col("video_title")),
        }
    )
    second = stash(second.withColumn("route", F.when(tried & is_confident(threshold, margin), "sure").otherwise("model")))
    columns = [*keep, "chapters", "description", "best", "best_score", "route"]
    routed = raw.where("route <> 'retry'").select(*columns).unionByName(second.select(*columns))
    place = tracks.select(F.col("id").alias("best"), F.col("position").alias("best_position"))
    routed = routed.join(place, "best", "left")
    blank = lambda kind: F.lit(None).cast(kind)
    sure = routed.where("route <> 'model'").select(
        "release_id", "video_id", F.when(F.col("route") == "sure", F.col("best")).alias("track_id"), F.col("best_score").alias("fuzzy_score"),
        F.when(F.col("route") == "sure", "full_track").otherwise("unrelated").alias("video_type"), "best_position", blank("double").alias("llm_confidence"), blank("string").alias("llm_reasoning"), F.lit(0).alias("late"),
    )
    open_ = routed.where("route = 'model'")
    asked = _ask(open_, tracks, releases, classify, similarity, margin)
    return select_matches(sure.unionByName(asked))


def _ask(open_: DataFrame, tracks: DataFrame, releases: DataFrame, classify, similarity: Similarity, margin: float) -> DataFrame:
    """The ambiguous videos with the model's verdict, which is overruled where it names a track that scores clearly below the best."""
    none = open_.select("video_id").limit(0).select("video_id", *[F.lit(None).cast("string").alias(c) for c in ("classification", "position", "reasoning")], F.lit(None).cast("double").alias("confidence"))
    if classify is None:
        verdicts = none
    else:
        lists = tracks.join(open_.select("release_id").distinct(), "release_id", "left_semi").groupBy("release_id").agg(F.array_sort(F.collect_list(F.struct("id", "position", "title", "artist", F.col("seconds").cast("int").alias("seconds")))).alias("tracklist"))
        own = releases.select(F.col("id").alias("release_id"), F.col("title").alias("release_title"), "artists")
        asked = open_.join(lists, "release_id", "left").join(own, "release_id", "left").select("video_id", prompt(F.col("release_title"), F.col("artists"), F.col("tracklist"), F.col("video_title"), F.col("video_seconds"), F.size("chapters"), F.col("description")).alias("prompt"))
        verdicts = classify(asked).select("video_id", "classification", "position", "confidence", "reasoning")
    rows = open_.join(verdicts, "video_id", "left")
    # of equal positions in a release the last track counts
    at = tracks.where("position <> ''").groupBy("release_id", "position").agg(F.max(F.struct("id", "title", "artist", "seconds")).alias("claim"))
    claimed = rows.join(at, ["release_id", "position"], "left")
    scored = score_pairs(
        claimed.where("claim is not null").select("video_id", F.col("claim.title").alias("track_title"), F.col("claim.artist").alias("track_artist"), F.col("claim.seconds").alias("track_seconds"), "video_title", "video_seconds"),
        similarity,
    ).select("video_id", F.col("score").alias("claim_score"))
    full = claimed.join(scored, "video_id", "left")
    failed = F.col("classification").isNull()
    is_track = (F.col("classification") == "full_track") & F.col("claim").isNotNull()
    distrust = is_track & F.col("best").isNotNull() & (F.col("claim.id") != F.col("best")) & (F.col("best_score") - F.coalesce("claim_score", F.lit(0.0)) >= margin)
    return full.select(
        "release_id",
        "video_id",
        F.when(failed, None).when(distrust, F.col("best")).when(is_track, F.col("claim.id")).alias("track_id"),
        F.when(is_track & ~distrust, F.col("claim_score")).otherwise(F.col("best_score")).alias("fuzzy_score"),
        F.when(failed, F.lit("unrelated")).otherwise(F.col("classification")).alias("video_type"),
        "best_position",
        F.when(distrust, None).otherwise(F.col("confidence")).alias("llm_confidence"),
        F.when(distrust, F.concat(F.lit("falling back to the best score instead of: "), F.coalesce("reasoning", F.lit("")))).otherwise(F.col("reasoning")).alias("llm_reasoning"),
        F.lit(1).alias("late"),
    )


def select_matches(results: DataFrame) -> DataFrame:
    """``results`` with ``is_selected``: of each track the video whose score and confidence (or score again) are highest on average, of equals the first.

    The order is that of results: first what was sure, then what a model decided, each by video id.
    """
    key = (F.col("fuzzy_score") + F.coalesce("llm_confidence", "fuzzy_score")) / 2
    ranked = F.row_number().over(W.partitionBy("track_id").orderBy(key.desc(), "late", "video_id"))
    chosen = results.where("track_id is not null").withColumn("is_selected", (ranked == 1).cast("int"))
    return chosen.unionByName(results.where("track_id is null").withColumn("is_selected", F.lit(0))).drop("late")


def score_matrix(tracks: DataFrame, videos: DataFrame, matches: DataFrame, similarity: Similarity = weighted_similarity) -> DataFrame:
    """Rows ``(release_id, video_id, track_id, score, is_selected, is_llm_selected)`` for every pair of a release, with titles as they are."""
    scored = score_pairs(pairs_within(tracks, videos, ()).withColumn("track_title", F.col("raw_title")), similarity)
    own = matches.select("track_id", "video_id", "is_selected", F.col("llm_confidence").isNotNull().alias("by_model"))
    joined = scored.join(own, ["track_id", "video_id"], "left")
    picked = F.coalesce(F.col("is_selected") == 1, F.lit(False))
    return joined.select("release_id", "video_id", "track_id", "score", picked.alias("is_selected"), (picked & F.coalesce("by_model", F.lit(False))).alias("is_llm_selected"))
