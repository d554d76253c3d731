"""A catalogue made from the test tables, and the same in SQL, for the queries of the catalogue's own operators.

The test tables hold no bridges, analysis results, matches or crates. They are derived here by fixed rules, the same in Spark and
in SQL: bridges from credits and label names, analysis values from ids, matches from videos whose title holds a track's title.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from platterkit.operators.sync import latest
from platterkit.schema import Catalog
from platterkit.session import read

NOW = "2025-06-01T00:00:00"


def catalog(spark: SparkSession, d: str) -> Catalog:
    """The catalogue of a data directory."""
    t = lambda name: read(spark, d, name)
    releases = latest(t("releases"), "id", "last_synced_at")
    releases = releases.withColumn("local_matched_at", F.when(F.col("id") % 4 == 0, F.lit(NOW)))
    names = releases.where("label_name is not null").groupBy("label_name").agg(F.min("id").alias("label_id"))
    labels = names.select(F.col("label_id").alias("id"), F.col("label_name").alias("name"))
    release_labels = releases.join(names, "label_name").select(F.col("id").alias("release_id"), "label_id", "catalog_number")
    credits = t("release_credits").select("id", "release_id", "artist_id", "artist_name", "role", "tracks", "name_variation").distinct()
    artists = t("artists").groupBy("id").agg(F.max("name").alias("name"))
    i = F.col("id")
    tracks = t("tracks").select("id", "release_id", "position", "title", "duration", "artist").distinct()
    tracks = tracks.withColumns(
        {
            "bpm": F.when(i % 7 == 0, None).otherwise(80.0 + (i % 9000) / 100.0),
            "musical_key": F.get(F.array(*[F.lit(k) for k in ("C", "A", "F#", "Eb", "H")]), (i % 5).cast("int")),
            "musical_key_scale": F.when(i % 2 == 0, "minor").otherwise("major"),
            "analyzed_at": F.when(i % 3 == 0, F.lit(NOW)),
            "local_audio_path": F.when(i % 5 == 0, F.concat(F.lit("/music/"), i.cast("string"), F.lit(".flac"))),
            "genre": F.when(i % 6 != 0, F.get(F.array(F.lit("Rock"), F.lit("Jazz"), F.lit("")), (i % 3).cast("int"))),
            "style": F.when(i % 4 != 0, F.concat(F.lit("Rock---Style "), (i % 4).cast("string"))),
        }
    )
    videos = t("release_videos").select("id", "release_id", "title", "url", "duration", "description").distinct()
    videos = videos.withColumns(
        {
            "yt_title": F.when(i % 5 != 0, F.col("title")),
            "yt_duration": F.when(i % 5 != 0, F.col("duration").cast("int")),
            "yt_fetched_at": F.when(i % 6 != 0, F.lit(NOW)),
            "video_type": F.when(i % 3 == 0, "full_track").when(i % 3 == 1, "unrelated"),
            "video_type_reasoning": F.when(i % 13 == 0, F.lit("metadata fetch failed")),
        }
    )
    holds = F.contains(F.lower("v.title"), F.lower("t.title"))
    pairs = videos.alias("v").join(tracks.alias("t"), (F.col("v.release_id") == F.col("t.release_id")) & holds)
    score = 0.6 + (F.col("v.id") % 40) / 100.0
    matches = pairs.select(F.col("t.id").alias("track_id"), F.col("v.id").alias("video_id"), score.alias("fuzzy_score"), F.when(F.col("v.id") % 2 == 0, 0.9).alias("llm_confidence"), F.lit(None).cast("string").alias("llm_reasoning"))
    best = F.row_number().over(W.partitionBy("track_id").orderBy(F.desc("fuzzy_score"), "video_id"))
    matches = matches.withColumn("is_selected", (best == 1).cast("int")).withColumn("created_at", F.lit(NOW))
    crates = t("nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), F.concat(F.lit("2024-01-"), F.lpad((F.col("n_nationkey") + 1).cast("string"), 2, "0")).alias("created_at"))
    crate_releases = releases.where("id % 3 = 0").select((i % 20).alias("crate_id"), i.alias("release_id"), F.lit(NOW).alias("added_at"))
    stickers = releases.where("id % 11 = 0").select(i.alias("release_id"), F.lit(NOW).alias("added_at"))
    return Catalog(releases, artists, credits.select("release_id", "artist_id").distinct(), labels, release_labels, tracks, videos, credits, matches, crates, crate_releases, stickers)


def sql(query: str) -> str:
    """A DuckDB query over the derived tables, which are named c_releases, c_artists and so on."""
    return _TABLES + query


_TABLES = f"""with c_releases as (select id, arg_max(r, r.last_synced_at).title title, arg_max(r, r.last_synced_at)."year" "year", arg_max(r, r.last_synced_at).genres genres,
   arg_max(r, r.last_synced_at).styles styles, arg_max(r, r.last_synced_at).label_name label_name, arg_max(r, r.last_synced_at).catalog_number catalog_number,
   arg_max(r, r.last_synced_at).date_added date_added, arg_max(r, r.last_synced_at).removed_from_discogs_at removed_from_discogs_at, arg_max(r, r.last_synced_at).artist_names artist_names,
   arg_max(r, r.last_synced_at).country country, arg_max(r, r.last_synced_at).cover_image_url cover_image_url, arg_max(r, r.last_synced_at).discogs_uri discogs_uri,
   case when id % 4 = 0 then '{NOW}' end local_matched_at
   from releases r where id is not null group by id),
 c_label_ids as (select label_name, min(id) label_id from c_releases where label_name is not null group by 1),
 c_labels as (select label_id id, label_name "name" from c_label_ids),
 c_release_labels as (select id release_id, label_id, catalog_number from c_releases join c_label_ids using (label_name)),
 c_credits as (select distinct id, release_id, artist_id, artist_name, role, tracks, name_variation from release_credits),
 c_artists as (select id, max(name) "name" from artists group by 1),
 c_release_artists as (select distinct release_id, artist_id from c_credits),
 c_tracks as (select *, case when id % 7 <> 0 then 80.0::double + (id % 9000)::double / 100.0 end bpm, ['C', 'A', 'F#', 'Eb', 'H'][(id % 5)::int + 1] musical_key,
   case when id % 2 = 0 then 'minor' else 'major' end musical_key_scale, case when id % 3 = 0 then '{NOW}' end analyzed_at,
   case when id % 5 = 0 then '/music/' || id || '.flac' end local_audio_path, case when id % 6 <> 0 then ['Rock', 'Jazz', ''][(id % 3)::int + 1] end genre,
   case when id % 4 <> 0 then 'Rock---Style ' || (id % 4) end "style"
   from (select distinct id, release_id, "position", title, duration, artist from tracks)),
 c_videos as (select *, case when id % 5 <> 0 then title end yt_title, case when id % 5 <> 0 then duration::int end yt_duration, case when id % 6 <> 0 then '{NOW}' end yt_fetched_at,
   case when id % 3 = 0 then 'full_track' when id % 3 = 1 then 'unrelated' end video_type, case when id % 13 = 0 then 'metadata fetch failed' end video_type_reasoning
   from (select distinct id, release_id, title, url, duration, description from release_videos)),
 c_matches as (select *, (row_number() over (partition by track_id order by fuzzy_score desc, video_id) = 1)::int is_selected from (
   select t.id track_id, v.id video_id, 0.6::double + (v.id % 40)::double / 100.0 fuzzy_score, case when v.id % 2 = 0 then 0.9::double end llm_confidence
   from c_videos v join c_tracks t on v.release_id = t.release_id and contains(lower(v.title), lower(t.title)))),
 c_crates as (select n_nationkey::bigint id, n_name "name", '2024-01-' || lpad((n_nationkey + 1)::varchar, 2, '0') created_at from nation),
 c_crate_releases as (select id % 20 crate_id, id release_id from c_releases where id % 3 = 0),
 c_stickers as (select id release_id from c_releases where id % 11 = 0),
 c_active as (select * from c_releases where removed_from_discogs_at is null)
"""


def flat(df: DataFrame, *columns: str) -> DataFrame:
    """Some columns of a result, unordered."""
    return df.select(*columns)
