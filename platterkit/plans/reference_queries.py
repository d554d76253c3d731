"""Queries of the catalogue engine's own operators over whole test tables, with their SQL where SQL can state them.

Each entry of ``_DEFINED`` is a name, the query and its DuckDB SQL (None where the kernel is not SQL: it is then tested against
brute force on a small fixture).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from platterkit.functions import music, text
from platterkit.functions.similarity import word_similarity
from platterkit.operators import detail, facets, layout, local_match, pending, pipeline, resolve, scores, search, sync
from platterkit.plans.fixture import NOW, catalog, sql
from platterkit.schema import TABLES, Catalog
from platterkit.session import read, shared_path, stash
from platterkit.streaming.sync_stream import read_state, stream_counts, stream_upserts

Query = Callable[[SparkSession, str], DataFrame]
_DEFINED: list[tuple[str, Query, str | None]] = []


def _define(name: str, query: Query, oracle: str | None) -> None:
    _DEFINED.append((name, query, oracle))


def _cat(name: str, run: Callable[[Catalog], DataFrame], oracle: str | None) -> None:
    """A query over the derived catalogue."""
    _define(name, lambda spark, d: run(catalog(spark, d)), sql(oracle) if oracle else None)


def _table(name: str, table: str, run: Callable[[DataFrame], DataFrame], oracle: str | None) -> None:
    """A query over one test table."""
    _define(name, lambda spark, d: run(read(spark, d, table)), oracle)


# faceted search
_SUMMARY = """, names as (select release_id, array_to_string(list(n order by artist_id), ', ') artist_names from (
    select distinct release_id, artist_id, a."name" n from c_release_artists join c_artists a on a.id = artist_id) group by 1),
 tc as (select t.release_id, count(*) track_count, coalesce(sum(m), 0)::bigint matched_count, count(analyzed_at) analyzed_count
   from c_tracks t left join (select track_id, count(*) m from c_matches where is_selected = 1 group by 1) on track_id = t.id group by 1),
 vc as (select release_id, count(*) filter (where video_type is null) = 0 processed from c_videos group by 1),
 summary as (select r.id, r.title, r."year", regexp_replace(coalesce(names.artist_names, ''), '\\s\\(\\d+\\)(,|$)', '\\1', 'g') artist_names, coalesce(track_count, 0) track_count,
   coalesce(matched_count, 0) matched_count, coalesce(analyzed_count, 0) analyzed_count, coalesce(processed, true) matching_processed, r.date_added
   from c_active r left join names on names.release_id = r.id left join tc on tc.release_id = r.id left join vc on vc.release_id = r.id)
"""


def list_active(spark: SparkSession, d: str) -> DataFrame:
    """The first page of the active releases with names, counts and statuses."""
    rows = search.list_releases(catalog(spark, d))
    return rows.select("id", "title", "year", "artist_names", "track_count", "matched_count", "analyzed_count", "matching_processed", "date_added")


_define("list_active", list_active, sql(_SUMMARY + "select * from summary order by date_added desc nulls last, id limit 48"))
_cat(
    "list_all_statuses",
    lambda c: search.list_releases(c, limit=None).select("id", "matching_status", "analysis_status"),
    _SUMMARY
    + """select id, case when not matching_processed or track_count <= 0 then '' when matched_count = track_count then 'done' else 'partial' end matching_status,
      case when matched_count <= 0 or analyzed_count < matched_count then '' when matched_count = track_count then 'done' else 'partial' end analysis_status from summary""",
)
_cat("count_active", search.count_releases, "select count(*) n from c_active")
_PAGE = [("sort_title_page_2", "title_asc", "translate(title, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"), ("sort_year_page_2", "year_desc", '"year" desc nulls last'), ("sort_year_asc_page_2", "year_asc", '"year" nulls first')]
for _name, _sort, _by in _PAGE:
    _cat(_name, lambda c, s=_sort: search.list_releases(c, s, 48, 48).select("id", "title"), f"select id, title from c_active order by {_by}, id limit 48 offset 48")
for _name, _sort, _bridge, _names, _key in (("sort_artist", "artist_asc", "c_release_artists", "c_artists", "artist_id"), ("sort_label", "label_asc", "c_release_labels", "c_labels", "label_id")):
    _cat(
        _name,
        lambda c, s=_sort: search.list_releases(c, s, 100).select("id"),
        f"""select r.id from c_active r left join (select release_id, arg_min(n."name", (translate(n."name", 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), n."name")) k
            from {_bridge} join {_names} n on n.id = {_key} group by 1) on release_id = r.id order by k nulls first, r.id limit 100""",
    )
_ids = lambda **f: lambda c: search.filter_releases(c, **f).select("id")  # noqa: E731
_named = lambda bridge, names, key, q: f"exists (select 1 from {bridge} b join {names} n on n.id = b.{key} where b.release_id = r.id and contains({text.fold_sql('n.\"name\"')}, {text.fold_sql(q)}))"  # noqa: E731
_cat("search_q", _ids(q="GRÖSSE"), f"select id from c_active r where contains({text.fold_sql('title')}, {text.fold_sql(chr(39) + 'GRÖSSE' + chr(39))}) or {_named('c_release_artists', 'c_artists', 'artist_id', chr(39) + 'GRÖSSE' + chr(39))}")
_cat("search_q_artist", _ids(q="nodadar"), f"select id from c_active r where contains({text.fold_sql('title')}, 'nodadar') or {_named('c_release_artists', 'c_artists', 'artist_id', chr(39) + 'nodadar' + chr(39))}")
_WILD = ("%", "_", "2 %", "SIDE_A", "100%_")  # signs that patterns would read as wildcards


def search_q_wildcards(spark: SparkSession, d: str) -> DataFrame:
    """How many documents hold each text with wildcard signs, taken literally."""
    docs = read(spark, d, "documents")
    counts = docs.agg(*[F.count(F.when(text.contains_folded(F.col("text"), q), 1)).alias(f"n{i}") for i, q in enumerate(_WILD)])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(q).alias("q"), F.col(f"n{i}").alias("n")) for i, q in enumerate(_WILD)])))


_define("search_q_wildcards", search_q_wildcards, " union all ".join(f"select '{q}' q, count(*) filter (where contains(lower(\"text\"), '{q.lower()}')) n from documents" for q in _WILD))
_cat("genres_any_of", _ids(genres=["Jazz", "Electronic", ""]), "select id from c_active where list_has_any(genres, ['Jazz', 'Electronic'])")
_cat("styles_any_of", _ids(styles=["House", "Dub"]), "select id from c_active where list_has_any(styles, ['House', 'Dub'])")
_cat("year_eq", _ids(year=1984), 'select id from c_active where "year" = 1984')
_cat("label_semi", _ids(label_name="rille"), f"select id from c_active r where {_named('c_release_labels', 'c_labels', 'label_id', chr(39) + 'rille' + chr(39))}")
_cat("artist_semi", _ids(artist_name="TRIO"), f"select id from c_active r where {_named('c_release_artists', 'c_artists', 'artist_id', chr(39) + 'trio' + chr(39))}")
_cat("bpm_band", _ids(bpm=120.0, bpm_tolerance=0.08), "select id from c_active r where exists (select 1 from c_tracks t where t.release_id = r.id and bpm between 120 * (1 - 0.08::double) and 120 * (1 + 0.08::double))")
_cat("bpm_exact", _ids(bpm=120.0, bpm_tolerance=0.0), "select id from c_active r where exists (select 1 from c_tracks t where t.release_id = r.id and bpm between 119.5 and 120.5)")
_cat("crate_member", _ids(crate_id=0), "select id from c_active r where exists (select 1 from c_crate_releases c where c.release_id = r.id and crate_id = 0)")
_cat("sticker_member", _ids(in_stickers=True), "select id from c_active r where exists (select 1 from c_stickers s where s.release_id = r.id)")
_cat(
    "all_filters",
    _ids(genres=["Rock", "Jazz"], label_name="a", bpm=110.0, bpm_tolerance=0.16, artist_name="e"),
    f"""select id from c_active r where list_has_any(genres, ['Rock', 'Jazz']) and {_named('c_release_labels', 'c_labels', 'label_id', chr(39) + 'a' + chr(39))}
        and {_named('c_release_artists', 'c_artists', 'artist_id', chr(39) + 'e' + chr(39))}
        and exists (select 1 from c_tracks t where t.release_id = r.id and bpm between 110 * (1 - 0.16::double) and 110 * (1 + 0.16::double))""",
)
_cat("artist_concat", search.artist_text, _SUMMARY + "select release_id id, regexp_replace(artist_names, '\\s\\(\\d+\\)(,|$)', '\\1', 'g') artist_names from names")
_cat(
    "progress_counts",
    lambda c: search.progress_counts(c),
    _SUMMARY + "select coalesce(tc.release_id, vc.release_id) id, track_count, matched_count, analyzed_count, processed from tc full join vc on tc.release_id = vc.release_id",
)

# facets and sets
_cat("facet_genres", facets.list_genres, "select distinct genre from (select unnest(genres) genre from c_active) where genre is not null")
_cat("facet_styles", facets.list_styles, "select distinct style from (select unnest(styles) style from c_active) where style is not null")
_cat("facet_years", facets.list_years, 'select distinct "year" from c_active where "year" is not null')
_cat("facet_labels", facets.list_labels, 'select distinct l."name" from c_labels l join c_release_labels b on b.label_id = l.id join c_active r on r.id = b.release_id')
_cat(
    "facet_artists_stripped",
    facets.list_artists,
    "select distinct regexp_replace(a.\"name\", '\\s\\(\\d+\\)(,|$)', '\\1', 'g') \"name\" from c_artists a join c_release_artists b on b.artist_id = a.id join c_active r on r.id = b.release_id",
)
_cat("crates_with_counts", facets.crates_with_counts, 'select c.id, c."name", c.created_at, count(b.release_id) item_count from c_crates c left join c_crate_releases b on b.crate_id = c.id group by all')
_cat("crates_of_release", lambda c: facets.crates_of_release(c).select("release_id", F.array_join("crate_ids", ",").alias("crate_ids")), "select release_id, array_to_string(list_sort(list(distinct crate_id)), ',') crate_ids from c_crate_releases group by 1")

# details
def _joined(column: str, *fields: str):
    """A digest of an array of structs: their fields with bars between, one line each, in order."""
    return F.md5(F.array_join(F.transform(column, lambda x: F.concat_ws("|", *[x[f].cast("string") for f in fields])), "\n")).alias(column)


_cat(
    "detail_nested",
    lambda c: detail.release_detail(c).select(
        "id", F.array_join("ai_genres", "|").alias("ai_genres"), F.array_join("ai_styles", "|").alias("ai_styles"), _joined("artists", "artist_id", "name"), _joined("labels", "label_id", "name", "catalog_number"),
        _joined("tracks", "id", "position", "title", "duration", "artist", "genre", "style", "url"), _joined("videos", "id", "title", "url", "duration", "video_type"), _joined("credits", "artist_id", "name", "role"),
    ),
    """, g as (select release_id, array_to_string(list(x order by o), '|') s from (select release_id, genre x, min(id) o from c_tracks where genre <> '' group by 1, 2) group by 1),
      st as (select release_id, array_to_string(list(x order by o), '|') s from (select release_id, "style" x, min(id) o from c_tracks where "style" <> '' group by 1, 2) group by 1),
      u as (select t.*, v.url from c_tracks t left join c_matches m on m.track_id = t.id and m.is_selected = 1 left join c_videos v on v.id = m.video_id)
      select r.id, coalesce(g.s, '') ai_genres, coalesce(st.s, '') ai_styles, md5(coalesce(a.s, '')) artists, md5(coalesce(l.s, '')) labels, md5(coalesce(t.s, '')) tracks, md5(coalesce(v.s, '')) videos, md5(coalesce(c.s, '')) credits from c_releases r
      left join (select release_id, string_agg(concat_ws('|', artist_id, "name"), chr(10) order by translate("name", 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), artist_id) s from c_release_artists join c_artists a on a.id = artist_id group by 1) a on a.release_id = r.id
      left join (select release_id, string_agg(concat_ws('|', label_id, "name", catalog_number), chr(10)) s from c_release_labels join c_labels on c_labels.id = label_id group by 1) l on l.release_id = r.id
      left join (select release_id, string_agg(concat_ws('|', id, "position", title, duration, artist, genre, "style", url), chr(10) order by id) s from u group by 1) t on t.release_id = r.id
      left join (select release_id, string_agg(concat_ws('|', id, title, url, duration, video_type), chr(10) order by id) s from c_videos group by 1) v on v.release_id = r.id
      left join (select release_id, string_agg(concat_ws('|', artist_id, "name", role), chr(10) order by role, translate("name", 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), artist_id) s from c_credits join c_artists a on a.id = artist_id group by 1) c on c.release_id = r.id
      left join g on g.release_id = r.id left join st on st.release_id = r.id""",
)
_cat(
    "distinct_track_artists",
    lambda c: detail.release_detail(c).where("tracks_have_distinct_artists").select("id"),
    """, n as (select release_id, regexp_replace(array_to_string(list(a."name" order by a."name"), ', '), '\\s\\(\\d+\\)(,|$)', '\\1', 'g') s from c_release_artists join c_artists a on a.id = artist_id group by 1)
      select r.id from c_releases r left join n on n.release_id = r.id where exists (select 1 from c_tracks t where t.release_id = r.id and t.artist <> ''
      and regexp_replace(t.artist, '\\s\\(\\d+\\)(,|$)', '\\1', 'g') <> coalesce(n.s, ''))""",
)
_cat("credits_by_role", lambda c: detail.credits_by_role(c).select("release_id", "role", F.array_join("names", "|").alias("names")),
     """select release_id, role, string_agg(n, '|' order by translate(n, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), n) names from (select distinct release_id, role, a."name" n from c_credits join c_artists a on a.id = artist_id) group by 1, 2""")  # fmt: skip
_cat("tracks_left_selected_video", lambda c: detail.tracks_with_videos(c).select("id", "video_id", F.round("fuzzy_score", 6).alias("fuzzy_score")), "select t.id, m.video_id, round(m.fuzzy_score, 6) fuzzy_score from c_tracks t left join c_matches m on m.track_id = t.id and m.is_selected = 1")
_cat("videos_left_candidates", lambda c: detail.candidates_of_videos(c).select("id", "track_id", "is_selected"), "select v.id, m.track_id, m.is_selected from c_videos v left join c_matches m on m.video_id = v.id")
_cat("release_log", lambda c: detail.release_log(c).select("id", "line"), "select id, coalesce(\"year\"::varchar, '----') || '  ' || title || case when removed_from_discogs_at is not null then ' [removed]' else '' end line from c_releases")

# incremental work
_cat("unclassified", lambda c: pending.with_unclassified_video(c).select("id"), "select id from c_active r where exists (select 1 from c_videos v where v.release_id = r.id and video_type is null)")
_ANALYZABLE = "analyzed_at is null and (local_audio_path is not null or exists (select 1 from c_matches m where m.track_id = t.id and m.is_selected = 1))"
_cat("analyzable_tracks", lambda c: pending.analyzable_tracks(c).select("id", "url"), "select t.id, v.url from c_tracks t left join c_matches m on m.track_id = t.id and m.is_selected = 1 left join c_videos v on v.id = m.video_id where analyzed_at is null and (v.url is not null or local_audio_path is not null)")
_cat("needing_analysis", lambda c: pending.needing_analysis(c).select("id"), f"select id from c_active r where exists (select 1 from c_tracks t where t.release_id = r.id and {_ANALYZABLE})")
_cat("pending", lambda c: pending.pending(c).select("id"), f"select id from c_active r where exists (select 1 from c_videos v where v.release_id = r.id and yt_fetched_at is null) or exists (select 1 from c_tracks t where t.release_id = r.id and {_ANALYZABLE})")
_cat(
    "count_pending",
    pending.count_pending,
    f"""select count(*) filter (where u) unclassified, count(*) filter (where n) unanalyzed, count(*) filter (where n or f) pending from (select
      exists (select 1 from c_videos v where v.release_id = r.id and video_type is null) u, exists (select 1 from c_videos v where v.release_id = r.id and yt_fetched_at is null) f,
      exists (select 1 from c_tracks t where t.release_id = r.id and {_ANALYZABLE}) n from c_active r)""",
)
_cat("locally_covered", pending.locally_covered, "select release_id, count(*) total, count(local_audio_path) covered from c_tracks group by 1 having count(*) = count(local_audio_path)")
_cat("stuck_fetches", pending.stuck_fetches, "select distinct release_id from c_videos where (yt_fetched_at is not null and yt_title is null and video_type is null) or video_type_reasoning = 'metadata fetch failed'")
_cat("to_check_locally", lambda c: pending.to_check_locally(c).select("id"), "select id from c_active where local_matched_at is null")
_cat("to_fetch_and_match", lambda c: pending.to_fetch(c).select("id", F.lit("fetch").alias("what")).unionByName(pending.to_match(c).select("id", F.lit("match").alias("what"))), "select id, 'fetch' what from c_videos where yt_fetched_at is null union all select id, 'match' from c_videos where yt_title is not null")
_cat("downloadable", lambda c: pending.downloadable(c).select("id", "url"), "select t.id, v.url from c_tracks t join c_matches m on m.track_id = t.id and m.is_selected = 1 join c_videos v on v.id = m.video_id")

# upserts and reconciliation, with snapshots 4 and 5 as the old and the new state
_OLD_NEW = ", o as (select id, arg_max(title, delivered_at) title from collection_snapshots where snapshot_no = 4 group by 1), n as (select id, arg_max(title, delivered_at) title from collection_snapshots where snapshot_no = 5 group by 1)"


def _snapshot(spark: SparkSession, d: str, no: int) -> DataFrame:
    rows = sync.latest(read(spark, d, "collection_snapshots").where(F.col("snapshot_no") == no).select("id", "title", "delivered_at"), "id", "delivered_at")
    return rows.select("id", "title", F.lit(f"2025-0{no}-01").alias("added_at"), F.lit(f"2025-0{no}-01").alias("last_synced_at"), F.when(F.col("id") % 5 == 0, F.lit(f"2025-0{no}-01")).alias("removed_from_discogs_at"))


_define(
    "upsert_latest",
    lambda s, d: sync.upsert_releases(_snapshot(s, d, 4), _snapshot(s, d, 5).select("id", "title"), "2025-05-01"),
    sql(_OLD_NEW + """select coalesce(n.id, o.id) id, coalesce(n.title, o.title) title, case when o.id is not null then '2025-04-01' else '2025-05-01' end added_at,
      case when n.id is not null then '2025-05-01' else '2025-04-01' end last_synced_at, case when n.id is null and o.id % 5 = 0 then '2025-04-01' end removed_from_discogs_at from o full join n on o.id = n.id"""),
)  # fmt: skip
_define(
    "soft_delete",
    lambda s, d: sync.soft_delete_missing(_snapshot(s, d, 4), _snapshot(s, d, 5), "2025-05-01").select("id", "removed_from_discogs_at"),
    sql(_OLD_NEW + "select o.id, case when o.id % 5 = 0 then '2025-04-01' when n.id is null then '2025-05-01' end removed_from_discogs_at from o left join n on n.id = o.id"),
)
_define("set_difference_fetch", lambda s, d: sync.missing(_snapshot(s, d, 5), _snapshot(s, d, 4), "id"), sql(_OLD_NEW + "select id from n where id not in (select id from o)"))
_table("latest_state", "releases", lambda r: sync.latest(r.select("id", "title", "last_synced_at"), "id", "last_synced_at"), "select id, arg_max(title, last_synced_at) title, max(last_synced_at) last_synced_at from releases group by 1")
_table("dedupe_first", "documents", lambda t: sync.dedupe_first(t.select("doc_id", "text"), ["text"], [F.col("doc_id")]).select("doc_id"), "select min(doc_id) doc_id from documents group by text")
_define(
    "upsert_names",
    lambda s, d: sync.upsert_names(read(s, d, "artists").groupBy("id").agg(F.max("name").alias("name")), read(s, d, "release_credits").where("artist_name is not null").select(F.col("artist_id").alias("id"), F.col("artist_name").alias("name"), F.col("id").alias("seq"))),
    """select id, coalesce(n, o) "name" from (select id, max("name") o from artists where id is not null group by 1)
       full join (select artist_id id, arg_max(artist_name, (id, artist_name)) n from release_credits where artist_name is not null and artist_id is not null group by 1) using (id)""",
)  # fmt: skip
_cat("replace_children", lambda c: sync.replace_children(c.release_labels, c.release_labels.join(search.active(c.releases).select(F.col("id").alias("release_id")), "release_id", "left_semi").withColumn("catalog_number", F.upper("catalog_number")), search.active(c.releases).select(F.col("id").alias("release_id")), ["release_id", "label_id", "catalog_number"]),
     "select release_id, label_id, case when release_id in (select id from c_active) then upper(catalog_number) else catalog_number end catalog_number from c_release_labels")  # fmt: skip
# the new matches are those of videos with a title, for all active releases
_cat("write_matches", lambda c: sync.write_matches(c, c.matches.join(c.videos.where("yt_title is not null").select(F.col("id").alias("video_id")), "video_id", "left_semi").select("video_id", "track_id", "fuzzy_score", "llm_confidence", "llm_reasoning", "is_selected", F.lit("full_track").alias("video_type"), F.lit("A1").alias("best_position")), search.active(c.releases).select(F.col("id").alias("release_id")), NOW).matches.select("track_id", "video_id", F.round("fuzzy_score", 6).alias("fuzzy_score"), "is_selected"),
     """select track_id, video_id, round(fuzzy_score, 6) fuzzy_score, is_selected from c_matches m join c_tracks t on t.id = m.track_id where t.release_id not in (select id from c_active)
        union all select track_id, video_id, round(fuzzy_score, 6), is_selected from c_matches where video_id in (select id from c_videos where yt_title is not null)""")  # fmt: skip
_cat("backfill_durations", lambda c: sync.backfill_durations(c).select("id", "duration"),
     r"""select t.id, case when regexp_matches(trim(t.duration), '^\s*[+-]?\d+\s*(:\s*[+-]?\d+\s*)*$') or v.yt_duration is null or v.yt_duration <= 0 then t.duration
       else (v.yt_duration // 60) || ':' || lpad((v.yt_duration % 60)::varchar, 2, '0') end duration
       from c_tracks t left join c_matches m on m.track_id = t.id and m.is_selected = 1 left join c_videos v on v.id = m.video_id""")  # fmt: skip
_GONE = lambda c: c.releases.where("removed_from_discogs_at is not null").select(F.col("id").alias("release_id"))  # noqa: E731
_cat("clear_matches", lambda c: (lambda k: k.videos.select("id", F.lit("type").alias("what"), F.col("video_type").alias("value")).unionByName(k.matches.select(F.col("video_id").alias("id"), F.lit("match").alias("what"), F.col("track_id").cast("string").alias("value"))))(sync.clear_matches(c, _GONE(c))),
     """select id, 'type' what, case when release_id in (select id from c_active) or release_id not in (select id from c_releases) then video_type end "value" from c_videos
        union all select video_id, 'match', track_id::varchar from c_matches m join c_tracks t on t.id = m.track_id where t.release_id not in (select id from c_releases where removed_from_discogs_at is not null)""")  # fmt: skip
_cat("clear_analysis", lambda c: sync.clear_analysis(c.tracks.withColumns({x: F.lit(None).cast("string") for x in ("mood", "mood_summary", "waveform_path")}), c.stickers).select("id", "bpm", "musical_key", "genre", "analyzed_at"),
     """select id, case when keep then bpm end bpm, case when keep then musical_key end musical_key, case when keep then genre end genre, case when keep then analyzed_at end analyzed_at from (select *, release_id not in (select release_id from c_stickers) keep from c_tracks)""")  # fmt: skip


def _local_catalog(c: Catalog) -> Catalog:
    return Catalog(c.releases.withColumns({"local_folder_path": F.lit(None).cast("string"), "local_folder_match_score": F.lit(None).cast("double")}), tracks=c.tracks.withColumn("local_match_score", F.lit(None).cast("double")))


def _local_written(c: Catalog) -> Catalog:
    """Local matches written for every release, with its catalogue number as folder and its year as score, and for every track, with its position as file."""
    years = c.releases.select(F.col("id").alias("release_id"), F.concat(F.lit("/"), F.coalesce("catalog_number", F.lit("-"))).alias("path"), ((F.coalesce("year", F.lit(1990)) - 1950) / 80.0).alias("score"))
    files = c.tracks.select(F.col("id").alias("track_id"), F.coalesce("position", F.lit("?")).alias("file"), (F.length("title") / 30.0).alias("score"))
    return sync.write_local_matches(_local_catalog(c), years, files, NOW)


_cat("write_local_matches", lambda c: _local_written(c).releases.select("id", "local_folder_path", F.round("local_folder_match_score", 6).alias("score"), "local_matched_at"),
     f"""select id, case when s >= 0.75 then '/' || coalesce(catalog_number, '-') end local_folder_path, round(s, 6) score, '{NOW}' local_matched_at from (select *, (coalesce("year", 1990) - 1950)::double / 80.0 s from c_releases)""")  # fmt: skip
_cat("write_local_files", lambda c: _local_written(c).tracks.select("id", "local_audio_path", F.round("local_match_score", 6).alias("score")),
     """select id, case when s >= 0.75 then coalesce("position", '?') end local_audio_path, round(s, 6) score from (select *, length(title)::double / 30.0 s from c_tracks)""")  # fmt: skip
_cat("sticker_add_remove", lambda c: sync.remove_members(sync.add_members(c.stickers, c.releases.where("year < 1990").select(F.col("id").alias("release_id"), F.lit(NOW).alias("added_at")), ["release_id"]), _GONE(c), ["release_id"]).select("release_id"),
     'select id release_id from c_active where id in (select release_id from c_stickers) or "year" < 1990')  # fmt: skip
_cat("delete_crates", lambda c: sync.delete_crates(c, c.crates.where("name < 'F'").select(F.col("id").alias("crate_id"))).crate_releases.select("crate_id", "release_id"), "select crate_id, release_id from c_crate_releases where crate_id not in (select id from c_crates where \"name\" < 'F')")
_cat("rename_crates", lambda c: sync.rename_crates(c.crates, c.crates.select("id", F.lower("name").alias("name"))).select("id", "name"), 'select id, lower("name") "name" from c_crates')

# entity resolution: the machinery with a similarity both engines have, on whole titles and artists; the weighted kernel is tested on known values
_WORDS = lambda x: f"list_distinct(list_filter(string_split_regex(lower({x}), '\\s+'), lambda w: w <> ''))"  # noqa: E731
_ALIKE = lambda a, b: f"coalesce(100.0::double * len(list_intersect({a}, {b})) / nullif(len(list_distinct(list_concat({a}, {b}))), 0), 0)"  # noqa: E731
_PAIRS = f"""tl as (select t.id, t.release_id, t.title, coalesce(case when trim(artist) <> '' then artist end, r.artist_names) artist,
   case when regexp_matches(trim(duration), '^\\s*[+-]?\\d+\\s*(:\\s*[+-]?\\d+\\s*)*$') then list_reduce(list_transform(string_split(trim(duration), ':'), lambda x: trim(x)::int), lambda a, x: a * 60 + x) end s from c_tracks t left join c_releases r on r.id = t.release_id),
 vl as (select id, release_id, title, duration::int s from c_videos where title is not null),
 wp as (select v.id video_id, t.id track_id, t.s ts, v.s vs, {_WORDS("t.title")} a, {_WORDS("v.title")} b, case when t.artist <> '' then {_WORDS("t.title || ' ' || t.artist")} end c from tl t join vl v on t.release_id = v.release_id),
 sp as (select video_id, track_id, ts, vs, greatest({_ALIKE("a", "b")}, coalesce(case when c is not null then {_ALIKE("c", "b")} end, 0)) x from wp),
 pairs as (select video_id, track_id, case when ts > 0 and vs > 0 and abs(ts - vs)::double / ts > 0.2 then 0.0::double
   when ts > 0 and vs > 0 then (0.7 * x + 0.3 * greatest(0::double, 100.0 - 100.0 * (abs(ts - vs)::double / ts))) / 100 else x / 100 end score from sp),
 rk as (select *, row_number() over (partition by video_id order by score desc, track_id) rn from pairs),
 b2 as (select video_id, max(case when rn = 1 and score > 0 then track_id end) best, max(case when rn = 1 then score end) best_score, coalesce(max(case when rn = 2 then score end), 0) runner_up from rk group by 1)"""


def whole_lists(c: Catalog) -> tuple[DataFrame, DataFrame]:
    """Tracks and videos with seconds, titles as they are and each track's artist, the release's where a track has none."""
    own = c.releases.select(F.col("id").alias("release_id"), "artist_names")
    artist = F.coalesce(F.when(F.trim("artist") != "", F.col("artist")), "artist_names").alias("artist")
    t = c.tracks.join(own, "release_id", "left").select("id", "release_id", "position", "title", artist, text.parse_duration(F.col("duration")).alias("seconds"))
    v = c.videos.where("title is not null").select("id", "release_id", "title", F.col("duration").cast("int").alias("seconds"), F.array().cast("array<string>").alias("chapters"), "description")
    return t, v


def _scored(c: Catalog) -> DataFrame:
    return resolve.score_pairs(resolve.pairs_within(*whole_lists(c), ()).drop("raw_title"), word_similarity)


def _route(b: DataFrame) -> DataFrame:
    return b.select("video_id", F.when(resolve.is_confident(), "full_track").when(F.col("best").isNull(), "unrelated").otherwise("ambiguous").alias("route"))


_cat("fuzzy_pairs", lambda c: _scored(c).select("video_id", "track_id", F.round("score", 4).alias("score")), ", " + _PAIRS + " select video_id, track_id, round(score, 4) score from pairs")
_cat("fuzzy_best_two", lambda c: resolve.best_two(_scored(c)).select("video_id", "best", F.round("best_score", 4).alias("best_score"), F.round("runner_up", 4).alias("runner_up")), ", " + _PAIRS + " select video_id, best, round(best_score, 4) best_score, round(runner_up, 4) runner_up from b2")
_cat("fuzzy_route", lambda c: _route(resolve.best_two(_scored(c))), ", " + _PAIRS + " select video_id, case when best is not null and best_score >= 0.8 and best_score - runner_up >= 0.05 then 'full_track' when best is null then 'unrelated' else 'ambiguous' end route from b2")
_cat(
    "fuzzy_select",
    lambda c: resolve.select_matches(
        resolve.best_two(_scored(c)).where("best is not null and best_score >= 0.6").select("video_id", F.col("best").alias("track_id"), F.col("best_score").alias("fuzzy_score"), F.lit(None).cast("double").alias("llm_confidence"), F.lit(0).alias("late"))
    ).select("video_id", "track_id", "is_selected"),
    ", " + _PAIRS + " select video_id, best track_id, (row_number() over (partition by best order by best_score desc, video_id) = 1)::int is_selected from b2 where best is not null and best_score >= 0.6",
)


def resolve_weighted(spark: SparkSession, d: str) -> DataFrame:
    """Every video of the catalogue resolved with the weighted kernel and no model: what is ambiguous stays unrelated."""
    c = catalog(spark, d)
    t, v = (stash(x) for x in whole_lists(c))  # read several times
    rows = resolve.resolve(t, v, c.releases.select("id", "title", F.array("artist_names").alias("artists")))
    return rows.select("video_id", "track_id", F.round("fuzzy_score", 4).alias("fuzzy_score"), "video_type", "is_selected")


_define("resolve_weighted", resolve_weighted, None)
_cat("score_matrix", lambda c: resolve.score_matrix(*whole_lists(c), c.matches, word_similarity).select("video_id", "track_id", F.round("score", 4).alias("score"), "is_selected", "is_llm_selected"),
     ", " + _PAIRS + """ select p.video_id, p.track_id, round(score, 4) score, coalesce(m.is_selected = 1, false) is_selected, coalesce(m.is_selected = 1 and m.llm_confidence is not null, false) is_llm_selected
       from pairs p left join c_matches m on m.track_id = p.track_id and m.video_id = p.video_id""")  # fmt: skip


def local_library(spark: SparkSession, d: str) -> DataFrame:
    """Each release's best local folder by token sort ratio."""
    c = catalog(spark, d)
    best = local_match.best_folders(c.releases.select("id", "title", F.col("artist_names").alias("artists")), read(spark, d, "local_folders").select("path"))
    return best.select("release_id", "path", F.round("score", 4).alias("score"))


def local_files(spark: SparkSession, d: str) -> DataFrame:
    """Files of confident folders given to tracks one to one."""
    c = catalog(spark, d)
    folders = read(spark, d, "local_folders").select("path", "files").distinct()
    return local_match.match_files(c.releases.select("id", "title", F.col("artist_names").alias("artists")), c.tracks, folders).select("release_id", "track_id", "file", F.round("score", 4).alias("score"))


_define("local_library", local_library, None)
_define("local_files", local_files, None)

# runs over the whole catalogue, with remote calls that give what both engines can work out
def full(c: Catalog) -> Catalog:
    """A derived catalogue with every column of the schemas, null where it has none."""
    have = lambda df, schema: df.select(*[(F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema])  # noqa: E731
    return Catalog(**{name: have(df, TABLES[name]) for name, df in c.tables().items()})


def _stored(spark: SparkSession, d: str, no: int) -> DataFrame:
    """The releases of a snapshot as stored ones."""
    return sync.latest(read(spark, d, "collection_snapshots").where(F.col("snapshot_no") == no).select("id", "title", "date_added", "delivered_at"), "id", "delivered_at")


def _detail(release: int) -> dict:
    if str(release).endswith("7"):
        raise OSError("not reached")
    return {"id": release, "title": f"Release {release}", "year": 1900 + release % 100, "artists": [{"id": release, "name": f"Artist {release}"}], "tracks": [{"position": "A1", "title": "One", "artists": ["x", "y"]}, {"position": "A2", "title": "Two"}]}


def sync_run(spark: SparkSession, d: str) -> DataFrame:
    """Snapshot 4 synced with the keys of snapshot 5: what is new is fetched, what is lacking is marked, failed records change nothing."""
    empty = {name: spark.createDataFrame([], schema) for name, schema in TABLES.items()}
    old = full(Catalog(_stored(spark, d, 4).withColumn("added_at", F.lit("then")))).releases
    run = pipeline.sync_collection(Catalog(**{**empty, "releases": old}), _stored(spark, d, 5).select("id", "date_added"), _detail, NOW)
    rows = run.catalog.releases.select("id", "title", "year", "added_at", "removed_from_discogs_at", F.lit("release").alias("what"))
    tracks = run.catalog.tracks.select("release_id", F.concat_ws("|", "position", "title", "artist").alias("title"), F.lit(None).cast("int").alias("year"), F.lit(None).cast("string").alias("added_at"), F.lit(None).cast("string").alias("removed_from_discogs_at"), F.lit("track").alias("what"))
    errors = run.errors.select("id", F.col("error").alias("title"), F.lit(None).cast("int").alias("year"), F.lit(None).cast("string").alias("added_at"), F.lit(None).cast("string").alias("removed_from_discogs_at"), F.lit("error").alias("what"))
    return rows.unionByName(tracks.withColumnRenamed("release_id", "id")).unionByName(errors)


_define("sync_run", sync_run, sql(_OLD_NEW + f""", f as (select id, not ends_with(id::varchar, '7') good from n where id not in (select id from o))
  select coalesce(f.id, o.id) id, coalesce('Release ' || f.id, o.title) title, (1900 + f.id % 100)::int "year", case when f.id is not null then '{NOW}' else 'then' end added_at, case when o.id is not null and n.id is null then '{NOW}' end removed_from_discogs_at, 'release' what
    from (select * from f where good) f full join o on o.id = f.id left join n on n.id = o.id
  union all select id, t, null, null, null, 'track' from f, (values ('A1|One|x, y'), ('A2|Two')) v(t) where good union all select id, 'OSError: not reached', null, null, null, 'error' from f where not good"""))


def _extract(url: str) -> dict | None:
    return None if url.endswith("2") else {"title": url.rsplit("/", 1)[1], "duration": len(url), "tags": []}


def match_fetch(spark: SparkSession, d: str) -> DataFrame:
    """The catalogue's videos after a run that matches what is open: what was fetched, what failed, what stays."""
    c = full(catalog(spark, d))
    run = pipeline.match_videos(c, _extract, "later", similarity=word_similarity)
    return run.catalog.videos.select("id", "yt_title", "yt_duration", "yt_fetched_at", F.col("video_type_reasoning").eqNullSafe(pending.FETCH_FAILED).alias("failed"), F.col("video_type").isNull().alias("unclassified"))


_define("match_fetch", match_fetch, sql(f""", ids as (select distinct release_id from c_videos where video_type is null and release_id in (select id from c_active)),
 v as (select *, release_id in (select release_id from ids) own from c_videos), w as (select *, own and yt_fetched_at is null now, ends_with(url, '2') bad from v)
 select id, case when now then case when not bad then regexp_extract(url, '([^/]*)$', 1) end else yt_title end yt_title, case when now then case when not bad then length(url)::int end else yt_duration end yt_duration,
   case when now then 'later' else yt_fetched_at end yt_fetched_at, case when now and bad then true when own and (now or yt_title is not null) then false else coalesce(video_type_reasoning = '{pending.FETCH_FAILED}', false) end failed,
   case when now or (own and yt_title is not null) then false else video_type is null end unclassified from w"""))  # fmt: skip
_cat("match_taken", lambda c: pipeline.releases_to_match(c, pipeline.Options()).withColumn("again", F.lit(False)).unionByName(pipeline.releases_to_match(c, pipeline.Options(force=True, reprocess=None)).withColumn("again", F.lit(True))),
     "select distinct release_id, false \"again\" from c_videos where video_type is null and release_id in (select id from c_active) union all select distinct release_id, true from c_videos where release_id in (select id from c_active)")


def download_run(spark: SparkSession, d: str) -> DataFrame:
    """Downloads for all active releases: kept files stay, failures are tried again and end as a status."""
    c = catalog(spark, d)
    kept = c.tracks.where("duration like '%7'").select("release_id", text.audio_stem(F.col("position"), F.col("title")).alias("stem"), F.lit("/kept").alias("path")).distinct()

    def one(url: str, stem: str) -> str:
        if url.endswith("3"):
            raise OSError("gone")
        return f"/audio/{stem}"

    ids = search.active(c.releases).select(F.col("id").alias("release_id"))
    return pipeline.download(c, ids, kept, one, pipeline.Options(delay=0.0)).select("track_id", "status", "path", "error")


_define("download_run", download_run, sql(r""", s as (select t.id, t.release_id, t.duration, v.url, trim(regexp_replace(regexp_replace(case when coalesce("position", '') <> '' then "position" || ' - ' || t.title else t.title end, '[\/:*?"<>|]', '_', 'g'), '[ 	

]+', ' ', 'g')) stem
   from c_tracks t join c_matches m on m.track_id = t.id and m.is_selected = 1 join c_videos v on v.id = m.video_id where t.release_id in (select id from c_active)),
 k as (select distinct release_id, trim(regexp_replace(regexp_replace(case when coalesce("position", '') <> '' then "position" || ' - ' || title else title end, '[\/:*?"<>|]', '_', 'g'), '[ 	

]+', ' ', 'g')) stem from c_tracks where duration like '%7')
 select s.id track_id, case when k.stem is not null then 'already_downloaded' when ends_with(url, '3') then 'failed' else 'downloaded' end status, case when k.stem is not null then '/kept' when not ends_with(url, '3') then '/audio/' || s.release_id || '/' || s.stem end path,
   case when k.stem is null and ends_with(url, '3') then 'OSError: gone' end "error" from s left join k on k.release_id = s.release_id and k.stem = s.stem"""))  # fmt: skip


def analysis_run(spark: SparkSession, d: str) -> DataFrame:
    """Tracks after an analysis of everything open: one value is stored, failures change nothing."""
    c = full(catalog(spark, d))

    def analyse(path: str) -> dict:
        if path.endswith("5.flac"):
            raise OSError("unreadable")
        return {"bpm": float(len(path))}

    paths = spark.createDataFrame([], "track_id long, path string")
    return pipeline.analyze_library(c, paths, analyse, "bpm double", "later").catalog.tracks.select("id", "bpm", "analyzed_at")


_define("analysis_run", analysis_run, sql(""", o as (select t.id, local_audio_path p from c_tracks t where analyzed_at is null and local_audio_path is not null and not ends_with(local_audio_path, '5.flac') and release_id in (select id from c_active))
 select t.id, case when o.id is not null then length(o.p)::double else t.bpm end bpm, case when o.id is not null then 'later' else analyzed_at end analyzed_at from c_tracks t left join o on o.id = t.id"""))  # fmt: skip

# scalar functions
_table("fold_text", "documents", lambda t: t.select("doc_id", F.md5(text.fold(F.col("text"))).alias("folded")), f"select doc_id, md5({text.fold_sql('\"text\"')}) folded from documents")
_table("fold_titles", "tracks", lambda t: t.select("title").distinct().select("title", text.fold(F.col("title")).alias("folded")), f"select title, {text.fold_sql('title')} folded from (select distinct title from tracks)")
_table("fold_search", "documents", lambda t: t.where(text.contains_folded(F.col("text"), "FÜR")).select("doc_id"), f"select doc_id from documents where contains({text.fold_sql('\"text\"')}, 'fur')")
_table("like_escape", "release_videos", lambda t: t.where(text.contains_folded(F.col("description"), "@GROOVE_")).select("id").distinct(), "select distinct id from release_videos where contains(lower(description), '@groove_')")
_table("strip_disambiguation", "artists", lambda t: t.select("id", text.strip_disambiguation(F.col("name")).alias("name")).distinct(), "select distinct id, regexp_replace(\"name\", '\\s\\(\\d+\\)(,|$)', '\\1', 'g') \"name\" from artists")
_table("denoise_title", "video_metadata", lambda t: t.select("id", text.denoise(F.col("title"), F.array("uploader"), ["Official Audio"]).alias("bare")).distinct(),
       r"select distinct id, trim(regexp_replace(regexp_replace(regexp_replace(case when uploader <> '' then regexp_replace(title, '\Q' || uploader || '\E', ' ', 'gi') else title end, 'Official Audio', ' ', 'gi'), '\b(19|20)\d{2}\b', ' ', 'g'), '\s+', ' ', 'g')) bare from video_metadata")  # fmt: skip
_table("has_content", "video_metadata", lambda t: t.select("id", text.has_content(F.col("title")).alias("ok")).distinct(), "select distinct id, regexp_matches(title, '[A-Za-z0-9]{2,}') ok from video_metadata")
_table("duration_parse", "tracks", lambda t: t.select("id", text.parse_duration(F.col("duration")).alias("seconds"), text.format_duration(text.parse_duration(F.col("duration"))).alias("shown")).distinct(),
       r"""select distinct id, s as seconds, case when s is null then 'unknown' else (s // 60) || ':' || lpad((s % 60)::varchar, 2, '0') end shown from (select id, case when regexp_matches(trim(duration), '^\s*[+-]?\d+\s*(:\s*[+-]?\d+\s*)*$')
         then list_reduce(list_transform(string_split(trim(duration), ':'), lambda x: trim(x)::int), lambda a, x: a * 60 + x) end s from tracks)""")  # fmt: skip
_FILES = "(select distinct unnest(files) f from local_folders)"
_table("clean_filename", "local_folders", lambda t: t.select(F.explode("files").alias("f")).distinct().select("f", text.clean_filename(F.col("f")).alias("name")), rf"select f, regexp_replace(regexp_replace(f, '\.[^.]*$', ''), '^\d{{1,3}}[\s._-]+', '') as name from {_FILES}")
_table("sanitize_filename", "releases", lambda t: t.select("title").distinct().select("title", text.sanitize_filename(F.concat("title", F.lit(": a/b  c?"))).alias("name")), r"""select title, trim(regexp_replace(regexp_replace(title || ': a/b  c?', '[\\/:*?"<>|]', '_', 'g'), '\s+', ' ', 'g')) as name from (select distinct title from releases)""")
_table("audio_stem", "tracks", lambda t: t.select("id", text.audio_stem(F.col("position"), F.col("title")).alias("stem")).distinct(), r"""select distinct id, trim(regexp_replace(regexp_replace(case when coalesce("position", '') <> '' then "position" || ' - ' || title else title end, '[\\/:*?"<>|]', '_', 'g'), '[ \t\n\r\f\v]+', ' ', 'g')) stem from tracks""")
_table("url_extension", "releases", lambda t: t.select("id", text.url_extension(F.col("cover_image_url")).alias("ext")).distinct(), r"select distinct id, case when cover_image_url is null then null else coalesce(nullif(regexp_extract(regexp_replace(cover_image_url, '[?#].*$', ''), '/[^/]*(\.[^./]+)$', 1), ''), '.jpg') end ext from releases")
_table("truncate_title", "tracks", lambda t: t.select("id", text.truncate(F.col("title"), 12).alias("short"), text.has_cjk(F.col("title")).alias("cjk")).distinct(), r"select distinct id, case when length(title) > 12 then left(title, 9) || '...' else title end short, regexp_matches(title, '[\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7A3}\x{F900}-\x{FAFF}\x{FF00}-\x{FFEF}]') cjk from tracks")
_table("json_props", "events", lambda t: t.select("event_id", F.from_json("props", "k int")["k"].alias("k")), "select event_id, (props->>'k')::int k from events")
_SEMITONE = "list_position(['C','C#','D','D#','E','F','F#','G','G#','A','A#','B'], case musical_key when 'Eb' then 'D#' else musical_key end)"
_cat("key_camelot", lambda c: c.tracks.select("id", music.format_key(F.col("musical_key"), F.col("musical_key_scale"), "camelot").alias("code"), music.format_key(F.col("musical_key"), F.col("musical_key_scale"), compact=True).alias("short")),
     f"""select id, coalesce(case when musical_key_scale = 'minor' then ['5A','12A','7A','2A','9A','4A','11A','6A','1A','8A','3A','10A'][{_SEMITONE}] else ['8B','3B','10B','5B','12B','7B','2B','9B','4B','11B','6B','1B'][{_SEMITONE}] end, musical_key) code,
       musical_key || case when musical_key_scale = 'minor' then ' min' else ' maj' end short from c_tracks""")  # fmt: skip
_cat("bpm_display", lambda c: c.tracks.select("id", music.bpm_page(F.col("bpm")).alias("page"), music.bpm_sticker(F.col("bpm")).alias("sticker"), music.style_badge(F.col("style")).alias("badge")),
     "select id, round_even(bpm, 0)::int page, floor(bpm)::int sticker, regexp_replace(\"style\", '^.*?---', '') badge from c_tracks")  # fmt: skip

# arrays, score maps and layout
_BINARY = ["mood_happy", "mood_sad", "danceability", "mood_party"]


def _score_maps(t: DataFrame) -> DataFrame:
    names = F.array(*[F.lit(x) for x in _BINARY], *[F.lit(f"genre_discogs400:G{i // 4}---S{i}") for i in range(12)])
    return t.select("vec_id", F.map_from_arrays(names, F.transform(F.slice("embedding", 1, 16), lambda x: x.cast("double"))).alias("m"))


_TOP = "list_position(embedding[5:16], list_max(embedding[5:16])) - 1"
_table("top_style", "embeddings", lambda t: _score_maps(t).select("vec_id", music.top_style(F.col("m")).alias("style"), music.top_genre(F.col("m")).alias("genre")), f"select vec_id, 'G' || ({_TOP}) // 4 || '---S' || ({_TOP}) as style, 'G' || ({_TOP}) // 4 genre from embeddings")
_table("mood_topk", "embeddings", lambda t: _score_maps(t).select("vec_id", music.summarize_mood(F.col("m"), 0.05).alias("mood")),
       "select vec_id, coalesce(nullif((select array_to_string(list(l order by x desc, k)[1:3], ', ') from (select unnest(embedding[1:4]) x, unnest(['mood_happy','mood_sad','danceability','mood_party']) k, unnest(['Happy','Sad','Danceable','Party']) l) where x >= 0.05), ''), 'Neutral') mood from embeddings")  # fmt: skip
_table("class_report", "embeddings", lambda t: scores.class_report(_score_maps(t), "vec_id", "m", 10).select("vec_id", F.coalesce("class", "head").alias("label"), F.round("score", 5).alias("score"), "place"),
       """with e as (select vec_id, unnest(embedding[1:16])::double x, unnest(['mood_happy','mood_sad','danceability','mood_party','G0---S0','G0---S1','G0---S2','G0---S3','G1---S4','G1---S5','G1---S6','G1---S7','G2---S8','G2---S9','G2---S10','G2---S11']) l, generate_subscripts(embedding[1:16], 1) > 4 of_class from embeddings)
       select vec_id, l as label, round(x, 5) score, (p - 1)::int place from (select *, row_number() over (partition by vec_id, of_class order by x desc, l) p from e) where not of_class or p <= 10""")  # fmt: skip
_table("arg_max", "embeddings", lambda t: t.select("vec_id", scores.arg_max(F.col("embedding")).alias("pos")), "select vec_id, (list_position(embedding, list_max(embedding)) - 1)::int pos from embeddings")
_table("embedding_mean", "embeddings", lambda t: scores.mean_vectors(t, "label", "embedding").select("label", "dim", F.round("mean", 5).alias("mean")), "select label, (i - 1)::int dim, round(avg(e::double), 5) mean from (select label, unnest(embedding) e, generate_subscripts(embedding, 1) i from embeddings) group by 1, 2")
_table("waveform_envelope", "embeddings", lambda t: scores.envelope(t, "vec_id", "embedding", 8, 250),
       """select vec_id, x, hi, lo, y1, case when y1 = y2 then y2 + 1 else y2 end y2 from (select vec_id, x, hi, lo, 125 - trunc(hi::double * 125)::int y1, 125 - trunc(lo::double * 125)::int y2 from
         (select vec_id, ((i - 1) // 8)::int x, max(e) hi, min(e) lo from (select vec_id, unnest(embedding) e, generate_subscripts(embedding, 1) i from embeddings) group by 1, 2))""")  # fmt: skip
_cat("audio_source", lambda c: detail.tracks_with_videos(c).select("id", scores.audio_source(F.col("local_audio_path"), F.when(F.col("id") % 9 == 0, F.lit("kept")), F.col("url"))["kind"].alias("kind")),
     "select t.id, case when local_audio_path is not null then 'local' when t.id % 9 = 0 then 'download' when v.url is not null then 'fetch' else 'error' end kind from c_tracks t left join c_matches m on m.track_id = t.id and m.is_selected = 1 left join c_videos v on v.id = m.video_id")  # fmt: skip
_table("sheet_slots", "releases", lambda t: layout.sheet_slots(t, "id", "herma_4222").select("id", "page", "row", "col", F.round("x", 4).alias("x"), F.round("y", 4).alias("y")),
       'select id, (i // 27)::int page, ((i % 27) // 3)::int "row", (i % 3)::int col, round(7.21::double + (i % 3) * (63.5::double + 2.54::double), 4) x, round(297.0::double - 15.15::double - (((i % 27) // 3) + 1) * 29.633::double, 4) y from (select id, row_number() over (order by id) - 1 i from (select distinct id from releases))')  # fmt: skip
_cat("footer_text", lambda c: c.releases.select("id", layout.footer(F.array("label_name"), F.array("catalog_number"), F.col("year"), F.coalesce("genres", F.array().cast("array<string>")), F.col("id"), None, F.col("date_added")).alias("footer")),
     """select id, case when length(f) > 120 then left(f, 117) || '...' else f end footer from (select id, array_to_string(list_filter([coalesce(case when length(label_name) > 30 then left(label_name, 27) || '...' else label_name end, ''), coalesce(catalog_number, ''),
       case when coalesce("year", 0) <> 0 then "year"::varchar else '' end, coalesce(case when length(g) > 30 then left(g, 27) || '...' else g end, ''), 'ID: ' || id, case when coalesce(date_added, '') <> '' then 'Added: ' || left(date_added, 10) else '' end], lambda x: x <> ''), ', ') f
       from (select *, array_to_string(list_filter(genres[1:2], lambda x: x is not null and x <> ''), ', ') g from c_releases))""")  # fmt: skip


def label_tracks(spark: SparkSession, d: str) -> DataFrame:
    """The track rows of each release's label."""
    c = catalog(spark, d)
    first = c.tracks.withColumn("n", F.row_number().over(W.partitionBy("release_id").orderBy("id"))).where(F.col("n") <= layout.MOST_TRACKS)  # a label's rows
    lists = first.groupBy("release_id").agg(F.array_sort(F.collect_list(F.struct("id", "position", "title", "bpm", "musical_key", "musical_key_scale"))).alias("t"))
    return lists.select("release_id", F.explode(layout.track_rows(F.col("t"))).alias("r")).select("release_id", "r.*")


_define("label_tracks", label_tracks, sql("""select release_id, case when length(coalesce("position", '')) > 3 then left("position", 0) || '...' else coalesce("position", '') end "position",
   case when length(title) > 28 then left(title, 25) || '...' else title end title, coalesce(floor(bpm)::int::varchar, '') bpm, musical_key || case when musical_key_scale = 'minor' then ' min' else ' maj' end as key
   from (select *, row_number() over (partition by release_id order by id) n from c_tracks) where n <= 8"""))  # fmt: skip
_table("stream_window_counts", "events", lambda t: stream_counts(t, "ts", "event_type").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n"), "select strftime(date_trunc('day', ts), '%Y-%m-%d') as day, event_type, count(*) n from events group by 1, 2")



def stream_latest(spark: SparkSession, d: str) -> DataFrame:
    """The latest delivery of each release, folded by a stream over the snapshots' files."""
    path = f"{d}/collection_snapshot?.parquet"  # a pattern, as the table may be one file or a folder
    fields = ["id", "title", "year", "delivered_at", "snapshot_no"]
    schema = read(spark, d, "collection_snapshots").select(*fields).schema
    at = shared_path(spark)
    stream_upserts(spark, path, schema, "id", "delivered_at", f"{at}/state", f"{at}/checkpoint").awaitTermination()
    return read_state(spark, schema, f"{at}/state").select("id", "title", "year", "snapshot_no")


_define("stream_latest", stream_latest, """select id, v.title title, v.y "year", v.n snapshot_no from (select id, arg_max(struct_pack(title := title, y := "year", n := snapshot_no), (delivered_at, title, coalesce("year", -1), snapshot_no)) v from collection_snapshots group by 1)""")

QUERIES: dict[str, Query] = {name: query for name, query, _ in _DEFINED}
ORACLES: dict[str, str] = {name: oracle for name, _, oracle in _DEFINED if oracle}
