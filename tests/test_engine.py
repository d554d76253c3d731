"""The catalogue's operators on a small catalogue, with the cases of a hand-made collection."""

from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from platterkit.functions import music
from platterkit.functions.similarity import levenshtein_similarity, ratio
from platterkit.operators import detail, facets, layout, local_match, pending, resolve, scores, search, sync
from platterkit.schema import TABLES, Catalog
from platterkit.sources import catalogue, fetch, folders
from platterkit.streaming.sync_stream import read_state, stream_upserts

NOW = "2024-02-01T00:00:00"


def table(spark, name, rows):
    schema = TABLES[name]
    return spark.createDataFrame([tuple(r.get(f) for f in schema.fieldNames()) for r in rows], schema)


@pytest.fixture(scope="module")
def cat(spark):
    rel = lambda i, title, **k: {"id": i, "title": title, "year": 2020, "genres": ["Electronic"], "styles": ["Acid"], "date_added": f"2024-01-0{i}T00:00:00", "added_at": NOW, **k}
    return Catalog(
        table(spark, "releases", [rel(1, "Acid Test"), rel(2, "rock 100%", year=1999, genres=["Rock"], styles=None), rel(3, "Kulør", year=None, genres=["Rock", None]), rel(4, "Gone", removed_from_discogs_at=NOW)]),
        table(spark, "artists", [{"id": 10, "name": "Müller (2)"}, {"id": 20, "name": "apple"}, {"id": 30, "name": "Zebra"}, {"id": 40, "name": "Müller (3)"}]),
        table(spark, "release_artists", [{"release_id": 1, "artist_id": 10}, {"release_id": 1, "artist_id": 20}, {"release_id": 2, "artist_id": 30}, {"release_id": 4, "artist_id": 40}]),
        table(spark, "labels", [{"id": 100, "name": "Label One"}]),
        table(spark, "release_labels", [{"release_id": 1, "label_id": 100, "catalog_number": "C1"}, {"release_id": 1, "label_id": 100, "catalog_number": "C2"}]),
        table(spark, "tracks", [
            {"id": 1, "release_id": 1, "position": "A1", "title": "One", "duration": "3:45", "bpm": 120.0, "genre": "Rock", "analyzed_at": NOW}, {"id": 2, "release_id": 1, "position": "A2", "title": "Two", "genre": "Jazz", "artist": "apple, Müller"},
            {"id": 3, "release_id": 2, "position": "A1", "title": "Three", "bpm": 129.6, "local_audio_path": "/x.flac", "genre": ""}, {"id": 4, "release_id": 3, "position": "1", "title": "Four", "artist": "Guest"},
        ]),
        table(spark, "videos", [{"id": 11, "release_id": 1, "title": "One", "url": "u1", "yt_title": "One", "yt_duration": 230, "yt_fetched_at": NOW, "video_type": "full_track"}, {"id": 12, "release_id": 3, "title": "Four", "url": "u2"}, {"id": 13, "release_id": 2, "title": "x", "url": "u3", "yt_fetched_at": NOW}]),
        table(spark, "credits", [{"id": 1, "release_id": 1, "artist_id": 30, "role": "Mixed By"}, {"id": 2, "release_id": 1, "artist_id": 20, "role": "Mixed By"}]),
        table(spark, "matches", [{"track_id": 1, "video_id": 11, "fuzzy_score": 0.9, "is_selected": 1}, {"track_id": 2, "video_id": 11, "fuzzy_score": 0.3, "is_selected": 0}]),
        table(spark, "crates", [{"id": 0, "name": "zero", "created_at": "a"}, {"id": 1, "name": "one", "created_at": "b"}]),
        table(spark, "crate_releases", [{"crate_id": 0, "release_id": 1}, {"crate_id": 0, "release_id": 4}]),
        table(spark, "stickers", [{"release_id": 2}]),
    )


def ids(df, column="id"):
    return [r[column] for r in df.select(column).collect()]


@pytest.mark.parametrize(
    ("filters", "want"),
    [
        ({}, {1, 2, 3}), ({"q": ""}, {1, 2, 3}), ({"year": 0}, {1, 2, 3}), ({"genres": []}, {1, 2, 3}), ({"q": "kulor"}, {3}), ({"q": "mueller"}, {1}), ({"q": "100%"}, {2}), ({"q": "_"}, set()),
        ({"genres": ["Rock", "Jazz"]}, {2, 3}), ({"styles": ["Acid"]}, {1, 3}), ({"year": 1999}, {2}), ({"label_name": "label"}, {1}), ({"artist_name": "ZEB"}, {2}), ({"bpm": 120.0, "bpm_tolerance": 0.08}, {1, 2}),
        ({"bpm": 120.0, "bpm_tolerance": 0.0}, {1}), ({"bpm": 120.0}, {1, 2, 3}), ({"crate_id": 0}, {1}), ({"crate_id": 1}, set()), ({"in_stickers": True}, {2}), ({"genres": ["Rock"], "q": "zebra"}, {2}),
    ],
)
def test_filters(cat, filters, want):
    assert set(ids(search.filter_releases(cat, **filters))) == want
    assert search.count_releases(cat, **filters).first()["n"] == len(want)


def test_orders_and_pages(cat):
    order = lambda s, **k: ids(search.list_releases(cat, s, **k))
    assert order("date_added_desc") == order("unknown") == [3, 2, 1]
    assert order("date_added_asc", limit=1, offset=1) == [2]
    assert order("title_asc") == [1, 3, 2]
    assert order("year_desc") == [1, 2, 3] and order("year_asc") == [3, 2, 1]
    assert order("artist_asc") == [3, 2, 1]  # the outer comparison is binary, no artist comes first
    assert order("label_asc") == [2, 3, 1]
    row = search.list_releases(cat, "title_asc", limit=1).first()
    assert (row.artist_names, row.track_count, row.matched_count, row.analyzed_count, row.matching_status, row.analysis_status) == ("Müller, apple", 2, 1, 1, "partial", "partial")


def test_request_texts():
    got = search.parse_filters({"q": "", "year": "19x", "bpm": "120", "bpm_tolerance": ["4", "8", "x"], "genres": ["", "A"]})
    assert got["year"] is None and got["bpm"] == 120 and got["bpm_tolerance"] == 0.08 and got["genres"] == ["A"] and got["q"] is None
    assert search.page_state(100, 48, 48) == {"loaded_count": 96, "has_more": True}


def test_facets(cat):
    assert ids(facets.list_genres(cat), "genre") == ["Electronic", "Rock"]
    assert ids(facets.list_styles(cat), "style") == ["Acid"]
    assert ids(facets.list_years(cat), "year") == [2020, 1999]
    assert ids(facets.list_labels(cat), "name") == ["Label One"]
    assert ids(facets.list_artists(cat), "name") == ["apple", "Müller", "Zebra"]
    assert [tuple(r)[1:] for r in facets.crates_with_counts(cat).collect()] == [("one", "b", 0), ("zero", "a", 2)]


def test_details(cat, spark):
    rows = {r.id: r for r in detail.release_detail(cat).collect()}
    assert set(rows) == {1, 2, 3, 4}
    one = rows[1]
    assert [a.name for a in one.artists] == ["apple", "Müller (2)"] and [x.catalog_number for x in one.labels] == ["C1", "C2"]
    assert one.ai_genres == ["Rock", "Jazz"] and [t.url for t in one.tracks] == ["u1", None] and [c.name for c in one.credits] == ["apple", "Zebra"]
    assert rows[3].tracks_have_distinct_artists and rows[4].tracks == []
    assert ids(detail.release_detail(cat, spark.createDataFrame([(2,)], "id long"))) == [2]
    assert detail.credits_by_role(cat).first()["names"] == ["apple", "Zebra"]
    assert detail.release_log(cat).where("id = 4").first()["line"] == "2020  Gone [removed]"


def test_pending(cat):
    assert set(ids(pending.with_unclassified_video(cat))) == {2, 3}
    assert set(ids(pending.needing_analysis(cat))) == {2}
    assert set(ids(pending.pending(cat))) == {2, 3}
    assert tuple(pending.count_pending(cat).first()) == (2, 1, 2)
    assert ids(pending.locally_covered(cat), "release_id") == [2]
    assert ids(pending.stuck_fetches(cat), "release_id") == [2]
    assert ids(pending.analyzable_tracks(cat)) == [3] and ids(pending.analyzable_tracks(cat, only_new=False)) == [1, 3]
    assert ids(pending.downloadable(cat)) == [1]


def test_sync_upserts_children_and_removes_the_missing(cat, spark):
    record = {"id": 1, "title": "Acid Test 2", "year": 2021, "genres": ["Rock"], "artists": [{"id": 10, "name": "Müller"}, {"id": 10, "name": "Müller"}], "labels": [{"id": 7, "name": "New", "catalog_number": None}], "images": [{"uri": "cover"}], "tracks": [{"position": "A1", "title": "Only", "artists": ["a", "b"]}], "videos": [{"url": "v"}, {"url": "v"}], "credits": [{"artist_id": 50, "artist_name": "Eng", "role": "Mix"}]}

    def get(i):
        if i == 5:
            raise KeyError("lost")
        return record

    detail_rows = fetch.fetch_releases(spark.createDataFrame([(1,), (5,)], "id long"), get)
    snapshot = spark.createDataFrame([(1, "2024-03-01"), (4, "2024-03-01"), (5, "x")], "id long, date_added string")
    done = sync.sync(cat, snapshot, detail_rows, "2024-04-01")
    rel = {r.id: r for r in done.releases.collect()}
    assert rel[1].title == "Acid Test 2" and rel[1].added_at == NOW and rel[1].cover_image_url == "cover" and rel[1].last_synced_at == "2024-04-01"
    assert rel[2].removed_from_discogs_at == "2024-04-01" and rel[4].removed_from_discogs_at == NOW and 5 not in rel
    assert {r.id: r.name for r in done.artists.collect()} == {10: "Müller", 20: "apple", 30: "Zebra", 40: "Müller (3)", 50: "Eng"}
    assert done.release_artists.where("release_id = 1").count() == 1 and done.release_labels.where("release_id = 1").first()["catalog_number"] == ""
    own = done.tracks.where("release_id = 1").collect()
    assert [(t.title, t.artist) for t in own] == [("Only", "a, b")] and own[0].id > 4 and done.tracks.count() == 3
    assert done.videos.where("release_id = 1").count() == 1
    assert sync.sync(cat, snapshot, detail_rows, "2024-04-01", complete=False).releases.where("removed_from_discogs_at = '2024-04-01'").count() == 0
    assert ids(sync.missing(snapshot, cat.releases, "id")) == [5]


def test_writes_and_clears(cat, spark):
    results = spark.createDataFrame([(13, 3, 0.9, None, None, "full_track", "A1", 1), (12, None, 0.1, 0.5, "no", "unrelated", None, 0)], "video_id long, track_id long, fuzzy_score double, llm_confidence double, llm_reasoning string, video_type string, best_position string, is_selected int")
    wrote = sync.write_matches(cat, results, spark.createDataFrame([(2,), (3,)], "release_id long"), NOW)
    assert {(r.track_id, r.video_id) for r in wrote.matches.collect()} == {(1, 11), (2, 11), (3, 13)}
    assert {r.id: r.video_type for r in wrote.videos.collect()} == {11: "full_track", 12: "unrelated", 13: "full_track"}
    assert {r.id: r.duration for r in sync.backfill_durations(cat).collect()} == {1: "3:45", 2: None, 3: None, 4: None}
    cleared = sync.clear_matches(cat, spark.createDataFrame([(1,)], "release_id long"))
    assert cleared.matches.count() == 0 and cleared.videos.where("id = 11").first()["yt_title"] == "One" and cleared.videos.where("id = 11").first()["video_type"] is None
    got = fetch.fetch_video_metadata(cat.videos.where("id < 13"), lambda url: {"title": "T", "duration": 5.0, "chapters": [{"title": "c", "start_time": 1}]} if url == "u1" else None)
    stamped = {r.id: r for r in sync.stamp_metadata(cat.videos, got, NOW).collect()}
    assert stamped[11].yt_title == "T" and stamped[12].video_type_reasoning == pending.FETCH_FAILED and stamped[13].yt_fetched_at == NOW
    assert sync.clear_analysis(cat.tracks, spark.createDataFrame([(1,)], "release_id long")).where("analyzed_at is not null").count() == 0
    assert sync.add_members(cat.stickers, table(spark, "stickers", [{"release_id": 2}, {"release_id": 1}, {"release_id": 1}]), ["release_id"]).count() == 2
    assert sync.delete_crates(cat, spark.createDataFrame([(0,)], "crate_id long")).crate_releases.count() == 0


def lists(spark, tracks, videos):
    t = spark.createDataFrame([(i, 1, p, title, artist, s) for i, p, title, artist, s in tracks], "id long, release_id long, position string, title string, artist string, seconds int")
    v = spark.createDataFrame([(i, 1, title, s, [], None) for i, title, s in videos], "id long, release_id long, title string, seconds int, chapters array<string>, description string")
    return t, v, spark.createDataFrame([(1, "Product", ["Tenth Chapter"])], "id long, title string, artists array<string>")


def test_scores_gate_and_artist(spark):
    rows = [("Song", None, 100, "Song", 121), ("Song", None, 100, "Song", 120), ("Song", "Band", None, "Song Band", 50), ("Song", None, 100, "song", None), ("Song", None, 0, "Song", 7)]
    df = spark.createDataFrame(rows, "track_title string, track_artist string, track_seconds int, video_title string, video_seconds int")
    got = {(r.video_seconds, r.track_seconds): round(r.score, 4) for r in resolve.score_pairs(df).collect()}
    assert got == {(121, 100): 0.0, (120, 100): 0.94, (50, None): 1.0, (None, 100): 1.0, (7, 0): 1.0}


def test_resolution_routes_and_selects_once(spark):
    t, v, r = lists(
        spark,
        [(1, "A1", "Product (Original Mix)", None, None), (2, "A2", "Product (“Bedrock Dub” Mix)", None, None), (3, "AA1", "Product (“Daydreamers Tonight At Noon” Mix)", None, None)],
        [(10, "Tenth Chapter -  Product (Daydreamers Tonite At Noon Mix)", None), (11, "Product", None), (12, "Something quite unlike it", None), (13, "Product", None)],
    )
    asked = []

    def model(prompts):
        asked.append(prompts)
        return prompts.select("video_id", F.lit("unrelated").alias("classification"), F.lit(None).cast("string").alias("position"), F.lit(0.9).alias("confidence"), F.lit("no").alias("reasoning"))

    got = {x.video_id: x for x in resolve.resolve(t, v, r, model).collect()}
    assert got[10].track_id == 3 and got[10].video_type == "full_track" and got[10].llm_confidence is None
    assert got[11].track_id == 1 and got[11].is_selected == 1 and got[13].is_selected == 0
    assert got[12].video_type == "unrelated" and got[12].llm_reasoning == "no"
    silent = {x.video_id: x for x in resolve.resolve(t, v, r).collect()}
    assert silent[12].track_id is None and silent[12].video_type == "unrelated"
    forced = resolve.resolve(t, v, r, model, force_model=True)
    assert forced.where("video_type = 'unrelated'").count() == 4


def test_a_model_that_contradicts_clear_scores_is_overruled(spark):
    t, v, r = lists(spark, [(1, "A1", "Alpha Song", None, None), (2, "A2", "Beta Tune", None, None)], [(10, "Alpha Song (long official upload)", None)])
    reply = lambda prompts: fetch.classify(prompts, lambda p: '[{"classification": "full_track", "matched_track_position": "A2", "confidence": 1, "reasoning": "r"}]')
    got = resolve.resolve(t, v, r, reply, force_model=True).first()
    assert got.track_id == 1 and got.llm_confidence is None and "falling back" in got.llm_reasoning
    bad = resolve.resolve(t, v, r, lambda p: fetch.classify(p, lambda _: "not json"), force_model=True).first()
    assert bad.track_id is None and bad.video_type == "unrelated"


def test_selection_prefers_the_mean_of_score_and_confidence(spark):
    rows = [(1, 10, 5, 0.6339, 1.0, 0), (1, 11, 5, 0.6654, 0.99, 0), (1, 12, 6, 0.855, None, 0), (1, 13, 6, 0.3488, 0.9, 1)]
    df = spark.createDataFrame(rows, "release_id long, video_id long, track_id long, fuzzy_score double, llm_confidence double, late int")
    assert {r.video_id for r in resolve.select_matches(df).where("is_selected = 1").collect()} == {11, 12}


def test_best_two_ties_and_nothing(spark):
    df = spark.createDataFrame([(1, 7, 0.5), (1, 5, 0.5), (1, 6, 0.2), (2, 1, 0.0), (3, 9, 0.4)], "video_id long, track_id long, score double")
    got = {r.video_id: (r.best, r.best_score, r.runner_up) for r in resolve.best_two(df).collect()}
    assert got == {1: (5, 0.5, 0.5), 2: (None, 0.0, 0.0), 3: (9, 0.4, 0.0)}
    assert resolve.best_two(df.limit(0)).count() == 0


def test_local_library(spark, tmp_path):
    for name in ("Label/Band - Great Album [FLAC]/01 - One.flac", "Label/Band - Great Album [FLAC]/02. Two.FLAC", "Other Stuff/x.mp3", "Other Stuff/readme.txt", "1/A1 - One.mp3"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    files = folders.list_files(spark, str(tmp_path))
    found = folders.audio_folders(files)
    assert found.count() == 3 and folders.list_files(spark, str(tmp_path / "missing")).count() == 0
    assert [tuple(r) for r in folders.download_counts(files).collect()] == [(1, 1)]
    rel = spark.createDataFrame([(1, "Great Album", "Band"), (2, "Unheard Of", "Nobody")], "id long, title string, artists string")
    tracks = spark.createDataFrame([(1, 1, "1", "One", None), (2, 1, "2", "Two", "Band"), (3, 1, "3", "Three", None)], "id long, release_id long, position string, title string, artist string")
    best, given = local_match.match_library(rel, tracks, found)
    assert [(r.release_id, r.path.rsplit("/", 1)[1]) for r in best.where("score >= 0.75").collect()] == [(1, "Band - Great Album [FLAC]")]
    assert {(r.track_id, r.file.rsplit("/", 1)[1]) for r in given.collect()} == {(1, "01 - One.flac"), (2, "02. Two.FLAC")}


@pytest.mark.parametrize("few", [0, 128])
def test_best_folders_are_those_of_all_pairs(spark, monkeypatch, few):
    monkeypatch.setattr(local_match, "FEW_PAIRS", few)
    monkeypatch.setattr(local_match, "BLOCK", 3)  # a frequent word is several cells
    monkeypatch.setattr(local_match, "PAIRS_AT_ONCE", 7)
    names = ["The Great Album", "the great ALBUM ", "Album, The Great", "Été the Night", "The " + "Long Winding Road " * 8, "no", "The 東京 Album x" * 6, "Tide"]
    rel = spark.createDataFrame([(i, n, a) for i, (n, a) in enumerate([(n, a) for n in names for a in ("Band", "The Long Band", None)])], "id long, title string, artists string")
    found = spark.createDataFrame([(f"/m/{i % 3}/{a}{n}",) for i, n in enumerate(names) for a in ("", "Band - ", "Road ")] + [(None,), ("/z/The Great Album/",)], "path string")
    want = {tuple(r) for r in local_match.best_folder(local_match.score_folders(rel, found)).collect()}
    assert {tuple(r) for r in local_match.best_folders(rel, found).collect()} == want and len(want) > 15
    assert local_match.best_folders(rel, found.limit(0)).count() == 0


def test_pairs_that_cannot_be_best_are_not_compared(monkeypatch):
    compared = []
    common = local_match._common_lengths
    monkeypatch.setattr(local_match, "_common_lengths", lambda codes, lengths, left, right: compared.append(len(left)) or common(codes, lengths, left, right))
    words = ["".join(chr(97 + (i * k + i // 7) % 26) for k in (3, 5, 7, 11, 13, 17)) for i in range(1, 301)]
    rel = pa.table({"w": [1] * 300, "release_id": list(range(300)), "text_words": [f"live {w}" for w in words]})
    own = [f"{w[:3]}{w[4:]} live" if i % 2 else f"live {w}" for i, w in enumerate(words)]
    found = pa.table({"w": [1] * 300, "path": [f"/{i:03}" for i in range(300)], "own": own})
    for least in (0.0, 75.0):
        compared.clear()
        want = {}
        for r, w in enumerate(words):
            score, path = min((-ratio(f"live {w}", o), f"/{i:03}") for i, o in enumerate(own))
            if -score >= least:
                want[r] = (path, -score)
        got = local_match._best_of_cell(rel, found, least).to_pylist()
        assert {x["release_id"]: (x["path"], x["ratio"]) for x in got} == want and len(want) > 100
        assert sum(compared) < 300 * 300 / 4


@pytest.mark.parametrize("least", [0.0, 0.75])
def test_folders_without_a_shared_word_are_compared(spark, monkeypatch, least):
    monkeypatch.setattr(local_match, "FEW_PAIRS", 0)
    monkeypatch.setattr(local_match, "KEPT", 5)
    # neither "Grat Albums" nor "U2" nor a longer name with a letter wrong everywhere shares a word of three letters with its release
    rel = spark.createDataFrame([(1, "Great Album", None), (2, "XO", "U2"), (3, "Long Winding Road " * 9, "Band"), (4, "!", None), (5, "Zq", "Zq")], "id long, title string, artists string")
    found = spark.createDataFrame([("/m/Grat Albums",), ("/m/u2 - xo",), ("/n/u2 - xo",), ("/m/" + "Longg Wwinding Roadd " * 9 + "Bband",), ("/m/?",), (None,), ("/m/Albu",)], "path string")
    want = {tuple(r) for r in local_match.best_folder(local_match.score_folders(rel, found)).where(f"score >= {least}").collect()}
    assert {tuple(r) for r in local_match.best_folders(rel, found, least).collect()} == want
    assert {(r[0], r[1][:7]) for r in want} >= {(1, "/m/Grat"), (2, "/m/u2 -"), (3, "/m/Long"), (4, "/m/?")}


def test_files_of_confident_folders_alone(spark):
    rel = spark.createDataFrame([(1, "Great Album", "Band"), (2, "Unheard Of", "Nobody"), (3, "Great Tide", "Band")], "id long, title string, artists string")
    tracks = spark.createDataFrame([(10 * r + i, r, f"A{i}", t, a) for r in (1, 2, 3) for i, (t, a) in enumerate([("One", None), ("Two", "Band"), ("One More", "Band & Co")])], "id long, release_id long, position string, title string, artist string")
    found = spark.createDataFrame([("/m/Band - Great Album", ["/m/1 One.mp3", "/m/2 Band - Two.mp3"]), ("/m/Great", ["/m/x.mp3"]), ("/n/Band Great Tide!", ["/n/One More.mp3", "/n/One.mp3", "/n/Tow.mp3"])], "path string, files array<string>")
    want = {tuple(r) for r in local_match.match_library(rel, tracks, found)[1].collect()}
    assert {tuple(r) for r in local_match.match_files(rel, tracks, found).collect()} == want and len(want) == 5


def test_music_and_scores(spark):
    keys = spark.createDataFrame([("C", "major"), ("A", "minor"), ("F#", "minor"), ("D#", "major"), ("Eb", "minor"), ("H", "minor"), (None, "minor"), ("C", None)], "k string, s string")
    got = [tuple(r) for r in keys.select(music.format_key(F.col("k"), F.col("s"), "camelot"), music.format_key(F.col("k"), F.col("s")), music.format_key(F.col("k"), F.col("s"), compact=True)).collect()]
    assert [g[0] for g in got] == ["8B", "8A", "11A", "5B", "2A", "H", None, "8B"]
    assert got[2][1:] == ("F# Minor", "F# min") and got[7][1] == "C"
    m = spark.createDataFrame([({"mood_happy": 0.9, "mood_sad": 0.5, "x": 0.1, "genre_discogs400:Rock---Punk": 0.8, "genre_discogs400:Jazz---Bop": 0.2},), ({"mood_sad": 0.4},)], "m map<string,double>")
    assert [tuple(r) for r in m.select(music.summarize_mood(F.col("m")), music.top_style(F.col("m")), music.top_genre(F.col("m"))).collect()] == [("Happy, Sad", "Rock---Punk", "Rock"), ("Neutral", None, None)]
    one = spark.createDataFrame([([0.3, 0.7],)], "p array<double>")
    assert one.select(music.collapse_predictions("d", ["not_d", "d"], F.col("p")), music.collapse_predictions("g", ["a", "b"], F.col("p"))).first()[:] == ({"d": 0.7}, {"g:a": 0.3, "g:b": 0.7})
    wave = spark.createDataFrame([(1, [0.5, -0.5, 1.0, -1.0, 0.25]), (2, [])], "id int, s array<float>")
    assert sorted(tuple(r) for r in scores.envelope(wave, "id", "s", 2, 100).collect()) == [(1, 0, 0.5, -0.5, 25, 75), (1, 1, 1.0, -1.0, 0, 100), (2, 0, 0.0, 0.0, 50, 51)]
    rows = scores.analyze(spark.createDataFrame([(1, "a"), (2, "bad")], "id long, path string"), lambda p: {"bpm": 1.0} if p == "a" else 1 / 0, "bpm double")
    assert {r.track_id: (r.bpm, r.error) for r in rows.collect()} == {1: (1.0, None), 2: (None, "ZeroDivisionError: division by zero")}


def test_layout(spark):
    slots = {r.id: r for r in layout.sheet_slots(spark.createDataFrame([(i * 3,) for i in range(25)] + [(None,)], "id long")).collect()}
    assert (slots[33].page, slots[33].row, slots[33].col) == (1, 0, 1) and slots[72].page == 2 and len(slots) == 25
    assert layout.scale("avery_l4744rev65") == 1.0 and layout.scale("herma_4222") == pytest.approx(29.633 / 50.8)
    row = spark.createDataFrame([(["L"], ["", "C"], 0, ["a", "b", "c"], 5, "2024-01-02T03")], "l array<string>, c array<string>, y int, g array<string>, i long, d string")
    assert row.select(layout.footer(F.col("l"), F.col("c"), F.col("y"), F.col("g"), F.col("i"), "DJ", F.col("d"))).first()[0] == "L, C, a, b, ID: 5, DJ, Added: 2024-01-02"


def test_versions_on_disk(cat, spark, tmp_path):
    root = str(tmp_path / "cat")
    assert catalogue.latest_version(spark, root) is None
    assert catalogue.save_catalog(cat, root) == 1 and catalogue.save_catalog(cat, root) == 2
    again = catalogue.open_catalog(spark, root)
    assert again.releases.schema == TABLES["releases"] and again.tracks.count() == 4


def test_stream_keeps_the_latest_row(spark, tmp_path):
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    schema = StructType([StructField("id", LongType()), StructField("v", StringType()), StructField("seq", LongType())])
    for n, rows in enumerate([[(1, "a", 1), (2, "b", 1)], [(1, "c", 3), (1, "d", 2)], [(3, "e", 1)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    state = str(tmp_path / "state")
    assert read_state(spark, schema, state).count() == 0
    stream_upserts(spark, str(tmp_path / "in"), schema, "id", "seq", state, str(tmp_path / "ck"), buckets=4).awaitTermination(60)
    assert {tuple(r) for r in read_state(spark, schema, state).collect()} == {(1, "c", 3), (2, "b", 1), (3, "e", 1)}
    # what comes later is folded in; no bucket keeps more than two versions
    for rows in ([(2, "f", 5)], [(2, "g", 4), (None, "h", 9)], [(2, "i", 6)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream_upserts(spark, str(tmp_path / "in"), schema, "id", "seq", state, str(tmp_path / "ck"), buckets=4).awaitTermination(60)
    assert {tuple(r) for r in read_state(spark, schema, state).collect()} == {(1, "c", 3), (2, "i", 6), (3, "e", 1)}
    versions = Counter(p.name for p in (tmp_path / "state").glob("batch=*/bucket=*"))
    assert max(versions.values()) <= 2


def test_stream_leaves_no_batch_without_rows(spark, tmp_path):
    schema = spark.createDataFrame([], "id long, v string, seq long").schema
    for n in range(5):
        spark.createDataFrame([(1, "abcde"[n], n)] + [(2, "z", 0)] * (n == 1), schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    state = str(tmp_path / "state")
    stream_upserts(spark, str(tmp_path / "in"), schema, "id", "seq", state, str(tmp_path / "ck"), buckets=1).awaitTermination(120)
    assert {tuple(r) for r in read_state(spark, schema, state).collect()} == {(1, "e", 4), (2, "z", 0)}
    assert len(list((tmp_path / "state").glob("batch=*"))) == 2  # the newest and the one before, from which a batch is run again


def test_levenshtein_similarity(spark):
    df = spark.createDataFrame([("abc", "abd"), ("", "")], "a string, b string")
    assert [round(r[0], 2) for r in df.select(levenshtein_similarity(F.col("a"), F.col("b"))).collect()] == [66.67, 100.0]


def test_weighted_queries_read_titles_and_artists_as_they_are(spark):
    from platterkit.plans import reference_queries
    from platterkit.schema import Catalog

    releases = spark.createDataFrame([(1, "Товелин")], "id long, artist_names string")
    tracks = spark.createDataFrame([(10, 1, "A1", "Солёный дождь", "4:00", None), (11, 1, "A2", "Été", "3:00", "Zoë"), (12, 1, "A3", "Dub", "2:00", " ")], "id long, release_id long, position string, title string, duration string, artist string")
    videos = spark.createDataFrame([(20, 1, "Солёный дождь", 240, None), (21, 1, "Été Zoë", 180, None), (22, 1, None, 1, None)], "id long, release_id long, title string, duration long, description string")
    c = Catalog(releases, tracks=tracks, videos=videos)
    t, v = reference_queries.whole_lists(c)
    assert {r.id: r.artist for r in t.collect()} == {10: "Товелин", 11: "Zoë", 12: "Товелин"} and v.count() == 2
    matches = spark.createDataFrame([], "track_id long, video_id long, is_selected int, llm_confidence double")
    got = {(r.video_id, r.track_id): r.score for r in reference_queries.resolve.score_matrix(t, v, matches).collect()}
    assert got[20, 10] == 1.0 and got[21, 11] == 1.0
