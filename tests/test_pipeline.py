"""Runs over a small catalogue: sync, matching, local files, downloads and analysis, end to end."""

import threading

import pytest

from platterkit import session
from platterkit.operators import pipeline, sync
from platterkit.operators.pipeline import Options
from platterkit.schema import TABLES, Catalog
from platterkit.sources import catalogue, fetch

NOW = "2024-03-01T00:00:00"
KEPT = "release_id long, stem string, path string"


def table(spark, name, rows):
    schema = TABLES[name]
    return spark.createDataFrame([tuple(r.get(f) for f in schema.fieldNames()) for r in rows], schema)


def small(spark, videos):
    empty = {name: table(spark, name, []) for name in TABLES}
    return Catalog(
        **{
            **empty,
            "releases": table(spark, "releases", [{"id": 1, "title": "Night Signals"}, {"id": 2, "title": "Done"}, {"id": 3, "title": "Gone", "removed_from_discogs_at": NOW}]),
            "artists": table(spark, "artists", [{"id": 9, "name": "Tovelin"}]),
            "release_artists": table(spark, "release_artists", [{"release_id": 1, "artist_id": 9}]),
            "tracks": table(spark, "tracks", [{"id": 1, "release_id": 1, "position": "A1", "title": "Salt Rain", "duration": "4:00"}, {"id": 2, "release_id": 1, "position": "A2", "title": "Empty Quarry"}, {"id": 3, "release_id": 2, "position": "A1", "title": "Settled", "analyzed_at": NOW}, {"id": 4, "release_id": 3, "title": "Away"}]),
            "videos": table(spark, "videos", videos),
        }
    )


VIDEOS = [
    {"id": 10, "release_id": 1, "url": "u/rain"}, {"id": 11, "release_id": 1, "url": "u/broken"}, {"id": 12, "release_id": 1, "url": "u/kept", "yt_title": "Tovelin - Empty Quarry", "yt_duration": 200, "yt_fetched_at": "then"},
    {"id": 20, "release_id": 2, "url": "u/old", "yt_title": "Settled", "yt_fetched_at": "then", "video_type": "full_track"}, {"id": 30, "release_id": 3, "url": "u/gone"},
]


extract = (lambda: lambda url: {"u/rain": {"title": "Salt Rain", "duration": 241.0}, "u/kept": {"title": "Other", "duration": 1}, "u/old": {"title": "Settled", "duration": 100}}.get(url))()  # workers can't import this module


def test_matching_fetches_resolves_and_writes(spark):
    cat = small(spark, VIDEOS)
    run = pipeline.match_videos(cat, extract, NOW)
    v = {r.id: r for r in run.catalog.videos.collect()}
    assert (v[10].yt_title, v[10].video_type) == ("Salt Rain", "full_track") and v[11].video_type_reasoning == "metadata fetch failed" and v[12].yt_title == "Tovelin - Empty Quarry"
    assert v[20].yt_fetched_at == "then" and v[30].yt_fetched_at is None  # classified, and removed
    assert {(r.track_id, r.video_id, r.is_selected) for r in run.catalog.matches.collect()} == {(1, 10, 1), (2, 12, 1)}
    assert {r.id: r.duration for r in run.catalog.tracks.collect()} == {1: "4:00", 2: "3:20", 3: None, 4: None}
    assert [(r.step, r.id) for r in run.errors.collect()] == [("fetch", 11)]
    # classified releases again, with what was fetched before; or everything fetched anew
    again = pipeline.match_videos(run.catalog, extract, "later", Options(reprocess=True))
    assert {r.id: r.yt_fetched_at for r in again.catalog.videos.collect()} == {10: NOW, 11: NOW, 12: "then", 20: "then", 30: None} and again.catalog.matches.count() == 3
    forced = pipeline.match_videos(run.catalog, extract, "later", Options(force=True))
    assert {r.id: r.yt_title for r in forced.catalog.videos.collect()} == {10: "Salt Rain", 11: None, 12: "Other", 20: "Settled", 30: None}
    assert pipeline.match_videos(run.catalog, extract, "later").extra["results"].count() == 0
    # a failed fetch is tried again on demand
    retried = pipeline.retry_failed(run.catalog, lambda url: {"title": "Empty Quarry", "duration": 200} if url == "u/broken" else extract(url), "later")
    assert {r.id: r.video_type for r in retried.catalog.videos.collect()}[11] == "full_track" and retried.errors.count() == 0


def test_a_model_is_asked_with_the_whole_record(spark):
    cat = small(spark, [{"id": 10, "release_id": 1, "url": "u/x"}])
    seen = []

    def model(text):
        assert "Night Signals by Tovelin" in text and "A1 Salt Rain by Tovelin (4:00)" in text and "one line" in text
        return '{"classification": "full_track", "matched_track_position": "A1", "confidence": 0.9, "reasoning": "it says so"}'

    run = pipeline.match_releases(cat, spark.createDataFrame([(1,)], "release_id long"), lambda u: {"title": "Unlike", "duration": 240, "description": "one\nline"}, NOW, model=model)
    assert [(r.track_id, r.llm_confidence, r.llm_reasoning) for r in run.catalog.matches.collect()] == [(1, 0.9, "it says so")] and not seen
    lists = [fetch.classify(spark.createDataFrame([(1, "p")], "video_id long, prompt string"), lambda p, x=x: x).first() for x in ("[]", "{}", '{"confidence": null}', "no json")]
    assert [(r.classification, r.confidence) for r in lists] == [("unrelated", 0.0), ("unrelated", 0.0), (None, None), (None, None)]


def test_both_passes(spark):
    cat = small(spark, VIDEOS)
    calls = spark.sparkContext.accumulator(0)

    def one(url, stem):
        calls.add(1)
        if url == "u/kept":
            raise OSError("gone")
        return f"/audio/{stem}.webm"

    options = Options(delay=0.0)
    first = pipeline.match_and_download(cat, extract, one, spark.createDataFrame([], KEPT), NOW, options)
    assert {(r.track_id, r.status) for r in first.extra["downloads"].collect()} == {(1, "downloaded"), (2, "failed")} and calls.value == 1 + 3
    run = pipeline.run_all(cat, extract, one, spark.createDataFrame([(1, "A2 - Empty Quarry", "/kept")], KEPT), lambda p: {"bpm": float(len(p))}, "bpm double", NOW, options)
    assert {r.id: r.bpm for r in run.catalog.tracks.collect()} == {1: float(len("/audio/1/A1 - Salt Rain.webm")), 2: 5.0, 3: None, 4: None}
    assert {(r.step, r.id) for r in run.errors.collect()} == {("fetch", 11)}
    halted = pipeline.run_all(cat, extract, one, spark.createDataFrame([], KEPT), lambda p: 1 / 0, "bpm double", NOW, options, stopped=lambda: True)
    assert halted.catalog.tracks.where("bpm is not null").count() == 0 and halted.errors.where("step = 'analyze'").count() == 0
    # a release with local files for all tracks isn't looked up
    folders = spark.createDataFrame([("/m/Tovelin Night Signals", ["/m/Tovelin Night Signals/A1 Salt Rain.flac", "/m/Tovelin Night Signals/A2 Empty Quarry.flac"])], "path string, files array<string>")
    local = pipeline.match_and_download(cat, lambda u: 1 / 0, one, spark.createDataFrame([], KEPT), NOW, options, folders=folders)
    assert local.errors.count() == 0 and local.catalog.tracks.where("local_audio_path is not null").count() == 2
    assert pipeline.match_local(cat, folders.limit(0), NOW) is cat


def test_sync_add_and_remove(spark):
    cat = small(spark, [])
    keys = fetch.collection_keys(spark, 2, lambda n: [(1, "d1"), (5, "d5")] if n == 1 else [(2, "d2"), (6, "d6")])
    detail = lambda i: {"id": i, "title": f"R{i}", "tracks": [{"title": "a"}, {"title": "b"}]} if i != 6 else 1 / 0
    run = pipeline.sync_collection(cat, keys, detail, NOW)
    assert {r.id: r.title for r in run.catalog.releases.collect()} == {1: "Night Signals", 2: "Done", 3: "Gone", 5: "R5"} and [r.id for r in run.errors.collect()] == [6]
    assert sorted(r.id for r in run.catalog.tracks.where("release_id = 5").collect()) == [5, 6]
    trial = pipeline.sync_collection(run.catalog, keys, detail, "later", limit=1)
    assert trial.catalog.releases.where("removed_from_discogs_at = 'later'").count() == 0
    told = []
    added = pipeline.add_release(run.catalog, 8, told.append, detail, "later")
    assert told == [8] and added.catalog.releases.where("id = 8").first()["date_added"] == "later" and added.catalog.releases.where("removed_from_discogs_at = 'later'").count() == 0
    gone = pipeline.remove_release(added.catalog, 8, told.append, "last")
    assert told == [8, 8] and [r.id for r in gone.releases.where("removed_from_discogs_at = 'last'").collect()] == [8]
    with pytest.raises(ZeroDivisionError):
        pipeline.remove_release(cat, 1, lambda i: 1 / 0, NOW)


def test_new_ids_depend_on_rows_alone(spark):
    rows = [(r, p, f"t{r}{p}") for r in range(40) for p in range(r % 4)]
    one, two = (
        {(r.release_id, r.place): r.id for r in sync.numbered(spark.createDataFrame(x, "release_id long, place int, title string").repartition(n), 100).collect()} for n, x in ((1, rows), (7, rows[::-1]))
    )
    assert one == two and sorted(one.values()) == list(range(100, 100 + len(rows)))


def test_options():
    assert Options.read({}) == Options()
    got = Options.read({"PLATTERKIT_CONFIDENT": "0.9", "PLATTERKIT_TERMS": " ", "PLATTERKIT_ATTEMPTS": None}, {"PLATTERKIT_CONFIDENT": "0.1", "PLATTERKIT_TERMS": "Mix, Edit,", "PLATTERKIT_FORCE": "yes", "PLATTERKIT_ATTEMPTS": "5"})
    assert got == Options(confident=0.9, terms=("Mix", "Edit"), force=True, attempts=5) and got.again and not Options(force=True, reprocess=False).again


def test_missing_tables_and_columns_are_created_in_order(spark, tmp_path):
    root = str(tmp_path / "cat")
    few = {"releases": TABLES["releases"]}
    assert catalogue.migrate(spark, root, few) == ["create releases"] and catalogue.migrate(spark, root, few) == []
    old = table(spark, "releases", [{"id": 1, "title": "x"}]).drop("country")
    catalogue.save_catalog(Catalog(old), root)
    done = catalogue.migrate(spark, root)
    assert done[0] == "add releases.country" and "create tracks" in done and catalogue.migrate(spark, root) == []
    assert catalogue.open_catalog(spark, root).releases.first()["title"] == "x"


def test_runs_of_a_kind_go_one_at_a_time(spark):
    runs = pipeline.Runs(spark)
    inside, go_on = threading.Event(), threading.Event()
    t = threading.Thread(target=lambda: runs.start("sync", lambda: (inside.set(), go_on.wait(20))))
    t.start()
    assert inside.wait(20) and runs.going() == {"sync"}
    with pytest.raises(RuntimeError):
        runs.start("sync", lambda: None)
    runs.stop("sync")
    runs.stop("other")
    go_on.set()
    t.join()
    assert runs.going() == set() and runs.start("sync", lambda: 7) == 7


def test_a_cluster_must_name_its_shared_folder():
    class Context:
        master = "spark://host:7077"

        class _jsc:
            @staticmethod
            def sc():
                return Context

        class getCheckpointDir:  # noqa: N801
            def __new__(cls):
                return cls

            @staticmethod
            def isEmpty():  # noqa: N802
                return True

        @staticmethod
        def getConf():  # noqa: N802
            return {}

    class Session:
        sparkContext = Context  # noqa: N815

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session._shared_folder(Session)


def test_matched_folders(spark):
    from platterkit.operators.local_match import matched_folders

    assert matched_folders(table(spark, "releases", [{"id": 1, "local_folder_path": "/x"}, {"id": 2}])).first()["n"] == 1
