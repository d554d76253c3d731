"""Lengths, packed fields and snapshot changes against brute force and known cases."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from platterkit.operators import packed, snapshots, units


def one(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


WORDED = {
    "PT3M53S": 233, "PT2M": 120, "PT1H2M3S": 3723, "0h02m09s": 129, "4m 22s": 262, "5m38": 338, "4min22": 262, "2 mins, 38 secs": 158, "6 Minuten 14 Sekunden": 374,
    "3 minuti e 37 secondi": 217, "5 minutos 11 segundos": 311, "3 minutes et 28 secondes": 208, "4′34″": 274, "3'30\"": 210, "1' 57''": 117, "5’39”": 339, "~6:57": 417, "[2:45]": 165,
    "ca. 3:17": 197, "time: 5:02": 302, "5:59 mins": 359, "0:02:21.152": 141.152, "~3 min": 180, "approx. 4 minutes": 240, "1,78 minutes": 106.8, "3.30min": 198, "0.0911 h": 327.96,
    "0.0381 Std.": 137.16, "196 Sek.": 196, "291.0 s": 291, "236.1s": 236.1, "292 750 milliseconds": 292.75, "357,930 msec": 357.93, "264430 ms": 264.43, "21645 frames (75/s)": 288.6,
    "6349152 samples @ 44100 Hz": 143.972, "7894876 smp at 44.1 kHz": 179.022, "7678031 samples, 48 kHz": 159.959,
    "33 rpm": None, "12 inch": None, "24 bit": None, "take 3": None, "A-side": None, "-": None, "?:??": None, "see insert": None, "": None, None: None, "312084": None, "3.43": None,
}


def test_worded_lengths(spark):
    got = one(spark, list(WORDED), units.worded_seconds)
    for (said, want), seconds in zip(WORDED.items(), got):
        assert seconds == (None if want is None else pytest.approx(want, abs=0.001)), said


@pytest.mark.parametrize(
    ("note", "units_read"),
    [
        (None, [None]), ("", [None]), ("Nobody knows.", [None]), ("Whole milliseconds.", ["millisecond"]), ("Dauer in Sekunden", ["second"]), ("durée en minutes décimales", ["minute"]),
        ("minutes, a full stop, then two digits of seconds", ["clock"]), ("CD sectors; one second is 75 of them", ["frame_75"]), ("counts 25 frames per second", ["frame_25"]),
        ("seconds up to the end of March 2024; from 1 April 2024 on milliseconds", ["second", "millisecond"]), ("Whole seconds at first. Since 2024-04-01T00:00Z tenths of a second.", ["second", "tenth"]),
    ],
)
def test_notes(note, units_read):
    assert [u for _, u in units.read_note(note)] == units_read


def records(spark, rows, kind):
    t = dt.datetime(2024, 5, 1)
    full = [(i, r, title, d, feed, at or t, "extra") for i, r, title, d, feed, at in rows]
    return spark.createDataFrame(full, f"id long, release_id long, title string, duration {kind}, feed string, recorded_at timestamp_ntz, unit string")


def test_stated_seconds(spark):
    early = dt.datetime(2024, 3, 31, 23, 59, 59)
    known = [(100 + i, i, f"t{i}", f"{3 + i % 3}:{i:02d}", "api", None) for i in range(40)]
    silent = [(200 + i, i, f"T{i} ", str((3 + i % 3) * 60000 + i * 1000), "dump", None) for i in range(40)]
    rows = known + silent + [
        (1, 1, "x", "90", "split", early), (2, 1, "y", "90000", "split", None), (3, 1, None, "3.05", "cards", None), (4, 1, "z", "0", "cards", None), (5, None, "n", "PT1M", None, None),
        (6, 1, "n", "100", "nowhere", None), (7, 1, "n", None, "cards", None), (8, 1, "n", "-5", "cards", None), (1, 1, "x", "90", "split", early), (9, 1, "n", "x" * 5000, "cards", None),
    ]
    videos = [(1, 1, "a", 250, "tape", None), (2, 1, "b", 180, "plain", None), (3, 1, "c", -1, "tape", None), (4, 1, None, None, "tape", None)]
    feeds = spark.createDataFrame(
        [("api", "tracks", "as delivered"), ("dump", "tracks", None), ("split", "tracks", "seconds; since 2024-04-01 milliseconds"), ("cards", "tracks", "minutes, a full stop, two digits of seconds"), ("tape", "release_videos", "25 frames per second"), ("plain", "release_videos", "seconds")],
        "feed string, delivers string, note string",
    )
    got = {(r.src, r.rec_id): (r.seconds, r.unit, r.is_unique) for r in units.stated_seconds(records(spark, rows, "string"), records(spark, videos, "long"), feeds).collect()}
    want = {("tracks", 1): 90, ("tracks", 2): 90, ("tracks", 3): 185, ("tracks", 5): 60, ("release_videos", 1): 10} | {("tracks", 200 + i): (3 + i % 3) * 60 + i for i in range(40)}
    assert {k: v[0] for k, v in got.items()} == want
    assert got["tracks", 200][1:] == ("millisecond", True)
    empty = records(spark, [], "string")
    assert units.stated_seconds(empty, records(spark, [], "long"), feeds.limit(0)).count() == 0


def test_a_unit_that_lengths_do_not_settle_is_flagged(spark):
    rows = [(i, i, f"t{i}", "4:00", "api", None) for i in range(20)] + [(100 + i, i, f"u{i}", str(240 * 27), "odd", None) for i in range(20)]
    feeds = spark.createDataFrame([("odd", "tracks", None)], "feed string, delivers string, note string")
    got = [r for r in units.stated_seconds(records(spark, rows, "string"), records(spark, [], "long"), feeds).collect()]
    assert {r.is_unique for r in got} == {False}


def test_contradicted_notes_and_changes_of_unit(spark):
    months = [dt.datetime(2024, m, 15) for m in range(1, 7)]
    seconds = lambda i: 180 + i % 97
    known = [(1000 + i, i, f"t{i}", f"{seconds(i) // 60}:{seconds(i) % 60:02d}", "api", None) for i in range(240)]
    # a note that says seconds over milliseconds, one that is right, and a silent feed that turns from seconds to milliseconds after three months
    liar = [(2000 + i, i, f"t{i}", str(seconds(i) * 1000), "liar", None) for i in range(240)]
    right = [(3000 + i, i, f"t{i}", str(seconds(i) * 10), "right", None) for i in range(240)]
    turn = [(4000 + i, i, f"t{i}", str(seconds(i) * (1 if i % 6 < 3 else 1000)), "turn", months[i % 6]) for i in range(240)]
    feeds = spark.createDataFrame([("api", "tracks", None), ("liar", "tracks", "seconds"), ("right", "tracks", "tenths of a second"), ("turn", "tracks", None)], "feed string, delivers string, note string")
    tracks, videos = records(spark, known + liar + right + turn, "string"), records(spark, [], "long")
    found = {}
    for r in units.feed_units(tracks, videos, feeds).collect():
        found.setdefault(r.feed, set()).add((r.unit, r.unit_from, r.is_unique, r.agrees))
    assert found["liar"] == {("second", "note", True, False)} and found["right"] == {("tenth", "note", True, True)} and {u for u, *_ in found["turn"]} == {"second", "millisecond"}
    got = {r.rec_id: r for r in units.stated_seconds(tracks, videos, feeds).collect()}
    assert all(got[4000 + i].seconds == seconds(i) for i in range(240)) and got[2000].agrees is False and got[3000].seconds == seconds(0)


def brute_items(s):
    """Splits by walking the text once."""
    out, i, n, item, quoted = [], 0, len(s), "", False
    while i < n:
        if s[i] == '"' and not item.strip():
            j, body = i + 1, ""
            while j < n:
                if s[j] == '"' and s[j + 1 : j + 2] == '"':
                    body, j = body + '"', j + 2
                elif s[j] == '"':
                    break
                else:
                    body, j = body + s[j], j + 1
            out.append(body.strip())
            item, i, quoted = "", j + 1, True
            continue
        m = re.match(r"\s*[,;|/&+\n\t]\s*(?:(?<=\s)and\s+)?|\s+and\s+", s[i:])
        if m:
            if not quoted:
                out.append(item.strip())
            item, quoted, i = "", False, i + len(m[0])
        else:
            item, i = item + s[i], i + 1
    if not quoted:
        out.append(item.strip())
    return [x for x in out if x]


PACKED = [
    "A1, B2", "A1,,B2", "A1; B2 | C3 / D4 & E5 + F6", "A1\nB2\tC3", '"Horizon, Silver"\t"Život Meadow", "A2"\tA1', "A1 to B2", "A1–A3, B1", '1 to 4, "Wild Garden", "1", 9–10', "A1, and B2", "3 and 9",
    '"say ""hi"", you" & A1', ' "A2"\n"Needle of Shadow"\nC2 ', "A1", "", None, "B1, B1", "A1, ", '"only"', "0, A1", '"a, b"',
]


def test_packed_references(spark):
    df = spark.createDataFrame([(i, p, 1) for i, p in enumerate(PACKED)] * 2, "id int, t string, pos int")
    got = {}
    for r in packed.split_packed(df, "id", "t").orderBy("id", "pos").collect():
        got.setdefault(r.id, []).append((r.pos, r["item"]))
    want = {i: list(enumerate(items, 1)) for i, p in enumerate(PACKED) if p and len(items := brute_items(p)) > 1}
    assert got == want
    long = ", ".join(f'"t, {i}"' for i in range(3000))
    rows = packed.split_packed(spark.createDataFrame([(1, long)], "id int, t string"), "id", "t").collect()
    assert len(rows) == 3000 and {r["item"] for r in rows} == {f"t, {i}" for i in range(3000)}


def test_known_names_stay_whole(spark):
    names = spark.createDataFrame([("Tide & Vigo",), ("Vale, The",), ("Ada",), (None,), ('The "Ember" Loposel',), ("X; Y; Z",)], "name string")
    texts = {
        1: "Tide & Vigo", 2: "Ada & Tide & Vigo", 3: "Vale, The, Ada", 4: 'Ada|"Tide & Vigo"', 5: 'The "Ember" Loposel + Ada', 6: '"The ""Ember"" Loposel" feat. Ada', 7: "X; Y; Z, Ada vs. Bob", 8: None, 9: "Ada",
    }
    df = spark.createDataFrame(list(texts.items()) * 2, "id int, t string")
    got = {}
    for r in packed.split_names(df, "id", "t", names, "name").orderBy("id", "pos").collect():
        got.setdefault(r.id, []).append(r["item"])
    assert got == {
        2: ["Ada", "Tide & Vigo"], 3: ["Vale, The", "Ada"], 4: ["Ada", "Tide & Vigo"], 5: ['The "Ember" Loposel', "Ada"], 6: ['The "Ember" Loposel', "Ada"], 7: ["X; Y; Z", "Ada", "Bob"],
    }
    assert packed.split_names(df, "id", "t", names.limit(0), "name").where("id = 1").count() == 2
    assert packed.split_names(df.limit(0), "id", "t", names, "name").count() == 0


def test_snapshot_changes_against_brute_force(spark):
    import random

    rng = random.Random(5)
    t0 = dt.datetime(2024, 1, 1)
    rows = []
    for no in (1, 2, 4, 5):
        for i in range(60):
            for version in range(rng.choice([0, 1, 1, 2])):
                removed = rng.choice([None, None, t0, t0 + dt.timedelta(days=900)])
                genres = rng.choice([None, ["a"], ["a", "b"], ["b", "a", "a"]])
                rows.append((no, t0 + dt.timedelta(days=30 * no), i, rng.choice(["x", " x ", "y", None]), rng.choice([None, 1999]), genres, rng.choice(["2020-01-01T00:00:00Z", "2020-01-01 00:00:00", "2020-01-01T02:00:00+02:00", None]), removed, t0 + dt.timedelta(days=version)))
    schema = "snapshot_no int, snapshot_at timestamp_ntz, id long, title string, year int, genres array<string>, date_added string, removed_from_discogs_at timestamp_ntz, delivered_at timestamp_ntz"
    df = spark.createDataFrame(rows + rows[:50] + [(None, None, 1, "q", None, None, None, None, None), (2, None, None, "q", None, None, None, None, None)], schema)
    best = {}
    for r in rows:
        if (r[0], r[2]) not in best or r[8] > best[r[0], r[2]][8]:
            best[r[0], r[2]] = r
    state = lambda r: ((r[3] or "").strip() if r[3] is not None else None, r[4], None if r[5] is None else frozenset(r[5]), r[6] is not None)
    here = {k: state(r) for k, r in best.items() if r[7] is None or r[7] > r[1]}
    want = set()
    for before, now in ((1, 2), (2, 4), (4, 5)):
        for i in range(60):
            a, b = here.get((before, i)), here.get((now, i))
            if a != b:
                want.add((now, i, "added" if a is None else "removed" if b is None else "changed"))
    assert {tuple(r) for r in snapshots.collection_changes(df).collect()} == want
    assert snapshots.collection_changes(df.limit(0)).count() == 0


def test_instants(spark):
    got = one(spark, ["2020-01-01T00:00:00Z", "2020-01-01 00:00:00", "2020-01-01T02:00:00+02:00", "2020-01-01T02:00:00+0200", "2020-01-01", "junk", None], snapshots.instant)
    assert got[0] == got[1] == got[2] == got[3] == got[4] and got[5:] == [None, None]
