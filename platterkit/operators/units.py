"""Lengths recorded in different units, brought to seconds (problem 1).

A length that states its unit (a clock reading, wording, an ISO-8601 duration) is read by itself. A bare number is in
the unit of its feed. The units of all feeds are fitted through the identity that binds the columns: number x unit = length, where a track's and
a video's length of the same release and title are one. The combination of units with the least log residuals is found by turns: feeds whose
unit is settled give lengths to the fit of the others. A feed's note, where it states a unit, goes before its residuals, but a note that
they contradict is flagged, as is a feed for which two units fit alike; a feed whose residuals change at a date has a unit for each period.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platterkit.session import stash

#: Units a bare number may be in, with the seconds in one of it; clock is minutes, a full stop, two digits of seconds.
UNITS: dict[str, float] = {
    "millisecond": 0.001,
    "frame_75": 1 / 75,
    "frame_30": 1 / 30,
    "frame_25": 1 / 25,
    "hundredth": 0.01,
    "tenth": 0.1,
    "second": 1.0,
    "minute": 60.0,
    "clock": 60.0,
    "hour": 3600.0,
}
#: Pseudo-observations that the distribution of stated lengths weighs against the linked records.
PRIOR_WEIGHT = 10.0
#: A unit is unique if the second best unit's mean log residual is worse by this much. By so much a note has to fit worse than the residuals' unit to be contradicted by them.
UNIQUE_MARGIN = 0.25
#: Links to known lengths from which a month's residuals may say that it has another unit than its feed.
MONTH_LINKS = 20
#: Microseconds of a month, on average.
MONTH_US = 2_629_746_000_000
#: Log residual beyond which a link counts as wrong, as for namesakes.
WORST = 1.5
#: Share of a feed's numbers by which a rule on their digits holds.
DIGIT_SHARE = 0.01

_HOUR = r"(?:h|hrs?|hours?|std|stunden?|heures?|horas?|ore|ora)"
_MINUTE = r"(?:m|mins?|minutes?|minuten|minutos?|minut[oiy]|′|'|’)"
_SECOND = r"(?:s|secs?|seconds?|sek|sekunden?|secondes?|segundos?|second[oi]|″|\"|”|''|′′|’’)"
_MILLI = r"(?:ms|msecs?|millis|milliseconds?|millisekunden?|millisecondes?|milisegundos?)"
_NUM = r"(\d+(?:[.,]\d+)?)"
_AND = r"\.?\s*(?:,|and|und|et|y|e)?\s*"
_START, _END = r"(?:^|[^\p{L}\d.,:])", r"(?:$|[^\p{L}\d])"

# Shapes of lengths that state their unit.
_ISO = r"^pt(?:(\d+(?:[.,]\d+)?)h)?(?:(\d+(?:[.,]\d+)?)m)?(?:(\d+(?:[.,]\d+)?)s)?$"
_FRAMES = r"^\D*(\d+)\s*(?:frames?|sectors?|sektoren)\s*[(@,]?\s*(?:at\s+)?(\d+(?:[.,]\d+)?)\s*(?:/\s*s|fps|per\s+sec)"
_SAMPLES = r"(\d+)\s*(?:samples?|smp)\s*(?:@|at|,)?\s*(\d+(?:[.,]\d+)?)\s*(k?)hz"
_CLOCK = r"(?:^|[^\d:.,])((?:\d+:)?\d+:\d{2}(?:[.,]\d+)?)(?:$|[^\d:])"
_GROUPED = rf"{_START}(\d{{1,3}}(?:[ ,.'’]\d{{3}})+)\s*{_MILLI}{_END}"
_MILLIS = rf"{_START}{_NUM}\s*{_MILLI}{_END}"
_HMS = rf"{_START}{_NUM}\s*{_HOUR}{_AND}(\d+)\s*{_MINUTE}?(?:{_AND}{_NUM}\s*{_SECOND}?)?{_END}"
_HOURS = rf"{_START}{_NUM}\s*{_HOUR}{_END}"
_MS = rf"{_START}(\d+)\s*{_MINUTE}{_AND}{_NUM}\s*{_SECOND}?{_END}"
_MINUTES = rf"{_START}{_NUM}\s*{_MINUTE}{_END}"
_SECONDS = rf"{_START}{_NUM}\s*{_SECOND}{_END}"


def _number(text: Column) -> Column:
    return F.regexp_replace(text, ",", ".").try_cast("double")


def _part(text: Column, pattern: str, group: int) -> Column:
    return _number(F.regexp_extract(text, pattern, group))


def clock_seconds(text: Column) -> Column:
    """Seconds of m:ss or h:mm:ss, with or without a fraction; null for other text."""
    p = r"^(?:(\d+):)?(\d+):(\d+(?:[.,]\d+)?)$"
    return F.when(text.rlike(p), F.coalesce(_part(text, p, 1), F.lit(0.0)) * 3600 + _part(text, p, 2) * 60 + _part(text, p, 3))


def worded_seconds(text: Column) -> Column:
    """Seconds that a text states together with their unit; null for bare numbers and for text that states none.

    Known are clock readings with a fraction or words around them, ISO-8601 durations, hours, minutes and
    seconds in words or signs in several languages, milliseconds with or without grouped thousands, frames with a rate
    and samples with a rate. Empty text states none.
    """
    t = F.lower(F.trim(F.regexp_replace(text, r"[\u00a0\u2000-\u200a\u202f\u3000]", " ")))
    part = lambda p, g: F.coalesce(_part(t, p, g), F.lit(0.0))
    return (
        F.when(~t.rlike(r"\d") | t.rlike(r"^\d+(?:[.,]\d+)?$"), None)
        .when(t.rlike(r"^pt\d") & t.rlike(_ISO), part(_ISO, 1) * 3600 + part(_ISO, 2) * 60 + part(_ISO, 3))
        .when(t.rlike(_FRAMES), part(_FRAMES, 1) / _part(t, _FRAMES, 2))
        .when(t.rlike(_SAMPLES), part(_SAMPLES, 1) / (_part(t, _SAMPLES, 2) * F.when(F.regexp_extract(t, _SAMPLES, 3) == "k", 1000.0).otherwise(1.0)))
        .when(t.rlike(_CLOCK), clock_seconds(F.regexp_extract(t, _CLOCK, 1)))
        .when(t.rlike(_GROUPED), F.regexp_replace(F.regexp_extract(t, _GROUPED, 1), r"\D", "").try_cast("double") / 1000)
        .when(t.rlike(_MILLIS), part(_MILLIS, 1) / 1000)
        .when(t.rlike(_HMS), part(_HMS, 1) * 3600 + part(_HMS, 2) * 60 + part(_HMS, 3))
        .when(t.rlike(_HOURS), part(_HOURS, 1) * 3600)
        .when(t.rlike(_MS), part(_MS, 1) * 60 + part(_MS, 2))
        .when(t.rlike(_MINUTES), part(_MINUTES, 1) * 60)
        .when(t.rlike(_SECONDS), part(_SECONDS, 1))
    )


def bare_seconds(number: Column, text: Column, unit: Column) -> Column:
    """Seconds of a bare number in a unit of :data:`UNITS`."""
    factor = F.element_at(F.create_map(*[x for k, v in UNITS.items() for x in (F.lit(k), F.lit(v))]), unit)
    fraction = F.rpad(F.regexp_extract(text, r"[.,](\d{1,2})", 1), 2, "0").try_cast("double")
    return F.when(unit == "clock", F.floor(number) * 60 + F.coalesce(fraction, F.lit(0.0))).otherwise(number * factor)


# What a note says. Keywords are fixed values: stems of unit names in the languages that notes are written in.
_NOTE_UNITS = [
    ("millisecond", r"milli|mili|\bms\b|\bmsec"),
    ("hundredth", r"hundredth|hundertstel|centi[eè]me|cent[eé]sim|\bcs\b"),
    ("tenth", r"tenth|zehntel|dixi[eè]me|d[eé]cim[ao]s? de seg|decimi"),
    ("sector", r"\bsectors?\b|sektor|secteur"),
    ("frame", r"\bframes?\b|\bbilder\b|\bimages\b|fotogram|fotogramm"),
    ("hour", r"\bhours?\b|stunden?\b|heures?\b|\bhoras?\b|\bore\b"),
    ("minute", r"minut"),
    ("second", r"second|sekund|segund"),
]
_MONTHS = {m: i + 1 for i, ms in enumerate("jan|feb f[eé]v|mar m[aä]r|apr avr abr|may mai|jun jui?n|jul juil|aug ao[uû] ago|sep|oct okt|nov|dec dez d[eé]c dic".split("|")) for m in ms.split()}
_DATE = re.compile(
    r"(\d{4})-(\d{2})-(\d{2})(?:t(\d{2}):(\d{2})(?::(\d{2}))?)?"
    rf"|(end of )?(?:(\d{{1,2}})\.?(?:st|nd|rd|th)?\s+(?:de\s+)?)?\b((?:{'|'.join(_MONTHS)})[a-zäéû]{{0,7}})\.?\s+(?:de\s+)?(\d{{4}})",
    re.I,
)


def _note_unit(clause: str) -> str | None:
    found = [(m.start(), u) for u, p in _NOTE_UNITS if (m := re.search(p, clause))]
    if not found:
        return None
    units = {u for _, u in found}
    if "sector" in units or "frame" in units:
        rate = re.search(r"(\d{2,3})\s*(?:of them|frames?|sectors?|bilder|images|sektoren)", clause) or re.search(r"(\d{2,3})\s*(?:fps|/\s*s\b|per second)", clause)
        return f"frame_{rate[1]}" if rate else "frame_75" if "sector" in units else None
    if "minute" in units and "second" in units and re.search(r"two digits|zwei (?:ziffern|stellen)|deux chiffres|dos (?:cifras|d[ií]gitos)|full stop|m\.ss|mm\.ss", clause):
        return "clock"
    for u in ("millisecond", "hundredth", "tenth"):
        if u in units:
            return u
    return min(found)[1]


def _date(m: re.Match) -> pd.Timestamp | None:
    if m[1]:
        return pd.Timestamp(int(m[1]), int(m[2]), int(m[3]), int(m[4] or 0), int(m[5] or 0), int(m[6] or 0))
    month = next((n for p, n in _MONTHS.items() if re.match(p, m[9].lower())), None)
    if month is None:
        return None
    day = pd.Timestamp(int(m[10]), month, int(m[8] or 1))
    return day + pd.offsets.MonthBegin(1) if m[7] else day


def read_note(note: str | None) -> list[tuple[pd.Timestamp | None, str | None]]:
    """The units a note states, each with the instant from which it holds (None: from the start).

    A date splits the note: what stands after "since" or "from" with a date holds from then on; an end ("up to the
    end of March") only confirms the split. A silent note gives one entry without a unit.
    """
    if not isinstance(note, str) or not note.strip():
        return [(None, None)]
    text = note.lower()
    dates = [(m, d) for m in _DATE.finditer(text) if (d := _date(m))]
    starts = [(m, d) for m, d in dates if re.search(r"(?:since|from|as of|after|seit|ab|depuis|[aà] partir d[eu]|desde)\s+(?:the\s+)?$", text[: m.start()])] or dates[-1:]
    if not starts:
        return [(None, _note_unit(text))]
    m, d = starts[-1]
    cut = max(text.rfind(x, 0, m.start()) for x in (".", ";", ",")) + 1
    head, tail = text[:cut], text[m.end() :]
    before, after = _note_unit(head), _note_unit(tail) or _note_unit(text[cut : m.start()])
    return [(None, before), (d, after)] if before and after and before != after else [(None, before or after)]


def _read_notes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for src, feed, note in zip(pdf["src"], pdf["feed"], pdf["note"]):
            read = read_note(note)
            for i, (start, unit) in enumerate(read):
                end = read[i + 1][0] if i + 1 < len(read) else None
                rows.append((src, feed, *(None if t is None else int(t.value // 1000) for t in (start, end)), unit))
        yield pd.DataFrame(rows, columns=["src", "feed", "start_us", "end_us", "unit"]).astype({"start_us": "Int64", "end_us": "Int64"})


def note_units(feeds: DataFrame) -> DataFrame:
    """Rows ``(src, feed, start_us, end_us, unit)`` of a table of feeds: one row a feed and period, unit null where the note is silent."""
    distinct = feeds.select(F.col("delivers").alias("src"), "feed", "note").where(F.col("feed").isNotNull()).distinct()
    return distinct.mapInPandas(_read_notes, "src string, feed string, start_us long, end_us long, unit string")


def _video_title(title: Column) -> Column:
    """The part after the artist and before a year in brackets."""
    tail = F.when(F.contains(title, F.lit(" - ")), F.substring_index(title, " - ", -1)).otherwise(title)
    return F.when(F.endswith(tail, F.lit(")")), F.regexp_replace(tail, r"\s*\((?:\d{4}|n\.d\.)\)\s*$", "")).otherwise(tail)


def _records(tracks: DataFrame, videos: DataFrame) -> DataFrame:
    """Rows ``(src, rec_id, k, feed, at_us, text, rest)`` of both tables: k is a 64-bit key of release and title, rest the text without its digits."""

    def one(src: str, df: DataFrame, title: Column) -> DataFrame:
        return df.select(
            F.lit(src).alias("src"),
            F.col("id").alias("rec_id"),
            F.when(F.col("title").isNotNull(), F.xxhash64("release_id", F.lower(F.trim(title)))).alias("k"),
            "feed",
            F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', recorded_at)").alias("at_us"),
            F.trim(F.col("duration").cast("string")).alias("text"),
        ).where("text <> ''")

    both = one("tracks", tracks, F.col("title")).unionByName(one("release_videos", videos, _video_title(F.col("title"))))
    return both.withColumn("rest", F.translate("text", "0123456789", ""))


# Cheap tests for the two commonest shapes; each text is bare, common or other.
def _is_bare() -> Column:
    return (F.col("rest") == "") | (F.col("rest").isin(".", ",") & ~F.col("text").rlike("^[.,]|[.,]$"))


def _is_common() -> Column:
    return F.col("rest").isin(":", "::") & ~F.col("text").rlike("^:|:$|::")


def _bare_number() -> Column:
    return F.translate("text", ",", ".").try_cast("double")


def _common_seconds() -> Column:
    part = lambda i: F.get(F.split("text", ":"), F.lit(i)).try_cast("double")
    return F.when(F.col("rest") == ":", part(0) * 60 + part(1)).otherwise(part(0) * 3600 + part(1) * 60 + part(2))


def _typed(tracks: DataFrame, videos: DataFrame) -> DataFrame:
    """Rows ``(src, rec_id, k, feed, at_us, common, stated, number, fraction)``, one a record with a length, read once: ``stated`` are seconds that
    the text states with their unit, ``number`` is a bare number and ``fraction`` the two digits behind its point, if it has one."""
    records = _records(tracks, videos)
    bare, common = _is_bare(), _is_common()
    # one struct that is made in a step of its own, as filters and sums over its parts would evaluate each part again
    read = F.struct(
        common.alias("common"), F.when(common, _common_seconds()).when(~bare, worded_seconds(F.col("text"))).alias("stated"), F.when(bare, _bare_number()).alias("number"),
        F.when(bare & (F.col("rest") != ""), F.rpad(F.regexp_extract("text", r"[.,](\d{1,2})", 1), 2, "0").try_cast("int")).alias("fraction"),
    )
    rows = records.select("src", "rec_id", "k", "feed", "at_us", F.explode(F.array(read)).alias("r"))
    return stash(rows.select("src", "rec_id", "k", "feed", "at_us", "r.*").where("stated > 0 or number > 0"))


def _costs(of: DataFrame, known: DataFrame, typical: DataFrame, keys: list[str]) -> DataFrame:
    """Rows ``(*keys, unit, cost, n)``: the mean absolute log residual of each unit for bare numbers ``(*keys, k, x, fraction)`` against known lengths ``(k, length)``.

    The median number against the median of all stated lengths is a prior of fixed weight. Digits rule units out: numbers with digits above .59 aren't in
    ``clock``, whole numbers not in ``clock`` or ``minute``, and decimals that stay below .60 are in ``clock`` rather than ``minute`` and no frames.
    """
    units = F.explode(F.array(*[F.struct(F.lit(k).alias("unit"), F.log(F.lit(v)).alias("factor")) for k, v in UNITS.items()]))
    linked = (
        of.join(known, "k").select(*keys, (F.col("x") - F.col("length")).alias("r")).select(*keys, "r", units.alias("u"))
        .groupBy(*keys, "u.unit").agg(F.avg(F.least(F.abs(F.col("r") + F.col("u.factor")), F.lit(WORST))).alias("gap"), F.count("*").alias("n"))
    )
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    shape = of.groupBy(*keys).agg(F.percentile_approx("x", 0.5, 1000).alias("x"), share(F.col("fraction") > 59).alias("beyond"), share(F.col("fraction").isNotNull()).alias("decimal"))
    prior = shape.crossJoin(F.broadcast(typical)).select(*keys, "beyond", "decimal", (F.col("x") - F.col("typical")).alias("r"), units.alias("u")).select(*keys, "beyond", "decimal", "r", "u.*")  # one number
    n, gap = F.coalesce("n", F.lit(0)), F.coalesce("gap", F.lit(0.0))
    low, whole = F.col("beyond") <= DIGIT_SHARE, F.col("decimal") < 0.5
    out = F.when(F.col("unit") == "clock", ~low | whole).when(F.col("unit") == "minute", low | whole).when(F.startswith("unit", F.lit("frame_")), ~whole).otherwise(False)
    cost = (gap * n + PRIOR_WEIGHT * F.coalesce(F.abs(F.col("r") + F.col("factor")), F.lit(0.0))) / (n + PRIOR_WEIGHT)
    rows = prior.join(linked, [*keys, "unit"], "left")  # as many rows as feeds, months and units
    return rows.select(*keys, "unit", cost.alias("cost"), n.alias("n"), out.alias("out"))


def _ranked(costs: DataFrame, keys: list[str]) -> DataFrame:
    """Rows ``(*keys, c, best, runner_up, margin, n, cost)``: the units in order, those that digits rule out last; as many as there are units are gathered."""
    ranked = costs.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("out", "cost", "unit", "n"))).alias("c"))
    first, second = F.get("c", F.lit(0)), F.get("c", F.lit(1))
    margin = F.when(second["out"] & ~first["out"], WORST).otherwise(second["cost"] - first["cost"])
    return ranked.select(*keys, "c", first["unit"].alias("best"), second["unit"].alias("runner_up"), margin.alias("margin"), first["n"].alias("n"), first["cost"].alias("cost"))


def fit_units(typed: DataFrame, noted: DataFrame) -> DataFrame:
    """Rows ``(src, feed, start_us, end_us, unit, unit_from, runner_up, margin, is_unique, agrees)``: the units of all feeds and their periods.

    ``typed`` are records of :func:`_typed`, ``noted`` the periods of :func:`note_units`. Lengths are known from records that state them; the feeds with a note add theirs for the fit
    of the silent ones. ``unit_from`` is note or residuals; ``margin`` is how much worse, in mean log residual, the best other unit fits; ``agrees`` is false where the residuals prefer
    another unit than the note's by UNIQUE_MARGIN. Units that digits rule out come last. A silent feed is fitted by months as well: a month with MONTH_LINKS links
    whose best unit beats the feed's by UNIQUE_MARGIN has that unit. A feed without bare numbers keeps its note; a silent one gives no row.

    Plan: known lengths are aggregated by a 64-bit key of release and title before they meet the bare numbers, both sides narrow columns;
    everything after is a few rows a feed and month.
    """
    feeds = noted.groupBy("src", "feed").agg(F.collect_list(F.struct("start_us", "end_us", "unit")).alias("periods"), F.max("unit").isNull().alias("silent"))
    bare = typed.where("number > 0").join(F.broadcast(feeds), ["src", "feed"])  # the table of feeds doesn't grow
    bare = bare.withColumn("p", _held(F.col("periods"))).select("src", "feed", "k", "at_us", "number", "fraction", "silent", F.col("p.start_us").alias("start_us"), F.col("p.end_us").alias("end_us"), F.col("p.unit").alias("unit"))
    said = typed.where("stated > 0").select("k", F.log("stated").alias("length"))
    typical = said.agg(F.percentile_approx("length", 0.5, 1000).alias("typical"))
    mean = lambda df: df.where("k is not null").groupBy("k").agg(F.avg("length").alias("length"))
    keys = ["src", "feed", "start", "month"]
    rows = bare.select("src", "feed", F.coalesce("start_us", F.lit(-1)).alias("start"), "silent", "unit", "k", F.log("number").alias("x"), "number", "fraction", F.floor(F.col("at_us") / MONTH_US).cast("long").alias("at_month"))
    # first what a note covers, as a whole, against lengths that others state
    told = _ranked(_costs(rows.where("not silent").withColumn("month", F.lit(-1).cast("long")), mean(said), typical, keys), keys).drop("month")
    cost_of = lambda c, unit: F.get(F.filter(c, lambda x: x["unit"] == unit), F.lit(0))["cost"]
    by_note = noted.where("unit is not null").withColumn("start", F.coalesce("start_us", F.lit(-1))).join(told, ["src", "feed", "start"], "left").select(
        "src", "feed", "start", "start_us", "end_us", "unit", F.lit("note").alias("unit_from"), F.when(F.col("best") == F.col("unit"), F.col("runner_up")).otherwise(F.col("best")).alias("runner_up"),
        F.when(F.col("best") == F.col("unit"), F.col("margin")).otherwise(F.col("cost") - cost_of("c", F.col("unit"))).alias("margin"),
    ).withColumns({"is_unique": F.lit(True), "agrees": F.coalesce(F.col("margin") > -UNIQUE_MARGIN, F.lit(True))})
    # then the silent feeds, as wholes and by months, against these lengths and those of the feeds whose note isn't contradicted
    trusted = F.broadcast(by_note.where("agrees").select("src", "feed", "start"))  # a few rows a feed
    settled = rows.where("unit is not null").join(trusted, ["src", "feed", "start"], "left_semi").select("k", F.log(F.nullif(_seconds_in(F.col("number"), F.col("fraction"), F.col("unit")), F.lit(0.0))).alias("length")).where("length is not null")
    wide = rows.where("silent").withColumn("month", F.explode(F.array(F.lit(-1).cast("long"), F.coalesce("at_month", F.lit(-2)))))
    best = _ranked(_costs(wide, mean(said.unionByName(settled)), typical, keys), keys)
    whole = best.where("month = -1").drop("month")
    quiet = noted.where("unit is null").select("src", "feed").distinct().join(whole, ["src", "feed"])
    months = best.where("month >= 0").join(whole.select("src", "feed", F.col("best").alias("of_feed")), ["src", "feed"])
    turned = (F.col("best") != F.col("of_feed")) & (F.col("n") >= MONTH_LINKS) & (cost_of("c", F.col("of_feed")) - F.col("cost") >= UNIQUE_MARGIN)
    other = months.where(turned).select("src", "feed", (F.col("month") * MONTH_US).alias("start_us"), ((F.col("month") + 1) * MONTH_US).alias("end_us"), F.col("best").alias("unit"), "runner_up", "margin")
    found = other.unionByName(quiet.select("src", "feed", F.lit(None).cast("long").alias("start_us"), F.lit(None).cast("long").alias("end_us"), F.col("best").alias("unit"), "runner_up", "margin"))
    found = found.select("src", "feed", "start_us", "end_us", "unit", F.lit("residuals").alias("unit_from"), "runner_up", "margin", (F.col("margin") >= UNIQUE_MARGIN).alias("is_unique"), F.lit(True).alias("agrees"))
    return by_note.drop("start").unionByName(found)


def _held(periods: Column) -> Column:
    """The narrowest of a feed's periods that holds the record's instant."""
    there = F.filter(periods, lambda p: (p["start_us"].isNull() | (p["start_us"] <= F.col("at_us"))) & (p["end_us"].isNull() | (p["end_us"] > F.col("at_us"))))
    return F.get(F.array_sort(there, lambda a, b: F.when(a["start_us"].isNotNull() & b["start_us"].isNull(), -1).when(a["start_us"].isNull() & b["start_us"].isNotNull(), 1).otherwise(0)), F.lit(0))


def _seconds_in(number: Column, fraction: Column, unit: Column) -> Column:
    """Seconds of a bare number, whose two digits behind the point are ``fraction``, in a unit of :data:`UNITS`."""
    factor = F.element_at(F.create_map(*[x for k, v in UNITS.items() for x in (F.lit(k), F.lit(v))]), unit)
    return F.when(unit == "clock", F.floor(number) * 60 + F.coalesce(fraction, F.lit(0))).otherwise(number * factor)


def feed_units(tracks: DataFrame, videos: DataFrame, feeds: DataFrame) -> DataFrame:
    """:func:`fit_units` of raw tables: one row a feed and period."""
    return fit_units(_typed(tracks, videos), note_units(feeds))


def stated_seconds(tracks: DataFrame, videos: DataFrame, feeds: DataFrame) -> DataFrame:
    """Rows ``(src, rec_id, seconds, unit, unit_from, is_unique, agrees)``: records that state a positive length, but not in the common form.

    The common form is digits joined by one or two colons for tracks and whole seconds for videos. ``unit_from`` is ``value``,
    ``note`` or ``residuals``; ``is_unique`` is false where the residuals don't settle the unit, ``agrees`` where they contradict the note. Null and empty lengths,
    zero, negative numbers and text without a length give no row, nor do bare numbers of a feed that is null or in no
    table of feeds. Repeated rows give one. Columns beyond those used are ignored.

    Plan: the records are read once into narrow typed columns; the table of feeds is small by definition, and its units are broadcast; after the narrow join
    of :func:`fit_units` only the final distinct over the result shuffles.
    """
    typed = _typed(tracks, videos)
    units = fit_units(typed, note_units(feeds))
    # at most a few rows a feed, gathered into one row a feed so that a record meets just one
    by_feed = units.groupBy("src", "feed").agg(F.collect_list(F.struct("start_us", "end_us", "unit", "unit_from", "is_unique", "agrees")).alias("periods"))
    read = typed.where("not common").join(F.broadcast(by_feed), ["src", "feed"], "left")  # the table of feeds doesn't grow
    p = F.when(F.col("number").isNotNull(), _held(F.col("periods")))
    read = read.withColumn("p", p).where("number is null or (p is not null and not (src = 'release_videos' and p.unit = 'second'))")
    length = F.when(F.col("number").isNull(), F.col("stated")).otherwise(_seconds_in(F.col("number"), F.col("fraction"), F.col("p.unit")))
    return (
        read.select("src", "rec_id", length.alias("length"), "p.unit", F.coalesce("p.unit_from", F.lit("value")).alias("unit_from"), F.coalesce("p.is_unique", F.lit(True)).alias("is_unique"), F.coalesce("p.agrees", F.lit(True)).alias("agrees"))
        .where("length > 0")
        .select("src", "rec_id", F.floor(F.col("length") + 0.5).cast("long").alias("seconds"), "unit", "unit_from", "is_unique", "agrees")
        .distinct()
    )
