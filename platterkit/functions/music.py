"""Functions on keys, score maps and audio values, as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Pitch classes, other spellings of them, and the wheel code of each major and minor key by semitone.
PITCHES = ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"]
ALIASES = {"Db": 1, "Eb": 3, "Fb": 4, "Gb": 6, "Ab": 8, "Bb": 10, "Cb": 11, "B#": 0, "E#": 5}
MAJOR_CODES = ["8B", "3B", "10B", "5B", "12B", "7B", "2B", "9B", "4B", "11B", "6B", "1B"]
MINOR_CODES = ["5A", "12A", "7A", "2A", "9A", "4A", "11A", "6A", "1A", "8A", "3A", "10A"]
MOODS = {"danceability": "Danceable", "mood_happy": "Happy", "mood_sad": "Sad", "mood_relaxed": "Relaxed", "mood_aggressive": "Aggressive", "mood_party": "Party"}
STYLE_HEAD = "genre_discogs400:"


def _map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def format_key(key: Column, scale: Column, notation: str = "standard", compact: bool = False) -> Column:
    """A key for display: its spelling with the scale, or its code on the wheel. Null or empty keys give null."""
    minor = F.lower(F.coalesce(scale, F.lit(""))) == "minor"
    if notation == "camelot":
        semitone = F.element_at(_map({**{p: i for i, p in enumerate(PITCHES)}, **ALIASES}), F.trim(key))
        code = F.when(minor, F.get(F.array(*[F.lit(c) for c in MINOR_CODES]), semitone)).otherwise(F.get(F.array(*[F.lit(c) for c in MAJOR_CODES]), semitone))
        shown = F.coalesce(code, key)
    else:
        names = ("min", "maj") if compact else ("Minor", "Major")
        label = F.when(F.coalesce(scale, F.lit("")) == "", F.lit("")).when(minor, F.lit(names[0])).otherwise(F.lit(names[1]))
        shown = F.trim(F.concat(key, F.lit(" "), label))
    return F.when(F.coalesce(key, F.lit("")) == "", None).otherwise(shown)


def collapse_predictions(name: str, classes: list[str], scores: Column) -> Column:
    """A score map of one head: two classes of which one negates the other give the other's score under the head's name."""
    negations = [c.startswith(("non_", "not_")) for c in classes]
    if len(classes) == 2 and any(negations):
        return F.create_map(F.lit(name), F.get(scores, F.lit(negations.index(False))).cast("double"))
    return F.map_from_arrays(F.array(*[F.lit(f"{name}:{c}") for c in classes]), F.transform(F.slice(scores, 1, len(classes)), lambda x: x.cast("double")))


def _ranked(scores: Column) -> Column:
    """Entries of a score map, the highest first, of equal ones by key."""
    return F.array_sort(F.transform(F.map_entries(scores), lambda e: F.struct((-e["value"]).alias("neg"), e["key"].alias("key"))))


def summarize_mood(scores: Column, threshold: float = 0.5, most: int = 3) -> Column:
    """Labels of the highest binary scores from a threshold on, ``Neutral`` if there is none."""
    kept = F.map_filter(scores, lambda k, v: ~F.contains(k, F.lit(":")) & (v >= threshold))
    names = F.transform(F.slice(_ranked(kept), 1, most), lambda e: F.coalesce(F.element_at(_map(MOODS), e["key"]), e["key"]))
    return F.when(F.coalesce(F.size(names), F.lit(0)) > 0, F.array_join(names, ", ")).otherwise(F.lit("Neutral"))


def top_style(scores: Column) -> Column:
    """The highest class of the style head, null if the map has none."""
    own = F.map_filter(scores, lambda k, v: F.startswith(k, F.lit(STYLE_HEAD)))
    return F.substring(F.get(_ranked(own), F.lit(0))["key"], len(STYLE_HEAD) + 1, 1_000)


def top_genre(scores: Column) -> Column:
    """The part of the top style before its first ``---``."""
    return F.substring_index(top_style(scores), "---", 1)


def style_badge(style: Column) -> Column:
    """The part of a style after its first ``---``, the style itself if it has none."""
    return F.element_at(F.split(style, "---", 2), -1)


def bpm_page(bpm: Column) -> Column:
    """Tempo as pages show it: rounded, halves to even."""
    return F.bround(bpm, 0).cast("int")


def bpm_sticker(bpm: Column) -> Column:
    """Tempo as stickers show it: cut."""
    return bpm.cast("int")


def bpm_band(bpm: float, tolerance: float) -> tuple[float, float]:
    """Bounds of a tempo with a relative tolerance; without one, half a beat on each side."""
    return (bpm * (1 - tolerance), bpm * (1 + tolerance)) if tolerance > 0 else (bpm - 0.5, bpm + 0.5)
