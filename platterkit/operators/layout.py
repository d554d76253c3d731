"""Label sheets as data: presets, places on the sheet, and the texts of a label. Nothing is drawn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from platterkit.functions.music import bpm_sticker, format_key
from platterkit.functions.text import date_prefix, truncate

#: Sizes of label sheets in millimetres (name: width, height, per row, per column, left margin, top margin, gap).
PRESETS = {"avery_l4744rev65": (96.0, 50.8, 2, 5, 7.0, 21.5, 4.0), "herma_4222": (63.5, 29.633, 3, 9, 7.21, 15.15, 2.54)}
PAGE_HEIGHT = 297.0
REFERENCE = (96.0, 50.8)
MOST_TRACKS, MOST_GENRES = 8, 2


def scale(preset: str) -> float:
    """Factor by which the reference layout shrinks to a preset; it never grows."""
    width, height = PRESETS[preset][:2]
    return min(1.0, width / REFERENCE[0], height / REFERENCE[1])


def sheet_slots(releases: DataFrame, key: str = "id", preset: str = "avery_l4744rev65") -> DataFrame:
    """Rows ``(<key>, page, row, col, x, y)``: where each label goes, in order of the key.

    Numbers in a total order need each row's rank. Keys are ranked in ranges: counts of ranges give offsets, and a window numbers
    the keys of one range, so no task sorts them all.
    """
    width, height, per_row, per_col, left, top, space = PRESETS[preset]
    ids = releases.select(key).where(F.col(key).isNotNull()).distinct()
    bounds = ids.agg(F.min(key).alias("lo"), F.max(key).alias("hi"))
    parts = 1024
    part = F.floor((F.col(key) - F.col("lo")) * F.lit(parts) / (F.col("hi") - F.col("lo") + 1)).cast("int")
    ranged = ids.crossJoin(F.broadcast(bounds)).select(key, part.alias("part"))  # one row
    before = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = ranged.groupBy("part").agg(F.count("*").alias("n")).select("part", before.alias("before"))  # at most ``parts`` rows
    rank = F.row_number().over(W.partitionBy("part").orderBy(key)) - 1
    i = (F.col("own") + F.col("before")).cast("long")
    placed = ranged.withColumn("own", rank).join(F.broadcast(offsets), "part").withColumn("i", i)
    slot = F.col("i") % (per_row * per_col)
    rows = placed.select(key, F.floor(F.col("i") / (per_row * per_col)).cast("int").alias("page"), F.floor(slot / per_row).cast("int").alias("row"), (slot % per_row).cast("int").alias("col"))
    return rows.withColumns({"x": left + F.col("col") * (width + space), "y": PAGE_HEIGHT - top - (F.col("row") + 1) * height})


def header(artists: Column, title: Column) -> tuple[Column, Column]:
    """Artist and title lines."""
    names = F.array_join(artists, ", ")
    return truncate(F.when(names != "", names).otherwise(F.lit("Unknown Artist")), 45), truncate(title, 45)


def footer(labels: Column, catalog_numbers: Column, year: Column, genres: Column, key: Column, dj_name: str | None, date_added: Column) -> Column:
    """The line of small facts: those that are known, by commas, cut to fit."""
    text = lambda c: F.coalesce(c, F.lit(""))
    joined = lambda c, most: truncate(F.array_join(F.filter(c, lambda x: x.isNotNull() & (x != "")), ", "), most)
    parts = F.array(
        text(joined(labels, 30)), text(joined(catalog_numbers, 20)), F.when(F.coalesce(year, F.lit(0)) != 0, year.cast("string")).otherwise(F.lit("")), text(joined(F.slice(genres, 1, MOST_GENRES), 30)),
        F.concat(F.lit("ID: "), key.cast("string")), F.lit(dj_name or ""), F.when(text(date_added) != "", F.concat(F.lit("Added: "), date_prefix(date_added))).otherwise(F.lit("")),
    )
    return truncate(F.array_join(F.filter(parts, lambda p: p != ""), ", "), 120)


def track_rows(tracks: Column, notation: str = "standard") -> Column:
    """The first tracks of a label: position, title, tempo and key, each cut to its column."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    return F.transform(
        F.slice(tracks, 1, MOST_TRACKS),
        lambda t: F.struct(
            truncate(blank(t["position"]), 3).alias("position"),
            truncate(t["title"], 28).alias("title"),
            F.when(F.coalesce(t["bpm"], F.lit(0.0)) != 0, bpm_sticker(t["bpm"]).cast("string")).otherwise(F.lit("")).alias("bpm"),
            blank(format_key(t["musical_key"], t["musical_key_scale"], notation, compact=True)).alias("key"),
        ),
    )
