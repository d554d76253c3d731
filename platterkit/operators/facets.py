"""Facet lists and membership sets of the active catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platterkit.functions.text import nocase, strip_disambiguation
from platterkit.operators.search import active
from platterkit.schema import Catalog


def _values(cat: Catalog, column: str, name: str) -> DataFrame:
    return active(cat.releases).select(F.explode(column).alias(name)).where(F.col(name).isNotNull()).distinct().orderBy(nocase(F.col(name)), name)


def list_genres(cat: Catalog) -> DataFrame:
    """Every genre of an active release, in order without regard to case."""
    return _values(cat, "genres", "genre")


def list_styles(cat: Catalog) -> DataFrame:
    """Every style of an active release, in order without regard to case."""
    return _values(cat, "styles", "style")


def list_years(cat: Catalog) -> DataFrame:
    """Every known year of an active release, the latest first."""
    return active(cat.releases).where("year is not null").select("year").distinct().orderBy(F.desc("year"))


def _names(cat: Catalog, bridge: DataFrame, names: DataFrame, key: str) -> DataFrame:
    used = bridge.join(active(cat.releases).select(F.col("id").alias("release_id")), "release_id", "left_semi").select(F.col(key).alias("id")).distinct()
    return names.join(used, "id", "left_semi").select("name").distinct()


def list_labels(cat: Catalog) -> DataFrame:
    """Names of labels with an active release."""
    return _names(cat, cat.release_labels, cat.labels, "label_id").orderBy(nocase(F.col("name")), "name")


def list_artists(cat: Catalog) -> DataFrame:
    """Names of artists with an active release without disambiguation numbers, each once, where its first full name stands."""
    own = _names(cat, cat.release_artists, cat.artists, "artist_id")
    bare = own.groupBy(strip_disambiguation(F.col("name")).alias("name")).agg(F.min(F.struct(nocase(F.col("name")).alias("k"), F.col("name").alias("full"))).alias("first"))
    return bare.orderBy("first.k", "first.full", "name").select("name")


def crates_with_counts(cat: Catalog) -> DataFrame:
    """Crates, the latest first, with how many releases each holds, removed ones included; empty crates have 0."""
    counts = cat.crate_releases.groupBy("crate_id").agg(F.count("release_id").alias("item_count"))
    rows = cat.crates.join(counts, F.col("id") == F.col("crate_id"), "left")
    return rows.select("id", "name", "created_at", F.coalesce("item_count", F.lit(0)).alias("item_count")).orderBy(F.desc("created_at"), "id")


def crates_of_release(cat: Catalog) -> DataFrame:
    """Rows ``(release_id, crate_ids)`` with each release's crates as a sorted set."""
    return cat.crate_releases.groupBy("release_id").agg(F.array_sort(F.collect_set("crate_id")).alias("crate_ids"))
