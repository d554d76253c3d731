"""Queries of this subpackage over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platterkit.llm.canonical import look_alike_pairs
from platterkit.llm.cooccurrence import pair_counts, release_baskets
from platterkit.llm.linkage import catalogue, folder_words, links, video_words
from platterkit.llm.mixing import mix, sized_texts
from platterkit.llm.mojibake import restore_texts
from platterkit.llm.packing import pack_texts, packing_report
from platterkit.llm.privacy import find_mentions, numbered_mentions, sanitise
from platterkit.llm.sql import ORACLES  # noqa: F401
from platterkit.llm.tokens import with_tokens
from platterkit.session import read


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose name or title looks the same but isn't the same string."""
    one = lambda t, text, within: read(spark, d, t).select(F.lit(t).alias("src"), F.col("id"), F.col(text).alias("text"), within.cast("long").alias("within"))
    rows = one("artists", "name", F.lit(0)).unionByName(one("tracks", "title", F.col("release_id"))).unionByName(one("release_videos", "title", F.col("release_id")))
    return look_alike_pairs(rows, "id", "text", ["src", "within"]).select("src", "id_a", "id_b")


def descriptions(spark: SparkSession, d: str) -> DataFrame:
    """All video descriptions as ``src, rec_id, text``."""
    one = lambda t: read(spark, d, t).select(F.lit(t).alias("src"), F.col("id").alias("rec_id"), F.col("description").alias("text"))
    return one("release_videos").unionByName(one("video_metadata"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Every mention of personal information in video descriptions."""
    found = find_mentions(descriptions(spark, d), read(spark, d, "artists"), read(spark, d, "given_names"))
    return numbered_mentions(found).select("src", "rec_id", "kind", "mention_no")


def p4_clean(spark: SparkSession, d: str) -> DataFrame:
    """All video descriptions with mentions replaced by typed placeholders."""
    texts = descriptions(spark, d)
    return sanitise(texts, find_mentions(texts, read(spark, d, "artists"), read(spark, d, "given_names")))


def p5_links(spark: SparkSession, d: str) -> DataFrame:
    """Videos paired with tracks and folders with releases, with confidences."""
    cat = catalogue(read(spark, d, "releases"), read(spark, d, "tracks"))
    found = links(cat, video_words(read(spark, d, "video_metadata")), folder_words(read(spark, d, "local_folders")), read(spark, d, "feeds"))
    return found.select(F.col("kind").alias("src"), F.col("entity").alias("entity_id"), F.col("item").alias("item_id"), "confidence")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Videos and folders that belong to a catalogue track or release."""
    return p5_links(spark, d).select("src", "entity_id", "item_id")


def p6_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every two genres or styles that share a release, with counts and odds."""
    return pair_counts(release_baskets(read(spark, d, "releases")), "id", "items").select("item_a", "item_b", "c_ab", "c_a", "c_b", "n", F.round("odds_ratio", 6).alias("odds_ratio"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Genres and styles that share releases much more often than chance."""
    cases = "c_ab >= 5 and 1000 * c_ab >= n and c_ab * n >= 3 * c_a * c_b"
    return p6_pairs(spark, d).where(cases).select("item_a", "item_b")


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    """All documents in containers of each capacity."""
    sized = with_tokens(read(spark, d, "documents").select("doc_id", "text"), "text")
    return pack_texts(sized, "doc_id", "n_tokens", read(spark, d, "pack_sizes"))


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    """How many containers of each capacity are used, and of how many the number is proven the fewest."""
    return packing_report(p8_packed(spark, d))


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    """The mixture of documents by the target shares."""
    targets = read(spark, d, "mix_targets")
    return mix(sized_texts(read(spark, d, "documents"), targets=targets), targets)[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares that the mixture reaches."""
    targets = read(spark, d, "mix_targets")
    return mix(sized_texts(read(spark, d, "documents"), targets=targets), targets)[1]


def p9_mixture_chars(spark: SparkSession, d: str) -> DataFrame:
    """The mixture measured in characters, which SQL can count, too."""
    targets = read(spark, d, "mix_targets")
    return mix(sized_texts(read(spark, d, "documents"), None, targets), targets)[0].withColumn("finish", F.round("finish", 2))


def p9_shares_chars(spark: SparkSession, d: str) -> DataFrame:
    """The shares that the mixture measured in characters reaches."""
    targets = read(spark, d, "mix_targets")
    shares = mix(sized_texts(read(spark, d, "documents"), None, targets), targets)[1]
    return shares.select("source", "source_tokens", "used_tokens", F.round("actual_share", 8).alias("actual_share"), F.round("budget", 2).alias("budget"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold characters from decoding with the wrong encoding."""
    return restore_texts(read(spark, d, "documents").select("doc_id", "text"), "text", keep_text=False).where("garbled_runs > 0").select("doc_id").distinct()


def p10_restored(spark: SparkSession, d: str) -> DataFrame:
    """The garbled documents with their text restored where it can be."""
    return restore_texts(read(spark, d, "documents").select("doc_id", "text"), "text").where("garbled_runs > 0").select("doc_id", "garbled_runs", "restored").distinct()


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p3_found": p3_found,
    "p4_found": p4_found,
    "p4_clean": p4_clean,
    "p5_found": p5_found,
    "p5_links": p5_links,
    "p6_found": p6_found,
    "p6_pairs": p6_pairs,
    "p8_packed": p8_packed,
    "p8_report": p8_report,
    "p9_mixture": p9_mixture,
    "p9_shares": p9_shares,
    "p9_mixture_chars": p9_mixture_chars,
    "p9_shares_chars": p9_shares_chars,
    "p10_found": p10_found,
    "p10_restored": p10_restored,
}
