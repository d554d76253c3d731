"""What changed between full snapshots of a table (problem 7).

Every key is windowed by snapshot index. Hashes of the compared columns are lagged to reveal changes; a gap in the
indexes at which a key is present reveals a removal at the gap's start and an addition at its end.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def instant(text: Column) -> Column:
    """Microseconds since 1970 of an ISO-8601 text; a text without an offset is in UTC; null where it can't be read."""
    t = F.trim(text)
    has_zone = t.rlike(r"(?i)(z|[+-]\d{2}(:?\d{2})?|utc|gmt)$") & t.rlike(r"[T ]\d{1,2}:")
    zoned = F.regexp_replace(F.when(has_zone, t).when(t.rlike(r"[T ]\d{1,2}:"), F.concat(t, F.lit("Z"))).otherwise(F.concat(t, F.lit("T00:00:00Z"))), r"([+-]\d{2})(\d{2})$", "$1:$2")
    return F.unix_micros(F.try_to_timestamp(F.regexp_replace(zoned, r" (?=[+-]|Z)", "")))


def snapshot_changes(
    rows: DataFrame,
    key: str,
    index: str,
    version: str,
    compared: Sequence[Column],
    present: Column | None = None,
) -> DataFrame:
    """Rows ``(<index>, <key>, change)`` with change ``added``, ``removed`` or ``changed``.

    ``rows`` holds all snapshots. Of the rows with equal key and index the one with the highest ``version`` counts (of
    equal versions the one whose values sort last), whenever it was delivered. ``present`` says whether such a row
    counts as present. A snapshot is compared with the one before it among those that occur; the first has no changes.

    Rows whose key or index is null are no records and give no row. A null version sorts before any other. Nulls among the compared values are
    equal to each other. An empty table gives no rows; columns beyond those named are ignored.

    Plan: one partial aggregation by (key, index) before the first shuffle, so repeated rows of a hot key never meet
    in one task; a second shuffle by key for the window, where a key has at most one row a snapshot. The only
    broadcast is the list of snapshot indexes, one row a snapshot.
    """
    values = F.struct(*[c.alias(f"v{i}") for i, c in enumerate(compared)])
    states = (
        rows.where(F.col(key).isNotNull() & F.col(index).isNotNull())
        .select(
            F.col(key).alias("__key"),
            F.col(index).alias("__at"),
            F.struct(
                F.col(version).alias("version"),
                F.coalesce(present if present is not None else F.lit(True), F.lit(False)).alias("here"),
                F.xxhash64(F.to_json(values)).alias("hash"),
                F.md5(F.to_json(values)).alias("exact"),
            ).alias("state"),
        )
        .groupBy("__at", "__key")
        .agg(F.max("state").alias("state"))
    )
    # the snapshots that occur, numbered: bounded by the number of deliveries, not by the size of the table
    order = W.orderBy("__at")
    known = rows.where(F.col(index).isNotNull()).select(F.col(index).alias("__at")).distinct()
    numbered = known.select("__at", F.row_number().over(order).alias("n"), F.lead("__at").over(order).alias("next_at"))
    by_key = W.partitionBy("__key").orderBy("n")
    seen = (
        states.where("state.here")
        .join(F.broadcast(numbered), "__at")
        .select("__key", "__at", "n", "next_at", F.col("state.hash").alias("hash"), F.col("state.exact").alias("exact"))
        .withColumns(
            {
                "before": F.lag("n").over(by_key),
                "before_hash": F.lag(F.struct("hash", "exact")).over(by_key),
                "after": F.lead("n").over(by_key),
            }
        )
    )
    events = F.array(
        F.when(
            F.col("n") > 1,
            F.when(F.col("before").isNull() | (F.col("before") < F.col("n") - 1), F.struct(F.col("__at").alias("at"), F.lit("added").alias("change"))).when(
                F.struct("hash", "exact") != F.col("before_hash"), F.struct(F.col("__at").alias("at"), F.lit("changed").alias("change"))
            ),
        ),
        F.when(
            F.col("next_at").isNotNull() & (F.col("after").isNull() | (F.col("after") > F.col("n") + 1)),
            F.struct(F.col("next_at").alias("at"), F.lit("removed").alias("change")),
        ),
    )
    return seen.select("__key", F.explode(F.array_compact(events)).alias("e")).select(
        F.col("e.at").alias(index), F.col("__key").alias(key), F.col("e.change").alias("change")
    )


def collection_changes(snapshots: DataFrame) -> DataFrame:
    """Rows ``(snapshot_no, release_id, change)`` of a table in the form of ``collection_snapshots``."""
    stated = instant(F.col("date_added"))
    changes = snapshot_changes(
        snapshots,
        key="id",
        index="snapshot_no",
        version="delivered_at",
        compared=[
            F.trim(F.col("title")),
            F.col("year"),
            F.sort_array(F.array_distinct(F.col("genres"))),
            F.coalesce(stated.cast("string"), F.col("date_added")),
        ],
        present=F.col("removed_from_discogs_at").isNull() | (F.col("removed_from_discogs_at") > F.col("snapshot_at")),
    )
    return changes.select("snapshot_no", F.col("id").alias("release_id"), "change")
