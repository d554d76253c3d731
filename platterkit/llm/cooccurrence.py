"""Items that appear together (problem 6).

Pairs of items are packed into 64-bit codes and counted by an external sort: every task turns its codes into sorted,
run-length counted runs; the shuffle spills the runs, the reducing side merges them in code order and adds up equal
neighbours. The counts give odds ratios with a continuity correction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Codes sorted at once in a task (32 MB); the result doesn't depend on it.
RUN_CODES = 4_000_000
#: Hash buckets in which item numbers are given out; the offsets of all buckets are one small table.
ID_BUCKETS = 4096
#: Below so many distinct items their numbers are broadcast; above they are joined by shuffle. The result is the same.
BROADCAST_ITEMS = 500_000


def _count_sorted(codes: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A sorted run with counts: distinct codes in order, and how often each came."""
    order = np.argsort(codes, kind="stable") if counts is not None else None
    codes = codes[order] if order is not None else np.sort(codes)
    if not len(codes):
        return codes, np.zeros(0, np.int64)
    starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
    return codes[starts], np.add.reduceat(counts[order], starts) if counts is not None else np.diff(np.r_[starts, len(codes)]).astype(np.int64)


def _pair_codes(values: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """Packed pairs of each list (sorted distinct ints), lists of equal length at once, in blocks of bounded size."""
    lengths = np.diff(offsets)
    for k in np.unique(lengths[lengths > 1]):
        starts = offsets[:-1][lengths == k]
        i, j = (np.triu_indices(k, 1) if k <= 2000 else (None, None))
        if i is None:  # a very long list: row by row of its pairs
            for s in starts:
                own = values[s : s + k].astype(np.int64)
                for x in range(k - 1):
                    yield (own[x] << 32) | own[x + 1 :]
            continue
        step = max(1, RUN_CODES // len(i))
        for at in range(0, len(starts), step):
            lists = values[starts[at : at + step, None] + np.arange(k)].astype(np.int64)
            yield ((lists[:, i] << 32) | lists[:, j]).ravel()


_RUN = pa.schema([("code", pa.int64()), ("n", pa.int64())])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted runs of counted pair codes of a partition; equal codes of different runs are merged while they fit."""
    out = lambda c, n: pa.RecordBatch.from_arrays([pa.array(c), pa.array(n)], schema=_RUN)
    codes, counts, buffer, held = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0
    for batch in batches:
        lists = batch.column(0)
        values = lists.flatten().to_numpy(zero_copy_only=False)
        lengths = np.asarray(lists.value_lengths().fill_null(0))
        for block in _pair_codes(values, np.r_[0, np.cumsum(lengths)]):
            buffer.append(block)
            held += len(block)
            if held >= RUN_CODES:
                c, n = _count_sorted(np.concatenate(buffer))
                codes, counts = _count_sorted(np.r_[codes, c], np.r_[counts, n])
                buffer, held = [], 0
                if len(codes) >= RUN_CODES:
                    yield out(codes, counts)
                    codes, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if buffer:
        c, n = _count_sorted(np.concatenate(buffer))
        codes, counts = _count_sorted(np.r_[codes, c], np.r_[counts, n])
    if len(codes):
        yield out(codes, counts)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up neighbours with equal codes of a partition that comes in code order."""
    code, total = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        codes, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
        heads, sums = codes[starts], np.add.reduceat(n, starts)
        if code is not None and heads[0] == code:
            sums[0] += total
        elif code is not None:
            heads, sums = np.r_[code, heads], np.r_[total, sums]
        code, total = heads[-1], sums[-1]
        if len(heads) > 1:
            yield pa.RecordBatch.from_arrays([pa.array(heads[:-1]), pa.array(sums[:-1])], schema=_RUN)
    if code is not None:
        yield pa.RecordBatch.from_arrays([pa.array([code], pa.int64()), pa.array([total], pa.int64())], schema=_RUN)


def numbered_items(counts: DataFrame) -> DataFrame:
    """``counts`` with ``code``, a dense number from 0 for each row's distinct ``item``; deterministic and made in parallel."""
    bucketed = counts.withColumn("bucket", F.pmod(F.xxhash64("item"), F.lit(ID_BUCKETS)).cast("int"))
    sizes = bucketed.groupBy("bucket").agg(F.count("*").alias("size"))
    before = F.coalesce(F.sum("size").over(W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("bucket", before.alias("before"))  # at most ID_BUCKETS rows
    own = F.row_number().over(W.partitionBy("bucket").orderBy("item")) - 1
    return bucketed.withColumn("own", own).join(F.broadcast(offsets), "bucket").select("item", "c", (F.col("own") + F.col("before")).cast("int").alias("code"))


def pair_counts(baskets: DataFrame, key: str, items: str) -> DataFrame:
    """Rows ``(item_a, item_b, c_ab, c_a, c_b, n, lift, odds_ratio, log_odds)`` for items that share a basket, item_a < item_b by code point.

    ``baskets`` has one row a basket with a key of its own and an array of items; nulls are ignored, an item counts once a basket. ``n`` is the number of
    baskets, also of those without items; ``odds_ratio`` has 0.5 added to each of the four cells. A basket of fewer than
    two items gives no pair; an empty table gives no row. Other columns are ignored.

    Plan: a pair that is in a third of all baskets leaves each task as one counted code, so no key is hot in the
    shuffle. The sort is Spark's external one and spills; no group is ever gathered.
    """
    own = baskets.select(F.col(key).alias("basket"), F.array_distinct(F.array_compact(F.col(items))).alias("items"))
    exploded = own.select(F.explode("items").alias("item"))
    vocabulary = numbered_items(exploded.groupBy("item").agg(F.count("*").alias("c")))
    codes = vocabulary.select("item", "code")
    if codes.limit(BROADCAST_ITEMS + 1).count() <= BROADCAST_ITEMS:
        codes = F.broadcast(codes)
    lists = (
        own.where(F.size("items") > 1).select("basket", F.explode("items").alias("item")).join(codes, "item").groupBy("basket").agg(F.sort_array(F.collect_list("code")).alias("codes")).select("codes")
    )
    runs = lists.mapInArrow(_runs, "code long, n long")
    pairs = runs.repartition("code").sortWithinPartitions("code").mapInArrow(_merge, "code long, n long")
    a = vocabulary.select(F.col("code").alias("a"), F.col("item").alias("x"), F.col("c").alias("c_x"))
    b = vocabulary.select(F.col("code").alias("b"), F.col("item").alias("y"), F.col("c").alias("c_y"))
    total = baskets.agg(F.count("*").alias("n"))
    decoded = (
        pairs.select(F.shiftright("code", 32).cast("int").alias("a"), F.col("code").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("b"), F.col("n").alias("c_ab"))
        .join(a, "a").join(b, "b").crossJoin(F.broadcast(total))  # one number
    )
    first = F.col("x") < F.col("y")
    pick = lambda p, q: F.when(first, F.col(p)).otherwise(F.col(q))
    rows = decoded.select(pick("x", "y").alias("item_a"), pick("y", "x").alias("item_b"), "c_ab", pick("c_x", "c_y").alias("c_a"), pick("c_y", "c_x").alias("c_b"), "n")
    return with_odds(rows)


def with_odds(rows: DataFrame) -> DataFrame:
    """Rows with counts ``c_ab, c_a, c_b, n``, and ``lift``, ``odds_ratio`` and ``log_odds`` beside them."""
    half = F.lit(0.5)
    odds: Column = ((F.col("c_ab") + half) * (F.col("n") - F.col("c_a") - F.col("c_b") + F.col("c_ab") + half)) / ((F.col("c_a") - F.col("c_ab") + half) * (F.col("c_b") - F.col("c_ab") + half))
    return rows.withColumns({"lift": F.col("c_ab") * F.col("n") / (F.col("c_a").cast("double") * F.col("c_b")), "odds_ratio": odds, "log_odds": F.log(odds)})


def release_baskets(releases: DataFrame) -> DataFrame:
    """One row ``(id, items)`` a release id: ``g:`` genres and ``s:`` styles of its row with the highest last_synced_at.

    Items are lower-cased and trimmed; null and blank ones are ignored. Of rows with equal last_synced_at the one whose values
    sort last counts. Rows with a null id are no release.
    """
    valid = releases.where("id is not null").groupBy("id").agg(F.max(F.struct("last_synced_at", "genres", "styles")).alias("v"))
    tagged = lambda c, tag: F.transform(F.filter(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: F.trim(x) != ""), lambda x: F.concat(F.lit(tag), F.lower(F.trim(x))))
    return valid.select("id", F.array_distinct(F.concat(tagged("v.genres", "g:"), tagged("v.styles", "s:"))).alias("items"))
