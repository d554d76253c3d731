"""Mixing sources to target weights (problem 9).

Weighted fair queueing: the texts of each source, shuffled, get a virtual finish time, the source's tokens so far divided by its
target weight. In the order of finish times all sources keep their shares, so the queue is sorted globally by it
and truncated at the total budget. A source whose texts are used up as often as they may be ends there; the others go on in proportion.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from platterkit.llm.tokens import TOKENIZER, with_tokens
from platterkit.session import stash

#: Hexadecimal digits that divide a source's shuffled order into parts for its running total; a part is one window group.
PART_DIGITS = 3
#: Total budget as a multiple of the tokens of all sources that have a target.
SIZE = 1.0


def sized_texts(documents: DataFrame, tokenizer: str | None = TOKENIZER, targets: DataFrame | None = None) -> DataFrame:
    """Rows ``(doc_id, source, n_tokens)``, one for each different text that has tokens; without a tokenizer characters are counted.

    A text that occurs under several ids is used under the least of them, so no text gets in more often than allowed; with ``targets``
    under the least whose source has a target, as sources without one take no part. Null and empty texts and rows without id or source are left out.
    """
    if targets is not None:
        aimed = targets.where("target_share > 0 and source is not null").select("source").distinct()
        documents = documents.join(F.broadcast(aimed), "source", "left_semi")  # as many rows as targets
    rows = documents.where("doc_id is not null and source is not null and text <> ''").select("doc_id", "source", "text", F.md5("text").alias("h"))
    counted = with_tokens(rows, "text", tokenizer) if tokenizer else rows.select("doc_id", "source", "h", F.length("text").cast("long").alias("n_tokens"))
    sized = counted.groupBy("h").agg(F.min(F.struct("doc_id", "source", "n_tokens")).alias("v"))
    return sized.select("v.doc_id", "v.source", "v.n_tokens").where("n_tokens > 0")


def quotas(sized: DataFrame, targets: DataFrame, budget: int | None = None, size: float = SIZE, strict: bool = False) -> DataFrame:
    """Rows ``(source, target_share, max_repeats, source_tokens, weight, cap, budget, level, quota)``, one for each source with target and texts.

    ``weight`` is the target share, scaled so that the weights of the sources that have texts add up to 1; ``cap`` is what max_repeats uses of every text give. The
    total budget is ``budget`` tokens or, by default, ``size`` times the tokens of these sources. ``level`` is the virtual time at which the budget is
    used up, when each source has given weight * level or, if that is more, its cap; where all caps are below the budget, it is the time at which the last
    source ends. ``quota`` is what each source has given by then. In ``strict`` mode the level is at most the time at which the first source ends, so that all shares are held exactly.

    Plan: one aggregation of the sizes; all after it has as many rows as there are targets.
    """
    goal = (
        targets.where("target_share > 0 and source is not null")
        .groupBy("source")
        .agg(F.max("target_share").alias("target_share"), F.greatest(F.max("max_repeats"), F.lit(1)).alias("max_repeats"))
    )
    totals = sized.groupBy("source").agg(F.sum("n_tokens").alias("source_tokens"))
    every = W.partitionBy(F.lit(0))  # as many rows as targets
    plan = goal.join(totals, "source").withColumns(
        {"weight": F.col("target_share") / F.sum("target_share").over(every), "cap": F.col("max_repeats") * F.col("source_tokens"), "budget": F.lit(float(budget)) if budget is not None else F.sum("source_tokens").over(every) * F.lit(size)}
    )
    ended = F.col("cap") / F.col("weight")
    # sources that end before this one have given their caps, the others their weights' share
    before = W.partitionBy(F.lit(0)).orderBy("ended", "source").rowsBetween(W.unboundedPreceding, -1)
    after = W.partitionBy(F.lit(0)).orderBy("ended", "source").rowsBetween(0, W.unboundedFollowing)
    plan = plan.withColumn("ended", ended).withColumns({"given": F.coalesce(F.sum("cap").over(before), F.lit(0)), "going": F.sum("weight").over(after)})
    reached = F.when(F.col("given") + F.col("ended") * F.col("going") >= F.col("budget"), (F.col("budget") - F.col("given")) / F.col("going"))
    # the first source before whose end the budget is used up tells the level
    level = F.coalesce(F.min(F.when(reached.isNotNull(), F.struct("ended", reached.alias("level")))).over(every)["level"], F.max("ended").over(every))
    plan = plan.withColumn("level", F.least(level, F.min("ended").over(every)) if strict else level)
    return plan.withColumn("quota", F.least(F.col("weight") * F.col("level"), F.col("cap").cast("double"))).drop("ended", "given", "going")


def mix(sized: DataFrame, targets: DataFrame, seed: int = 7, budget: int | None = None, size: float = SIZE, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """The mixture, rows ``(source, doc_id, use_no, n_tokens, finish)``, and the shares reached.

    ``targets`` has ``source, target_share, max_repeats``; budget, size and strict are those of :func:`quotas`. Texts of sources without a target
    take no part; targets whose source has no text are reported with share 0 and the others are scaled up. Null or
    non-positive shares count as no target, repeats of less than one as one. Rows without id, source or tokens are left out, other columns ignored.

    The shares are rows ``(source, target_share, max_repeats, source_tokens, used_tokens, actual_share, shortfall_tokens, budget)``; the shortfall is what the
    source's target share of the budget is more than its tokens used, 0 if it isn't.

    Plan: a source may hold a third of all texts, so its running total isn't one window: the shuffled order, that of a digest of seed and id, is divided
    by its first digits into parts, whose totals (sources x parts rows at most) give the offsets of the windows within the parts.
    """
    sized = stash(sized.select("doc_id", "source", "n_tokens").where("doc_id is not null and source is not null and n_tokens > 0"))  # used several times
    u = F.md5(F.concat_ws(":", F.lit(str(seed)), "doc_id"))
    plan = quotas(sized, targets, budget, size, strict)
    weighted = plan.select("source", "max_repeats", "source_tokens", "weight", "level")
    placed = sized.join(F.broadcast(weighted), "source").withColumns({"u": u, "part": F.left(u, F.lit(PART_DIGITS))})  # as many rows as targets
    part_totals = placed.groupBy("source", "part").agg(F.sum("n_tokens").alias("t"))
    before = F.coalesce(F.sum("t").over(W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = part_totals.select("source", "part", before.alias("before"))  # at most sources x 16 ** PART_DIGITS rows
    within = F.sum("n_tokens").over(W.partitionBy("source", "part").orderBy("u", "doc_id").rowsBetween(W.unboundedPreceding, 0))
    run = placed.withColumn("own", within).join(offsets, ["source", "part"]).withColumn("place", F.col("before") + F.col("own"))
    # a text's uses end at place, place + source_tokens, ...: those up to the level are taken
    last = F.floor((F.col("level") * F.col("weight") * (1 + 1e-12) - F.col("place")) / F.col("source_tokens"))
    uses = F.least(last, F.col("max_repeats") - 1)
    queue = (
        run.where(uses >= 0)
        .select("source", "doc_id", "n_tokens", "source_tokens", "weight", "place", F.explode(F.sequence(F.lit(0).cast("long"), uses.cast("long"))).alias("r"))
        .select("source", "doc_id", (F.col("r") + 1).cast("int").alias("use_no"), "n_tokens", ((F.col("place") + F.col("r") * F.col("source_tokens")) / F.col("weight")).alias("finish"))
    )
    used = run.where(uses >= 0).groupBy("source").agg(F.sum(F.col("n_tokens") * (uses + 1)).alias("used_tokens"))
    goal = targets.where("target_share > 0 and source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.greatest(F.max("max_repeats"), F.lit(1)).alias("max_repeats"))
    all_ = W.partitionBy(F.lit(0))  # as many rows as targets
    shares = goal.join(plan.select("source", "source_tokens", "budget"), "source", "left").join(used, "source", "left").fillna(0, ["source_tokens", "used_tokens"])
    shares = shares.withColumns({"actual_share": F.coalesce(F.try_divide("used_tokens", F.sum("used_tokens").over(all_)), F.lit(0.0)), "budget": F.max("budget").over(all_)})
    short = F.greatest(F.lit(0.0), F.coalesce(F.col("target_share") * F.col("budget"), F.lit(0.0)) - F.col("used_tokens"))
    return queue.orderBy("finish", "source", "doc_id", "use_no"), shares.select("source", "target_share", "max_repeats", "source_tokens", "used_tokens", "actual_share", F.round(short, 3).alias("shortfall_tokens"), "budget")
