"""Ordering times of day across midnight, and how long each timed use really lasted.

A log has no dates. Its rows, by time, form a circle; the first of the widest gaps is where the log begins and ends, and times
before it belong to the next day. All windows here run over the distinct seconds of a key, at most 86,400 of
them however many rows it has; rows are joined to their second, and those of one second are put in order in parts, so no task sorts a key's rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweft.functions import texts, times

UNIT = 600
CUTOFF, SCALED = "cutoff", "scaled"


def start_second(seconds: DataFrame, key: list[str]) -> DataFrame:
    """seconds (key, sod, unique) with first_sod, the second after the first widest gap."""
    family = Window.partitionBy(*key) if key else Window.partitionBy(F.lit(0))
    after = F.lead("sod").over(family.orderBy("sod"))
    least = F.min("sod").over(family)
    gaps = seconds.withColumn("after", F.coalesce(after, least)).withColumn("gap", F.coalesce(after, least + times.DAY) - F.col("sod"))
    widest = F.max(F.struct("gap", -F.col("sod"), "after")).over(family)
    return gaps.withColumn("first_sod", widest["after"]).drop("after", "gap")


#: Bits of ord that a part of a second holds: at most so many rows of a second are put in order by one task.
PART_BITS = 16


def ordered(records: DataFrame, key: list[str]) -> DataFrame:
    """records with sod, pos (from 0, in the order of their key) and day_offset (0 or 86400). Null keys are a key like others.

    A row's place is the rows of earlier seconds, those of earlier parts of its second (by ord), and its rank in its part.
    """
    rows = records.withColumn("sod", times.seconds_of_day(F.col("timestamp"))).withColumn("part__", F.shiftright("ord", PART_BITS))
    parts = rows.groupBy(*key, "sod", "part__").agg(F.count("*").alias("n"))
    own = lambda df, *more: [df[c].eqNullSafe(F.col(f"{c}__")) for c in key] + [df[c] == F.col(f"{c}__of") for c in more]
    renamed = lambda df, *more: df.withColumnsRenamed({c: f"{c}__" for c in key} | {c: f"{c}__of" for c in more})
    seconds = start_second(parts.groupBy(*key, "sod").agg(F.sum("n").alias("n")), key)
    seconds = seconds.withColumn("day_offset", F.when(F.col("sod") < F.col("first_sod"), times.DAY).otherwise(0))
    family = (Window.partitionBy(*key) if key else Window.partitionBy(F.lit(0))).orderBy("day_offset", "sod").rowsBetween(Window.unboundedPreceding, -1)
    seconds = seconds.withColumn("earlier", F.coalesce(F.sum("n").over(family), F.lit(0))).drop("n", "first_sod")
    in_second = Window.partitionBy(*key, "sod").orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("n").over(in_second), F.lit(0))).drop("n")
    offsets = parts.join(renamed(seconds, "sod"), own(parts, "sod")).select(*key, "sod", "part__", "day_offset", (F.col("earlier") + F.col("before")).alias("earlier"))
    ranked_rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy(*key, "sod", "part__").orderBy("ord")))
    both = ranked_rows.join(renamed(offsets, "sod", "part__"), own(ranked_rows, "sod", "part__"))
    return both.select(*[ranked_rows[c] for c in records.columns], ranked_rows["sod"], "day_offset", (F.col("earlier") + F.col("nth") - 1).alias("pos"))


def weight(watt: Column, mode: str) -> Column:
    """How a second of an item counts: all or nothing at a strength of 100, or in proportion above 20. Unknown items: 0."""
    w = F.when(watt >= 100, 1.0).otherwise(0.0) if mode == CUTOFF else F.greatest(F.lit(0.0), (watt - 20) / 80.0)
    return F.coalesce(w, F.lit(0.0))


def segments(records: DataFrame, items: DataFrame, mode: str = CUTOFF, by_player: bool = True) -> DataFrame:
    """A row for each record: start_s, end_s, active_s, full_s, lost_s, weight, watt and is_attack.

    An attack item (strength and duration above 0) ends the attack item before it on the same timeline; others neither end
    nor are ended. Of several attack records in a second all but the last in order last 0 seconds.
    """
    rows = records.withColumn("sod", times.seconds_of_day(F.col("timestamp"))).withColumn("timeline", texts.label(F.col("player")) if by_player else F.lit(""))
    rows = rows.join(items.select(F.col("name").alias("item"), "duration", "watt"), "item", "left")
    rows = rows.withColumn("full_s", F.coalesce("duration", F.lit(0))).withColumn("watt", F.coalesce("watt", F.lit(0)))
    rows = rows.withColumn("is_attack", (F.col("watt") > 0) & (F.col("full_s") > 0))
    seconds = rows.groupBy("timeline", "sod").agg(F.max(F.when(F.col("is_attack"), F.col("ord"))).alias("last_attack"))
    seconds = start_second(seconds, ["timeline"])
    seconds = seconds.withColumn("start_s", F.col("sod") + F.when(F.col("sod") < F.col("first_sod"), times.DAY).otherwise(0))
    # from the last second back, so that the frame only grows: Spark computes frames that shrink anew for each row
    later = Window.partitionBy("timeline").orderBy(F.desc("start_s")).rowsBetween(Window.unboundedPreceding, -1)
    seconds = seconds.withColumn("next_attack", F.min(F.when(F.col("last_attack").isNotNull(), F.col("start_s"))).over(later)).drop("first_sod")
    both = rows.join(seconds, ["timeline", "sod"])
    ended = F.when(F.col("ord") < F.col("last_attack"), F.col("start_s")).otherwise(F.col("next_attack"))
    active = F.when(F.col("is_attack") & ended.isNotNull(), F.greatest(F.lit(0), F.least(F.col("full_s"), ended - F.col("start_s")))).otherwise(F.col("full_s"))
    return (
        both.withColumn("active_s", active).withColumn("end_s", F.col("start_s") + F.col("active_s")).withColumn("lost_s", F.greatest(F.lit(0), F.col("full_s") - F.col("active_s")))
        .withColumn("weight", weight(F.col("watt"), mode)).drop("duration", "sod", "last_attack", "next_attack")
    )


def totals() -> list[Column]:
    """Aggregates of segments. Sums of seconds by weight are exact (weights are multiples of a quarter); one division ends each."""
    effective = F.sum(F.col("active_s") * F.col("weight")) / UNIT
    logged = F.sum(F.col("full_s") * F.col("weight")) / UNIT
    zero = F.lit(0.0)
    return [
        F.count("*").alias("logs"), F.coalesce(effective, zero).alias("effective"), F.coalesce(logged, zero).alias("logged"),
        F.greatest(zero, F.coalesce(logged - effective, zero)).alias("overlap_loss"),
        F.coalesce(F.sum(F.when(F.col("weight") > 0, F.col("active_s"))), F.lit(0)).alias("active_s"),
        F.count_if((F.col("weight") > 0) & (F.col("full_s") > 0)).alias("weighted_logs"),
        F.count_if(~((F.col("weight") > 0) & (F.col("full_s") > 0))).alias("unweighted_logs"),
    ]


def by_player(segs: DataFrame, seen: Column | None = None) -> DataFrame:
    """totals() for each player. `seen` filters what is counted; hidden records have already ended others."""
    rows = segs if seen is None else segs.where(seen)
    return rows.groupBy(F.col("timeline").alias("player")).agg(*totals())


def overall(segs: DataFrame, seen: Column | None = None) -> DataFrame:
    return (segs if seen is None else segs.where(seen)).agg(*totals())


def ranked(players: DataFrame) -> DataFrame:
    """Players by effect, then logs, then name."""
    return players.orderBy(F.desc("effective"), F.desc("logs"), *texts.alphabetical(F.col("player")))
