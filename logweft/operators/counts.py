"""Counts, facets and first rows of records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweft.functions import texts, times


def count_by(rows: DataFrame, key: Column) -> DataFrame:
    """label, n."""
    return rows.groupBy(texts.label(key).alias("label")).agg(F.count("*").alias("n"))


def by_count(counts: DataFrame) -> DataFrame:
    """Most first, equal counts by name."""
    return counts.orderBy(F.desc("n"), *texts.alphabetical(F.col("label")))


def nested_counts(rows: DataFrame, outer: Column, inner: Column) -> DataFrame:
    """outer_key (as it stands), label, n."""
    return rows.groupBy(outer.alias("outer_key"), texts.label(inner).alias("label")).agg(F.count("*").alias("n"))


def item_mix(rows: DataFrame, most: int = 3) -> DataFrame:
    """player, mix: the most used items (as they stand) as 'item ×n, ...', equal counts by name. The window is over a player's distinct items."""
    counts = rows.groupBy(texts.label(F.col("player")).alias("player"), F.coalesce("item", F.lit("")).alias("item")).agg(F.count("*").alias("n"))
    order = Window.partitionBy("player").orderBy(F.desc("n"), *texts.alphabetical(F.col("item")))
    top = counts.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most)
    part = F.concat("item", F.lit(" ×"), "n")
    return top.groupBy("player").agg(F.concat_ws(", ", F.transform(F.array_sort(F.collect_list(F.struct("nth", part.alias("part")))), lambda x: x["part"])).alias("mix"))


def uses_split(rows: DataFrame, items: DataFrame, strong: int = 100) -> DataFrame:
    """player (as it stands), uses: 'strong' or 'strong+other'."""
    known = rows.join(items.select(F.col("name").alias("item"), "watt"), "item", "left")
    high = F.count_if(F.coalesce(F.col("watt"), F.lit(0)) >= strong)
    other = F.count("*") - high
    uses = F.when(other == 0, high.cast("string")).otherwise(F.concat(high.cast("string"), F.lit("+"), other.cast("string")))
    return known.groupBy("player").agg(uses.alias("uses"))


def first_rows(rows: DataFrame, key: Sequence[str], order: str = "ord") -> DataFrame:
    """The first row of each key; a limit of 1 within each task's rows comes before the shuffle."""
    nth = Window.partitionBy(*key).orderBy(order)
    return rows.withColumn("nth__", F.row_number().over(nth)).where("nth__ = 1").drop("nth__")


def facet_items(rows: DataFrame, player: str | None) -> DataFrame:
    """Every item there is, with its rows under the player filter alone."""
    hit = F.lit(True) if player is None else F.col("player") == player
    return rows.groupBy("item").agg(F.count_if(hit).alias("n"))


def facet_players(rows: DataFrame, items: Sequence[str]) -> DataFrame:
    """Every player there is, with rows under the item filter alone (none listed: all), zero kept."""
    hit = F.lit(True) if not items else F.col("item").isin(*items)
    return rows.groupBy(texts.label(F.col("player")).alias("player")).agg(F.count_if(hit).alias("n"))


def header(segs: DataFrame, seen: Column) -> DataFrame:
    """Of what is seen: rows, all rows, players, overlapping uses, first and last time in order pos. segs are segments of rows that have pos."""
    marked = segs.withColumn("seen__", F.coalesce(seen, F.lit(False)))
    when = lambda c: F.when(F.col("seen__"), c)
    return marked.agg(
        F.count_if("seen__").alias("shown"), F.count("*").alias("all_rows"), F.count_distinct(when(F.col("timeline"))).alias("players"),
        F.count_if(F.col("seen__") & (F.col("lost_s") > 0) & (F.col("weight") > 0)).alias("overlaps"),
        F.min_by(times.shown(F.col("timestamp")), when(F.col("pos"))).alias("first_time"), F.max_by(times.shown(F.col("timestamp")), when(F.col("pos"))).alias("last_time"),
    )


def suggestions(rows: DataFrame, column: str) -> DataFrame:
    """Distinct non-empty values, for completion; sort them where they are shown."""
    return rows.where(texts.trimmed(F.col(column)) != "").select(F.col(column).alias("value")).distinct()
