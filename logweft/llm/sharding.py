"""A uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Rows are first dealt to partitions by a hash of all that is looked at and of the row's place in the scan, so that one row repeated very
often is dealt out too (the place is frozen in the checkpoint that follows). How many rows of each partition go to each shard is drawn
exactly: the matrix of a uniform shuffle has multivariate hypergeometric rows, given what the shards still hold. Every partition
is permuted by itself (a seeded hash order) and cut into runs of the drawn lengths; runs are exchanged to their shards,
and each shard is permuted again, by rank within seeded buckets plus the rows in the buckets before.

Law `rows`: shard sizes are N // shards, one more for the first N % shards. The matrix has PARTITIONS rows, one
for about ROWS documents within bounds, and is the only thing on the driver (probabilities there are doubles, good to about 1e-16 times the logarithms of
factorials: one part in a thousand where a shard holds 1e11 rows); plain integers are drawn there, and all
rows are moved by DataFrame operations.

Null doc_ids are one value; null texts have 0 bytes. Repeated rows are rows like any other, and as all columns that
are looked at are equal, it makes no difference which is which. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logweft.llm.common import cut

SHARDS, SEED = 8, 29
#: Documents for a partition or bucket, and bounds of their number.
ROWS, FEWEST, MOST = 20_000, 256, 65_536


def hypergeometric(rng: random.Random, good: int, bad: int, drawn: int) -> int:
    """How many of `good` are among `drawn` from good + bad: by inversion outward from the mode."""
    low, high = max(0, drawn - bad), min(good, drawn)
    if low == high:
        return low
    fact = lambda n: math.lgamma(n + 1)
    mode = min(high, max(low, (drawn + 1) * (good + 1) // (good + bad + 2)))
    at_mode = math.exp(
        fact(good) - fact(mode) - fact(good - mode) + fact(bad) - fact(drawn - mode) - fact(bad - drawn + mode)
        - fact(good + bad) + fact(drawn) + fact(good + bad - drawn)
    )
    u = rng.random() - at_mode
    up = down = at_mode
    a = b = mode
    while u > 0 and (a > low or b < high):
        if b < high:
            up *= (good - b) * (drawn - b) / ((b + 1) * (bad - drawn + b + 1))
            b += 1
            u -= up
            if u <= 0:
                return b
        if a > low:
            down *= a * (bad - drawn + a) / ((good - a + 1) * (drawn - a + 1))
            a -= 1
            u -= down
            if u <= 0:
                return a
    return mode


def matrix(sizes: list[int], shards: int, seed: int) -> list[list[int]]:
    """For each partition of so many rows, how many go to each shard."""
    rng = random.Random(seed)
    total = sum(sizes)
    held = [total // shards + (s < total % shards) for s in range(shards)]
    out = []
    for size in sizes:
        row, left, rest = [], size, sum(held)
        for s in range(shards):
            rest -= held[s]
            got = hypergeometric(rng, held[s], rest, left)
            row.append(got)
            left -= got
            held[s] -= got
        out.append(row)
    return out


def shards(documents: DataFrame, n: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, size (bytes and 1), text_crc32, law, shard, slot (0 to the shard's size less 1) and grown_shard (null)."""
    spark = documents.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.select(F.monotonically_increasing_id().alias("place"), "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    parts = min(MOST, max(FEWEST, math.ceil(documents.count() / ROWS)))
    hashed = lambda k: F.xxhash64(F.lit(seed * 1000 + k), "doc_id", "size", "text_crc32", "place")
    rows = rows.withColumn("part", F.pmod(hashed(1), F.lit(parts)).cast("int"))
    # reliable and narrow: the counts that are drawn from and the rows that are cut must be the same whatever is lost
    rows = cut(rows)
    sizes = dict(map(tuple, rows.groupBy("part").count().collect()))
    drawn = matrix([sizes.get(p, 0) for p in range(parts)], n, seed)
    ends = ";".join(",".join(str(sum(r[: s + 1])) for s in range(n)) for r in drawn)
    table = spark.range(1).select(F.posexplode(F.split(F.lit(ends), ";")).alias("part", "runs")).select("part", F.split("runs", ",").cast("array<long>").alias("runs"))

    within = Window.partitionBy("part").orderBy(hashed(2), "place")
    placed = rows.withColumn("at", F.row_number().over(within)).join(table, "part")
    placed = placed.select("place", "doc_id", "size", "text_crc32", F.size(F.filter("runs", lambda end: end < F.col("at"))).alias("shard"))

    placed = placed.withColumn("bucket", F.pmod(hashed(3), F.lit(max(1, parts // n))).cast("int"))
    order = Window.partitionBy("shard", "bucket").orderBy(hashed(4), "place")
    ranked = placed.withColumn("rank", F.row_number().over(order))
    counts = placed.groupBy("shard", "bucket").count()
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    return ranked.join(offsets, ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("offset") + F.col("rank") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
