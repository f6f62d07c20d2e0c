"""Lines that recur across documents, found by levelled sorted runs of line hashes.

A run is a table of (line hash, documents that hold it), each hash once, written to the checkpoint folder in sorted buckets of the
hash, so that runs are merged without another shuffle. Documents come in batches (of one table: by a hash of doc_id, all counted in one scan). A batch's hashes are anti-joined by merge
with the runs of settled lines (those already known to recur: nothing about them needs to be counted any more), and what is left becomes a
run of level 0. FAN runs of a level are compacted into one of the next: their counts are added, and hashes that reach the threshold move to
a settled run. A last compaction of all levels settles the rest, so the result does not depend on batches or on their order.

A line's key is the line without `[\\x20\\x09-\\x0D]` at its ends and with A-Z lower-cased; its hash is the 128-bit MD5 of the key, so two keys are
taken for one with a chance of about n * n / 2**129 among n keys. Documents are rows: equal texts count each, a line twice in a text
counts once. A row is known by 128 bits of hash of its doc_id and text, so repeated rows have equal results. Null texts are one empty
line. Empty keys (shorter than `shortest`) always stay. An empty table gives an empty result; other columns are not read.

All of it is DataFrame operations: no Python runs in tasks, and no rows reach the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweft.llm.common import bucketed

BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Documents that a recurring line is found in, and code points of its key, at least.
LEAST, SHORTEST = 10, 1
#: Batches that a table is dealt to, and runs of a level that are compacted into one.
BATCHES, FAN = 6, 3
#: Parts that the documents of one hash are dealt to where lines meet the recurring ones.
SALTS = 16


def line_key(line: Column) -> Column:
    bare = F.btrim(line, F.lit(BLANK))
    # lower() is the fast way for ASCII alone; it would change other letters too
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_hashes(text: Column, shortest: int) -> Column:
    """For each line of a text its hash, null for a key that is too short."""

    def hashed(line: Column) -> Column:
        key = line_key(line)
        return F.when(F.length(key) >= shortest, F.md5(key))

    return F.transform(lines_of(text), hashed)


class Runs:
    """Levelled sorted runs of line hashes with counts of documents."""

    def __init__(self, spark: SparkSession, least: int = LEAST, shortest: int = SHORTEST, fan: int = FAN):
        self.least, self.shortest, self.fan = least, shortest, fan
        self.parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[DataFrame]] = []
        self.settled: list[DataFrame] = []

    def add(self, documents: DataFrame) -> None:
        """Counts the lines of one batch of documents, and adds them."""
        self.add_counts(counted(documents.select("text", F.lit(0).alias("batch")), self.shortest).drop("batch").repartition(self.parts, "line"))

    def add_counts(self, counts: DataFrame) -> None:
        """Leaves out of a batch's (line, n) what is settled, and adds the rest as a run."""
        for settled in self.settled:
            counts = counts.join(settled.hint("merge"), "line", "left_anti")
        self.put(bucketed(counts, self.parts, "line"), 0)

    def put(self, run: DataFrame, level: int) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == self.fan:
            runs, self.levels[level] = self.levels[level], []
            self.put(self.compacted(runs), level + 1)

    def compacted(self, runs: list[DataFrame]) -> DataFrame:
        """What is left of runs as one; hashes that reach the threshold are settled."""
        merged = runs[0]
        for other in runs[1:]:
            both = merged.join(other.withColumnRenamed("n", "more").hint("merge"), "line", "full")
            merged = both.select("line", (F.coalesce("n", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("n"))
        merged = bucketed(merged, self.parts, "line")
        self.settled.append(merged.where(F.col("n") >= self.least).select("line"))
        return merged.where(F.col("n") < self.least)

    def recurring(self) -> DataFrame | None:
        """(line): the hash of every line found in enough documents; None if nothing was added."""
        rest = [run for level in self.levels for run in level]
        if rest:
            self.levels = [[], [self.compacted(rest)]]
        found = None
        for settled in self.settled:
            found = settled if found is None else found.unionByName(settled)
        return None if found is None else found.distinct()


def counted(documents: DataFrame, shortest: int) -> DataFrame:
    """(line, batch, n): how many documents (text, batch) of each batch hold each line."""
    of = documents.select("batch", F.explode(F.array_distinct(line_hashes(F.col("text"), shortest))).alias("line")).where("line is not null")
    return of.groupBy(F.unhex("line").alias("line"), "batch").agg(F.count("*").alias("n"))


def deduplicated(documents: DataFrame, least: int = LEAST, shortest: int = SHORTEST, most: int = BATCHES, fan: int = FAN) -> DataFrame:
    """doc_id, kept (the text without recurring lines), n_lines (before) and n_dropped of every row."""
    docs = documents.select("doc_id", "text")
    runs = Runs(documents.sparkSession, least, shortest, fan)
    batch = F.pmod(F.xxhash64("doc_id"), F.lit(most)).cast("int").alias("batch")
    counts = bucketed(counted(docs.select("text", batch), shortest).repartition(runs.parts, "line"), runs.parts, "line")
    for k in range(most):
        runs.add_counts(counts.where(F.col("batch") == k).drop("batch"))
    common = runs.recurring().withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))

    known = [F.xxhash64("doc_id", "text").alias("row_a"), F.xxhash64(F.lit(1), "doc_id", "text").alias("row_b")]
    rows = docs.select(*known, "doc_id", "text")
    lines = rows.select("row_a", "row_b", F.posexplode(line_hashes(F.col("text"), shortest)).alias("at", "line")).where("line is not null")
    lines = lines.select("row_a", "row_b", "at", F.unhex("line").alias("line"), F.pmod("row_a", F.lit(SALTS)).cast("int").alias("salt"))
    drops = lines.join(common, ["line", "salt"], "left_semi").groupBy("row_a", "row_b").agg(F.collect_set("at").alias("drops"))
    made = rows.join(drops, ["row_a", "row_b"], "left").withColumn("all_lines", lines_of(F.col("text")))
    n = F.size("all_lines")
    stay = F.array_except(F.sequence(F.lit(0), n - 1), F.col("drops"))
    kept = F.array_join(F.transform(stay, lambda k: F.get("all_lines", k)), "\n")
    return made.select(
        "doc_id", F.when(F.col("drops").isNull(), F.coalesce("text", F.lit(""))).otherwise(kept).alias("kept"), n.cast("long").alias("n_lines"),
        F.coalesce(F.size("drops"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def digests(documents: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256."""
    out = deduplicated(documents)
    return out.select("doc_id", "n_lines", F.greatest("n_dropped", F.lit(0)).cast("long").alias("n_dropped"), F.sha2("kept", 256).alias("kept_sha256"))


def oracle_sql(least: int = LEAST, shortest: int = SHORTEST) -> str:
    blank = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""with d as (select row_number() over () as r, doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
  l as (select r, unnest(ls) as line, generate_subscripts(ls, 1) as nth from d),
  k as (select r, nth, line, translate(trim(line, {blank}), '{UPPER}', '{LOWER}') as key from l),
  common as (select key from k where length(key) >= {shortest} group by key having count(distinct r) >= {least}),
  s as (select r, count(*) filter (key in (select key from common)) as dropped, string_agg(line, chr(10) order by nth) filter (key not in (select key from common)) as kept from k group by r)
  select doc_id, len(ls)::bigint as n_lines, dropped::bigint as n_dropped, sha256(coalesce(kept, '')) as kept_sha256 from d join s using (r)"""
