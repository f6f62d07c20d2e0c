"""Mixing sources to target weights by hierarchical budgets over a domain, language, source tree.

A budget of tokens goes down the tree. At each node it is shared among the children by weight; a child that can't use its
share (a leaf can give its tokens MAX_EPOCHS times) leaves the shortage to its siblings in proportion to their
weights, and only what the whole family can't use has, one level up, gone to the node's own siblings, since a node's
capacity is the sum of its leaves'. Shares are whole tokens, rounded down.

A leaf's budget is a number of whole epochs and a remainder. Epoch e orders the leaf's documents by
md5(seed:e:doc_id); the remainder takes the prefix of the next epoch: each document before which fewer tokens stand
than the remainder. Documents are whole, so a leaf's last document may go over its budget.

The order is never sorted in one task: tokens are summed in buckets of the digest's next STEP hex digits, a running
sum over a leaf's buckets (256 at most) finds the bucket where the budget ends, and that bucket is divided again until it
holds at most SMALL documents; only these are sorted. What comes out is a cut-off digest for each leaf; documents compare
their own with it, so texts are never shuffled.

A token is a run of characters other than \\x20 and \\x09-\\x0D. Null domains, languages and sources are the
empty text; null or empty texts have no tokens and are never taken. Rows with the same doc_id in a leaf share a place in the order.
Empty tables give empty results. Other columns are passed on by take() and not read.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweft.llm.common import cut, free_name

LEVELS = ("domain", "lang", "source")
MAX_EPOCHS, SEED = 4, 17
#: Hex digits of the digest that a round looks at, all it has, and documents that are few enough to sort.
STEP, DIGITS, SMALL = 2, 32, 1000
#: Share of the corpus's tokens that the mixture has, in hundredths.
BUDGET = 100
#: Target weights by level and name; names that are not listed weigh OTHER.
WEIGHTS: Mapping[str, Mapping[str, int]] = {
    "domain": {"web": 50, "reference": 30, "community": 20},
    "lang": {"en": 40, "de": 20, "fr": 20, "es": 20},
    "source": {},
}
OTHER = 10
#: Leaves are joined by a key salted this much, so that no leaf's documents meet in one task.
SALTS = 64


def domain_of(source: Column) -> Column:
    """documents has no domain column: sources are dealt to three domains by the first hex digit of their md5."""
    first = F.substring(F.md5(F.coalesce(source, F.lit("")).cast("binary")), 1, 1)
    return F.when(first < "6", "web").when(first < "b", "reference").otherwise("community")


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def weight(level: str, weights: Mapping[str, Mapping[str, int]]) -> Column:
    listed = weights.get(level, {})
    out = F.lit(OTHER)
    for name, value in listed.items():
        out = F.when(F.col(level) == name, value).otherwise(out)
    return out.cast("long")


def shared(children: DataFrame, parent: tuple[str, ...], level: str) -> DataFrame:
    """children (parent columns, level, capacity, weight, budget of the parent) with `budget` their own share.

    In order of capacity by weight, a child is filled while what is left, by weight, would cover it. Partitions are one node's
    children: a few languages or the sources of one language, whatever the number of documents.
    """
    family = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    upto = family.orderBy(F.col("capacity") / F.col("weight"), level)
    before = F.coalesce(F.sum("capacity").over(upto.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(upto.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    filled = children.withColumn("full", (F.col("budget") - before) * F.col("weight") >= F.col("capacity") * rest)
    used = F.coalesce(F.sum(F.when(F.col("full"), F.col("capacity"))).over(family), F.lit(0))
    open_weight = F.coalesce(F.sum(F.when(~F.col("full"), F.col("weight"))).over(family), F.lit(1))
    part = filled.withColumn("used", used).withColumn("open_weight", open_weight)
    return part.withColumn("budget", F.when(F.col("full"), F.col("capacity")).otherwise(F.expr("(budget - used) * weight div open_weight"))).drop("full", "used", "open_weight", "weight")


def budgets(leaves: DataFrame, weights: Mapping[str, Mapping[str, int]], percent: int, max_epochs: int) -> DataFrame:
    """Leaves (LEVELS, available tokens) with `budget`."""
    at = leaves.withColumn("capacity", F.col("available") * max_epochs)
    total = at.agg(F.expr(f"coalesce(sum(available), 0) * {percent} div 100").alias("budget"))
    domains = at.groupBy("domain").agg(F.sum("capacity").alias("capacity")).crossJoin(F.broadcast(total))
    out = shared(domains.withColumn("weight", weight("domain", weights)), (), "domain")
    for depth in (2, 3):
        level, parent = LEVELS[depth - 1], LEVELS[: depth - 1]
        below = at.groupBy(*LEVELS[:depth]).agg(F.sum("capacity").alias("capacity"), F.sum("available").alias("available"))
        below = below.join(out.select(*parent, "budget"), list(parent))
        out = shared(below.withColumn("weight", weight(level, weights)), parent, level)
    return out.select(*LEVELS, "available", "budget")


def place(epoch: Column, doc_id: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), epoch.cast("string"), F.lit(":"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def salted(leaves: DataFrame) -> DataFrame:
    return leaves.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def salt(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(SALTS)).cast("int")


def plan(docs: DataFrame, weights: Mapping[str, Mapping[str, int]] = WEIGHTS, percent: int = BUDGET, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """From (doc_id, LEVELS, n_tokens): for each leaf its budget, whole epochs, and the cut-off in the next one."""
    leaves = docs.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("available"))
    shares = budgets(leaves, weights, percent, max_epochs).select(
        *LEVELS, "available", "budget",
        F.expr("case when available > 0 then budget div available else 0 end").alias("epochs"),
        F.expr("case when available > 0 then budget % available else 0 end").alias("left_over"),
    )
    ends = shares.where("left_over > 0").select(*LEVELS, "left_over", F.lit("").alias("prefix"), F.lit(0).cast("long").alias("before"))
    leaf = [*LEVELS, "salt"]
    ordered = (
        docs.where("n_tokens > 0").withColumn("salt", salt(F.col("doc_id"))).join(salted(shares.where("left_over > 0").select(*LEVELS, "epochs")), leaf)
        .select(*leaf, "n_tokens", place(F.col("epochs"), F.col("doc_id"), seed).alias("place"))
    )
    ordered, ends = cut(ordered), cut(ends)
    running = Window.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # a round carries on only what lies in the bucket that its leaf's budget ends in
    inside = ordered
    for known in range(STEP, DIGITS + 1, STEP):
        sums = inside.groupBy(*LEVELS, F.substring("place", 1, known).alias("bucket")).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows"))
        upto = F.col("before") + F.sum("tokens").over(running)
        ends = cut(
            sums.join(ends.select(*LEVELS, "left_over", "before"), list(LEVELS)).withColumn("upto", upto).withColumn("begins", F.col("upto") - F.col("tokens"))
            .where("begins < left_over and upto >= left_over").select(*LEVELS, "left_over", F.col("bucket").alias("prefix"), F.col("begins").alias("before"), "rows")
        )
        inside = inside.join(salted(ends.select(*LEVELS, "prefix")), leaf).where(F.substring("place", 1, known) == F.col("prefix")).drop("prefix")
        most = ends.agg(F.max("rows")).first()[0]
        if most is None or most <= SMALL:
            break
        inside = cut(inside)
    inside = inside.groupBy(*LEVELS, "place").agg(F.sum("n_tokens").alias("tokens")).join(ends, list(LEVELS))
    earlier = Window.partitionBy(*LEVELS).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    cut_off = (
        inside.withColumn("upto", F.col("before") + F.coalesce(F.sum("tokens").over(earlier), F.lit(0)))
        .where("upto < left_over").groupBy(*LEVELS).agg(F.max("place").alias("cut_off"))
    )
    return shares.join(cut_off, list(LEVELS), "left").select(*LEVELS, "budget", "epochs", "cut_off")


def narrow(docs: DataFrame) -> DataFrame:
    return docs.select(
        "doc_id", domain_of(F.col("source")).alias("domain"), F.coalesce("lang", F.lit("")).alias("lang"),
        F.coalesce("source", F.lit("")).alias("source"), n_tokens(F.col("text")).alias("n_tokens"),
    )


def copies(rows: DataFrame, leaves: DataFrame, seed: int = SEED) -> DataFrame:
    """rows (doc_id, LEVELS, n_tokens and more) with their leaf's budget and how often each row is taken."""
    taken = F.col("epochs") + F.coalesce(place(F.col("epochs"), F.col("doc_id"), seed) <= F.col("cut_off"), F.lit(False)).cast("long")
    return (
        rows.withColumn("salt", salt(F.col("doc_id"))).join(salted(leaves), [*LEVELS, "salt"])
        .withColumn("copies", F.when(F.col("n_tokens") > 0, taken).otherwise(0)).drop("salt", "epochs", "cut_off")
    )


def mixture(documents: DataFrame, **parameters) -> DataFrame:
    """doc_id, its leaf and tokens, its leaf's budget, and how many copies of it are taken, for each row. Texts are read once."""
    rows = cut(narrow(documents))
    return copies(rows, plan(rows, **parameters)).select("doc_id", *LEVELS, "n_tokens", "budget", "copies")


def take(documents: DataFrame, **parameters) -> DataFrame:
    """The rows of documents, each as often as it is taken, with the columns of documents."""
    inner = free_name(documents, "row_of_documents")
    rows = documents.select(
        F.col("doc_id"), domain_of(F.col("source")).alias("domain"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"),
        n_tokens(F.col("text")).alias("n_tokens"), F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias(inner),
    )
    taken = copies(rows, plan(cut(narrow(documents)), **parameters)).where("copies > 0")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(f"{inner}.*")


def oracle_sql() -> str:
    """The same for DuckDB over the view documents."""
    case = lambda level: "case " + "".join(f"when {level} = '{k}' then {v} " for k, v in WEIGHTS[level].items()) + f"when false then 0 else {OTHER} end"
    out = f"""
with docs as (
  select doc_id, coalesce(lang, '') as lang, coalesce(source, '') as source,
    case when md5(coalesce(source, ''))[1] < '6' then 'web' when md5(coalesce(source, ''))[1] < 'b' then 'reference' else 'community' end as domain,
    coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as n_tokens
  from documents),
s0 as (select 0 as root, (coalesce(sum(n_tokens), 0) * {BUDGET} // 100)::bigint as budget from docs)"""
    for depth, level in enumerate(LEVELS, 1):
        keys, parent = ", ".join(LEVELS[:depth]), ", ".join(LEVELS[: depth - 1]) or "root"
        root = "" if depth > 1 else "0 as root, "
        out += f""",
c{depth} as (select c.*, s{depth - 1}.budget as given, {case(level)} as weight
  from (select {root}{keys}, sum(n_tokens)::bigint as available, sum(n_tokens)::bigint * {MAX_EPOCHS} as capacity from docs group by {keys}) c
  join s{depth - 1} using ({parent})),
f{depth} as (select *, (given - coalesce(sum(capacity) over (partition by {parent} order by capacity / weight, {level} rows between unbounded preceding and 1 preceding), 0)) * weight
  >= capacity * sum(weight) over (partition by {parent} order by capacity / weight, {level} rows between current row and unbounded following) as filled from c{depth}),
s{depth} as (select {keys}, available, (case when filled then capacity else
  (given - coalesce(sum(case when filled then capacity end) over (partition by {parent}), 0)) * weight
  // coalesce(sum(case when not filled then weight end) over (partition by {parent}), 1) end)::bigint as budget from f{depth})"""
    return out + f""",
leaf as (select *, case when available > 0 then budget // available else 0 end as epochs, case when available > 0 then budget % available else 0 end as left_over from s3),
placed as (select d.*, budget, epochs, left_over, md5('{SEED}:' || epochs || ':' || coalesce(doc_id::varchar, '')) as place from docs d join leaf using (domain, lang, source)),
summed as (select *, coalesce(sum(n_tokens) over (partition by domain, lang, source order by place range between unbounded preceding and current row), 0)
  - sum(n_tokens) over (partition by domain, lang, source, place) as upto from placed)
select doc_id, domain, lang, source, n_tokens, budget,
  (case when n_tokens > 0 then epochs + case when upto < left_over then 1 else 0 end else 0 end)::bigint as copies from summed"""
