"""Approximate nearest neighbours: inverted lists of coarse centroids, product-quantised residuals, exact reranking.

Nearness is the largest inner product, in double precision, ties to the smaller vec_id. Equal vectors are one entry that
knows its smallest ids, so copies cost nothing and keep their ties. Centroids (k-means) and codebooks of residuals are fitted on
a bounded sample (SAMPLE entries, by hash); every entry is indexed. There are about as many lists as the square root of the entries.

What a query looks at is measured on the sample, not set: the lists (in order of their centroids' inner product with it)
that hold TARGET of the sample's true neighbours, so that vectors which cluster need few and vectors which do not need many. Codes
are scored by the query's table of inner products with codebook entries; reranked exactly is each entry whose score may, within the
error that codes have on the sample, reach the query's (k + 1)-th best in the sample. That one is no better than the (k + 1)-th best of all, so
nothing is capped. The cost: queries by the entries of their lists. Where vectors hardly cluster that grows with the square of the table.

Lists are packed into shards of about SHARD entries (a larger list is cut into several), and a query goes once to each shard that it has
lists in. For very many queries a shard is dealt out again by groups of queries. Between tasks go only candidates.

Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows without vec_id. Shorter vectors count as
filled up with zeros. Rows with the same vec_id and vector count once; a vec_id with several vectors is a row (and a query) for each of
them. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweft.llm.common import cut

NEAREST = 20
#: Entries that the index is fitted on, k-means rounds, sample entries for a list at least, queries that the search is tuned with.
SAMPLE, ITERATIONS, EACH, TUNED = 16_384, 8, 8, 512
#: Share of the sample's neighbours whose lists a query looks at, and of those whose error of codes is allowed for.
TARGET, SURE = 0.95, 0.995
PART, CODES = 4, 256
#: Entries of a shard, queries of a group, and queries that are scored at one time.
SHARD, QUERY_GROUP, AT_ONCE = 8192, 8192, 256


def k_means(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Centroids of x by Lloyd's iterations; an empty one moves to a random point."""
    k = min(k, len(x))
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(ITERATIONS):
        at = nearest_centre(x, centres)
        counts = np.bincount(at, minlength=k)
        sums = np.stack([np.bincount(at, weights=x[:, d], minlength=k) for d in range(x.shape[1])], 1)
        some = counts > 0
        centres[some] = sums[some] / counts[some, None]
        if not some.all():
            centres[~some] = x[rng.choice(len(x), int((~some).sum()))]
    return centres


def nearest_centre(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres**2).sum(1) / 2
    return np.concatenate([(x[a : a + 4096] @ centres.T - half).argmax(1) for a in range(0, len(x), 4096)]) if len(x) else np.empty(0, dtype=int)


@dataclass
class Index:
    """What is learnt: lists x dim centroids, and for each part of a vector CODES centroids of residuals. Bounded by the parameters."""

    centres: np.ndarray
    books: list[np.ndarray]
    sample: np.ndarray
    probes: int = 1
    margin: float = 0.0

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = nearest_centre(x, self.centres)
        rest = x - self.centres[at]
        return at, np.stack([nearest_centre(rest[:, j * PART : (j + 1) * PART], b) for j, b in enumerate(self.books)], 1).astype(np.uint8)

    def tables(self, q: np.ndarray) -> list[np.ndarray]:
        """For each part, the inner products of each query's part with the codebook."""
        return [q[:, j * PART : (j + 1) * PART] @ b.T for j, b in enumerate(self.books)]


    def rough(self, q: np.ndarray, at: int, codes: np.ndarray) -> np.ndarray:
        """Scores of queries by entries of list `at` from their codes."""
        out = np.repeat((q @ self.centres[at])[:, None], len(codes), 1)
        for j, t in enumerate(self.tables(q)):
            out += t[:, codes[:, j]]
        return out

    def bounds(self, q: np.ndarray, k: int) -> np.ndarray:
        """Each query's k-th best score in the sample; no bound if the sample is smaller."""
        if len(self.sample) < k:
            return np.full(len(q), -np.inf)
        return np.concatenate([np.partition(q[a : a + AT_ONCE] @ self.sample.T, -k, axis=1)[:, -k] for a in range(0, len(q), AT_ONCE)])


def fit(sample: np.ndarray, lists: int, k: int) -> Index:
    """Centroids and codebooks of the sample, and how far a search must look to find TARGET of its neighbours."""
    rng = np.random.default_rng(7)
    centres = k_means(sample, lists, rng)
    at = nearest_centre(sample, centres)
    rest = sample - centres[at]
    index = Index(centres, [k_means(rest[:, a : a + PART], CODES, rng) for a in range(0, sample.shape[1], PART)], sample)
    _, codes = index.encode(sample)
    asked = rng.choice(len(sample), min(TUNED, len(sample)), replace=False)
    q = sample[asked]
    scores = q @ sample.T
    scores[np.arange(len(asked)), asked] = -np.inf
    near = np.argsort(-scores, axis=1)[:, : min(k, max(1, len(sample) - 1))]
    place = np.argsort(np.argsort(-(q @ centres.T), axis=1, kind="stable"), axis=1)
    index.probes = int(np.quantile(np.take_along_axis(place, at[near], 1), TARGET, method="higher")) + 1
    tables = index.tables(q)
    told = (q[:, None] * centres[at[near]]).sum(2) + sum(np.take_along_axis(t, codes[near, j].astype(int), 1) for j, t in enumerate(tables))
    error = np.take_along_axis(scores, near, 1) - told
    error = error[np.isfinite(error)]
    index.margin = float(np.quantile(error, SURE)) if len(error) else 0.0
    return index


def packed(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each list its first shard, and the shards it is cut into (one, for lists that share a shard)."""
    first, pieces = np.zeros(len(size), dtype=int), np.maximum(1, -(-size // SHARD))
    shard, held = -1, SHARD
    for c, n in enumerate(size.tolist()):
        if n > SHARD:
            first[c], shard, held = shard + 1, shard + int(pieces[c]), SHARD
        else:
            if held + n > SHARD:
                shard, held = shard + 1, 0
            first[c], held = shard, held + n
    return first, pieces


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def matrix(vectors) -> np.ndarray:
    return np.array(list(vectors), dtype=np.float64)


def search(vectors: DataFrame, is_query: Column, k: int = NEAREST) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k nearest other rows of every row of (vec_id, embedding) that is_query holds for."""
    spark = vectors.sparkSession
    out = "query_id bigint, rank int, vec_id bigint, score double"
    kind = vectors.schema["embedding"].dataType.simpleString()
    kind = kind if kind == "array<float>" else "array<double>"
    rows = vectors.select("vec_id", F.col("embedding").cast(kind).alias("embedding"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    width = rows.agg(F.max(F.size("embedding"))).first()[0]
    if width is None:
        return spark.createDataFrame([], out)
    filled = F.concat("embedding", F.array_repeat(F.lit(0.0).cast(kind[6:-1]), F.lit(width) - F.size("embedding")))
    rows = cut(rows.withColumn("embedding", F.when(F.size("embedding") < width, filled).otherwise(F.col("embedding"))).groupBy("vec_id", "embedding").agg(F.max("asks").alias("asks")))

    # equal vectors: the k + 1 smallest ids; the limit within each task's rows comes before the shuffle
    small = Window.partitionBy("embedding").orderBy("vec_id")
    entries = (
        rows.withColumn("nth", F.row_number().over(small)).where(F.col("nth") <= k + 1)
        .groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("members"))
    )
    entries = cut(entries.select(F.monotonically_increasing_id().alias("entry"), F.col("members")[0].alias("first"), "embedding", "members"))
    queries = cut(rows.where("asks").join(entries.select("embedding", "entry"), "embedding").select(F.col("vec_id").alias("query_id"), "entry"))
    n = entries.count()

    chosen = entries.orderBy(F.xxhash64("embedding"), "entry").limit(SAMPLE).select("embedding").toArrow()["embedding"]
    sample = chosen.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    index = fit(sample, max(1, min(math.isqrt(n), SAMPLE // EACH, len(sample) // EACH)), k)
    shared = spark.sparkContext.broadcast(index)

    def assign(frames):
        for f in frames:
            if len(f):
                at, codes = shared.value.encode(matrix(f["embedding"]))
                yield f.assign(list=at, codes=[c.tobytes() for c in codes])

    indexed = cut(entries.select("entry", "first", "embedding").mapInPandas(assign, f"entry bigint, first bigint, embedding {kind}, list int, codes binary"))
    sizes = dict(map(tuple, indexed.groupBy("list").count().collect()))  # as many rows as there are lists
    size = np.array([sizes.get(c, 0) for c in range(len(index.centres))])
    first, pieces = packed(size)
    asked = queries.select("entry").distinct()
    groups = max(1, math.ceil(asked.count() * index.probes / len(size) / QUERY_GROUP))

    def probe(frames):
        for f in frames:
            if not len(f):
                continue
            q = matrix(f["embedding"])
            bound = shared.value.bounds(q, k + 1) - shared.value.margin
            order = np.argsort(-(q @ shared.value.centres.T), axis=1, kind="stable")
            # more lists where those do not hold enough entries
            wanted = np.maximum(shared.value.probes, (np.cumsum(size[order], axis=1) < 2 * (k + 1)).sum(1) + 1)
            made = []
            for e, v, o, m, b in zip(f["entry"], f["embedding"], order, wanted, bound):
                lists: dict[int, list[int]] = {}
                for c in np.sort(o[:m]).tolist():
                    for piece in range(int(pieces[c])):
                        lists.setdefault(int(first[c]) + piece, []).append(c)
                made += [(e, v, b, shard, told) for shard, told in lists.items()]
            yield pd.DataFrame(made, columns=["entry", "embedding", "bound", "shard", "lists"])

    place = ["shard", "group"]
    places = spark.createDataFrame([(c, int(a), int(b)) for c, (a, b) in enumerate(zip(first, pieces))], "list int, first_shard int, pieces int")
    base = indexed.join(F.broadcast(places), "list").withColumn("shard", F.col("first_shard") + F.pmod(F.xxhash64("entry"), F.col("pieces")).cast("int")).drop("first_shard", "pieces")
    base = base.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    looking = (
        asked.join(entries.select("entry", "embedding"), "entry").mapInPandas(probe, f"entry bigint, embedding {kind}, bound double, shard int, lists array<int>")
        .withColumn("group", F.pmod(F.xxhash64("entry"), F.lit(groups)).cast("int"))
    )

    def compare(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(q) and len(b):
            x, y, held = matrix(b["embedding"]), matrix(q["embedding"]), b["list"].to_numpy()
            codes = np.frombuffer(b"".join(b["codes"]), dtype=np.uint8).reshape(len(b), -1)
            bound, per = q["bound"].to_numpy(), np.array([len(v) for v in q["lists"]])
            asker, listed = np.repeat(np.arange(len(q)), per), np.concatenate(q["lists"].to_numpy())
            for c in np.unique(held).tolist():
                inside, asking = np.flatnonzero(held == c), asker[listed == c]
                for a in range(0, len(asking), AT_ONCE):
                    some = asking[a : a + AT_ONCE]
                    i, j = np.nonzero(shared.value.rough(y[some], c, codes[inside]) >= bound[some, None])
                    found.append((some[i], inside[j]))
        if not found:
            return pd.DataFrame({"entry": [], "found": [], "first": [], "score": []})
        i, j = map(np.concatenate, zip(*found))
        score = np.concatenate([np.einsum("nd,nd->n", y[i[a : a + 65536]], x[j[a : a + 65536]]) for a in range(0, max(1, len(i)), 65536)])
        ids = b["first"].to_numpy()[j]
        order = np.lexsort((ids, -score, i))
        i, j, score, ids = i[order], j[order], score[order], ids[order]
        best = np.arange(len(i)) - np.searchsorted(i, i) <= k  # no more than k + 1 of a shard can be among the best
        return pd.DataFrame({"entry": q["entry"].to_numpy()[i[best]], "found": b["entry"].to_numpy()[j[best]], "first": ids[best], "score": score[best]})

    near = looking.groupBy(*place).cogroup(base.groupBy(*place)).applyInPandas(compare, "entry bigint, found bigint, first bigint, score double")
    by_score = Window.partitionBy("entry").orderBy(F.desc("score"), "first")
    near = near.withColumn("nth", F.row_number().over(by_score)).where(F.col("nth") <= k + 1).drop("nth", "first")
    members = entries.select(F.col("entry").alias("found"), "members")
    each = near.join(members, "found").select("entry", "score", "found", F.explode("members").alias("vec_id"))
    order = Window.partitionBy("entry").orderBy(F.desc("score"), "vec_id", "found")
    each = each.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k + 1)
    lists = cut(each.groupBy("entry").agg(F.array_sort(F.collect_list(F.struct("nth", "vec_id", "score", "found"))).alias("best")))
    others = F.slice(F.filter("best", lambda x: (x["vec_id"] != F.col("query_id")) | (x["found"] != F.col("entry"))), 1, k)
    return queries.join(lists, "entry").select("query_id", F.posexplode(others).alias("rank", "b")).select(
        "query_id", (F.col("rank") + 1).cast("int").alias("rank"), "b.vec_id", "b.score"
    )
