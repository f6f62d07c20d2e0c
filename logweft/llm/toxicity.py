"""Toxic passages by maximum-scoring segments of token log-odds, calibrated by extreme values.

Learning, on a bounded sample of labelled rows: the counts in toxic and in other documents of each token that SEEN documents hold give
log-odds with a Dirichlet prior of PRIOR for each token, shared out as the pooled counts are, so that no evidence gives odds of 0. A token that was hardly seen, or says little, falls
back on its first five letters, which are counted the same way. DRIFT is taken off each score, so that ordinary text has
a falling sum.

Scoring: segments whose score sum can't be raised by extending or shrinking them are found in one linear scan of the
tokens (Ruzzo and Tompa's). By extreme-value theory the best segment of an ordinary text of n tokens exceeds S with
probability 1 - exp(-K n exp(-lambda S)); lambda comes from the spread of the best segments of the sample's ordinary
documents, K from their TAIL. A passage counts if its own such probability is below SIGNIFICANT. A
document's score is a logistic curve, fitted on the sample, of the square root of what its segments' lambda S exceed log(K n) by in all.

Null and empty texts score as a text whose best segment is zero. With no labelled rows of both kinds every score is zero.
Repeated rows and ties score alike; an empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from logweft.llm.common import cut, filter_texts, in_slices, labelled_sample, map_texts, split_by_crc

#: Labelled documents that the model may be fitted on. It has every token that SEEN of them hold and whose log-odds times count come to EVIDENCE.
SAMPLE, EVIDENCE = 20_000, 12.0
#: DRIFT is the one of 0.5 to 3.2 with the least loss on learnable rows left out of a fit (residue 0 of doc_id's crc32 modulo 4, fitted on 1 and 3).
PRIOR, DRIFT, STEM, SEEN = 1.0, 3.2, 5, 4
SIGNIFICANT, TAIL = 0.01, 0.01
THRESHOLD = 0.3
EDGE = "\"'.,;:!?()[]{}<>*-_"
WORD = re.compile(r"\S+")


def bare(word: str) -> str:
    return word.strip(EDGE).lower()


def stem(token: str) -> str:
    """How the first letters of a longer token are listed beside whole tokens."""
    return "\x01" + token[:STEM]


@dataclass
class Model:
    scores: dict[str, float] = field(default_factory=dict)
    unseen: float = -DRIFT
    rate: float = 1.0
    log_k: float = 0.0
    slope: float = 0.0
    offset: float = -50.0

    def score(self, token: str) -> float:
        got = self.scores.get(token)
        if got is None:
            got = self.scores.get(stem(token), self.unseen) if len(token) >= STEM else self.unseen
        return got

    def normal(self, best: float, n: int) -> float:
        """The best segment's score less what is usual for n tokens."""
        return self.rate * best - math.log(max(n, 1)) - self.log_k

    def together(self, sums: list[float], n: int) -> float:
        """The square root of what all segments exceed the usual by; or if none does, how near the best one comes."""
        over = [x for x in (self.normal(s, n) for s in sums) if x > 0]
        return math.sqrt(sum(over)) if over else min(0.0, self.normal(max(sums, default=0.0), n))

    def chance(self, best: float, n: int) -> float:
        """Probability that ordinary text of n tokens has such a segment."""
        return -math.expm1(-math.exp(min(50.0, -self.normal(best, n))))

    def probability(self, normal: float) -> float:
        return 1 / (1 + math.exp(min(60.0, max(-60.0, -(self.slope * normal + self.offset)))))


def segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, sum), in order."""
    if not scores:
        return []
    sums = np.concatenate(([0.0], np.cumsum(scores)))
    found: list[tuple[int, int, float, float]] = []  # start, end, sum before, sum after
    below: list[int] = []  # for each, the nearest one before it with a lower sum before its start
    for i in np.flatnonzero(sums[1:] > sums[:-1]).tolist():
        now = i, i + 1, float(sums[i]), float(sums[i + 1])
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= now[2]:
                j = below[j]
            if j < 0 or found[j][3] >= now[3]:
                found.append(now)
                below.append(j)
                break
            now = found[j][0], now[1], found[j][2], now[3]
            del found[j:], below[j:]
    return [(a, b, after - before) for a, b, before, after in found]


COUNTS = StructType([StructField("token", StringType()), StructField("label", IntegerType()), StructField("n", LongType()), StructField("docs", LongType())])


def token_counts(sample: DataFrame) -> DataFrame:
    """(token, label, n, number of documents) over (text, label) rows; beginnings of tokens too."""

    def run(batches):
        import pyarrow as pa

        counts: dict[int, Counter] = {0: Counter(), 1: Counter()}
        holding: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for batch in in_slices(batches):
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                tokens = list(map(bare, (text or "").split()))
                tokens += [stem(t) for t in tokens if len(t) >= STEM]
                counts[int(label > 0)].update(tokens)
                holding[int(label > 0)].update(set(tokens))
        for label, tokens in counts.items():
            columns = [list(tokens), [label] * len(tokens), list(tokens.values()), [holding[label][t] for t in tokens]]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=to_arrow_type(f.dataType)) for c, f in zip(columns, COUNTS.fields)], names=COUNTS.names)

    return sample.select("text", "label").mapInArrow(run, COUNTS).groupBy("token", "label").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def calibrated(usual: np.ndarray, sizes: np.ndarray) -> tuple[float, float]:
    """lambda and log K from the best segments of ordinary texts and the logarithms of their numbers of tokens."""
    rate = float(np.clip(np.pi / math.sqrt(6) / max(usual.std(), 1e-6), 0.2, 5.0))
    # P(rate * best - log n - log K > x) = 1 - exp(-exp(-x)) is set right at its tail; texts without any segment can't exceed it, however short they are
    reached = np.sort((rate * usual - sizes)[usual > 0])[::-1]
    tail = float(reached[min(len(reached) - 1, int(TAIL * len(usual)))]) if len(reached) else 0.0
    return rate, tail + math.log(-math.log1p(-TAIL))


def fit(documents: DataFrame, labels: DataFrame, learnable=None) -> Model:
    """The model of at most SAMPLE labelled rows; learnable: a condition on label rows.

    The sample is written once. The driver gets its tokens of enough evidence, and the sums of its documents' segments.
    """
    sample = cut(labelled_sample(documents, labels, "toxic", F.lit(True) if learnable is None else learnable, SAMPLE))
    of = lambda label: F.sum(F.when(F.col("label") == label, F.col("n")).otherwise(0))
    counted = cut(token_counts(sample).groupBy("token").agg(of(1).alias("toxic"), of(0).alias("plain"), F.sum("docs").alias("docs")))
    n1, n0 = counted.where(~F.col("token").startswith("\x01")).agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.coalesce(F.sum("plain"), F.lit(0))).first()
    if not n1 or not n0:
        return Model()
    a1, a0 = PRIOR * n1 / (n1 + n0), PRIOR * n0 / (n1 + n0)
    odds = F.log((F.col("toxic") + a1) / (n1 + a1)) - F.log((F.col("plain") + a0) / (n0 + a0))
    says = F.abs(F.col("odds")) * (F.col("toxic") + F.col("plain")) >= EVIDENCE
    told = counted.where(F.col("docs") >= SEEN).withColumn("odds", odds).where(says).select("token", "odds").toArrow()
    model = Model(dict(zip(told["token"].to_pylist(), (told["odds"].to_numpy() - DRIFT).tolist())))
    found = measured(sample, ("label",), model).toArrow()
    label, sizes, sums = found["label"].to_numpy() > 0, found["n_words"].to_numpy(), found["sums"].to_pylist()
    best = np.array([max(x, default=0.0) for x in sums])
    model.rate, model.log_k = calibrated(best[~label], np.log(np.maximum(sizes[~label], 1)))
    model.slope, model.offset = logistic(np.array([model.together(x, n) for x, n in zip(sums, sizes.tolist())]), label.astype(float))
    return model


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve, by Newton's method with a slight pull to zero."""
    middle, width = float(x.mean()), float(x.std()) or 1.0
    z = np.stack([(x - middle) / width, np.ones_like(x)], 1)
    w = np.zeros(2)
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (q * (1 - q))[:, None]).T @ z + 0.1 * np.eye(2), z.T @ (y - q) - 0.1 * w)
        w += np.clip(step, -4, 4)
        if abs(step).max() < 1e-8:
            break
    return float(w[0] / width), float(w[1] - w[0] * middle / width)


class Scorer(dict):
    """Word as it stands to score."""

    def __init__(self, model: Model, most: int = 50_000):
        self.model, self.most = model, most

    def __missing__(self, word: str) -> float:
        got = self.model.score(bare(word))
        if len(self) < self.most and len(word) <= 64:
            self[word] = got
        return got


MEASURES = [StructField("sums", ArrayType(DoubleType())), StructField("n_words", LongType())]
SCORES = [
    StructField("score", DoubleType()),
    StructField("p_value", DoubleType()),
    StructField("n_passages", LongType()),
    StructField("passages", StringType()),
]


def measured(docs: DataFrame, keep: tuple[str, ...], model: Model) -> DataFrame:
    """keep, then the sums of all maximal segments, and the number of words."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        of = Scorer(held.value)

        def work(texts: list[str]) -> list[list]:
            found = [list(map(of.__getitem__, text.split())) for text in texts]
            return [[[x[2] for x in segments(scores)] for scores in found], list(map(len, found))]

        return work

    return map_texts(docs, keep, "text", make, MEASURES)


def scored(docs: DataFrame, keep: tuple[str, ...], model: Model) -> DataFrame:
    """keep, then score (0 to 1), p_value of the best passage, and the significant passages as start:end in code points.

    The model's size is bounded by the sample's documents, so it is broadcast.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = held.value
        of = Scorer(m)

        def work(texts: list[str]) -> list[list]:
            out: list[list] = [[], [], [], []]
            for text in texts:
                scores = list(map(of.__getitem__, text.split()))
                parts, n = segments(scores), len(scores)
                sums = [s for _, _, s in parts]
                best = max(sums, default=0.0)
                found = []
                if m.chance(best, n) < SIGNIFICANT:
                    places = [w.span() for w in WORD.finditer(text)]
                    found = [f"{places[a][0]}:{places[b - 1][1]}" for a, b, s in parts if m.chance(s, n) < SIGNIFICANT]
                for column, value in zip(out, (m.probability(m.together(sums, n)), m.chance(best, n), len(found), ",".join(found))):
                    column.append(value)
            return out

        return work

    return map_texts(docs, keep, "text", make, SCORES)


def learnable():
    return split_by_crc(F.col("doc_id"), 4) != 2


def toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document; labels whose crc32(doc_id) modulo 4 is 2 are held out of the fit."""
    model = fit(documents, labels, learnable())
    return scored(documents, ("doc_id",), model).select(
        "doc_id", (split_by_crc(F.col("doc_id"), 4) == 2).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "p_value", "n_passages", "passages",
    )


def without_toxic(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of documents that score below THRESHOLD, with their columns; rows stay in their partitions."""
    held = documents.sparkSession.sparkContext.broadcast(fit(documents, labels, learnable()))

    def make():
        m = held.value
        of = Scorer(m)

        def work(texts: list[str]) -> list[bool]:
            scores = (list(map(of.__getitem__, t.split())) for t in texts)
            return [m.probability(m.together([x for _, _, x in segments(s)], len(s))) < THRESHOLD for s in scores]

        return work

    return filter_texts(documents, "text", make)
