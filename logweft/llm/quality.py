"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad. A line's potential is a linear function of features of its own and of its
neighbouring lines; a two-by-two matrix scores neighbouring labels. Forward-backward gives each line's probability of
being good, and the mean of these weighted by line length, with the least of them, gives the document's score
through a logistic curve.

Learning, on a bounded sample of labelled rows, all lines of each: the lines of good documents are good; in bad documents they start as bad, and
those that the fitted field finds good are relabelled before it is fitted again (the worst line stays bad). No text,
language, source or id is a feature, only the make-up of lines, so languages are treated alike.

Null and empty texts are one empty line. With no labelled rows of both kinds the score is 1. Repeated rows and ties
score alike; an empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, StructField

from logweft.llm.common import cut, labelled_sample, map_texts, split_by_crc

#: Labelled documents that the field may be fitted on, and lines of them in all: documents in the order of the sample's hash, as
#: long as those before hold fewer lines; a document counts with all its lines. Lines of a chain: longer texts are cut into several.
SAMPLE, LINES, CHAIN = 4_000, 200_000, 64
ROUNDS, STEPS = 3, 150
THRESHOLD = 0.3
SIZE = 10
CLEAR = 0.5

#: Byte classes: 1 upper case, 2 lower case or part of a longer character, 3 digit, 4 space, 5 ordinary punctuation, 6 other symbols.
CLASS = np.full(256, 6, dtype=np.uint8)
CLASS[65:91], CLASS[97:123], CLASS[128:], CLASS[48:58] = 1, 2, 2, 3
CLASS[[9, 11, 12, 13, 32]] = 4
CLASS[[ord(c) for c in ".,;:?'\"()-"]] = 5


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(lines, SIZE) features and the lines' lengths in bytes, at least 1 each."""
    data = text.encode("utf-8", "surrogatepass")
    lines = data.split(b"\n")
    n = len(lines)
    lengths = np.fromiter(map(len, lines), dtype=np.int64, count=n)
    kinds = CLASS[np.frombuffer(data + b"\n", dtype=np.uint8)]
    row = np.repeat(np.arange(n), lengths + 1)
    counts = np.bincount(row * 8 + kinds, minlength=8 * n).reshape(n, 8).astype(float)
    words = [line.split() for line in lines]
    total = np.fromiter(map(len, words), dtype=float, count=n)
    distinct = np.fromiter((len(set(w)) for w in words), dtype=float, count=n)
    again = np.fromiter((sum(a == b for a, b in zip(w, w[1:])) for w in words), dtype=float, count=n)
    size, some = np.maximum(lengths, 1), np.maximum(total, 1)
    letters = np.maximum(counts[:, 1] + counts[:, 2], 1)
    out = np.stack([
        np.ones(n),
        counts[:, 1] / letters,
        np.minimum(counts[:, 6] / some, 3.0),
        counts[:, 3] / size,
        counts[:, 5] / some,
        again / some,
        1 - distinct / some,
        np.log1p(total) / 5,
        np.minimum(letters / some, 20.0) / 10,
        total == 0,
    ], 1)
    return out, np.maximum(lengths, 1)


def beside(x: np.ndarray) -> np.ndarray:
    """Each line's features, those of the line before and of the line after (zeros at the ends)."""
    none = np.zeros((1, x.shape[1]), dtype=x.dtype)
    return np.concatenate([x, np.concatenate([none, x[:-1]]), np.concatenate([x[1:], none])], 1)


@dataclass
class Field:
    weights: np.ndarray  # 3 * SIZE: for a good line
    pairs: np.ndarray  # 2 x 2: for neighbouring labels
    curve: np.ndarray  # of the document: offset, mean, least

    def document(self, mean: float, least: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.curve @ [1.0, mean, least], -60, 60))))


def marginals(good: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each line's probability of good, and the expected (summed) pairs of neighbouring labels.

    Forward and backward messages are ratios of good to bad, so that long texts can't under- or overflow.
    """
    e = np.exp(pairs - pairs.max())
    (bb, bg), (gb, gg) = e.tolist()
    odds = np.exp(np.clip(good, -30, 30)).tolist()
    n = len(odds)
    ahead, back = [0.0] * n, [1.0] * n
    r = odds[0]
    ahead[0] = r
    for t in range(1, n):
        r = min(1e30, max(1e-30, odds[t] * (bg + r * gg) / (bb + r * gb)))
        ahead[t] = r
    b = 1.0
    for t in range(n - 2, -1, -1):
        o = odds[t + 1] * b
        b = min(1e30, max(1e-30, (gb + gg * o) / (bb + bg * o)))
        back[t] = b
    a, k = np.array(ahead), np.array(back)
    q = a * k / (1 + a * k)
    if n == 1:
        return q, np.zeros((2, 2))
    o = np.array(odds)[1:] * k[1:]
    joint = np.stack([np.full(n - 1, bb), bg * o, gb * a[:-1], gg * a[:-1] * o], 1)
    return q, (joint / joint.sum(1, keepdims=True)).sum(0).reshape(2, 2)


def chain_marginals(good: np.ndarray, there: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What marginals() gives, for many chains at once: rows of good, where there is true (from the left)."""
    (bb, bg), (gb, gg) = np.exp(pairs - pairs.max())
    odds = np.exp(np.clip(good, -30, 30))
    ahead, back = odds.copy(), np.ones_like(odds)
    for t in range(1, odds.shape[1]):
        ahead[:, t] = np.clip(odds[:, t] * (bg + ahead[:, t - 1] * gg) / (bb + ahead[:, t - 1] * gb), 1e-30, 1e30)
    for t in range(odds.shape[1] - 2, -1, -1):
        o = odds[:, t + 1] * back[:, t + 1]
        back[:, t] = np.where(there[:, t + 1], np.clip((gb + gg * o) / (bb + bg * o), 1e-30, 1e30), 1)
    q = ahead * back / (1 + ahead * back)
    o = odds[:, 1:] * back[:, 1:]
    joint = np.stack([np.full_like(o, bb), bg * o, gb * ahead[:, :-1], gg * ahead[:, :-1] * o])
    return q, ((joint / joint.sum(0)) * there[:, 1:]).sum((1, 2)).reshape(2, 2)


def fit_field(x: np.ndarray, there: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the likeliest field (Adam steps on the mean log-likelihood, with a slight pull to zero).

    x: chains, lines, features; there: which lines are; y: which are good.
    """
    flat, inner = x[there], there[:, 1:]
    seen = np.array([[((y[:, :-1] == a) & (y[:, 1:] == b) & inner).sum() for b in (0, 1)] for a in (0, 1)], dtype=float)
    w, p = np.zeros(x.shape[2]), np.zeros((2, 2))
    state = np.zeros((2, w.size + 4))
    for step in range(1, STEPS + 1):
        good = np.zeros(there.shape)
        good[there] = flat @ w
        q, pairs = chain_marginals(good, there, p)
        slope = np.concatenate([flat.T @ (y - q)[there], (seen - pairs).ravel()]) / len(flat) - 1e-4 * np.concatenate([w, p.ravel()])
        state[0] = 0.9 * state[0] + 0.1 * slope
        state[1] = 0.99 * state[1] + 0.01 * slope**2
        move = 0.3 * state[0] / (1 - 0.9**step) / (np.sqrt(state[1] / (1 - 0.99**step)) + 1e-8)
        w, p = w + move[: w.size], p + move[w.size :].reshape(2, 2)
    return w, p


def summary(q: np.ndarray, lengths: np.ndarray) -> tuple[float, float]:
    return float((q * lengths).sum() / lengths.sum()), float(q.min())


def fit(documents: DataFrame, labels: DataFrame, learnable=None) -> Field | None:
    """The field of at most SAMPLE labelled rows; learnable: a condition on label rows."""
    sample = labelled_sample(documents, labels, "quality", F.lit(True) if learnable is None else learnable, SAMPLE)

    def make():
        def work(texts: list[str]) -> list[list]:
            out: list[list] = [[], [], []]
            for text in texts:
                x, lengths = features(text)
                for column, value in zip(out, (len(x), x.astype("<f4").tobytes(), lengths.tolist())):
                    column.append(value)
            return out

        return work

    fields = [StructField("n", IntegerType()), StructField("x", BinaryType()), StructField("lengths", ArrayType(IntegerType()))]
    rows = cut(map_texts(sample.withColumn("at", F.xxhash64("text")), ("at", "label"), "text", make, fields))
    earlier = Window.partitionBy(F.lit(0)).orderBy("at", "label").rowsBetween(Window.unboundedPreceding, -1)  # of at most SAMPLE numbers
    upto = rows.select("at", "label", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")).where(F.col("before") < LINES).agg(F.max("at")).first()[0]
    rows = rows.where(F.col("at") <= F.lit(upto)).select("label", "x", "lengths").collect() if upto is not None else []
    texts = [np.frombuffer(r.x, dtype="<f4").reshape(-1, SIZE) for r in rows]
    good = np.array([r.label > 0 for r in rows], dtype=bool)
    if not good.any() or good.all():
        return None
    chains, owner = [], []
    for k, t in enumerate(texts):
        whole = beside(t).astype("<f4")
        chains += [whole[a : a + CHAIN] for a in range(0, len(whole), CHAIN)]
        owner += [k] * (len(chains) - len(owner))
    owner = np.array(owner)
    x = np.zeros((len(chains), max(map(len, chains)), 3 * SIZE), dtype="<f4")
    there = np.zeros(x.shape[:2], dtype=bool)
    for k, c in enumerate(chains):
        x[k, : len(c)], there[k, : len(c)] = c, True
    y = np.repeat(good[owner][:, None], x.shape[1], 1)
    for _ in range(ROUNDS):
        w, p = fit_field(x, there, y)
        q, _ = chain_marginals(x @ w, there, p)
        worst = np.full(len(texts), 2.0)
        np.minimum.at(worst, owner, np.where(there, q, 2.0).min(1))
        y = np.where(good[owner][:, None], True, (q > CLEAR) & (q > worst[owner][:, None]))
    means = np.array([[1.0, *summary(marginals(beside(t) @ w, p)[0], np.array(r.lengths, dtype=float))] for t, r in zip(texts, rows)])
    curve = np.zeros(3)
    for _ in range(60):
        q = 1 / (1 + np.exp(-np.clip(means @ curve, -30, 30)))
        step = np.linalg.solve((means * (q * (1 - q))[:, None]).T @ means + 0.05 * np.eye(3), means.T @ (good - q) - 0.05 * curve)
        curve += np.clip(step, -3, 3)
    return Field(w, p, curve)


SCORES = [
    StructField("score", DoubleType()),
    StructField("good_share", DoubleType()),
    StructField("least_good", DoubleType()),
    StructField("n_lines", IntegerType()),
    StructField("n_bad_lines", IntegerType()),
]


def scored(docs: DataFrame, keep: tuple[str, ...], model: Field | None) -> DataFrame:
    """keep, then score (0 to 1), the length-weighted share of good lines, the least marginal, and counts of lines."""

    def make():
        def work(texts: list[str]) -> list[list]:
            out: list[list] = [[] for _ in SCORES]
            for text in texts:
                x, lengths = features(text)
                if model is None:
                    got = 1.0, 1.0, 1.0, len(x), 0
                else:
                    q, _ = marginals(beside(x) @ model.weights, model.pairs)
                    mean, least = summary(q, lengths)
                    got = model.document(mean, least), mean, least, len(x), int((q < 0.5).sum())
                for column, value in zip(out, got):
                    column.append(value)
            return out

        return work

    return map_texts(docs, keep, "text", make, SCORES)


def quality(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document; labels whose crc32(doc_id) modulo 5 is 0 are held out of the fit."""
    held = split_by_crc(F.col("doc_id"), 5) == 0
    model = fit(documents, labels, ~held)
    return scored(documents, ("doc_id",), model).select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        "good_share", "least_good", "n_lines", "n_bad_lines",
    )
