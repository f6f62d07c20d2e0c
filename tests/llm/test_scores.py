"""The scores of op9 and op10, recomputed document by document in plain Python from the models' parameters."""

import math

import pytest
from pyspark.sql import functions as F

from logweft.llm import quality, toxicity

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    """The documents, and a few awkward ones beside them."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    more = spark.createDataFrame([(10**9, None), (10**9 + 1, ""), (10**9 + 2, "\n\n"), (10**9 + 3, "one"), (10**9 + 4, "a b\n" * 300)], "doc_id long, text string")
    return docs.unionByName(more), spark.read.parquet(f"{FOLDER}/labels.parquet")


def maximal(scores):
    """Maximal segments by their definition: the best run (the first of equals, the shortest), then the same left and right of it."""
    best = None
    for a in range(len(scores)):
        total = 0.0
        for b in range(a, len(scores)):
            total += scores[b]
            if total > 1e-9 and (best is None or total > best[2] + 1e-9):
                best = (a, b + 1, total)
    if best is None:
        return []
    left, right = maximal(scores[: best[0]]), maximal(scores[best[1] :])
    return left + [best] + [(a + best[1], b + best[1], s) for a, b, s in right]


def test_toxic_scores_by_brute_force(tables):
    docs, labels = tables
    m = toxicity.fit(docs, labels, toxicity.learnable())
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    compared = 0
    for r in docs.collect():
        words = (r.text or "").split()
        if len(words) > 150:  # the definition takes the cube of the words
            continue
        compared += 1
        scores = []
        for word in words:
            token = word.strip("\"'.,;:!?()[]{}<>*-_").lower()
            stem = "\x01" + token[:5]
            scores.append(m.scores[token] if token in m.scores else m.scores.get(stem, m.unseen) if len(token) >= 5 else m.unseen)
        found, n = maximal(scores), len(words)
        beyond = lambda s: m.rate * s - math.log(max(n, 1)) - m.log_k
        chance = lambda s: 1 - math.exp(-math.exp(min(50.0, -beyond(s))))
        over = sum(beyond(s) for _, _, s in found if beyond(s) > 0)
        best = max([s for _, _, s in found], default=0.0)
        x = math.sqrt(over) if over > 0 else min(0.0, beyond(best))
        want = 1 / (1 + math.exp(min(60.0, max(-60.0, -(m.slope * x + m.offset)))))
        own = got[r.doc_id]
        assert own.score == pytest.approx(want, abs=1e-6) and own.predicted == int(own.score >= 0.3) and own.p_value == pytest.approx(chance(best), abs=1e-6)
        at, places = 0, []
        for word in words:
            at = r.text.index(word, at)
            places.append((at, at + len(word)))
            at += len(word)
        clear = [(a, b, s) for a, b, s in found if chance(s) < toxicity.SIGNIFICANT]
        assert own.passages == ",".join(f"{places[a][0]}:{places[b - 1][1]}" for a, b, _ in clear) and own.n_passages == len(clear)
    assert compared > 50


def test_quality_scores_by_brute_force(tables):
    """Forward-backward by plain products, rescaled at each line."""
    docs, labels = tables
    held = toxicity.split_by_crc(F.col("doc_id"), 5) == 0
    m = quality.fit(docs, labels, ~held)
    got = {r.doc_id: r for r in quality.quality(docs, labels).collect()}
    e = [[math.exp(m.pairs[a][b]) for b in (0, 1)] for a in (0, 1)]
    for r in docs.collect():
        lines = (r.text or "").encode().split(b"\n")
        x, lengths = quality.features(r.text or "")
        n = len(lines)
        none = [0.0] * quality.SIZE
        good = []
        for k in range(n):
            row = [*x[k], *(x[k - 1] if k else none), *(x[k + 1] if k + 1 < n else none)]
            good.append(math.exp(min(30.0, max(-30.0, sum(w * v for w, v in zip(m.weights, row))))))
        ahead, back = [[1.0, good[0]]], [[1.0, 1.0]]
        for k in range(1, n):
            f = [sum(ahead[-1][a] * e[a][b] for a in (0, 1)) * (good[k] if b else 1.0) for b in (0, 1)]
            ahead.append([v / sum(f) for v in f])
        for k in range(n - 1, 0, -1):
            f = [sum(e[a][b] * (good[k] if b else 1.0) * back[0][b] for b in (0, 1)) for a in (0, 1)]
            back.insert(0, [v / sum(f) for v in f])
        q = [a[1] * b[1] / (a[0] * b[0] + a[1] * b[1]) for a, b in zip(ahead, back)]
        size = [max(1, len(line)) for line in lines]
        mean, least = sum(p * s for p, s in zip(q, size)) / sum(size), min(q)
        z = m.curve[0] + m.curve[1] * mean + m.curve[2] * least
        own = got[r.doc_id]
        assert lengths.tolist() == size and own.n_lines == n and own.n_bad_lines == sum(p < 0.5 for p in q)
        assert own.score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-6) and own.good_share == pytest.approx(mean, abs=1e-6)
        assert own.least_good == pytest.approx(least, abs=1e-6) and own.predicted == int(own.score >= 0.3)
