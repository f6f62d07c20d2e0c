"""Phrase mining, line deduplication and vector codes against brute force, and on awkward tables."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from logweft.llm import codes, linededup, phrases

DOCS = "doc_id long, text string, lang string, line string, n long, drops string, phrase string, words int"


def documents(spark, rows):
    return spark.createDataFrame([(*r, "l", 1, "d", "p", 2) for r in rows], DOCS)


def awkward(spark):
    long = "word other\n" * 20_000 + "x" * 50_000
    return documents(spark, [(1, None, None), (2, "", "en"), (3, " Same\nLine\n\nsame \t", "en"), (3, " Same\nLine\n\nsame \t", "en"), (None, "same\r\nÉtat\nétat", None), (4, long, "de"), (5, "a b. a b, a b", "und")])


def brute_lines(rows, least):
    blank = " \t\n\x0b\x0c\r"
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    texts = [(i, (t or "").split("\n")) for i, t in rows]
    keys = [[lower(x.strip(blank)) for x in ls] for _, ls in texts]
    seen = Counter(k for ks in keys for k in set(ks) if k)
    out = []
    for (i, ls), ks in zip(texts, keys):
        kept = [x for x, k in zip(ls, ks) if not k or seen[k] < least]
        out.append((i, len(ls), len(ls) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


@pytest.mark.parametrize(("most", "fan"), [(1, 2), (5, 2), (6, 3)])
def test_lines_by_brute_force(spark, most, fan):
    rng = random.Random(most)
    pool = ["Alpha  beta", " alpha  beta\t", "ÉTAT", "état", "", "  ", "z" * 300, "K", "K", *[f"line {k}" for k in range(40)]]
    rows = [(None if k % 17 == 0 else k % 60, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 9)))) for k in range(80)]
    rows.append((7, None))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    for least in (2, 10):
        got = linededup.deduplicated(d, least, most=most, fan=fan).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256)).collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute_lines(rows, least)))


def test_one_line_in_every_document(spark):
    d = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("Common\n"), F.col("id").cast("string"), F.lit("\ncommon ")).alias("text"))
    got = linededup.digests(d)
    assert got.where("n_lines = 3 and n_dropped = 2").where(F.col("kept_sha256") == F.sha2(F.col("doc_id").cast("string"), 256)).count() == 3000


def test_awkward_lines(spark):
    rows = [(r.doc_id, r.text) for r in awkward(spark).collect()]
    assert sorted(map(str, map(tuple, linededup.digests(awkward(spark)).collect()))) == sorted(map(str, brute_lines(rows, 10)))
    assert linededup.digests(documents(spark, [])).collect() == []


def brute_phrases(rows, longest, least, first):
    count, total = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        t = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for c in ".,;:!?\n\x0b\x0c\r":
            t = t.replace(c, "\n")
        for piece in t.split("\n"):
            w = [x for x in piece.replace("\t", " ").split(" ") if x]
            total[lang] += len(w)
            for d in range(1, longest + 1):
                for k in range(len(w) - d + 1):
                    count[lang, tuple(w[k : k + d])] += 1
    made = {k: a for k, a in count.items() if len(k[1]) >= 2 and a >= least}
    out = []
    for (lang, p), a in made.items():
        inside = [b for (m, q), b in made.items() if m == lang and len(q) > len(p) and any(q[k : k + len(p)] == p for k in range(len(q) - len(p) + 1))]
        if any(100 * b >= 50 * a for b in inside):
            continue
        score, _, left, right = min((10**6 * a * a // (count[lang, p[:k]] * count[lang, p[k:]]), k, count[lang, p[:k]], count[lang, p[k:]]) for k in range(1, len(p)))
        out.append((lang, " ".join(p), a, left, right, total[lang], score))
    ranked = []
    for lang in {r[0] for r in out}:
        best = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:first]
        ranked += [(r[0], k, *r[1:]) for k, r in enumerate(best, 1)]
    return sorted(ranked)


@pytest.mark.parametrize(("longest", "shard"), [(3, 1 << 20), (3, 60), (4, 300), (2, 200)])
def test_phrases_by_brute_force(spark, monkeypatch, longest, shard):
    monkeypatch.setattr(phrases, "SHARD_BYTES", shard)
    rng = random.Random(longest)
    words = ["a", "B", "b", "é", "É", "c d", "x-y", "\U0001f600", "aa"]
    rows = [("".join(rng.choice(words) + rng.choice([" ", " ", "\t", "  ", ". ", ",", "\n", "\r"]) for _ in range(rng.randint(0, 40))), rng.choice(["en", "de", None])) for _ in range(120)]
    d = spark.createDataFrame([(k, *r) for k, r in enumerate([*rows, (None, "en"), ("", None)])], "doc_id long, text string, lang string").repartition(3)
    for first in (5, 2000):
        got = phrases.collocations(d, longest, 10, first).collect()
        assert sorted(map(tuple, got)) == brute_phrases(rows, longest, 10, first)


def test_automaton_states():
    """States are the classes of substrings that end at the same places; a link leads to the longest suffix that ends at more."""
    rng = random.Random(4)
    ids = np.array([rng.randint(0, 3) for _ in range(200)])
    found = phrases.levels(ids, 4)
    ends = {}
    for e in range(len(ids)):
        for d in range(1, 5):
            p = tuple(ids[e - d + 1 : e + 1]) if e + 1 >= d else (0,)
            if 0 not in p:
                ends.setdefault(p, set()).add(e)
    seen = {}
    for s in phrases.states(found):
        for end, shortest, count, link in zip(s.end, s.shortest, s.count, s.link):
            phrase = tuple(ids[end - s.longest + 1 : end + 1])
            for d in range(shortest, s.longest + 1):
                assert phrase[-d:] not in seen and len(ends[phrase[-d:]]) == count and ends[phrase[-d:]] == ends[phrase]
                seen[phrase[-d:]] = count
            if shortest > 1:
                at = found[shortest - 2].end[link - 1]
                assert tuple(ids[at - shortest + 2 : at + 1]) == phrase[-(shortest - 1) :] and len(ends[phrase[-(shortest - 1) :]]) > count
    assert set(seen) == set(ends)


def test_awkward_phrases(spark):
    rows = [(r.text, r.lang) for r in awkward(spark).collect()]
    assert sorted(map(tuple, phrases.collocations(awkward(spark)).collect())) == brute_phrases(rows, 3, 10, 2000) != []
    assert phrases.collocations(documents(spark, [])).collect() == []


def test_exact_scores(spark):
    """Products that pass 64 bits."""
    a = 3 * 10**12
    c = spark.createDataFrame([("en", 2, "a b", a), ("en", 1, "a", 4 * 10**12), ("en", 1, "b", a + 1)], phrases.COUNTS_SQL)
    assert phrases.scored(c).first().score == 10**6 * a * a // (4 * 10**12 * (a + 1))


def brute_codes(rows, rounds=6):
    kept = [(i, y, [int(np.floor(np.float64(4096) * v)) for v in x]) for i, x, y in rows if x is not None and all(v is not None and np.isfinite(v) for v in x)]
    kept.sort(key=lambda r: (r[0] is None, r[0], r[2]))
    w = -(-max(len(x) for _, _, x in kept) // 8)
    parts = [[(x + [0] * (8 * w))[p * w : (p + 1) * w] for _, _, x in kept] for p in range(8)]
    books = [[list(v) for v in ps[:16]] for ps in parts]
    dist = lambda a, b: sum((s - t) ** 2 for s, t in zip(a, b))
    for t in range(rounds + 1):
        near = [[min(range(len(b)), key=lambda e: (dist(v, b[e]), e)) for v in ps] for ps, b in zip(parts, books)]
        if t < rounds:
            for ps, b, n in zip(parts, books, near):
                for e in range(len(b)):
                    mine = [v for v, k in zip(ps, n) if k == e]
                    if mine:
                        b[e] = [sum(c) // len(mine) for c in zip(*mine)]
    sha = hashlib.sha256(",".join(str(v) for b in books for c in b for v in c).encode()).hexdigest()
    errors = [sum(dist(ps[k], b[n[k]]) for ps, b, n in zip(parts, books, near)) for k in range(len(kept))]
    by = Counter()
    for (_, y, _), e in zip(kept, errors):
        by[y] += e
    top = (1 << 63) - 1
    return sorted(((i, "".join(f"{n[k]:02x}" for n in near), min(e, top), min(by[y], top), sha) for k, ((i, y, _), e) in enumerate(zip(kept, errors))), key=str)


VECTORS = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("seed", [1, 2])
def test_codes_by_brute_force(spark, seed):
    """Small integers, so that many distances are equal; copies, repeated ids, nulls, vectors of other lengths."""
    rng = np.random.default_rng(seed)
    rows = [(int(k), [float(v) / 4096 for v in rng.integers(-3, 4, 16)], int(rng.integers(0, 3))) for k in range(150)]
    rows += [rows[3], (3, rows[5][1], None), (None, rows[7][1], None), (900, None, 1), (901, [None] + rows[1][1][1:], 1), (902, [float("nan")] * 16, 1), (903, [float("inf")] * 16, 1), (904, [0.5, -0.5], 2), (905, [], 0)]
    got = codes.codes(spark.createDataFrame([(*r, "s", "p") for r in rows], VECTORS + ", state string, part string")).collect()
    assert sorted(map(tuple, got), key=str) == brute_codes(rows)


def test_awkward_vectors(spark):
    huge = [(k, [3e38 if k % 3 else -3e38, 1.0 * k, 2.0**-13, 0.0, 0.0, 0.0, 0.0, 1e30], k % 2) for k in range(20)]
    exact = [(i, [float(np.float32(v)) for v in x], y) for i, x, y in huge]
    assert sorted(map(tuple, codes.codes(spark.createDataFrame(huge, VECTORS)).collect()), key=str) == brute_codes(exact)
    few = [(1, [1.0] * 8, None), (2, [2.0] * 8, None)]
    assert sorted(map(tuple, codes.codes(spark.createDataFrame(few, VECTORS)).collect()), key=str) == brute_codes(few)
    assert codes.codes(spark.createDataFrame([], VECTORS)).collect() == [] == codes.codes(spark.createDataFrame([(1, None, 1)], VECTORS)).collect()


def test_bounds_save_distances():
    """Assignments of later rounds are those of a full scan, with far fewer distances where vectors cluster."""
    rng = np.random.default_rng(5)
    middles = rng.integers(-4000, 4000, (16, 8))
    x = np.concatenate([m + rng.integers(-300, 300, (200, 8)) for m in middles])
    rng.shuffle(x)
    book, bounds, scanned = codes.Codebook.started(x[:16].copy(), codes.GROUPS), None, []
    for _ in range(7):
        bounds = codes.assigned(x, book, bounds)
        full = codes.squared(x, book.entries).argmin(axis=1)
        assert (bounds.near == full).all()
        scanned.append(bounds.scanned)
        count = np.bincount(full, minlength=16)
        sums = np.zeros(book.entries.shape, dtype=np.int64)
        np.add.at(sums, full, x)
        book = book.updated(count, sums)
        kept = codes.unpacked(codes.packed([bounds] * codes.PARTS))[0]
        bounds = codes.Bounds(kept.near, kept.upper, kept.lower)
    assert scanned[0] == 16 * len(x) and scanned[-1] < scanned[0] / 4


def test_awkward_pages_and_encodings(spark):
    """Operators behind the queries on nulls, empty, repeated and very long pages and texts, clashing names, and empty tables."""
    from logweft.llm import media, piece_bpe, queries

    schema = "page_id long, html string, pos int, kind string, digest string, text string"
    rows = [(1, None, 9, "k", "d", "t"), (2, "", 9, "k", "d", "t"), (3, "<p>a</p><img src=sha256:ab alt=x>", 9, "k", "d", "t"), (3, "<p>a</p><img src=sha256:ab alt=x>", 9, "k", "d", "t"), (None, "b", 9, "k", "d", "t"), (4, "<p>" + "w " * 50_000, 9, "k", "d", "t")]
    pages = spark.createDataFrame(rows, schema)
    store = media.described(media.stored(spark.createDataFrame([("ab", "text")], "digest string, text string"), "digest"), "digest")
    found = media.items(pages, "page_id")
    assert Counter((r.page_id, r.kind) for r in found.collect()) == {(3, "text"): 2, (3, "image"): 2, (None, "text"): 1, (4, "text"): 1}
    put = {r.page_id: r.sequence for r in media.sequences(media.resolved(found, store), "page_id").collect()}
    assert [i.payload_bytes for i in put[3]] == [None, None, 192, 192] and len(put[4][0].text) >= 99_999 and put[None][0].text == "b"
    assert media.sequences(media.resolved(media.items(pages.limit(0), "page_id"), store), "page_id").collect() == []
    docs = awkward(spark).withColumn("ids", F.lit("i")).withColumn("decoded", F.lit("d"))
    got = piece_bpe.encode(docs, queries.piece_model(), ("doc_id",)).collect()
    assert len(got) == 7 and [len(r.ids) for r in got if r.doc_id in (1, 2)] == [1, 1] and len({tuple(r.ids) for r in got if r.doc_id == 3}) == 1
    assert piece_bpe.encode(docs.limit(0), queries.piece_model()).collect() == []
