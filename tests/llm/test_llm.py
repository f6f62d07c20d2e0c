"""The training-data operators against brute force, and on awkward tables."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from logweft.llm import ann, components, media, mixing, piece_bpe, pii, quality, queries, secrets, sharding, simhash, toxicity

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, row string, key string"


def awkward(spark, empty=False):
    """Nulls in any column, empty and very long texts, ties, repeated rows, columns with clashing names."""
    rows = [
        (1, None, None, None, None), (2, "", "en", "src0", 0), (3, "a b c", "en", "src0", 5), (3, "a b c", "en", "src0", 5), (None, "a b c", None, "src1", 5),
        (4, "word " * 30_000, "de", None, 150_000), (5, "x" * 100_000, "fr", "src2", 100_000), (6, "idiot\n\n▁ 😀 token = abcdefabcdef0123456789", "es", "src3", 1),
    ]
    return spark.createDataFrame([] if empty else [(*r, "f", "r", "k") for r in rows], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{FOLDER}/labels.parquet")


OPERATORS = {
    "pii": lambda d, _: pii.personal_data(d),
    "mixing": lambda d, _: mixing.mixture(d),
    "take": lambda d, _: mixing.take(d),
    "bpe": lambda d, _: piece_bpe.encode_digests(d, queries.piece_model()),
    "shards": lambda d, _: sharding.shards(d),
    "simhash": lambda d, _: simhash.near_duplicates(d),
    "keep_one": lambda d, _: simhash.keep_one(d),
    "secrets": lambda d, _: secrets.secrets(d),
    "redacted": lambda d, _: secrets.redacted(d),
    "media": lambda d, _: media.document_media(d),
    "quality": lambda d, y: quality.quality(d, y),
    "toxicity": lambda d, y: toxicity.toxicity(d, y),
    "without_toxic": lambda d, y: toxicity.without_toxic(d, y),
}
SUBSETS = {"take", "keep_one", "without_toxic"}


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_tables(spark, labels, name):
    got = OPERATORS[name](awkward(spark), labels)
    rows = got.collect()
    assert 0 < len(rows) <= 60 if name in SUBSETS else len(rows) == 8
    if name in SUBSETS:
        assert got.columns == awkward(spark).columns
    elif "slot" not in got.columns:  # repeated rows have repeated results
        twins = [tuple(r) for r in rows if r.doc_id == 3]
        assert len(twins) == 2 and twins[0] == twins[1]
    assert OPERATORS[name](awkward(spark, empty=True), labels.limit(0)).collect() == []


CLASHING = ("doc_id__", "text_hash__", "digest", "spans", "id", "of", "salt", "copies", "domain", "label", "node", "passes", "entry", "list", "nth")


@pytest.mark.parametrize("name", sorted(SUBSETS | {"redacted"}))
def test_clashing_columns_pass_through(spark, labels, name):
    own = awkward(spark).drop("fp", "row", "key")
    wide = own.select("*", *[F.lit(c).alias(c) for c in CLASHING])
    got = OPERATORS[name](wide, labels)
    assert got.columns == wide.columns and all(r[c] == c for r in got.collect() for c in CLASHING)


def test_base_spans_are_the_patterns():
    email, ip = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card, phone = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

    def brute(t):
        digits = lambda m: re.sub(r"\D", "", m[0])
        out = [(m.start(), 0, m.end()) for m in email.finditer(t)] + [(m.start(), 1, m.end()) for m in ip.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
        out += [(m.start(), 2, m.end()) for m in card.finditer(t) if 14 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
        return sorted(out + [(m.start(), 3, m.end()) for m in phone.finditer(t) if 10 <= len(digits(m)) <= 15])

    rng = random.Random(3)
    for _ in range(4000):
        t = "".join(rng.choice(" 0123456789.-+@()abA%_é") for _ in range(rng.randint(0, 60)))
        assert pii.base_spans(t) == brute(t)


def test_skip_chain_carries_a_label():
    field = pii.Field({"n11+=3": 50, "n10=-1": 30, "n10=3": 2, "same=1": 400})
    text = "call +1 (974) 555-3436 now. " + "word " * 200 + "Again: 9745553436. Other: 1112223334"
    base, spans = pii.find(text, field)
    assert [text[a:b] for a, _, b in spans if (a, _, b) not in base] == ["9745553436"]


def test_held_out_links_are_learnt(spark):
    d = spark.createDataFrame([(1, "4845168114407329 and 4845 1681 1440 7329 word +1 (974) 555-3436 or 9745553436"), (2, None)], "doc_id long, text string")
    assert {k: v for k, v in pii.counted(d).items() if k.split("=")[0] in pii.PRIOR} == {"same=1": 1}


def brute_like(a, b):
    one_less = lambda x: {x[:k] + x[k + 1 :] for k in range(len(x))}
    changed = len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1
    return changed or b in one_less(a) or a in one_less(b)


def test_like_numbers():
    rng = random.Random(8)
    for _ in range(3000):
        a = "".join(rng.choice("012") for _ in range(rng.randint(1, 6)))
        b = "".join(rng.choice("012") for _ in range(rng.randint(1, 6)))
        assert pii.is_like(a, b) == brute_like(a, b), (a, b)
    for _ in range(300):  # the halves find every pair of longer numbers
        a = "".join(rng.choice("0123456789") for _ in range(rng.randint(10, 16)))
        k = rng.randrange(len(a))
        b = rng.choice([a[:k] + str((int(a[k]) + 1) % 10) + a[k + 1 :], a[:k] + a[k + 1 :], a[:k] + "5" + a[k:]])
        if len(b) >= 10:
            assert pii.skips([(0, 1, -1, "n", a), (2, 3, -1, "n", b)]), (a, b)


def test_field_marginals_by_enumeration():
    """Messages are exact where links make no loop, and near where they do."""
    field = pii.Field({"n11+=3": 50, "n10=-1": 30, "n16=-1": 9, "n16L=2": 20, "same=1": 4})
    for keys, loops in ((["12345678", "12345678", "7777777"], False), (["1234567890", "12345678", "1234567890", "1234567899", "12345678"], True)):
        found = [(30 * k, 30 * k + 10, 3 if k == 0 else -1, "n11+" if k == 0 else "n10", key) for k, key in enumerate(keys)]
        links = pii.skips(found)
        for k in range(len(found) - 1):
            links.setdefault((k, k + 1), "near")
        total = np.zeros((len(found), 5))
        for y in np.ndindex(*[5] * len(found)):
            if y[0] == 4:
                w = np.exp(sum(field.potential[m[3]][v] for m, v in zip(found[1:], y[1:]))) * np.prod([field.link[link][y[a], y[b]] for (a, b), link in links.items()])
                for k, v in enumerate(y):
                    total[k, v] += w
        want = total / total.sum(1, keepdims=True)
        assert np.abs(field.marginals(found) - want).max() < (0.12 if loops else 1e-3)


def test_personal_data_is_its_parts(spark, docs):
    """Counts, digest and spans of every document from the patterns and the field."""
    field = pii.Field(pii.counted(docs))
    for r in pii.personal_data(docs).join(docs, "doc_id").collect():
        base, spans = pii.find(r.text or "", field)
        told = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == n for _, k, _ in base) for n in range(4)]
        assert r.base_sha256 == hashlib.sha256(told.encode()).hexdigest() and set(base) <= set(spans) and r.spans == pii.joined(spans)


def test_many_names_and_numbers_are_linear():
    began = time.time()
    pii.find(" ".join(f"name{k}x@site.example.com" for k in range(20_000)) + " 4845168114407329" * 20_000, pii.Field({}))
    assert time.time() - began < 10


def test_search_finds_most(spark):
    e = spark.read.parquet(f"{FOLDER}/embeddings.parquet")
    extra = spark.createDataFrame([(900_000, [0.0] * 64), (900_020, None), (900_040, [float("nan")] * 64)], "vec_id long, embedding array<float>")
    got = ann.search(e.select("vec_id", "embedding").unionByName(extra), F.col("vec_id") % 20 == 0).toPandas()
    p = e.toPandas()
    x, ids = np.array(p.embedding.tolist(), dtype=float), p.vec_id.to_numpy()
    hits = total = 0
    for q, g in got.groupby("query_id"):
        scores = x @ x[np.flatnonzero(ids == q)[0]]
        want = [i for i in ids[np.lexsort((ids, -scores))] if i != q][:20]
        hits, total = hits + len({*want} & {*g.vec_id}), total + 20
        assert g["rank"].tolist() == list(range(1, 21))
    assert hits / total >= 0.9 and not got.query_id.isin([900_000, 900_020, 900_040]).any()


def test_search_ties_and_few(spark):
    e = spark.createDataFrame([(k, [1.0, 0.0]) for k in range(40)] + [(50, [0.5, 0.0])], "vec_id long, embedding array<float>")
    got = ann.search(e, F.col("vec_id") == 20).orderBy("rank").collect()
    assert [r.vec_id for r in got] == list(range(20))
    assert ann.search(e.limit(0), F.col("vec_id") == 20).collect() == []


def test_search_takes_every_row(spark):
    """Repeated rows once, a vec_id with two vectors as two rows, shorter vectors filled up, clashing columns left alone."""
    rows = [(1, [1.0, 0.0]), (1, [0.5, 0.0]), (2, [0.5, 0.5]), (2, [0.5, 0.5]), (3, [2.0]), (4, None), (5, [0.0, 0.0]), (None, [1.0, 1.0])]
    d = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], "vec_id long, embedding array<double>, entry string, list string, asks string")
    got = sorted(tuple(r) for r in ann.search(d, F.col("vec_id") == 1).collect())
    # of [1, 0]: 2.0 with 3, 0.5 with the other 1 and with 2; of [0.5, 0]: 1.0 with 3, 0.5 with the other 1, 0.25 with 2
    assert got == sorted([(1, 1, 3, 2.0), (1, 2, 1, 0.5), (1, 3, 2, 0.5), (1, 1, 3, 1.0), (1, 2, 1, 0.5), (1, 3, 2, 0.25)])


def test_lists_are_packed():
    first, pieces = ann.packed(np.array([5000, 3000, 500, 20_000, 0, 9000, 10]))
    assert first.tolist() == [0, 0, 1, 2, 4, 5, 7] and pieces.tolist() == [1, 1, 1, 3, 1, 2, 1]


def test_mixture_is_its_sql(spark, docs):
    got = mixing.mixture(docs)
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{FOLDER}/documents.parquet'")
    want = c.sql(mixing.oracle_sql())
    at = [want.columns.index(n) for n in got.columns]
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(repr(tuple(r[k] for k in at)) for r in want.fetchall())


def test_encoding_is_the_library():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=queries.piece_model())
    bpe, rng = piece_bpe.load(queries.piece_model()), random.Random(5)
    for _ in range(3000):
        t = "".join(rng.choice(" aeiothrn\n\t$#é▁漢😀\x00　ab_-.=/()<s>") for _ in range(rng.randint(0, 50)))
        ids = bpe.encode(t)
        assert ids == sp.encode(t, add_eos=True) and bpe.decode(ids) == sp.decode(ids)


def test_encoded_digests_are_the_library(spark, monkeypatch):
    """The query's path, which remembers words, against the library; with little memory too."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=queries.piece_model())
    sha = lambda t: hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest()
    rng = random.Random(6)
    texts = ["".join(rng.choice(" aeiothrn\n\t$#é▁漢😀\x00　ab_-.=/()<s>⁇") for _ in range(rng.randint(0, 80))) for _ in range(4000)]
    texts += [r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()] + ["", " a", "a  b", "漢" * 70 + " " + "x" * 70]
    for most in (250_000, 50):
        monkeypatch.setattr(piece_bpe, "REMEMBERED", most)
        piece_bpe._digests.cache_clear()
        work = piece_bpe._digests(queries.piece_model())
        for a in range(0, len(texts), 256):
            for t, n, ids_sha, back_sha in zip(texts[a:], *work(texts[a : a + 256])):
                ids = sp.encode(t, add_eos=True)
                assert (n, ids_sha, back_sha) == (len(ids), sha(" ".join(map(str, ids))), sha(sp.decode(ids))), t
    piece_bpe._digests.cache_clear()


def test_shards_have_sizes_and_sums(docs):
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = sharding.shards(docs).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "rows", None)


def test_shuffle_is_uniform(spark):
    """Over 20 seeds, each of 24 rows (some of them equal) is in each of 4 shards, and in each place of a shard, about as often."""
    d = spark.createDataFrame([(k // 2, "same") for k in range(24)], "doc_id long, text string")
    shard, slot = np.zeros((12, 4)), np.zeros((12, 6))
    for seed in range(20):
        for r in sharding.shards(d, 4, seed).collect():
            shard[r.doc_id, r.shard] += 1
            slot[r.doc_id, r.slot] += 1
    assert (shard.sum(0) == 20 * 6).all() and ((shard - 10) ** 2 / 10).sum() < 75 and ((slot - 20 / 3) ** 2 / (20 / 3)).sum() < 110


def test_one_row_repeated_is_dealt_out(spark):
    got = sharding.shards(spark.range(20_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("x").alias("text"))).toPandas()
    assert got.groupby("shard").size().tolist() == [2500] * 8 and (got.groupby("shard").slot.nunique() == 2500).all()


def test_shards(docs):
    rows = sharding.shards(docs).toPandas()
    sizes = rows.groupby("shard").slot.agg(["count", "min", "max", "nunique"])
    assert sizes["count"].max() - sizes["count"].min() <= 1 and (sizes["nunique"] == sizes["count"]).all() and (sizes["max"] == sizes["count"] - 1).all()


def test_matrix_has_exact_margins_and_the_right_mean():
    sizes = [100, 0, 37, 263]
    got = np.array([sharding.matrix(sizes, 8, s) for s in range(300)])
    assert (got.sum(2) == sizes).all() and (got.sum(1) == 50).all()
    assert abs(got[:, 0, 0].mean() - 100 / 8) < 0.6 and abs(got[:, 0, 0].var() - 100 * (1 / 8) * (7 / 8) * 300 / 399) < 2


@pytest.mark.parametrize("pairs", [32, 1])
def test_components(spark, docs, monkeypatch, pairs):
    """With every block in the lists of one-bit changes too."""
    monkeypatch.setattr(simhash, "BLOCK_PAIRS", pairs)
    texts = {r.doc_id: r.text for r in docs.collect()}
    ids = sorted(texts)
    prints = np.array([simhash.fingerprint(texts[i]) & (2**64 - 1) for i in ids], dtype=np.uint64)
    least = dict(zip(ids, ids))
    changed = True
    while changed:
        changed = False
        for k, i in enumerate(ids):
            near = min(least[ids[j]] for j in np.flatnonzero(np.bitwise_count(prints ^ prints[k]) <= 2))
            changed, least[i] = changed or near < least[i], min(near, least[i])
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()} == least


def test_near_copies_leave_one(spark):
    rng = random.Random(1)
    base = [f"w{rng.randint(0, 5000)}" for _ in range(300)]
    copies = [base[:k] + ["changed"] + base[k + 1 :] for k in (10, 100, 200)]
    other = [f"v{rng.randint(0, 5000)}" for _ in range(300)]
    d = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate([other, *copies, base])], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_one(d).collect()) == [0, 1]


def test_recurring_ids_join_no_groups(spark):
    """doc_id 5 has texts A and B, 10 to 20 have B; 30 recurs with texts of its own."""
    rng = random.Random(2)
    a, b, *own = [" ".join(f"w{rng.randint(0, 9000)}" for _ in range(80)) for _ in range(12)]
    rows = [(5, a), (5, b), (5, b)] + [(k, b) for k in range(10, 21)] + [(30, t) for t in own]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in simhash.keep_one(d).collect()) == sorted([(5, a), (5, b), *((30, t) for t in own)])


def test_near_copies_by_kind_of_edit(spark):
    """Texts alike to just over 0.8 by five-word shingles are one group whatever the edit, texts just under it are two."""
    rng = random.Random(4)
    words = lambda n: [f"w{rng.randint(0, 10**6)}" for _ in range(n)]
    rows, want = [], set()
    for k in range(240):
        base = words(300)
        kept = k % 8 < 4
        if k % 4 == 0:
            other = base + words(72 if kept else 78)  # 296 of 368, of 374
        elif k % 4 == 1:
            other = base[: 241 if kept else 236]  # 237 of 296, 232
        elif k % 4 == 2:
            other = base[:100] + words(28 if kept else 34) + base[128 if kept else 134 :]  # 264 of 328, 258 of 334
        else:
            other = base.copy()
            for at in range(10, 10 + 25 * (6 if kept else 7), 25):
                other[at] = words(1)[0]  # 266 of 326, 261 of 331
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(other))]
        want |= {2 * k} if kept else {2 * k, 2 * k + 1}
    got = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert want <= got and len(got - want) <= 2


@pytest.mark.parametrize("seed", [2365, 4996])
def test_near_copies_are_found_by_fingerprint(spark, seed):
    """Two texts alike to just over 0.8 whose fingerprints agree in a block; 24 bands of 6 least shingle values find neither pair."""
    rng = random.Random(seed)
    words = lambda n: [f"w{rng.randint(0, 10**6)}" for _ in range(n)]
    base = words(300)
    if seed % 4 == 1:
        other = base[:241]
    else:
        other = base + words(72)
    d = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(other))], "doc_id long, text string")
    assert [r.doc_id for r in simhash.keep_one(d).collect()] == [1]


@pytest.mark.parametrize("most", [4000, 20])
def test_near_blocks_are_all_pairs_that_agree_in_a_block(spark, monkeypatch, most):
    """In blocks of one slice and of several; nodes that are near none have no block."""
    monkeypatch.setattr(simhash, "SLICE", most)
    prints = wide_prints(300, 8)
    for k in range(60):  # one block of sixty
        prints[k][0] = prints[k][0] & ~0xFFFF
    masks = simhash.block_masks(300)
    near = lambda x, y: sum(((a ^ b) & (2**64 - 1)).bit_count() for a, b in zip(x, y)) <= simhash.WIDE_BITS
    agree = lambda x, y: any(not any((a ^ b) & m for a, b, m in zip(x, y, mask)) for mask in masks)
    want = [(i, j) for i in range(300) for j in range(i) if near(prints[i], prints[j]) and agree(prints[i], prints[j])]
    nodes = spark.createDataFrame(list(enumerate(prints)), "node long, fp array<long>")
    got = {r.node: {*r.blocks} for r in simhash.near_blocks(nodes).collect()}
    assert len(want) > 100 and {*got} == {i for pair in want for i in pair} and all(got[i] & got[j] for i, j in want)


def test_blocks_for_any_number_of_nodes():
    for n, bits, least in [(0, 8, 32), (256_000, 8, 32), (256_001, 9, 39), (10**9, 20, 250)]:
        masks = simhash.block_masks(n)
        assert len(masks) >= least and {sum((w & (2**64 - 1)).bit_count() for w in m) for m in masks} == {bits}
        assert (1 - (1 - simhash.DIFFERING) ** bits) ** len(masks) <= simhash.MISSED


def components_of(links):
    least = {}
    find = lambda x: x if least.setdefault(x, x) == x else find(least[x])
    for a, b in links:
        a, b = sorted((find(a), find(b)))
        least[b] = a
    return {x: find(x) for x in least}


@pytest.mark.parametrize("n", [0, 400])
def test_contracted_links_join_the_same(spark, n):
    """Stars with shared members, links in chains, repeated links; and none at all."""
    rng = random.Random(7)
    links = [(rng.randrange(5), 10 + rng.randrange(100)) for _ in range(n)] + [(200 + k, 201 + k) for k in range(n // 20)] + [(300 + k % 3, 310 + k % 40) for k in range(n)]
    got = [(r.a, r.b) for r in components.contracted(spark.createDataFrame(links, "a long, b long")).collect()]
    assert components_of(got) == components_of(links)
    assert all(a < b for a, b in got) and len({*got}) == len(got) <= len(components_of(links)) + 10


def wide_prints(n, seed=3):
    """Families of fingerprints at 2 to 50 bits from a common one, and unrelated ones."""
    rng = np.random.default_rng(seed)
    bits = [rng.integers(0, 2, 256)]
    for k in range(1, n):
        new = rng.integers(0, 2, 256) if k % 20 == 0 else bits[k - 1 - k % 20 if k % 20 else k].copy()
        if k % 20:
            new[rng.choice(256, rng.integers(2, 50), replace=False)] ^= 1
        bits.append(new)
    return [np.packbits(b, bitorder="little").view("<i8").tolist() for b in map(lambda b: b.astype(np.uint8), bits)]


def test_wide_groups_are_all_pairs_of_blocks(spark):
    prints = wide_prints(300)
    raw = [np.array(p, dtype="<i8").tobytes() for p in prints]
    near = lambda i, j: sum((x ^ y).bit_count() for x, y in zip(raw[i], raw[j])) <= simhash.WIDE_BITS
    meet = lambda i, j: any(all(raw[i][k] == raw[j][k] for k in simhash.block_bytes(t)) for t in range(simhash.BLOCKS))
    want = components_of((i, j) for i in range(300) for j in range(i) if near(i, j) and meet(i, j))
    nodes = spark.createDataFrame(list(enumerate(prints)), "node long, fp array<long>")
    assert len(want) > 30 and {r.node: r.label for r in simhash.wide_groups(nodes).collect()} == want


def test_wide_groups_of_large_blocks(spark, monkeypatch):
    """Three families far from each other in one hot block: members far from the least go on to smaller blocks."""
    monkeypatch.setattr(simhash, "BLOCK_PAIRS", 4)
    rng = np.random.default_rng(5)
    families = []
    for _ in range(3):
        base = rng.integers(0, 256, 32).astype(np.uint8)
        base[[0, 5, 13]] = 7
        for k in range(30):
            one = base.copy()
            one[1 + k % 4] ^= 1 + k
            families.append(one.view("<i8").tolist())
    nodes = spark.createDataFrame(list(enumerate(families)), "node long, fp array<long>")
    assert {r.node: r.label for r in simhash.wide_groups(nodes).collect()} == {k: k // 30 * 30 for k in range(90)}


def test_wide_groups_of_a_block_of_thousands(spark, monkeypatch):
    """As brute force in blocks of 2,000: near and not near the least, families and their fringes, more than one page."""
    monkeypatch.setattr(simhash, "PAGE", 300)
    monkeypatch.setattr(simhash, "WIDE_BITS", 36)
    rng = np.random.default_rng(11)
    bits = rng.integers(0, 2, (5, 256), dtype=np.uint8).repeat(400, 0) ^ (rng.random((2000, 256)) < rng.uniform(0.03, 0.13, (2000, 1)))
    raw = np.packbits(bits.astype(np.uint8), axis=1, bitorder="little")
    raw[:, [0, 5, 13]] = 7
    raw = raw[rng.permutation(2000)]
    words = raw.view("<u8")
    near = [(i, int(j)) for i in range(2000) for j in np.flatnonzero(np.bitwise_count(words[:i] ^ words[i]).sum(1) <= simhash.WIDE_BITS)]
    nodes = spark.createDataFrame(list(enumerate(raw.view("<i8").tolist())), "node long, fp array<long>")
    got = {r.node: r.label for r in simhash.wide_groups(nodes).collect()}
    assert got == components_of(near) and len(near) > 10_000


def test_a_page_gives_no_more_links_than_join_its_labels():
    """The same groups of labels as all pairs of the page, of which there are many more; pairs that share a lesser key are another page's."""
    rng = np.random.default_rng(13)
    bases, prints = rng.integers(-(2**62), 2**62, (4, 100)), rng.integers(-(2**62), 2**62, (4, 4))
    rows = []
    for node in range(200):
        shingles = bases[node % 4].copy()
        shingles[rng.choice(100, rng.integers(0, 14), replace=False)] = rng.integers(-(2**62), 2**62, 1)
        rows.append((9, node, prints[node % 4] ^ (1 << int(rng.integers(0, 60))), node if node % 20 else 0, [9] if node % 3 else [5, 9], np.unique(shingles), node % 20 > 0))
    page = pd.DataFrame(rows, columns=["key", "node", "fp", "label", "keys", "set", "other"])
    pairs = []
    for i, a in enumerate(page.itertuples()):
        for b in page.iloc[:i].itertuples():
            shared = len({*a.set} & {*b.set})
            if a.label != b.label and (a.node % 3 or b.node % 3) and a.node % 4 == b.node % 4 and 5 * shared >= 4 * (len(a.set) + len(b.set) - shared):
                pairs.append((a.label, b.label))
    want = components_of(pairs)
    got = [*simhash.page_links(page[page["other"]], page, simhash.WIDE_BITS).itertuples(index=False, name=None)]
    assert components_of(got) == want and all(a < b for a, b in got)
    assert len(got) == len(want) - len({*want.values()}) < len(pairs) / 10


def test_secrets_link_parts(spark):
    d = spark.createDataFrame([(1, "ID ABCD1234EFGH5678 near token = abcdefabcdef0123456789"), (2, "ID ABCD1234EFGH5678 alone"), (3, "token=secret: abcdefghijklmnop")], "doc_id long, text string")
    got = {r.doc_id: (r.n_assign, r.n_hex, r.spans) for r in secrets.secrets(d).collect()}
    assert got == {1: (1, 1, "access:3:19,assign:25:55,hex:33:55"), 2: (0, 0, ""), 3: (0, 0, "")}
    assert [r.text for r in secrets.redacted(d).orderBy("doc_id").collect()][0] == "ID [secret] near [secret]"


def secret_texts(n, seed=4):
    """Texts of parts at all distances, on either side of SCOPE."""
    rng = random.Random(seed)
    part = lambda: rng.choice([
        "ABCD1234EFGH5678", "AKIA" + "Z9" * rng.randint(5, 9), "token = " + "k" * rng.randint(9, 14), "aB3" * rng.randint(7, 12), "0123456789abcdef" * rng.randint(1, 2),
        "https://x.example/y", "API-KEY", "api_key: 'S3CR3T/+=zzzzzzz'", "PassWord=ABCD1234EFGH5678", "é漢😀", "ABCDEFGHIJKLMNOPQR", "x=\"", "token=token=abcdefghijklmnop",
    ])
    return [" ".join(part() + " " + "w" * rng.choice([0, 3, 100, 200, 238, 241]) for _ in range(rng.randint(0, 9))) for _ in range(n)]


def test_base_secrets_are_the_patterns(spark):
    rules = [
        (re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 12),
        (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18), (re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 16),
    ]
    texts = secret_texts(400) + [r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    got = secrets.secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in got:
        base = sorted((m.start(), k, m.end()) for k, (regex, holds) in enumerate(rules) for m in regex.finditer(texts[r.doc_id]) if holds(m))
        told = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert r.base_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == n for _, k, _ in base) for n in range(3)] and set(told.split(",")) <= {*r.spans.split(","), ""}


def test_linked_secrets_are_the_sql(spark):
    """Bins decide as a join of intervals does."""
    d = spark.createDataFrame(list(enumerate(secret_texts(600, 5))), "doc_id long, text string")
    c = duckdb.connect()
    c.register("documents", d.toPandas())
    want = c.sql(secrets.oracle_sql())
    got = secrets.secrets(d)
    rows = got.collect()
    at = [want.columns.index(n) for n in got.columns]
    assert sorted(map(repr, map(tuple, rows))) == sorted(repr(tuple(r[k] for k in at)) for r in want.fetchall())
    assert sum(r.spans.count(",") + bool(r.spans) > r.n_assign + r.n_access + r.n_hex for r in rows) > 30


def test_many_weak_parts_are_linear(spark):
    d = spark.createDataFrame([(1, " ".join(f"ABCD1234EFGH{k:06d}" for k in range(30_000)))], "doc_id long, text string")
    began = time.time()
    assert secrets.secrets(d).first().spans == "" and time.time() - began < 30


def test_masks_cover_all_spans(spark):
    texts = secret_texts(300, 6)
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    every = {r.doc_id: [tuple(map(int, s.split(":")[1:])) for s in r.spans.split(",") if s] for r in secrets.secrets(d).collect()}
    for r in secrets.redacted(d).collect():
        text, out, at = texts[r.doc_id], "", 0
        for a, b in sorted(every[r.doc_id]):
            if a >= at:
                out += text[at:a] + "[secret]"
            at = max(at, b)
        assert r.text == out + text[at:]


def test_media_round_trip_and_order():
    for n in (0, 1, 191, 192, 193, 5000):
        payload = media.padded(bytes(k % 251 for k in range(n)))
        assert len(payload) % 192 == 0 and payload and media.from_png(media.to_png(payload))[2] == payload
    page = "<p>one <b>two</b></p><script>x</script><figure><img src='sha256:ab' alt='z'><figcaption>told &amp; so</figcaption></figure>three<img src=sha256:cd alt=q>"
    assert media.parse(page) == [(0, "text", "one two", None, None), (1, "image", None, "ab", "told & so"), (2, "text", "three", None, None), (3, "image", None, "cd", "q")]


def test_captions_are_never_lost():
    parse = lambda page: [(k, t, d, c) for _, k, t, d, c in media.parse(page)]
    assert parse("<figure><figcaption>first</figcaption><img src=sha256:ab></figure>") == [("image", None, "ab", "first")]
    assert parse("<figure><figcaption>table</figcaption><table><td>1</table></figure>a") == [("text", "table", None, None), ("text", "1", None, None), ("text", "a", None, None)]
    assert parse("<figcaption>loose</figcaption>a<figure><img src=x><figcaption>open") == [("text", "loose", None, None), ("text", "a", None, None), ("image", None, "x", "open")]


@pytest.mark.parametrize("piece", ["<!--", '<a "', "<script>", "<a href='", "<figure><figcaption>x", "<", "<a ='"])
def test_open_pages_are_linear(piece):
    began = time.time()
    media.parse(piece * (1_000_000 // len(piece)))
    assert time.time() - began < 3


def test_pages_are_read_in_order(spark):
    """Items of the given pages against the standard library's parser: same words in the same order, same references."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__()
            self.words, self.media, self.skip = [], 0, 0

        def handle_starttag(self, tag, attrs):
            self.skip += tag in ("script", "style")
            self.media += tag in media.MEDIA

        def handle_endtag(self, tag):
            self.skip -= tag in ("script", "style")

        def handle_data(self, data):
            if not self.skip:
                self.words.append(data)

    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    own = {r.page_id: r.html for r in pages.collect()}
    rows = media.sequences(media.items(pages, "page_id"), "page_id").collect()
    assert len(rows) > 10
    for r in rows:
        reader = Reader()
        reader.feed(own[r.page_id])
        reader.close()
        assert [i.pos for i in r.sequence] == list(range(len(r.sequence)))
        assert "".join("".join(i.text or "" for i in r.sequence if i.kind == "text").split()) == "".join("".join(reader.words).split())
        assert sum(i.kind != "text" for i in r.sequence) == reader.media


def test_document_media_by_brute_force(spark, docs):
    texts = [r.text for r in docs.limit(150).collect()] + [None, "", "a & <b>\n\n c", "same", "same", "x" * 192, "x" * 193]
    got = {r.doc_id: r for r in media.document_media(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for k, text in enumerate(texts):
        data = (text or "").encode()
        payload = data + b" " * (-len(data) % 192 or 192 * (not data))
        x = np.frombuffer(payload, dtype=np.uint8)
        lines = [" ".join(line.split()) for line in (text or "").split("\n")]
        half = len(lines) // 2
        png = media.to_png(payload)
        r = got[k]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (r.media_bytes, r.media_sha256) == (len(png), hashlib.sha256(png).hexdigest())
        assert r.feature.startswith(f"64x{len(payload) // 192};mean={','.join(str(int(x[c::3].astype(int).sum()) * 1000 // (len(x) // 3)) for c in range(3))};")
        assert (r.n_items, r.media_pos, r.caption) == (1 + sum(map(bool, lines)), sum(map(bool, lines[:half])), f"{len(data)} bytes")


def test_references_stay_in_place(spark):
    """Two references to one payload, one to none: positions and captions hold, what is not there is null."""
    store = media.described(media.stored(spark.createDataFrame([("ab", "text")], "digest string, text string"), "digest"), "digest")
    pages = spark.createDataFrame([(1, "a<img src=sha256:ab alt=one>b<img src=sha256:zz><figure><img src=sha256:ab><figcaption>two</figcaption></figure>")], "page_id long, html string")
    found = media.sequences(media.resolved(media.items(pages, "page_id"), store), "page_id").first().sequence
    assert [(i.pos, i.kind, i.text, i.caption, i.payload_bytes) for i in found] == [
        (0, "text", "a", None, None), (1, "image", None, "one", 192), (2, "text", "b", None, None), (3, "image", None, None, None), (4, "image", None, "two", 192)
    ]


def test_chains_at_once_are_chains_by_themselves():
    rng = np.random.default_rng(3)
    sizes, p = [5, 1, 9, 3], rng.normal(size=(2, 2))
    good, there = np.zeros((4, 9)), np.zeros((4, 9), dtype=bool)
    total = np.zeros((2, 2))
    for k, n in enumerate(sizes):
        good[k, :n], there[k, :n] = rng.normal(size=n), True
    q, pairs = quality.chain_marginals(good, there, p)
    for k, n in enumerate(sizes):
        one, own = quality.marginals(good[k, :n], p)
        total += own
        assert np.allclose(q[k, :n], one)
    assert np.allclose(pairs, total)


def test_marginals_by_enumeration():
    rng = np.random.default_rng(2)
    good, pairs = rng.normal(size=5), rng.normal(size=(2, 2))
    weights = np.zeros((5, 2))
    for k in range(32):
        y = [k >> t & 1 for t in range(5)]
        w = np.exp(sum(g for g, v in zip(good, y) if v) + sum(pairs[a, b] for a, b in zip(y, y[1:])))
        for t, v in enumerate(y):
            weights[t, v] += w
    assert np.allclose(quality.marginals(good, pairs)[0], weights[:, 1] / weights.sum(1))


def test_segments_are_maximal():
    assert toxicity.segments([4, -5, 3, -3, 1, 2, -2, 2, -2, 1, 5]) == [(0, 1, 4.0), (2, 3, 3.0), (4, 11, 7.0)]


def test_segments_by_brute_force():
    """Each maximal segment holds no better part and no segment around it is better (Ruzzo and Tompa's definition, checked on all pairs)."""
    rng = random.Random(12)
    for _ in range(200):
        scores = [rng.choice([-3, -2, -1, 1, 2, 3]) for _ in range(rng.randint(0, 12))]
        sums = np.concatenate(([0], np.cumsum(scores)))
        proper = lambda a, b: all(sums[a] < sums[k] for k in range(a + 1, b + 1)) and all(sums[k] < sums[b] for k in range(a, b))
        good = {(a, b) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1) if proper(a, b)}
        want = sorted((a, b) for a, b in good if not any((c, d) != (a, b) and c <= a and b <= d for c, d in good))
        assert [(a, b) for a, b, _ in toxicity.segments(scores)] == want


def test_extreme_values_are_calibrated():
    """Of texts of ordinary tokens, about the TAIL that the calibration is set at come under it."""
    rng = np.random.default_rng(5)
    model = toxicity.Model()
    best = lambda n: max((s for _, _, s in toxicity.segments(rng.normal(-0.7, 0.5, n).tolist())), default=0.0)
    usual, sizes = np.array([best(200) for _ in range(1500)]), np.log(np.full(1500, 200.0))
    model.rate, model.log_k = toxicity.calibrated(usual, sizes)
    share = np.mean([model.chance(best(200), 200) < toxicity.TAIL for _ in range(1500)])
    assert 0.002 < share < 0.03


@pytest.mark.parametrize(("find", "label", "least"), [(quality.quality, "quality", 0.9), (toxicity.toxicity, "toxic", 0.9)])
def test_held_out(spark, find, label, least):
    folder = FOLDER.replace("0.001", "0.1")
    y = spark.read.parquet(f"{folder}/labels.parquet")
    got = find(spark.read.parquet(f"{folder}/documents.parquet"), y).join(y, "doc_id").where("held_out").toPandas()
    assert (got.predicted == got[label]).mean() >= least


def test_pipeline_by_brute_force(spark, tmp_path):
    """All five stages on a fixture with planted near copies, secrets and toxic texts, each held against plain Python over what came in."""
    import corpus_pipeline
    import sentencepiece

    folder, rng = str(tmp_path), random.Random(21)
    real = [r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect() if r.text]
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in real]
    base = [f"w{rng.randint(0, 9**6)}" for _ in range(200)]
    for k in range(5):
        near = base[: 40 * k] + ["other"] + base[40 * k + 1 :]
        rows.append((1_000_000 + k, " ".join(near), "en", "src1", 9))
    rows.append((2_000_000, "the word token = abcdefabcdef0123456789 and more", "en", "src2", 9))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{FOLDER}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        assert k == len(corpus_pipeline.STAGES) - 1 or out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        seen.append(docs.collect())

    scores = toxicity.toxicity(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")).collect()
    rejected = {r.doc_id for r in scores if r.predicted}
    assert sorted(r.doc_id for r in seen[0]) == sorted(r[0] for r in rows if r[0] not in rejected) and len(rejected) < 0.3 * len(rows)

    def shingles(text):
        words = text.encode().lower().split()
        return {b" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()

    kept_in = {r.doc_id: shingles(r.text) for r in seen[0]}
    ids = sorted(kept_in)
    alike = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if 5 * len(kept_in[a] & kept_in[b]) >= 4 * len(kept_in[a] | kept_in[b])]
    label = components_of(alike)
    want = {i for i in ids if label.get(i, i) == i}
    got = {r.doc_id for r in seen[1]}
    assert want <= got and len(got - want) <= 1 and len(got & set(range(1_000_000, 1_000_005))) == 1

    by_id = {r.doc_id: r for r in seen[1]}
    assert {r.doc_id for r in seen[2]} == set(by_id)
    masked = [r for r in seen[2] if r.text != by_id[r.doc_id].text]
    assert all("[secret]" in r.text and r.n_chars == len(r.text) for r in masked) and any(r.doc_id == 2_000_000 and r.text == "the word [secret] and more" for r in masked)
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{folder}/2/*.parquet'")
    copies = {r[0]: r[1] for r in c.sql(f"select doc_id, copies from ({mixing.oracle_sql()})").fetchall() if r[1]}
    text_of = {r.doc_id: r.text for r in seen[2]}
    taken = Counter(r.doc_id for r in seen[3])
    assert taken == copies and all(r.text == text_of[r.doc_id] for r in seen[3])
    sp = sentencepiece.SentencePieceProcessor(model_file=queries.piece_model())
    assert Counter(r.doc_id for r in seen[4]) == copies
    for r in seen[4]:
        encoded = sp.encode(text_of[r.doc_id], add_eos=True)
        assert (r.n_tokens, r.ids_sha256) == (len(encoded), hashlib.sha256(" ".join(map(str, encoded)).encode()).hexdigest())


def test_pipeline_runs(spark):
    import corpus_pipeline

    got = corpus_pipeline.run(spark, FOLDER).toPandas()
    texts = {r.doc_id for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    assert len(got) and set(got.doc_id) <= texts
