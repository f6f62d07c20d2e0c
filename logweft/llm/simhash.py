"""SimHash near-duplicates: pigeonhole blocks, join on blocks, verified Hamming distance, components.

A text's fingerprint: A-Z lower-cased, words [^\\x20\\x09-\\x0D]+, shingles of consecutive words joined by a space
(repeats included; fewer words than a shingle holds: the whole sequence), XXH64 with seed 42 of each; a bit is 1 if it
is set in over half of the hashes. No word: fingerprint zero, linked like any other.

Fingerprints are cut into four blocks of 16 bits. Two that differ in at most two bits agree in at least two whole
blocks, so all such pairs meet in one of the six joins on two blocks. Equal fingerprints are one node from the
start, so copies make no pairs. Where more than BLOCK_PAIRS fingerprints share a key, they are not paired: each lists
the remaining bits and all their one-bit changes, and is linked to the least fingerprint on each list entry. Two
fingerprints share an entry just if they differ in at most two bits, so components are the same, in linear size.

Near copies that share four fifths of their shingles differ in more bits than blocks of 64 can find, so keep_one(),
which leaves one document of each group, takes 256-bit fingerprints of distinct five-word shingles. They differ in about 39 bits,
so blocks are short (8 bits, and a bit more each time the nodes double beyond 256,000) and many, and in each block the fingerprints are
compared with one another. What is within WIDE_BITS bits there is then compared shingle by shingle.

Null text counts as empty. A null doc_id gets a fingerprint and a component but is never the component's id (which is
null if no other id is there). Repeated rows give repeated rows. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField

from logweft.llm.common import cut, free_name, map_texts
from logweft.llm.components import components, contracted

BITS = 2
SHINGLE = 3
#: Fingerprints that may share a key before lists of one-bit changes take the place of pairs.
BLOCK_PAIRS = 32


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """As a signed 64-bit number."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    parts = [words[k:] for k in range(shingle)] if len(words) > shingle else [[b" ".join(words)]]
    hashes = np.fromiter((xxhash.xxh64_intdigest(b" ".join(s), 42) for s in zip(*parts)), dtype="<u8")
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    return map_texts(docs, keep, text, lambda: lambda texts: [[fingerprint(t, shingle) for t in texts]], [StructField("fp", LongType())])


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def links(nodes: DataFrame) -> DataFrame:
    """Links (a, b) that join the distinct fingerprints of nodes, column fp, as all pairs within BITS bits would."""
    block = [F.shiftright(F.col("fp"), 16 * k).bitwiseAND(F.lit(0xFFFF)) for k in range(4)]
    pairs = [(i, j) for i in range(4) for j in range(i + 1, 4)]
    keys = F.array(*[
        F.struct(F.lit(n).alias("n"), F.shiftleft(block[i], 16).bitwiseOR(block[j]).alias("key")) for n, (i, j) in enumerate(pairs)
    ])
    placed = nodes.select("fp", F.explode(keys).alias("k")).select("fp", "k.n", "k.key")
    shared = placed.groupBy("n", "key").count().where("count > 1")
    placed = cut(placed.join(shared, ["n", "key"]))

    small = placed.where(F.col("count") <= BLOCK_PAIRS)
    paired = (
        small.withColumnRenamed("fp", "a").join(small.select("n", "key", F.col("fp").alias("b")), ["n", "key"])
        .where((F.col("a") < F.col("b")) & (distance(F.col("a"), F.col("b")) <= BITS)).select("a", "b")
    )
    # bits outside the two blocks of the key, from the least significant
    rest = [[16 * k + t for k in range(4) if k not in p for t in range(16)] for p in pairs]
    changes = F.element_at(F.array(*[F.array(*[F.lit((1 << b) - (1 << 64) * (b == 63)).cast("long") for b in bits]) for bits in rest]), F.col("n") + 1)
    listed = (
        placed.where(F.col("count") > BLOCK_PAIRS)
        .select("n", "key", "fp", F.explode(F.concat(F.array(F.lit(0).cast("long")), changes)).alias("change"))
        .select("n", "key", "fp", F.col("fp").bitwiseXOR(F.col("change")).alias("entry"))
    )
    least = listed.groupBy("n", "entry").agg(F.min("fp").alias("a"), F.count("*").alias("m")).where("m > 1").drop("m")
    starred = listed.join(least, ["n", "entry"]).where((F.col("fp") != F.col("a")) & (distance(F.col("a"), F.col("fp")) <= BITS)).select("a", F.col("fp").alias("b"))
    return paired.unionByName(starred).distinct()


def near_duplicates(docs: DataFrame, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id that links reach) of each row."""
    prints = cut(fingerprints(docs, ("doc_id",), text, shingle))
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    joined = components(links(nodes))
    labels = nodes.join(joined, nodes.fp == joined.node, "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    least = labels.groupBy("label").agg(F.min("least").alias("component_id"))
    of = cut(labels.join(least, "label").select("fp", "component_id"))
    return prints.join(of, "fp").select("doc_id", "fp", "component_id")


#: Wide fingerprints: 64-bit words, blocks of bytes, and bits that candidates may differ in. Two texts whose distinct
#: shingles are alike to 0.8 differ in about 38 of 256 bits (deviation 6), whatever the edit; unrelated ones in 128 (deviation 8).
WORDS, BLOCKS, WIDE_BITS = 4, 48, 72
#: Words of a near copy's shingles, the share of bits in which texts alike to 0.8 differ, and the share of such pairs that may have no block in common.
NEAR_SHINGLE, DIFFERING, MISSED = 5, 0.1515, 5e-5
#: Bits of a block at least, and nodes that it holds on average at most: beyond that it has more bits, and there are more blocks.
BLOCK_BITS, BLOCK_NODES = 8, 1000
#: Nodes of a block that are compared with as many others in a task, and fingerprints of them at one time.
SLICE, PRINTS_AT_ONCE = 4000, 128
#: Bytes of a block, as offsets from its number; the later blocks, numbered from 8 * WORDS, have the second kind.
STEPS = ((0, 5, 13), (0, 3, 14))
#: Rounds that link members of a block to a centre, and nodes to a side of a page in which the pairs that are left are compared.
CENTRES, PAGE = 4, 1000
#: Fixed odd multipliers that make further words of a hash.
MULTIPLIERS = (1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def shingle_hashes(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of each shingle, repeats included."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype="<u8")
    parts = [words[k:] for k in range(shingle)] if len(words) > shingle else [[b" ".join(words)]]
    return np.fromiter((xxhash.xxh64_intdigest(b" ".join(s), 42) for s in zip(*parts)), dtype="<u8")


def wide_bits(hashes: np.ndarray) -> list[int]:
    """A bit is 1 if it is set in over half of the hashes; where just half have it, it is as in the first."""
    mixed = hashes[:, None] * np.array(MULTIPLIERS, dtype="<u8")
    mixed ^= mixed >> np.uint64(29)
    bits = np.unpackbits(mixed.view(np.uint8), axis=1, bitorder="little")
    ones = 2 * sum((bits[at : at + 255].sum(0, dtype=np.uint8).astype(np.int64) for at in range(0, len(bits), 255)), np.zeros(64 * WORDS, dtype=np.int64))
    return np.packbits((ones > len(hashes)) | ((ones == len(hashes)) & bits[:1].any(0)), bitorder="little").view("<i8").tolist()


def wide_fingerprint(text: str, shingle: int = SHINGLE) -> list[int]:
    """WORDS signed 64-bit numbers: SimHash over each shingle's hash, multiplied and mixed once a word."""
    return wide_bits(shingle_hashes(text, shingle))


def sketch(text: str) -> tuple[int, list[int]]:
    """A node for the set of a text's distinct shingles of NEAR_SHINGLE words, and the set's wide fingerprint."""
    hashes = np.unique(shingle_hashes(text, NEAR_SHINGLE))
    return int(np.array(xxhash.xxh64_intdigest(hashes.tobytes()), dtype="<u8").view("<i8")), wide_bits(hashes)


def block_masks(n: int) -> list[list[int]]:
    """The bits of each block for n nodes, as masks of the fingerprint's words.

    Blocks are cut from the bits in a fixed random order, and from further orders once one is used up. There are so many that pairs
    that differ in each bit with probability DIFFERING have none in common with probability MISSED.
    """
    bits = max(BLOCK_BITS, math.ceil(math.log2(max(n, 1) / BLOCK_NODES)))
    most = math.ceil(math.log(MISSED) / math.log1p(-((1 - DIFFERING) ** bits)))
    masks: list[list[int]] = []
    for turn in range(most):
        order = sorted(range(64 * WORDS), key=lambda bit: xxhash.xxh64_intdigest(bit.to_bytes(2, "little"), turn))
        for at in range(0, len(order) - bits + 1, bits):
            chosen = np.zeros(64 * WORDS, dtype=np.uint8)
            chosen[order[at : at + bits]] = 1
            masks.append(np.packbits(chosen, bitorder="little").view("<i8").tolist())
        if len(masks) >= most:
            break
    return masks[:most]


def block_bytes(t: int) -> tuple[int, ...]:
    """Numbers of the bytes that block t holds."""
    n = 8 * WORDS
    return tuple((t + d) % n for d in STEPS[t // n])


def apart(x: Column, y: Column) -> Column:
    """Bits in which two wide fingerprints differ."""
    return sum((F.bit_count(x[w].bitwiseXOR(y[w])) for w in range(1, WORDS)), F.bit_count(x[0].bitwiseXOR(y[0])))


def alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of pairs (a, b) whose sets are alike to 0.8 or more: i shared of m and n, i / (m + n - i) >= 4 / 5."""
    a, b = sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), sets.select(F.col("node").alias("b"), F.col("set").alias("set_b"))
    shared = F.size(F.array_intersect("set_a", "set_b"))
    return pairs.join(b, "b").join(a, "a").where(9 * shared >= 4 * (F.size("set_a") + F.size("set_b"))).select("a", "b")


def page_links(x: pd.DataFrame, y: pd.DataFrame, bits: int) -> pd.DataFrame:
    """Links between labels that join what the near pairs of a page join, one less than the labels that they join.

    Pairs are of the page's nodes x (outside the component of the block's least label) and y; pairs of two such nodes count once.
    Nodes whose labels are already joined are not compared.
    """
    found: list[tuple[int, int]] = []
    if len(x) and len(y):
        fp = np.array(y["fp"].tolist(), dtype="<i8").view("<u8")
        key, node = x["key"].iloc[0], y["node"].to_numpy()
        labels, of_label = np.unique(np.concatenate([x["label"], y["label"]]), return_inverse=True)
        joined, theirs = np.arange(len(labels)), of_label[len(x) :]
        keys, of = np.concatenate(y["keys"].tolist()), np.repeat(np.arange(len(y)), [len(k) for k in y["keys"]])
        inside, sets = ~y["other"].to_numpy(dtype=bool), [np.asarray(s, dtype="<i8") for s in y["set"]]
        size = np.array([len(s) for s in sets])
        for n, f, k, own, s in zip(x["node"], x["fp"], x["keys"], of_label, x["set"]):
            near = np.flatnonzero((joined[theirs] != joined[own]) & (inside | (node > n)))
            near = near[np.bitwise_count(fp[near] ^ np.asarray(f, dtype="<i8").view("<u8")).sum(1) <= bits]
            if len(near):  # not those that share a lesser key, whose block compares them
                near = near[~np.isin(near, of[np.isin(keys, [other for other in k if other < key])])]
            if size.any() and len(near):
                own_set, flat = np.sort(np.asarray(s, dtype="<i8")), np.concatenate([sets[j] for j in near])
                at = np.minimum(np.searchsorted(own_set, flat), len(own_set) - 1)
                shared = np.bincount(np.repeat(np.arange(len(near)), size[near]), own_set[at] == flat, len(near))
                near = near[9 * shared >= 4 * (len(own_set) + size[near])]
            ends, label = theirs[near], int(labels[own])
            once = ends[np.unique(joined[ends], return_index=True)[1]]
            found += [(min(label, other), max(label, other)) for other in labels[once].tolist()]
            joined[np.isin(joined, joined[once])] = joined[own]
    return pd.DataFrame(found, columns=["x", "y"], dtype="int64")


def wide_groups(nodes: DataFrame, blocks: Column | None = None, verifier: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(node, label) of nodes (node, fp) that are linked: label is the least node that links reach.

    Links are all pairs that share a block and differ in at most WIDE_BITS bits. A node's blocks are the array `blocks`; without
    it, BLOCKS blocks of three bytes of the fingerprint each, no two having more than a byte in common. The verifier gets the nodes that
    share a block and gives (node, set); of two nodes that are near, those are linked whose sets are alike to 0.8 or more.

    In each block the node that meets most others in all blocks (the least of them) is linked to those near it, then the
    first of those near no earlier centre to all others near it, while over BLOCK_PAIRS are near no centre, as long as a round gives as many links as it has centres, and for at most
    CENTRES rounds. (Rounds only spare comparisons: what they leave is compared all the same.) The stars of all blocks make components. Only pairs of different components can still change the groups, so these pairs of a block are compared, in pages of about PAGE by PAGE
    nodes, each pair in the block of the least key that it shares; blocks that lie in one component, however large, need none. A page gives
    as many links of labels as join what its pairs join. In the worst case (a block of many texts that are nearly, but not quite, alike) that is a comparison for each pair of a block.
    """
    byte = [F.shiftright(F.element_at("fp", 1 + k // 8), 8 * (k % 8)).bitwiseAND(F.lit(0xFF)) for k in range(8 * WORDS)]
    keys = blocks if blocks is not None else F.array(*[F.xxhash64(F.lit(t), *[byte[k] for k in block_bytes(t)]) for t in range(BLOCKS)])
    nodes = nodes.select("node", "fp", keys.alias("keys"))
    placed = nodes.select("node", "fp", F.explode("keys").alias("key"))
    shared = placed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    # a node that meets many others is likelier to be what they are copies of
    met = placed.select("key", "node").join(shared, "key").groupBy("node").agg(F.sum("n").alias("met"))
    members = cut(placed.join(shared.select("key"), "key").join(met, "node").select("key", "node", "fp", "met"))
    sets = verifier(members.select("node").distinct()) if verifier else None
    verified = (lambda pairs: alike(pairs, sets)) if verifier else lambda pairs: pairs
    links, free = None, members
    for turn in range(CENTRES):
        least = free.groupBy("key").agg(F.min(F.struct(-F.col("met"), "node", "fp")).alias("c"), F.count("*").alias("free"))
        least = cut(least.where((F.col("free") > (0 if links is None else BLOCK_PAIRS)) & (F.col("free") > 1)).select("key", F.col("c.node").alias("least"), F.col("c.fp").alias("least_fp")))
        centres = 0 if links is None else least.count()
        if links is not None and not centres:
            break
        around = free.join(least, "key").where(F.col("node") != F.col("least"))
        near = around.where(apart(F.col("fp"), F.col("least_fp")) <= WIDE_BITS)
        found = cut(verified(near.select(F.col("least").alias("a"), F.col("node").alias("b")).distinct()))
        links = found if links is None else links.unionByName(found)
        if turn == CENTRES - 1 or (centres and found.count() < centres):
            break
        # only those near no centre go on, and only in blocks that had one
        free = cut(around.join(found.select(F.col("a").alias("least"), F.col("b").alias("node")), ["least", "node"], "left_anti").select("key", "node", "fp", "met"))

    labels = components(contracted(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))).select("node", "label")
    members = cut(members.select("key", "node", "fp").join(labels, "node", "left").select("key", "node", "fp", F.coalesce("label", "node").alias("label")))
    # the others of a block: those outside the component of its least label; blocks of one component have none, and of two nodes one was the other's centre
    sizes = members.groupBy("key").agg(F.min("label").alias("own"), F.max("label").alias("last"), F.count("*").alias("n")).where("own <> last and n > 2")
    members = members.join(sizes.select("key", "own", F.ceil(F.col("n") / PAGE).alias("wide")), "key").withColumn("other", F.col("label") != F.col("own"))
    members = members.join(members.where("other").groupBy("key").agg(F.ceil(F.count("*") / PAGE).alias("high")), "key")
    whole = members.join(nodes.select("node", "keys"), "node")
    whole = whole.join(sets, "node") if verifier else whole.withColumn("set", F.array().cast("array<bigint>"))
    page = lambda pages: F.pmod(F.xxhash64("node"), pages)
    every = lambda pages: F.explode(F.sequence(F.lit(0).cast("long"), pages.cast("long") - 1))
    side = ("key", "node", "fp", "label", "keys", "set", "other")
    x = whole.where("other").select(*side, page(F.col("high")).alias("row"), every(F.col("wide")).alias("column"))
    y = whole.toDF(*whole.columns).select(*side, page(F.col("wide")).alias("column"), every(F.col("high")).alias("row"))
    place = ["key", "row", "column"]
    bits = WIDE_BITS
    # components of components
    ends = cut(x.groupBy(*place).cogroup(y.groupBy(*place)).applyInPandas(lambda left, right: page_links(left, right, bits), "x bigint, y bigint").distinct())
    if ends.isEmpty():
        return labels
    upper = components(contracted(ends.toDF("a", "b"))).select(F.col("node").alias("own"), F.col("label").alias("top"))
    every_node = labels.unionByName(ends.select(F.col("x").alias("node"), F.col("x").alias("label")).unionByName(ends.select(F.col("y").alias("node"), F.col("y").alias("label")))).distinct()
    return cut(every_node.join(upper, F.col("label") == F.col("own"), "left").select("node", F.coalesce("top", "label").alias("label")))


def bits_apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bits in which each of the fingerprints x (a column each) differs from each of y."""
    return sum((np.bitwise_count(a[:, None] ^ b) for a, b in zip(x, y)), np.zeros((1, 1), dtype=np.uint16))


def near_in_slice(page: pd.DataFrame, bits: int) -> pd.DataFrame:
    """Those nodes of a page that differ from another one of it in at most so many bits, each with a number of the nodes that such steps reach.

    The same nodes have the same number in every block. In a block of several slices, where steps may lead through other pages, it is the block's key.
    """
    prints = page[[f"w{w}" for w in range(WORDS)]].to_numpy().astype("<i8").view("<u8").T.copy()
    found = np.zeros(len(page), dtype=bool)
    for at in range(0, len(page), PRINTS_AT_ONCE):
        near = bits_apart(prints[:, at : at + PRINTS_AT_ONCE], prints[:, at:]) <= bits
        np.fill_diagonal(near, False)
        found[at : at + PRINTS_AT_ONCE] |= near.any(1)
        found[at:] |= near.any(0)
    page, prints = page[found], prints[:, found]
    node, group = page["node"].to_numpy(), page["key"].to_numpy().copy()
    free = np.arange(len(page) if len(page) and page["slices"].iloc[0] == 1 else 0)
    while len(free):
        reached, free = free[:1], free[1:]
        done = 0
        while done < len(reached):
            near = (bits_apart(prints[:, reached[done : done + PRINTS_AT_ONCE]], prints[:, free]) <= bits).any(0)
            done = min(done + PRINTS_AT_ONCE, len(reached))
            reached, free = np.concatenate([reached, free[near]]), free[~near]
        group[reached] = np.array(xxhash.xxh64_intdigest(np.sort(node[reached]).tobytes()), dtype="<u8").view("<i8")
    return pd.DataFrame({"node": node, "block": group, "sliced": np.full(len(page), len(page) > 0 and page["slices"].iloc[0] > 1)})


def near_blocks(nodes: DataFrame) -> DataFrame:
    """(node, blocks) of the nodes (node, fp) that agree with another one in a whole block of the fingerprint and differ from it in at most WIDE_BITS bits.

    Any two such nodes have a number among their blocks in common. Of a block of up to SLICE nodes only those that are joined by such steps
    stay together, and the same nodes in other blocks are the same (over BLOCK_PAIRS together: those that share a node are one); of a larger one, whose slices are compared two by two, all that are near any other.
    """
    words = [F.col("fp")[w].alias(f"w{w}") for w in range(WORDS)]
    keys = [F.xxhash64(F.lit(t), *[F.col("fp")[w].bitwiseAND(F.lit(m)) for w, m in enumerate(mask) if m]) for t, mask in enumerate(block_masks(nodes.count()))]
    placed = nodes.select("node", *words, F.explode(F.array(*keys)).alias("key"))
    large = placed.groupBy("key").agg(F.ceil(F.count("*") / SLICE).alias("slices")).where("slices > 1")
    # a row of large stands for more than SLICE rows
    sliced = placed.join(F.broadcast(large), "key", "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
    sliced = sliced.withColumn("own", F.pmod(F.xxhash64("node"), "slices")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)))
    pages = sliced.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other")).drop("own", "other")
    bits = WIDE_BITS
    found = pages.groupBy("key", "low", "high").applyInPandas(lambda page: near_in_slice(page, bits), "node bigint, block bigint, sliced boolean")
    found = cut(found.distinct())
    # a large group that is cut a little differently in many blocks is one
    many = found.where("not sliced").groupBy("block").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK_PAIRS).select("block")
    many = found.join(many, "block").select("node", "block")
    meets = many.join(many.groupBy("node").agg(F.min("block").alias("a")), "node").where("a <> block").select("a", F.col("block").alias("b")).distinct()
    merged = components(contracted(cut(meets))).select(F.col("node").alias("block"), "label")
    found = found.join(merged, "block", "left").select("node", F.coalesce("label", "block").alias("block"))
    return found.groupBy("node").agg(F.collect_set("block").alias("blocks"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The columns of docs, one row of each group of near copies: that of its smallest doc_id (and hash of text).

    Groups are components of links between sets of shingles, which are nodes by a hash of their own: a doc_id that recurs with
    different texts joins no groups. Two texts are linked if their distinct shingles of NEAR_SHINGLE words are alike to 0.8 or more
    (exactly; candidates share a block of their fingerprints). Rows without a doc_id stay; of rows with one doc_id and text, one stays.
    """
    make = lambda: lambda texts: list(zip(*[sketch(t) for t in texts]))
    digest, number = free_name(docs, "digest_of_text"), free_name(docs, "row_of_doc")
    rows = docs.where("doc_id is not null").withColumn(digest, F.xxhash64("text"))
    fields = [StructField("node", LongType()), StructField("fp", ArrayType(LongType()))]
    prints = map_texts(rows, ("doc_id", digest), "text", make, fields).withColumnRenamed(digest, "digest")
    nodes = cut(prints.groupBy("node", "fp").agg(F.min(F.struct("doc_id", "digest")).alias("row")))

    def verifier(members: DataFrame) -> DataFrame:
        """(node, set of hashes of shingles) of members."""
        texts = nodes.join(members, "node").select("node", "row.doc_id", F.col("row.digest").alias(digest))
        hashes = lambda: lambda texts: [[np.unique(shingle_hashes(t, NEAR_SHINGLE)).view("<i8") for t in texts]]
        sets = map_texts(rows.select("doc_id", digest, "text").join(texts, ["doc_id", digest]), ("node",), "text", hashes, [StructField("set", ArrayType(LongType()))])
        return cut(sets.groupBy("node").agg(F.first("set").alias("set")))

    joined = wide_groups(cut(nodes.join(near_blocks(nodes), "node").select("node", "fp", "blocks")), F.col("blocks"), verifier)
    groups = nodes.select("node", "row").join(joined, "node", "left").groupBy(F.coalesce("label", "node").alias("label"))
    kept = groups.agg(F.min("row").alias("row")).select("row.doc_id", F.col("row.digest").alias(digest))
    # copies of a row go before the shuffle
    once = rows.withColumn(number, F.row_number().over(Window.partitionBy("doc_id", digest).orderBy(digest))).where(F.col(number) == 1)
    return once.join(kept, ["doc_id", digest], "left_semi").select(*docs.columns).unionByName(docs.where("doc_id is null"))
