"""Phrases whose words go together, mined with generalised suffix automata of words.

Texts are lower-cased (A-Z), cut at `[.,;:!?\\x0A-\\x0D]` into pieces and those at spaces and tabs into words. A shard is what a task has read, up to
SHARD_BYTES of text (a longer text is a shard of its own). The pieces of a language in a shard make one generalised suffix automaton whose
letters are words, cut at a depth: as no longer substring is asked for, its states are found without going letter by letter. Level d
holds the different suffixes of d words of all prefixes, numbered by sorting pairs (level d - 1, the word before); a node whose count
equals that of the only node that prolongs it to the left ends at the same places, so the two are one state. A state has its longest phrase, the
length of its shortest, the size of its endpos set and a suffix link to the longest suffix that ends at more places. All
substrings of bounded depth are enumerated from the states, each with the count of its state, and counts are added up over shards.

A phrase of d words is frequent only if the two of d - 1 words in it are: after words and pairs, each further length takes one more pass
over the texts, in which an automaton grows only where both parts may be frequent. That is looked up in a Bloom filter of the frequent phrases, twelve
bits for each and MOST_BITS in all; a filter that is too full, or wrong about a phrase, only lets through more of them, and whatever is let through is
counted exactly. So results don't depend on the filter, on shards or on tasks.

A candidate has 2 to `longest` words and f >= `least`. Its score is the least, over its cuts in two, of floor(1000000 * a * a / (l * r)), in
38-digit decimals (exact to a = 1e16). A candidate goes if its words lie inside a longer candidate's with at least half its count: the longer candidates hand their count
to the phrases inside them, down the suffix link (without the first word) and along the prefix (without the last).

Null texts are empty, null languages are `und`. Repeated rows count each. Ties in score, count and language go by the bytes of the phrase. An empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweft.llm.common import cut, in_slices

LONGEST, LEAST, FIRST = 3, 10, 2000
#: Percent of a phrase's count that a longer candidate must have to take its place.
SHARE = 50
SHARD_BYTES = 12_000_000
#: Bits of the filter for each phrase and in all (32 MB), and bits that are set for each.
BITS_EACH, MOST_BITS, PROBES = 12, 1 << 28, 3
SPLIT = bytes.maketrans(b",;:!?\n\x0b\x0c\r\t", b"........." + b" ")
BREAK = b"."
COUNTS = pa.schema([("lang", pa.string()), ("words", pa.int32()), ("phrase", pa.string()), ("n", pa.int64())])
COUNTS_SQL = "lang string, words int, phrase string, n bigint"


def word_ids(texts: list[bytes]) -> tuple[np.ndarray, pa.Array]:
    """Numbers from 1 of the words of texts (UTF-8), one after the other, with 0 between pieces; and the word of each number less 1."""
    found = b"\n".join(texts).lower().translate(SPLIT).replace(BREAK, b" . ").split()  # lower() of bytes changes A-Z alone
    coded = pa.array(found, pa.binary()).dictionary_encode()
    ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1
    gap = pc.index(coded.dictionary, pa.scalar(BREAK, pa.binary())).as_py()
    if gap >= 0:
        ids[ids == gap + 1] = 0
    return ids, coded.dictionary


@dataclass
class Level:
    """The different phrases of one length: where one ends first, how often it occurs, and the node (on the level before) of it without its first word."""

    end: np.ndarray
    count: np.ndarray
    parent: np.ndarray


def levels(ids: np.ndarray, depth: int, grows: Callable[[int, Level], np.ndarray] | None = None) -> list[Level]:
    """Levels 1 to depth. grows(d, level) says which nodes of level d may be part of a phrase that is prolonged; without it, all."""
    out: list[Level] = []
    node = ids
    for d in range(1, depth + 1):
        if d == 1:
            at = np.flatnonzero(ids)
            key = ids[at]
        else:
            may = np.ones(len(out[-1].end) + 1, dtype=bool)
            may[0] = False
            if grows is not None:
                may[1:] = grows(d - 1, out[-1])
            ok = may[node]
            at = np.flatnonzero(ok[1:] & ok[:-1]) + 1 if d > 2 else np.flatnonzero(ok[1:] & (ids[:-1] > 0)) + 1
            key = node[at] * (ids.max(initial=0) + 1) + ids[at - (d - 1)]
        _, first, place, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        out.append(Level(at[first], count, node[at[first]] if d > 1 else np.zeros(len(first), dtype=np.int64)))
        node = np.zeros(len(ids), dtype=np.int64)
        node[at] = place + 1
    return out


@dataclass
class States:
    """States of an automaton by the length of their longest phrase: its end, its shortest length, the endpos count, and the link
    (node on the level of that length, from 1; 0: the root)."""

    longest: int
    end: np.ndarray
    shortest: np.ndarray
    count: np.ndarray
    link: np.ndarray


def states(found: list[Level]) -> list[States]:
    """Nodes with the same endpos set put together: each state with the longest phrase that ends at its places."""
    out, shortest, link = [], None, None
    for d, level in enumerate(found, 1):
        if d == 1:
            shortest, link = np.ones(len(level.end), dtype=np.int64), level.parent
        else:
            above = level.parent - 1
            same = found[d - 2].count[above] == level.count
            last = out[-1]
            absorbed = np.zeros(len(last.end), dtype=bool)
            absorbed[above[same]] = True
            keep = ~absorbed
            shortest, link = np.where(same, last.shortest[above], d), np.where(same, last.link[above], level.parent)
            out[-1] = States(d - 1, last.end[keep], last.shortest[keep], last.count[keep], last.link[keep])
        out.append(States(d, level.end, shortest, level.count, link))
    return out


def phrase_texts(ids: np.ndarray, words: pa.Array, end: np.ndarray, length: int) -> pa.Array:
    parts = [words.take(pa.array(ids[end - k] - 1)) for k in range(length - 1, -1, -1)]
    return (pc.binary_join_element_wise(*parts, b" ") if length > 1 else parts[0]).cast(pa.string())


def enumerated(ids: np.ndarray, words: pa.Array, found: list[States], lengths: range) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
    """(length, phrases, counts) of every substring of those lengths, each once."""
    for length in lengths:
        of = [(s.end[m], s.count[m]) for s in found if s.longest >= length for m in [s.shortest <= length]]
        if of:
            end, count = (np.concatenate(x) for x in zip(*of))
            yield length, phrase_texts(ids, words, end, length), count


def probes(hashed: np.ndarray, bits: int) -> list[np.ndarray]:
    """Places of unsigned 64-bit hashes in a filter of so many bits (a power of two)."""
    low, high = hashed & np.uint64(0xFFFFFFFF), (hashed >> np.uint64(32)) | np.uint64(1)
    return [((low + np.uint64(k) * high) & np.uint64(bits - 1)).astype(np.int64) for k in range(PROBES)]


def filter_of(phrases: DataFrame, n: int) -> np.ndarray:
    """A Bloom filter of n phrases as 64-bit words; only its words, bounded by MOST_BITS, reach the driver."""
    bits = 1 << max(10, min(MOST_BITS.bit_length() - 1, (BITS_EACH * n).bit_length()))
    h = F.xxhash64("phrase")
    low, high = h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32).bitwiseOR(F.lit(1).cast("long"))
    place = F.explode(F.array(*[(low + F.lit(k).cast("long") * high).bitwiseAND(F.lit(bits - 1).cast("long")) for k in range(PROBES)]))
    cells = phrases.select(place.alias("place")).groupBy(F.shiftright("place", 6).alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("mask"))
    got = cells.toArrow()
    table = np.zeros(bits // 64, dtype=np.uint64)
    table[got["cell"].to_numpy()] = got["mask"].to_numpy().astype(np.int64).view(np.uint64)
    return table


def seen_in(table: np.ndarray, phrases: pa.Array) -> np.ndarray:
    hashed = np.array([xxhash.xxh64_intdigest(p, seed=42) for p in phrases.cast(pa.binary()).to_pylist()], dtype=np.uint64)
    out = np.ones(len(hashed), dtype=bool)
    for place in probes(hashed, len(table) * 64):
        out &= (table[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) == 1
    return out


def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """(language, texts) of a task's rows, up to SHARD_BYTES at one time over all languages."""
    held: dict[str, list[bytes]] = {}
    size = 0
    for batch in in_slices(batches):
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
            if size and size + len(text) > SHARD_BYTES:
                yield from held.items()
                held, size = {}, 0
            held.setdefault(lang, []).append(text)
            size += len(text)
    yield from held.items()


def counted(documents: DataFrame, lengths: range, known: np.ndarray | None = None) -> DataFrame:
    """(lang, words, phrase, n) of the phrases of those lengths, added up over shards; words 0 with an empty phrase is a language's words altogether.

    known: the filter of frequent phrases one word shorter; only phrases whose two parts it holds are counted.
    """
    shared = None if known is None else documents.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, texts in shards(batches):
            ids, words = word_ids(texts)

            def grows(d: int, level: Level) -> np.ndarray:
                if shared is None or d < lengths[0] - 1:
                    return np.ones(len(level.end), dtype=bool)
                return seen_in(shared.value, phrase_texts(ids, words, level.end, d))

            found = states(levels(ids, lengths[-1], grows))
            made = [(k, p, n) for k, p, n in enumerated(ids, words, found, lengths)]
            if lengths[0] == 1:
                made.append((0, pa.array([""]), np.array([np.count_nonzero(ids)])))
            for length, phrases, n in made:
                for a in range(0, len(phrases), 65_536):
                    some = phrases.slice(a, 65_536)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), pa.array([length] * len(some), pa.int32()), some, pa.array(n[a : a + 65_536], pa.int64())], schema=COUNTS)

    rows = documents.select(F.coalesce("lang", F.lit("und")).cast("string").alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    # a shard has every phrase once, so there is nothing to add up before the exchange
    return rows.mapInArrow(run, COUNTS_SQL).repartition("lang", "phrase").groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n"))


def part(phrase: Column, start: Column | int, length: Column | int) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), start, length), " ")


def frequent(documents: DataFrame, longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """(lang, words, phrase, n) of phrases up to longest words that occur least times, and the rows of words 0."""
    out = found = cut(counted(documents, range(1, 3)).where((F.col("n") >= least) | (F.col("words") == 0)))
    for length in range(3, longest + 1):
        shorter = found.where(F.col("words") == length - 1).select("phrase")
        found = cut(counted(documents, range(length, length + 1), filter_of(shorter, shorter.count())).where(F.col("n") >= least))
        out = out.unionByName(found)
    return out


def scored(counts: DataFrame) -> DataFrame:
    """lang, words, phrase, a, l, r and score of every phrase of several words in frequent(), by its lowest-scoring cut (ties: the first)."""
    cuts = counts.where("words >= 2").select(
        "lang", "words", "phrase", F.col("n").alias("a"), F.explode(F.transform(F.sequence(F.lit(1), F.col("words") - 1), lambda k: F.struct(
            k.alias("k"), part(F.col("phrase"), F.lit(1), k).alias("left"), part(F.col("phrase"), k + 1, F.col("words") - k).alias("right"))
        )).alias("cut"),
    ).select("lang", "words", "phrase", "a", "cut.*")
    whole = counts.where("words >= 1")
    of = lambda side, n: whole.select("lang", F.col("phrase").alias(side), F.col("n").alias(n))
    both = cuts.join(of("left", "l"), ["lang", "left"]).join(of("right", "r"), ["lang", "right"])
    score = F.expr("cast(a as decimal(19,0)) * cast(a as decimal(19,0)) * 1000000 div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    best = both.groupBy("lang", "words", "phrase", "a").agg(F.min(F.struct(score.cast("long").alias("score"), "k", "l", "r")).alias("best"))
    return best.select("lang", "words", "phrase", "a", "best.l", "best.r", "best.score")


def unsubsumed(phrases: DataFrame, share: int = SHARE) -> DataFrame:
    """phrases (lang, words, phrase, a) without those that lie inside a longer one with share percent of their count."""
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("words") - n + 1), lambda at: part(F.col("phrase"), at, n))))
    longer = phrases.where("words > 2").select("lang", F.explode(inner).alias("phrase"), F.col("a").alias("longer"))
    most = longer.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    held = F.coalesce(F.col("longer") * 100 >= F.col("a") * share, F.lit(False))
    return phrases.join(most, ["lang", "phrase"], "left").where(~held).drop("longer")


def collocations(documents: DataFrame, longest: int = LONGEST, least: int = LEAST, first: int = FIRST) -> DataFrame:
    """lang, rank (from 1), phrase, a, l, r, n (the language's words) and score of each language's first phrases."""
    counts = frequent(documents, longest, least)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = unsubsumed(scored(counts)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= first)
    total = counts.where("words = 0").select("lang", "n")
    return best.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def oracle_sql(least: int = LEAST, first: int = FIRST, share: int = SHARE) -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""with t as (select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), '{upper}', '{lower}') as text from documents),
  p as (select lang, unnest(regexp_split_to_array(text, '[.,;:!?\n\x0b\x0c\r]')) as piece from t),
  w as (select lang, list_filter(regexp_split_to_array(piece, '[ \t]'), lambda x: x <> '') as w from p),
  g as (select lang, d, unnest([array_to_string(w[i:i + d - 1], ' ') for i in range(1, len(w) - d + 2)]) as phrase from w, range(1, 4) t(d)),
  f as (select lang, d, phrase, count(*) as n from g group by all), total as (select lang, sum(n)::bigint as n from f where d = 1 group by 1),
  c as (select lang, d, phrase, n as a from f where d >= 2 and n >= {least}),
  u as (select c.*, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') as lp, array_to_string(string_split(phrase, ' ')[k + 1:d], ' ') as rp from c, range(1, 3) t(k) where k < d),
  s as (select u.lang, u.d, u.phrase, a, x.n as l, y.n as r, (a::hugeint * a * 1000000 // (x.n::hugeint * y.n))::bigint as score, k
    from u join f x on x.lang = u.lang and x.phrase = lp join f y on y.lang = u.lang and y.phrase = rp),
  b as (select * from s qualify row_number() over (partition by lang, phrase order by score, k) = 1),
  i as (select lang, unnest([array_to_string(string_split(phrase, ' ')[1:2], ' '), array_to_string(string_split(phrase, ' ')[2:3], ' ')]) as phrase, a from c where d = 3),
  m as (select lang, phrase, max(a) as longer from i group by 1, 2),
  o as (select b.*, row_number() over (partition by b.lang order by score desc, a desc, b.phrase) as rank from b left join m using (lang, phrase) where d = 3 or longer is null or 100 * longer < {share} * a)
  select lang, rank, phrase, a, l, r, total.n as n, score from o join total using (lang) where rank <= {first}"""
