"""SentencePiece BPE encoding by backtracking over longest matches, and decoding.

The encoding that merging in score order gives is the only token sequence in which every two
neighbours are compatible: merging the characters of both, joined, gives just these two again. So the
encoder walks forward by the longest piece that starts at a position (found for all positions by one
Aho-Corasick pass), steps to shorter pieces while the neighbour before is incompatible, goes back one
token when none is left, and never returns to a position in the bitfield of failed ones.

No piece of a vocabulary split at spaces holds a space mark after another character, so texts are cut
before such marks and each distinct chunk is encoded once a worker (within a bound on remembered chunks).

Null and empty texts give the end id alone, decoded as the empty text. Every row is encoded by itself: repeated rows and ties give
repeated results, an empty table gives an empty result, and other columns are not read but for those named in keep. Normalisation is the model's: this module
handles models that change nothing but put a space before the text (checked when the model is loaded).
"""

from __future__ import annotations

import hashlib
import heapq
import re
from functools import lru_cache

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField

from logweft.llm.common import map_texts

MARK = "▁"
#: Words and pairs of tokens that a worker remembers.
REMEMBERED, PAIRS = 250_000, 250_000
#: Bytes of the bitfield of words met.
SEEN = 1 << 20
LONGEST_REMEMBERED = 64
PROBE = "  ﬁ é\t　x \n"


class PieceBPE:
    """Vocabulary of a SentencePiece BPE model; the library only reads the model file."""

    def __init__(self, model_file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        if sp.decode(sp.encode(PROBE)) != PROBE:
            raise ValueError("the model's normaliser changes texts")
        pieces = [sp.id_to_piece(i) for i in range(n)]
        special = {i for i in range(n) if sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i)}
        if any(sp.is_unused(i) for i in range(n)):
            raise ValueError("models with unused pieces are not handled")
        self.ids = {p: i for i, p in enumerate(pieces) if i not in special}
        self.scores = {p: sp.get_score(i) for p, i in self.ids.items()}
        self.end, self.unknown = sp.eos_id(), sp.unk_id()
        byte = {int(pieces[i][3:5], 16): i for i in special if sp.is_byte(i)}
        self.bytes = [byte[b] for b in range(256)] if len(byte) == 256 else None
        self.byte_of = {i: b for b, i in byte.items()}
        self.text_of = {i: "" if sp.is_control(i) else " ⁇ " if sp.is_unknown(i) else p.replace(MARK, " ") for i, p in enumerate(pieces)}
        crossing = any(a != MARK and b == MARK for p in self.ids for a, b in zip(p, p[1:]))
        if crossing:
            raise ValueError("pieces over word ends are not handled")
        self.beside = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        self.chunk = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
        self.pairs: dict[tuple[str, str], bool] = {}
        self.own = {p: p for p in self.ids}
        # a piece that merging can't build never stands in an encoding
        self.whole = {p for p in self.ids if len(p) == 1 or self.merged(p) == [p]}
        self.shorter: dict[str, str | None] = {}
        self.search = ahocorasick.Automaton()
        for p in self.whole:
            self.search.add_word(p, len(p))
            self.shorter[p] = next((p[:k] for k in range(len(p) - 1, 0, -1) if k == 1 or p[:k] in self.whole), None)
        self.search.make_automaton()

    def merged(self, text: str) -> list[str]:
        """text's characters, merged two by two: highest score first, leftmost among equal ones."""
        at, after, before = list(text), list(range(1, len(text) + 1)), list(range(-1, len(text) - 1))
        waiting: list[tuple[float, int, str, str]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < len(at) and (score := self.scores.get(at[i] + at[j])) is not None:
                heapq.heappush(waiting, (-score, i, at[i], at[j]))

        for i in range(len(at) - 1):
            offer(i, i + 1)
        while waiting:
            _, i, left, right = heapq.heappop(waiting)
            j = after[i]
            if at[i] != left or j >= len(at) or at[j] != right or not left:
                continue
            at[i], at[j], after[i] = left + right, "", after[j]
            if after[j] < len(at):
                before[after[j]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [p for p in at if p]

    def compatible(self, left: str, right: str) -> bool:
        got = self.merged(left + right) == [left, right]
        if len(self.pairs) < PAIRS:  # under the vocabulary's own strings
            self.pairs[self.own.get(left, left), self.own.get(right, right)] = got
        return got

    def split(self, text: str) -> list[str]:
        """The pieces of a chunk; characters outside the vocabulary stand alone."""
        n, known, shorter = len(text), self.pairs.get, self.shorter
        longest = [1] * n
        for end, k in self.search.iter(text):  # ends rise, so the last match from a place is its longest
            longest[end - k + 1] = k
        tokens: list[str] = []
        failed: bytearray | None = None
        at, last, token = 0, None, text[: longest[0]]
        while True:
            fits = last is None or known((last, token))
            if fits is None:
                fits = self.compatible(last, token)
            end = at + len(token)
            if fits and (failed is None or not failed[end >> 3] >> (end & 7) & 1):
                tokens.append(token)
                if end == n:
                    return tokens
                at, last, token = end, token, text[end : end + longest[end]]
            elif len(token) > 1:
                token = shorter[token]
            else:
                if failed is None:
                    failed = bytearray(n // 8 + 1)
                failed[at >> 3] |= 1 << (at & 7)
                token = tokens.pop()
                at -= len(token)
                last = tokens[-1] if tokens else None

    def chunk_ids(self, chunk: str) -> list[int]:
        pieces = self.split(chunk)
        try:
            return [self.ids[p] for p in pieces]
        except KeyError:
            pass
        out: list[int] = []
        for p in pieces:
            if p in self.ids:
                out.append(self.ids[p])
            elif self.bytes:
                out += [self.bytes[b] for b in p.encode("utf-8", "surrogatepass")]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return out

    def encode(self, text: str) -> list[int]:
        """Ids of text, then the end id."""
        out = [i for c in self.chunks(text) for i in self.chunk_ids(c)]
        return [*out, self.end]

    def chunks(self, text: str) -> list[str]:
        return self.chunk.findall(MARK + text.replace(" ", MARK)) if text else []

    def decode(self, ids: list[int]) -> str:
        """The text of ids, less the space put before it."""
        text = self.read(ids)
        return text[1:] if text[:1] == " " and ids[0] not in self.byte_of else text

    def read(self, ids: list[int]) -> str:
        """Pieces joined; runs of byte ids are read as UTF-8, faulty bytes as U+FFFD each."""
        out: list[str] = []
        run = bytearray()
        for i in ids:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            if run:
                out.append(read_utf8(bytes(run)))
                run.clear()
            out.append(self.text_of[i])
        if run:
            out.append(read_utf8(bytes(run)))
        return "".join(out)


def read_utf8(data: bytes) -> str:
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(data):
            for k in (1, 2, 3, 4):
                try:
                    out.append(data[at : at + k].decode("utf-8"))
                    at += k
                    break
                except UnicodeDecodeError:
                    pass
            else:
                out.append("�")
                at += 1
        return "".join(out)


@lru_cache(1)
def load(model_file: str) -> PieceBPE:
    return PieceBPE(model_file)


FIELDS = [
    StructField("n_tokens", LongType()),
    StructField("ids_sha256", StringType()),
    StructField("decoded_sha256", StringType()),
]


class Known(dict):
    """Word to ids as text. A word that decodes to anything but itself after a space has that in `back`.

    A chunk starts with the space mark, which is a piece, so no run of byte ids goes over the end of a chunk and chunks
    can be decoded one by one. At most REMEMBERED words are kept, from the second time on; `back` of others goes when forget() is called.
    """

    def __init__(self, bpe: PieceBPE):
        self.bpe = bpe
        self.back: dict[str, str] = {}
        self.passing: list[str] = []
        self.seen = bytearray(SEEN)

    def __missing__(self, word: str) -> str:
        if 1 < len(word) <= LONGEST_REMEMBERED and word[-2:] not in self.bpe.beside:
            # no piece has these two characters beside each other, so no merge goes over this place
            first, end = self[word[:-1]], self.bpe.chunk_ids(word[-1])
            ids, back = f"{first} {' '.join(map(str, end))}", self.back.get(word[:-1], " " + word[:-1]) + self.bpe.read(end)
        else:
            got = self.bpe.chunk_ids(MARK + word)
            ids, back = " ".join(map(str, got)), self.bpe.read(got)
        kept = len(self) < REMEMBERED and len(word) <= LONGEST_REMEMBERED and self.met(word)
        if kept:
            self[word] = ids
        if back[:1] != " " or back[1:] != word:
            self.back[word] = back
            if not kept:
                self.passing.append(word)
        return ids

    def met(self, word: str) -> bool:
        """Whether a word with this hash was met before (most words are met once, and need no memory)."""
        at = hash(word) & (8 * len(self.seen) - 1)
        before = self.seen[at >> 3] >> (at & 7) & 1
        self.seen[at >> 3] |= 1 << (at & 7)
        return bool(before)

    def forget(self) -> None:
        for word in self.passing:
            self.back.pop(word, None)
        self.passing.clear()


@lru_cache(1)
def _digests(model_file: str):
    bpe = load(model_file)
    known = Known(bpe)
    end = str(bpe.end)

    def work(texts: list[str]) -> list[list]:
        counts, shas, decoded = [], [], []
        for text in texts:
            if not text:
                words = []
            elif text[0] == " " or "  " in text or MARK in text:
                words = [c[1:] for c in bpe.chunks(text)]
            else:
                words = text.split(" ")
            ids = " ".join([*map(known.__getitem__, words), end])
            if known.back and not known.back.keys().isdisjoint(words):
                text = "".join([known.back.get(w) or " " + w for w in words])[1:]
                known.forget()
            else:
                text = " ".join(words)
            counts.append(ids.count(" ") + 1)
            shas.append(hashlib.sha256(ids.encode()).hexdigest())
            decoded.append(hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest())
        return [counts, shas, decoded]

    return work


def encode_digests(docs: DataFrame, model_file: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """keep, then the number of ids (the end id too), the SHA-256 of the ids and that of the decoded text."""
    return map_texts(docs, keep, text, lambda: _digests(model_file), FIELDS)


def encode(docs: DataFrame, model_file: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """keep, then the ids of each text as `ids` and their decoded text as `decoded`."""

    def make():
        bpe = load(model_file)

        def work(texts: list[str]) -> list[list]:
            ids = [bpe.encode(t) for t in texts]
            return [ids, [bpe.decode(i) for i in ids]]

        return work

    return map_texts(docs, keep, text, make, [StructField("ids", ArrayType(IntegerType())), StructField("decoded", StringType())])
