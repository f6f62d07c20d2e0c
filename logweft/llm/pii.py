"""Personal data by patterns, and a skip-chain conditional random field that carries labels to mentions like them.

Base spans come from four patterns (email, ip, card, phone). Mentions that the patterns leave out become nodes
beside them: numbers of seven digits and more in any grouping, words that stand like the name of an address of the same
text, and spelled-out addresses. Base nodes are observed; loopy sum-product messages give the others' marginals, and those
above SURE become spans of that kind.

A node's own potential is a smoothed log-frequency of labels by the make-up of its mention (number of digits, Luhn, plus sign),
counted over all documents. A make-up that patterns can't hit would say no more than that they do not hit it, so it counts for
at most NEVER_HIT: it is the links that decide. Skip links join a mention to the next one of its document that is like it, however far
apart: the same last digits or name (`same`), or a number that differs from it in one digit, left out or changed (`like`, found by the
halves of the digits: one of them is whole). The potentials of `same` and `like` are learnt from mentions that are held out: each base mention is
predicted from the base mention that it is linked to, over all documents, and how often the kinds agree gives the log-odds, with a
prior of PRIOR pairs that agree. Neighbours within WINDOW code points are linked weakly.

A mention has one link of a kind to the next, so links grow with the mentions, not with their square.
Null and empty texts have no spans. Repeated rows and ties get the same spans; an empty table gives an empty result; other
columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from logweft.llm.common import in_slices, map_texts

KINDS = ("email", "ip", "card", "phone")
SURE, WINDOW, ROUNDS = 0.8, 40, 15
#: Last digits that make numbers the same, digits one of them may have before those of the other, digits of numbers that can be like, letters of a name.
KEY_DIGITS, PREFIX, LEAST_LIKE, MIN_NAME = 8, 3, 10, 5
#: Bounds of the log-odds of a make-up, and of one that patterns never hit; log-odds of neighbours, bound of those of links, and pairs that are taken to agree before any is seen.
MOST_ODDS, NEVER_HIT, NEAR_LINK, MOST_LINK = 3.0, 1.5, 0.2, 8.0
PRIOR = {"same": 400, "like": 200}

TAIL = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]")
NUMBER = re.compile(r"\+?\(?[0-9](?:[ ().-]{0,2}[0-9]){6,}+")
WORD = re.compile(r"[A-Za-z0-9_%+-]+(?:\.[A-Za-z0-9_%+-]+)*")
SPELLED = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?[\[({](?:at|AT)[\])}] ?[A-Za-z0-9-]+(?: ?(?:\.|[\[({](?:dot|DOT)[\])}]) ?[A-Za-z0-9-]+)+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def is_octet(digits: str) -> bool:
    value = digits.lstrip("0")
    return len(value) <= 3 and int(value or 0) <= 255


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses: each valid domain, with the name before it back to the last address."""
    out, free = [], 0
    if "@" in text:
        for m in TAIL.finditer(text):
            start = m.start()
            while start > free and (text[start - 1] in "._%+-" or (text[start - 1].isascii() and text[start - 1].isalnum())):
                start -= 1
            if start < m.start():
                out.append((start, m.end()))
                free = m.end()
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in order of start, then kind."""
    out = [(a, 0, b) for a, b in emails(text)]
    if DIGITS.search(text):
        out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(map(is_octet, m[0].split(".")))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(DIGITS.findall(m[0])) <= 15]
    return sorted(out)


def mentions(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, str, str]]:
    """(start, end, kind or -1, make-up, key) of base spans and of mentions outside them, by start."""
    out = []
    taken = [(a, b) for a, _, b in base]
    for a, kind, b in base:
        out.append((a, b, kind, *described(text[a:b], kind)))
    free = Free(taken)
    if DIGITS.search(text):
        for m in NUMBER.finditer(text):
            if free(m.start(), m.end()):
                out.append((m.start(), m.end(), -1, *described(m[0], -1)))
    names = {name.lower() for a, kind, b in base if kind == 0 and len(name := text[a:b].split("@")[0]) >= MIN_NAME}
    if names:
        for m in WORD.finditer(text):  # each word once, whatever the number of names
            if m[0].lower() in names and text[m.end() : m.end() + 1] != "@" and free(m.start(), m.end()):
                out.append((m.start(), m.end(), -1, "name", m[0].lower()))
    if "at" in text or "AT" in text:
        for m in SPELLED.finditer(text) if any(x in text for x in ("[at", "(at", "{at", "[AT", "(AT", "{AT")) else ():
            if free(m.start(), m.end()):
                out.append((m.start(), m.end(), -1, "address", re.split(r" ?[\[({]", m[0], maxsplit=1)[0].lower()))
    return sorted(out)


class Free:
    """Whether a span meets none of some disjoint or overlapping spans."""

    def __init__(self, taken: list[tuple[int, int]]):
        self.starts = np.array([a for a, _ in sorted(taken)], dtype=np.int64)
        self.ends = np.maximum.accumulate(np.array([b for _, b in sorted(taken)], dtype=np.int64)) if taken else self.starts

    def __call__(self, start: int, end: int) -> bool:
        k = int(np.searchsorted(self.starts, end))
        return k == 0 or int(self.ends[k - 1]) <= start


def described(mention: str, kind: int) -> tuple[str, str]:
    """Make-up and key of a mention."""
    if kind == 0:
        return "address", mention.split("@")[0].lower()
    digits = "".join(DIGITS.findall(mention))
    dots = mention.count(".")
    plain = dots == 3 and digits and all(p.isdigit() and len(p) <= 3 for p in mention.split("."))
    return f"{'ip' if plain else 'n'}{min(len(digits), 24)}{'+' if mention[0] == '+' else ''}{'L' if len(digits) >= 14 and luhn(digits) else ''}", digits


def is_like(a: str, b: str) -> bool:
    """Whether digits differ in one place: a digit changed, left out or added."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    k = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[k + (len(a) >= len(b)) :] == b[k + (len(b) >= len(a)) :]


def skips(found: list[tuple[int, int, int, str, str]]) -> dict[tuple[int, int], str]:
    """Pairs of mentions, each with the next that is the same, and the next number that is like it; by what links them."""
    same: dict[str, int] = {}
    half: dict[tuple[str, str], int] = {}
    out = {}
    for k, (_, _, _, made, key) in enumerate(found):
        number = key.isdigit()
        tail = key[-KEY_DIGITS:] if number else key
        if tail in same and (not number or abs(len(found[same[tail]][4]) - len(key)) <= PREFIX):
            out[same[tail], k] = "same"
        same[tail] = k
        if number and len(key) >= LEAST_LIKE:
            middle = len(key) // 2
            # with a digit more or less, a half of one number is the half or the half and a digit of the other
            ends = {("a", key[:middle]), ("a", key[: middle - 1]), ("b", key[middle:]), ("b", key[middle + 1 :])}
            for e in ends:
                if e in half and (half[e], k) not in out and is_like(found[half[e]][4], key):
                    out[half[e], k] = "like"
            for e in ends:
                half[e] = k
    return out


LEARNT = StructType([StructField("what", StringType()), StructField("n", LongType())])


def counted(docs: DataFrame, text: str = "text") -> dict[str, int]:
    """Over all documents: mentions of each make-up by kind, and base mentions whose kind their linked base mention tells, or does not.

    Make-ups are bounded (under 150 with the kinds), and counted per task before the shuffle.
    """

    def run(batches):
        import pyarrow as pa

        seen: Counter = Counter()
        for batch in in_slices(batches):
            for t in batch.column(0).to_pylist():
                if not t or not (DIGITS.search(t) or "@" in t):
                    continue
                found = mentions(t, base_spans(t))
                seen.update(f"{m[3]}={m[2]}" for m in found)
                seen.update(f"{link}={int(found[a][2] == found[b][2])}" for (a, b), link in skips(found).items() if found[a][2] >= 0 <= found[b][2])
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), type=pa.string()), pa.array(list(seen.values()), type=pa.int64())], names=LEARNT.names)

    return {r.what: int(r.n) for r in docs.select(text).mapInArrow(run, LEARNT).groupBy("what").agg(F.sum("n").alias("n")).collect()}


class Field:
    """Potentials over the labels none, email, ip, card, phone."""

    def __init__(self, counts: dict[str, int]):
        self.potential: dict[str, np.ndarray] = {}
        for made in {w.rpartition("=")[0] for w in counts} - set(PRIOR):
            n = np.array([counts.get(f"{made}={k}", 0) + 0.5 for k in range(-1, len(KINDS))])
            odds = np.log(n / n.sum())
            hit = any(counts.get(f"{made}={k}", 0) for k in range(len(KINDS)))
            self.potential[made] = np.clip(odds - odds.max(), -MOST_ODDS if hit else -NEVER_HIT, 0)
        self.default = np.array([0.0] + [-NEVER_HIT] * len(KINDS))
        self.potential["name"] = np.array([0.0, -NEVER_HIT, -MOST_ODDS, -MOST_ODDS, -MOST_ODDS])
        odds_of = lambda link: np.log((counts.get(f"{link}=1", 0) + PRIOR[link]) / (counts.get(f"{link}=0", 0) + 1))
        self.link = {link: np.exp(min(MOST_LINK, max(0.0, float(odds_of(link)))) * np.eye(5)) for link in PRIOR}
        self.link["near"] = np.exp(NEAR_LINK * np.eye(5))

    def marginals(self, found: list[tuple[int, int, int, str, str]]) -> np.ndarray:
        n = len(found)
        own = np.empty((n, 5))
        for k, (_, _, kind, made, _) in enumerate(found):
            own[k] = self.potential.get(made, self.default)
            if kind >= 0:
                own[k] = -60.0
                own[k, kind + 1] = 0.0
        links = skips(found)
        for k in range(n - 1):
            if found[k + 1][0] - found[k][1] <= WINDOW:
                links.setdefault((k, k + 1), "near")
        if not links:
            p = np.exp(own)
            return p / p.sum(1, keepdims=True)
        pairs = np.array(list(links))
        psi = np.stack([self.link[link] for link in links.values()])
        psi = np.concatenate([psi, psi])
        source, target = np.concatenate([pairs[:, 0], pairs[:, 1]]), np.concatenate([pairs[:, 1], pairs[:, 0]])
        back = np.concatenate([np.arange(len(pairs)) + len(pairs), np.arange(len(pairs))])
        messages = np.zeros((len(source), 5))
        for _ in range(ROUNDS):
            belief = own.copy()
            np.add.at(belief, target, messages)
            out = belief[source] - messages[back]
            new = np.log(np.einsum("ea,eab->eb", np.exp(out - out.max(1, keepdims=True)), psi))
            new -= new.max(1, keepdims=True)
            if np.abs(new - messages).max() < 1e-4:
                break
            messages = new
        belief = own.copy()
        np.add.at(belief, target, messages)
        p = np.exp(belief - belief.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def find(text: str, field: Field) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans, of one text."""
    if not (DIGITS.search(text) or "@" in text or "at" in text or "AT" in text):
        return [], []
    base = base_spans(text)
    found = mentions(text, base)
    if all(m[2] >= 0 for m in found):
        return base, base
    p = field.marginals(found)
    added = [(m[0], int(q.argmax()) - 1, m[1]) for m, q in zip(found, p) if m[2] < 0 and q.argmax() and q.max() >= SURE]
    return base, sorted(base + added)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join([f"{KINDS[k]}:{a}:{b}" for a, k, b in spans])


FIELDS = [StructField(f"n_{k}", LongType()) for k in KINDS] + [
    StructField("base_sha256", StringType()),
    StructField("spans", StringType()),
    StructField("n_added", LongType()),
]


def personal_data(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """keep, then counts of base spans by kind, the digest of the base spans, and all spans as kind:start:end."""
    field = Field(counted(docs, text))

    def work(texts: list[str]) -> list[list]:
        out: list[list] = [[] for _ in FIELDS]
        for t in texts:
            base, spans = find(t, field)
            kinds = Counter(k for _, k, _ in base)
            row = [kinds[k] for k in range(len(KINDS))]
            row += [hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), len(spans) - len(base)]
            for column, value in zip(out, row):
                column.append(value)
        return out

    return map_texts(docs, keep, text, lambda: work, FIELDS)
