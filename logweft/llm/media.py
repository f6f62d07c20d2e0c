"""Media columns and interleaved document sequences.

HTML is parsed, by one forward scan whatever is left open in it, into ordered items: runs of text, and references to media
by digest with the caption of their figure (or their alt text). Payloads are kept once, as a lossless image, under the SHA-256 of the payload;
references are resolved by a join on the digest, and the items of a page keep their positions.

A payload is stored as a PNG of 64 columns of 8-bit RGB samples, 192 bytes a row, so its size is a multiple of 192; it is
padded with spaces to a positive multiple. Stored forms never go through a shuffle: a task encodes
a payload, reads the stored bytes back, and passes on their narrow features.

Null texts and pages count as empty: an empty page has no items, an empty text is a payload of 192 spaces. References
whose digest is not in the store keep their place with null features. Repeated rows stay repeated; equal payloads share
one entry. Empty tables give empty results; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import html as markup
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from logweft.llm.common import cut, map_texts

ROW = 192
LEVEL = 1
SIGNATURE = b"\x89PNG\r\n\x1a\n"
NAME = re.compile(r"(/?)([A-Za-z][A-Za-z0-9]*)")
#: What ends a tag, or begins a quoted value in it.
STOP = re.compile(r">|=\s*[\"']")
RAW = {name: re.compile(f"</{name}", re.I) for name in ("script", "style")}
ATTRIBUTE = re.compile(r"([A-Za-z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
SPACES = re.compile(r"\s+")
MEDIA = {"img": "image", "video": "video", "audio": "audio", "source": "media"}
INLINE = {"a", "abbr", "b", "code", "em", "i", "mark", "q", "s", "small", "span", "strong", "sub", "sup", "u"}


def tag_end(page: str, at: int) -> int:
    """Where the tag that is open at this place ends; -1 if it does not."""
    while m := STOP.search(page, at):
        if m[0] == ">":
            return m.end()
        closing = page.find(m[0][-1], m.end())
        if closing < 0:
            return -1
        at = closing + 1
    return -1


def tags(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name, whether it closes, attributes) of tags, comments and raw elements (no name), by one forward scan.

    What is not closed (a comment, a script, a tag, a quoted value) goes on to the end of the page, as in browsers.
    """
    at = 0
    while (start := page.find("<", at)) >= 0:
        m = NAME.match(page, start + 1)
        name, closes, told = "", False, ""
        if m:
            end = tag_end(page, m.end())
            name, closes, told = m[2].lower(), bool(m[1]), page[m.end() : end]
            if end >= 0 and name in RAW and not closes:
                close = RAW[name].search(page, end)
                end, name = tag_end(page, close.end()) if close else -1, ""
        elif page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            end += 3 * (end >= 0)
        elif page.startswith(("<!", "<?"), start):
            end = page.find(">", start) + 1 or -1
        else:  # a mere sign
            at = start + 1
            continue
        if end < 0:
            end, name = len(page), ""
        yield start, end, name, closes, told
        at = end


def parse(page: str) -> list[tuple[int, str, str | None, str | None, str | None]]:
    """(position, kind, text, digest, caption) of a page's items: texts between blocks, and media where they stand.

    A figure's caption goes to its media wherever it stands in the figure; without any it is a text.
    """
    items: list[list] = []
    words: list[str] = []
    figure: list[list] | None = None
    told: tuple[int, str] | None = None
    in_caption = False

    def taken() -> str:
        text = SPACES.sub(" ", markup.unescape("".join(words))).strip()
        words.clear()
        return text

    def flush() -> None:
        if text := taken():
            items.append(["text", text, None, None])

    def end_caption() -> None:
        nonlocal told, in_caption
        if in_caption:
            in_caption, text = False, taken()
            if text and figure is None:
                items.append(["text", text, None, None])
            elif text:
                told = told[0] if told else len(items), f"{told[1]} {text}" if told else text

    def end_figure() -> None:
        nonlocal figure, told
        end_caption()
        flush()
        if told and figure:
            for item in figure:
                item[3] = told[1]
        elif told:
            items.insert(told[0], ["text", told[1], None, None])
        figure, told = None, None

    at = 0
    for start, end, name, closes, attributes in tags(page):
        words.append(page[at:start])
        at = end
        if not name or name in INLINE:
            continue
        if name == "figcaption":
            if closes:
                end_caption()
            else:
                end_caption()
                flush()
                in_caption = True
            continue
        if name == "figure":
            end_figure()
            figure = None if closes else []
            continue
        if not in_caption:
            flush()
        else:
            words.append(" ")
        if name in MEDIA and not closes:
            own = {a.lower(): markup.unescape(x or y or z or "") for a, x, y, z in ATTRIBUTE.findall(attributes)}
            item = [MEDIA[name], None, own.get("src", "").removeprefix("sha256:") or None, own.get("alt") or None]
            items.append(item)
            if figure is not None:
                figure.append(item)
    words.append(page[at:])
    end_figure()
    return [(k, *item) for k, item in enumerate(items)]


ITEM = StructType([
    StructField("pos", IntegerType()), StructField("kind", StringType()), StructField("text", StringType()),
    StructField("digest", StringType()), StructField("caption", StringType()),
])


def items(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """A row for each item of each page: key, pos, kind, text, digest, caption."""

    def work(texts: list[str]) -> list[list]:
        names = [f.name for f in ITEM.fields]
        return [[[dict(zip(names, item)) for item in parse(t)] for t in texts]]

    parsed = map_texts(pages, (key,), html, lambda: work, [StructField("items__", ArrayType(ITEM))])
    return parsed.select(key, F.explode("items__").alias("item__")).select(key, "item__.*")


def padded(data: bytes) -> bytes:
    return data.ljust(max(ROW, -(-len(data) // ROW) * ROW), b" ")


def to_png(payload: bytes) -> bytes:
    rows = np.frombuffer(payload, dtype=np.uint8).reshape(-1, ROW)
    lines = np.zeros((len(rows), ROW + 1), dtype=np.uint8)
    lines[:, 1:] = rows
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", ROW // 3, len(rows), 8, 2, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), LEVEL)) + chunk(b"IEND", b"")


def from_png(stored: bytes) -> tuple[int, int, bytes]:
    """Width, height and samples of what to_png made; checksums are verified."""
    if stored[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, width, height, data = 8, 0, 0, b""
    while at < len(stored):
        size, kind = struct.unpack(">I4s", stored[at : at + 8])
        body = stored[at + 8 : at + 8 + size]
        if struct.unpack(">I", stored[at + 8 + size : at + 12 + size])[0] != zlib.crc32(kind + body):
            raise ValueError("damaged PNG")
        if kind == b"IHDR":
            width, height, depth, colour = struct.unpack(">IIBB", body[:10])
            if (depth, colour) != (8, 2):
                raise ValueError("only 8-bit RGB is stored")
        elif kind == b"IDAT":
            data += body
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(data), dtype=np.uint8).reshape(height, 3 * width + 1)
    if lines[:, 0].any():
        raise ValueError("only unfiltered rows are stored")
    return width, height, lines[:, 1:].tobytes()


def feature(width: int, height: int, samples: bytes) -> str:
    """Size, the mean of each channel in thousandths, and the share in thousandths of each eighth of the sample range."""
    x = np.frombuffer(samples, dtype=np.uint8)
    means = x.reshape(-1, 3).sum(0, dtype=np.int64) * 1000 // (width * height)
    eighths = np.bincount(x >> 5, minlength=8) * 1000 // len(x)
    return f"{width}x{height};mean={','.join(map(str, means))};eighths={','.join(map(str, eighths))}"


MEDIA_FIELDS = [
    StructField("payload_bytes", LongType()), StructField("payload_sha256", StringType()), StructField("tail_crc32", LongType()),
    StructField("media_bytes", LongType()), StructField("media_sha256", StringType()), StructField("feature", StringType()),
]


def stored(payloads: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key and the PNG of each padded text, column media."""

    def work(texts: list[str]) -> list[list]:
        return [[to_png(padded(t.encode("utf-8", "surrogatepass"))) for t in texts]]

    return map_texts(payloads, (key,), text, lambda: work, [StructField("media", BinaryType())])


def described(media: DataFrame, key: str) -> DataFrame:
    """key and what the stored bytes of column media hold, read back."""

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(f.dataType) for f in MEDIA_FIELDS]
        for batch in batches:
            rows = []
            for one in batch.column("media"):
                data = one.as_py()
                width, height, samples = from_png(data)
                rows.append((len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature(width, height, samples)))
            made = list(zip(*rows)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), *[pa.array(list(v), type=k) for v, k in zip(made, kinds)]], names=[key, *[f.name for f in MEDIA_FIELDS]]
            )

    source = media.select(key, "media")
    return source.mapInArrow(run, StructType([source.schema[key], *MEDIA_FIELDS]))


def resolved(refs: DataFrame, store: DataFrame) -> DataFrame:
    """refs with the features that store has for their digest; one row for each of refs.

    store is read from its checkpoint, so both sides of the join are dealt out for it and a digest that very many
    references share is split at run time.
    """
    once = cut(store.groupBy("digest").agg(*[F.max(f.name).alias(f.name) for f in MEDIA_FIELDS]))
    return refs.join(once, "digest", "left")


def sequences(page_items: DataFrame, key: str) -> DataFrame:
    """key and the page's items in order, as an array of structs."""
    columns = [c for c in page_items.columns if c not in (key, "pos")]
    return page_items.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", *columns))).alias("sequence"))


def payload_digest(text):
    """Digest of a text's payload, as an expression on the JVM."""
    size = F.octet_length(text)
    return F.sha2(F.concat(text, F.repeat(F.lit(" "), F.greatest(F.lit(ROW), F.ceil(size / ROW) * ROW).cast("int") - size)), 256)


def page_of(text: Column, digest: Column, n_bytes: Column) -> Column:
    """A page of a text: a paragraph for each line, and after the first half of them a figure that refers to the text's payload."""
    escaped = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    lines = F.transform(F.split(escaped, "\n"), lambda line: F.concat(F.lit("<p>"), line, F.lit("</p>")))
    half = F.floor(F.size(lines) / 2).cast("int")
    figure = F.concat(F.lit('<figure><img src="sha256:'), digest, F.lit('"><figcaption>'), n_bytes.cast("string"), F.lit(" bytes</figcaption></figure>"))
    return F.concat(F.lit("<article>"), F.array_join(F.slice(lines, 1, half), ""), figure, F.array_join(F.slice(lines, half + 1, F.size(lines)), ""), F.lit("</article>"))


def document_media(documents: DataFrame) -> DataFrame:
    """Each document as a page of its lines with a figure between them, parsed, resolved, put in sequence and read back.

    Equal texts have equal values. doc_id null stays null; repeated rows are told apart by a row number of the scan, kept in the
    checkpoint of the narrow items (a text item keeps its length). n_items, media_pos and caption are those of the sequence.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    own = documents.select(F.monotonically_increasing_id().alias("row"), "doc_id", text.alias("text"), payload_digest(text).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"))
    keyed = own.select(F.struct("row", "doc_id", "n_bytes").alias("key"), page_of(F.col("text"), F.col("digest"), F.col("n_bytes")).alias("html"))
    narrow = cut(items(keyed, "key").select("key", "pos", "kind", F.length("text").alias("n_chars"), "digest", "caption"))
    store = described(stored(own.select("digest", "text"), "digest"), "digest")
    names = [f.name for f in MEDIA_FIELDS]
    found = resolved(narrow.where("digest is not null"), store)
    others = narrow.where("digest is null").select(*[F.col(c) if c in narrow.columns else F.lit(None).cast(found.schema[c].dataType).alias(c) for c in found.columns])
    whole = sequences(found.unionByName(others), "key")
    medium = F.element_at(F.filter("sequence", lambda x: x["digest"].isNotNull()), 1)
    return whole.select("key.doc_id", "key.n_bytes", F.size("sequence").alias("n_items"), medium.alias("m")).select(
        "doc_id", "n_bytes", *[f"m.{n}" for n in names], "n_items", F.col("m.pos").alias("media_pos"), "m.caption",
    )
