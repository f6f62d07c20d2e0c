"""Vector codes by product quantisation with Yinyang Lloyd on integers.

Components become floor(4096 * x). A vector is cut into PARTS equal parts; each part position has a codebook of ENTRIES entries, first that part of the
vectors of smallest vec_id. A round gives every part its nearest entry (squared distance, ties to the lower index) and moves every
entry to the floor of the mean of its parts.

Entries of a codebook are clustered into GROUPS groups once. A vector's part keeps an upper bound of the distance to its entry, and for each group a lower bound of
the distance to the group's entries (but its own). When entries move, the upper bound grows by what its entry moved, and each lower bound shrinks by the largest
move in its group. A part whose upper bound stays below all its lower bounds keeps its entry unseen; for others the distance
to the entry is computed anew, and only groups whose bound is not above it are scanned. Bounds are 32-bit, rounded away from being
believed and with SLACK to spare; whatever they can't exclude, ties among it, is decided by squared distances in integers. So assignments are
those of plain Lloyd.

State (entries and bounds, 13 bytes a part with two groups) travels with the vectors, as a table of the checkpoint folder written each
round; the table of the round before is deleted. Tasks add up their parts for each entry, so only PARTS * ENTRIES rows are moved for each
task and reach the driver, where codebooks are kept.

Vectors that are null or hold null or non-finite components take no part. Shorter vectors, and lengths that PARTS does not divide, are filled up with
zeros. Ties of vec_id among the first vectors go by the vector, null vec_ids come last; with fewer than ENTRIES vectors codebooks are
smaller. Components whose squares may pass 64 bits are computed in Python's integers; an error that passes a long is given as the largest long. Repeated rows
are rows like any other. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweft.llm.common import checkpoint_folder

PARTS, ENTRIES, ROUNDS, SCALE, GROUPS = 8, 16, 6, 4096, 2
#: Share by which bounds are loosened; far above what 64-bit distances are off.
SLACK = 1e-5
#: Greatest component whose squared distances are safe in 64 bits (for parts of up to 2**14 components).
SAFE = 1 << 23
ROWS_AT_ONCE = 8192
LARGEST = (1 << 63) - 1


def whole(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) as integers: int64, or Python's where those may pass 64 bits in a square."""
    scaled = np.floor(x * float(SCALE))
    if not scaled.size or np.abs(scaled).max() < SAFE:
        return scaled.astype(np.int64)
    exact = [int(v) if np.isfinite(v) else int(o) * SCALE for v, o in zip(scaled.ravel().tolist(), x.ravel().tolist())]
    return np.array(exact, dtype=object).reshape(x.shape)


def squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances, rows of x by rows of entries, exact."""
    if x.dtype == object or entries.dtype == object:
        x, entries = x.astype(object), entries.astype(object)
    d = x[:, None, :] - entries[None]
    return (d * d).sum(axis=2)


def root(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d.astype(np.float64))


@dataclass
class Codebook:
    """Entries of one part position, their groups, and how far each has moved in the last update."""

    entries: np.ndarray
    group: np.ndarray
    moved: np.ndarray

    @staticmethod
    def started(entries: np.ndarray, groups: int) -> Codebook:
        """Entries clustered into groups by a few rounds of k-means from the first ones that differ."""
        x = entries.astype(np.float64)
        _, first = np.unique(x, axis=0, return_index=True)
        centres = x[np.sort(first)[:groups]]
        for _ in range(8):
            at = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
            centres = np.stack([x[at == g].mean(0) if (at == g).any() else centres[g] for g in range(len(centres))])
        return Codebook(entries, at, np.zeros(len(entries)))

    def updated(self, count: np.ndarray, sums: np.ndarray) -> Codebook:
        """Entries at the floor of the mean of their parts; unused ones stay."""
        rows = [[s // n for s in row] if n else old for n, row, old in zip(count.tolist(), sums.tolist(), self.entries.tolist())]
        new = np.array(rows, dtype=object)
        if not new.size or max(abs(v) for v in new.ravel().tolist()) < SAFE:
            new = new.astype(np.int64)
        step = new.astype(np.float64) - self.entries.astype(np.float64)
        return Codebook(new, self.group, np.sqrt((step**2).sum(1)))


@dataclass
class Bounds:
    """Of a batch of parts: entry, upper bound, a lower bound for each group, and how many distances to entries were computed."""

    near: np.ndarray
    upper: np.ndarray
    lower: np.ndarray
    scanned: int = 0


def assigned(x: np.ndarray, book: Codebook, old: Bounds | None = None) -> Bounds:
    """Nearest entries of parts x, from what was known before the last update of book (None: nothing)."""
    n, k = len(x), len(book.entries)
    if old is None:
        near, upper, lower = np.zeros(n, dtype=np.int64), np.full(n, np.inf), np.zeros((n, GROUPS))
    else:
        drift = np.array([book.moved[book.group == g].max(initial=0.0) for g in range(GROUPS)])
        near = old.near.astype(np.int64)
        upper = (old.upper.astype(np.float64) + book.moved[near]) * (1 + SLACK) + SLACK
        lower = np.maximum(0.0, (old.lower.astype(np.float64) - drift) * (1 - SLACK) - SLACK)
    scanned, least = 0, lower.min(axis=1)
    for step in ("tighten", "scan"):
        rows = np.flatnonzero(upper >= least)
        if step == "tighten" and old is not None and len(rows):
            own = (x[rows] - book.entries[near[rows]]) if x.dtype == book.entries.dtype else x[rows].astype(object) - book.entries[near[rows]].astype(object)
            upper[rows] = root((own * own).sum(axis=1)) * (1 + SLACK) + SLACK
            scanned += len(rows)
    if not len(rows):
        return Bounds(near, upper, lower, scanned)
    # each group whose bound does not exclude it, and the entry itself, in integers
    looked = np.zeros((len(rows), k), dtype=bool)
    kind = object if object in (x.dtype, book.entries.dtype) else np.int64
    found = np.full((len(rows), k), 1 << 400 if kind is object else LARGEST, dtype=kind)
    fails = upper[rows, None] >= lower[rows]
    for g in range(GROUPS):
        members, hit = np.flatnonzero(book.group == g), np.flatnonzero(fails[:, g])
        if len(members) and len(hit):
            found[np.ix_(hit, members)] = squared(x[rows[hit]], book.entries[members])
            looked[np.ix_(hit, members)] = True
            scanned += len(hit) * len(members)
    for e in np.unique(near[rows]).tolist():
        own = np.flatnonzero((near[rows] == e) & ~looked[:, e])
        if len(own):
            found[own, e] = squared(x[rows[own]], book.entries[e : e + 1])[:, 0]
            looked[own, e] = True
    pick = found.argmin(axis=1).astype(np.int64)  # the first of equals
    everyone = np.arange(len(rows))
    best = found[everyone, pick]
    others = np.where(looked, root(np.where(looked, found, 0)), np.inf)
    others[everyone, pick] = np.inf
    for g in range(GROUPS):
        members = book.group == g
        seen = others[:, members].min(axis=1, initial=np.inf) * (1 - SLACK)
        lower[rows, g] = np.where(fails[:, g], seen, np.minimum(lower[rows, g], seen))
    near[rows], upper[rows] = pick, root(best) * (1 + SLACK)
    return Bounds(near, upper, lower, scanned)


def vectors_of(column: pa.Array, width: int) -> np.ndarray:
    """Rows of the column as doubles, filled up with zeros to width."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    lengths = np.diff(column.offsets.to_numpy())
    if (lengths == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(lengths), width))
    out[np.arange(width)[None] < lengths[:, None]] = flat
    return out


def packed(parts: list[Bounds]) -> pa.Array:
    """Bounds of all parts, a row of bytes for each vector."""
    n = len(parts[0].near)
    up = [np.nextafter(b.upper.astype(np.float32), np.float32(np.inf))[:, None] for b in parts]
    down = [np.nextafter(b.lower.astype(np.float32), np.float32(-np.inf)) for b in parts]
    rows = np.ascontiguousarray(np.concatenate([np.stack([b.near for b in parts], 1).astype(np.uint8), np.concatenate(up + down, 1).view(np.uint8)], 1))
    offsets = np.arange(n + 1, dtype=np.int32) * rows.shape[1]
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(rows)])


def unpacked(column: pa.Array) -> list[Bounds]:
    rows = np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(column), -1)
    bounds = np.ascontiguousarray(rows[:, PARTS:]).view(np.float32)
    return [Bounds(rows[:, p], bounds[:, p], bounds[:, PARTS + p * GROUPS : PARTS + (p + 1) * GROUPS]) for p in range(PARTS)]


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole_batch in batches:
        for at in range(0, whole_batch.num_rows, ROWS_AT_ONCE):
            yield whole_batch.slice(at, ROWS_AT_ONCE)


def part_of(x: np.ndarray, p: int) -> np.ndarray:
    size = x.shape[1] // PARTS
    return x[:, p * size : (p + 1) * size]


def usable(vector: Column) -> Column:
    return vector.isNotNull() & F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


class Rounds:
    """The state table of all vectors and the codebooks, from round to round."""

    def __init__(self, vectors: DataFrame):
        self.spark = vectors.sparkSession
        self.kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
        rows = vectors.select("vec_id", "label", F.col("embedding").cast(self.kind).alias("embedding")).where(usable(F.col("embedding")))
        self.rows, self.path, self.books = rows, None, []
        self.width = rows.agg(F.max(F.size("embedding"))).first()[0]
        if self.width is not None:
            self.width = max(1, -(-self.width // PARTS)) * PARTS
            first = rows.orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(ENTRIES).select("embedding").toArrow()["embedding"].combine_chunks()
            x = whole(vectors_of(first, self.width))
            self.books = [Codebook.started(part_of(x, p), GROUPS) for p in range(PARTS)]

    def written(self, rows: DataFrame) -> DataFrame:
        """rows as a table of the checkpoint folder, in the place of the one before."""
        path = f"{checkpoint_folder(self.spark)}/codes_{uuid.uuid4().hex}"
        rows.write.parquet(path)
        if self.path:
            remove(self.spark, self.path)
        self.path = path
        return self.spark.read.parquet(path)

    def assign(self) -> None:
        """Every vector's entries under the codebooks as they are, and its error."""
        shared, width, started = self.spark.sparkContext.broadcast(self.books), self.width, self.path is not None
        out = f"vec_id {self.rows.schema['vec_id'].dataType.simpleString()}, label {self.rows.schema['label'].dataType.simpleString()}, embedding {self.kind}, state binary, error bigint"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches):
                if not b.num_rows:
                    continue
                x = whole(vectors_of(b.column("embedding"), width))
                old = unpacked(b.column("state")) if started else [None] * PARTS
                new = [assigned(part_of(x, p), book, o) for p, (book, o) in enumerate(zip(shared.value, old))]
                error = np.zeros(len(x), dtype=object)
                for p, (book, made) in enumerate(zip(shared.value, new)):
                    own = part_of(x, p)
                    d = own.astype(object) - book.entries[made.near].astype(object) if object in (own.dtype, book.entries.dtype) else own - book.entries[made.near]
                    error = error + (d * d).sum(axis=1)
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), b.column("embedding"), packed(new), pa.array([min(int(e), LARGEST) for e in error], pa.int64())], names=["vec_id", "label", "embedding", "state", "error"])

        source = self.rows if not started else self.rows.select("vec_id", "label", "embedding", "state")
        self.rows = self.written(source.mapInArrow(run, out))

    def update(self) -> None:
        """Codebooks from the means of their parts."""
        width, sizes = self.width, [len(b.entries) for b in self.books]

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            count = [np.zeros(k, dtype=np.int64) for k in sizes]
            total = [np.zeros((k, width // PARTS), dtype=object) for k in sizes]
            for b in slices(batches):
                if not b.num_rows:
                    continue
                x = whole(vectors_of(b.column("embedding"), width))
                near = np.frombuffer(b"".join(v[:PARTS] for v in b.column("state").to_pylist()), dtype=np.uint8).reshape(-1, PARTS)
                for p in range(PARTS):
                    count[p] += np.bincount(near[:, p], minlength=sizes[p])
                    here = np.zeros(total[p].shape, dtype=x.dtype)
                    np.add.at(here, near[:, p], part_of(x, p))
                    total[p] = total[p] + here.astype(object)
            made = [(p, e, int(count[p][e]), [str(v) for v in total[p][e]]) for p in range(PARTS) for e in range(sizes[p]) if count[p][e]]
            part, entry, n, told = zip(*made) if made else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(n, pa.int64()), pa.array(told, pa.list_(pa.string()))], names=["part", "entry", "n", "sums"])

        def added(table: pa.Table) -> pa.Table:
            """One row for each task has come in."""
            n = sum(table["n"].to_pylist())
            total = [str(sum(map(int, column))) for column in zip(*table["sums"].to_pylist())]
            return pa.table({"part": table["part"][:1], "entry": table["entry"][:1], "n": pa.array([n], pa.int64()), "sums": pa.array([total], pa.list_(pa.string()))})

        schema = "part int, entry int, n bigint, sums array<string>"
        got = self.rows.select("embedding", "state").mapInArrow(sums, schema).groupBy("part", "entry").applyInArrow(added, schema).collect()
        for p, book in enumerate(self.books):
            count, total = np.zeros(len(book.entries), dtype=np.int64), np.zeros(book.entries.shape, dtype=object)
            for r in got:
                if r.part == p:
                    count[r.entry], total[r.entry] = r.n, [int(v) for v in r.sums]
            self.books[p] = book.updated(count, total)

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(v) for b in self.books for v in b.entries.ravel().tolist()).encode()).hexdigest()


def remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def codes(vectors: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code (two hex digits for each part), error, label_error and codebooks_sha256 of every usable row of (vec_id, embedding, label)."""
    work = Rounds(vectors)
    if work.width is None:
        return vectors.sparkSession.createDataFrame([], "vec_id bigint, code string, error bigint, label_error bigint, codebooks_sha256 string")
    for _ in range(rounds):
        work.assign()
        work.update()
    work.assign()
    rows = work.rows.select("vec_id", "label", F.lower(F.hex(F.substring("state", 1, PARTS))).alias("code"), "error")
    # whoever has the label is joined to its sum; a label that very many have is summed up in each task before, and Spark splits its rows in the join
    sums = rows.groupBy(F.col("label").alias("label_")).agg(F.coalesce(F.try_sum("error"), F.lit(LARGEST)).alias("label_error"))
    both = rows.join(sums, rows["label"].eqNullSafe(sums["label_"]))
    return both.select("vec_id", "code", "error", "label_error", F.lit(work.digest()).alias("codebooks_sha256"))


def oracle_sql(rounds: int = ROUNDS) -> str:
    steps = [f"""k as materialized (select vec_id, label, row_number() over (order by vec_id nulls last, embedding) as r, [floor({SCALE} * x::double)::bigint for x in embedding] as q from embeddings
    where embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
  v as materialized (select r, p, q[p * (len(q) // {PARTS}) + 1:(p + 1) * (len(q) // {PARTS})] as v from k, range({PARTS}) t(p)),
  b0 as materialized (select p, r - 1 as e, v as c from v where r <= {ENTRIES})"""]
    for t in range(rounds + 1):
        steps.append(f"""a{t} as materialized (select r, p, e, v, list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(v, c)]) as d from v join b{t} using (p)
    qualify row_number() over (partition by r, p order by d, e) = 1)""")
        if t < rounds:
            steps.append(f"""m{t} as (select p, e, i, sum(x)::hugeint as s, count(*) as n from (select p, e, unnest(v) as x, generate_subscripts(v, 1) as i from a{t}) group by all),
  n{t} as (select p, e, list(((s - ((s % n + n) % n)) // n)::bigint order by i) as c from m{t} group by 1, 2),
  b{t + 1} as materialized (select p, e, coalesce(n{t}.c, b{t}.c) as c from b{t} left join n{t} using (p, e))""")
    steps.append(f"""h as (select sha256(string_agg(array_to_string(c, ','), ',' order by p, e)) as codebooks_sha256 from b{rounds}),
  o as (select r, string_agg(printf('%02x', e), '' order by p) as code, sum(d)::bigint as error from a{rounds} group by 1)""")
    return "with " + ",\n  ".join(steps) + "\n  select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256 from o join k using (r), h"
