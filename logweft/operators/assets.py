"""Image files: admission, duplicates by content, restoring, clearing, and the grid of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweft.operators.counts import first_rows

MAX_BYTES = 3 * 1024 * 1024
#: The grid: lines, their step, height and width, and the margin below them.
LINES, STEP, HEIGHT, WIDTH, MARGIN = 39, 13, 12, 384, 69


def numbered(rows: DataFrame, order: str, name: str, width: int = 10_000) -> DataFrame:
    """rows with their place by an integer column, from 0: ranks within ranges of its values plus the rows in ranges before, these summed up in ranges of ranges."""
    ranged = rows.withColumn("range__", F.floor(F.col(order) / width))
    within = Window.partitionBy("range__").orderBy(order)
    counts = ranged.groupBy("range__").count().withColumn("wide__", F.floor(F.col("range__") / width))
    before = lambda window: F.coalesce(F.sum("count").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wide = counts.groupBy("wide__").agg(F.sum("count").alias("count")).select("wide__", before(Window.partitionBy(F.lit(0)).orderBy("wide__")).alias("wide_before__"))
    own = counts.select("range__", "wide__", before(Window.partitionBy("wide__").orderBy("range__")).alias("before__"))
    offsets = own.join(wide, "wide__").select("range__", (F.col("before__") + F.col("wide_before__")).alias("before__"))
    return ranged.withColumn("rank__", F.row_number().over(within)).join(offsets, "range__").withColumn(name, F.col("before__") + F.col("rank__") - 1).drop("range__", "rank__", "before__")


def admitted(files: DataFrame, known: DataFrame, next_id: int, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Files (file_ord, name, mime, content, size_bytes) with checksum, outcome and id.

    Outcomes in order: not_png (neither by type nor by name), too_large, duplicate (every file equal to an active image of known), restored (of a removed one), accepted.
    Of other files with equal content in a batch the first counts; the others are dropped. Only accepted files get ids, in order.
    """
    is_png = (F.coalesce("mime", F.lit("")) == "image/png") | F.lower(F.coalesce("name", F.lit(""))).endswith(".png")
    checked = files.withColumn("refused", F.when(~is_png, "not_png").when(F.col("size_bytes") >= max_bytes, "too_large"))
    sound = checked.where("refused is null").withColumn("checksum", F.sha2("content", 256)).drop("content")
    active = known.where("lifecycle = 'active'").select("checksum").distinct()
    removed = known.where("lifecycle = 'removed'").groupBy("checksum").agg(F.min("id").alias("removed_id"))
    once = first_rows(sound.join(active, "checksum", "left_anti"), ["checksum"], "file_ord")
    judged = once.join(removed, "checksum", "left").withColumn("outcome", F.when(F.col("removed_id").isNotNull(), "restored").otherwise("accepted"))
    new = numbered(judged.where("outcome = 'accepted'").select("file_ord"), "file_ord", "place").select("file_ord", (F.col("place") + next_id).alias("new_id"))
    out = judged.join(new, "file_ord", "left").select(
        "file_ord", "name", "size_bytes", "checksum", "outcome", F.coalesce("new_id", F.when(F.col("outcome") == "restored", F.col("removed_id"))).alias("id")
    )
    no_id = F.lit(None).cast("long").alias("id")
    again = sound.join(active, "checksum", "left_semi").select("file_ord", "name", "size_bytes", "checksum", F.lit("duplicate").alias("outcome"), no_id)
    refused = checked.where("refused is not null").select("file_ord", "name", "size_bytes", F.lit(None).cast("string").alias("checksum"), F.col("refused").alias("outcome"), no_id)
    return out.unionByName(again).unionByName(refused)


def restored(known: DataFrame, outcome: DataFrame) -> DataFrame:
    """known (with file_name and size_bytes) with the removed images active again that a batch restored, under the name and size of the file that did."""
    back = outcome.where("outcome = 'restored'").select("id", F.col("name").alias("name__"), F.col("size_bytes").alias("size__"))
    of = lambda new, old: F.when(F.col("name__").isNotNull() | F.col("size__").isNotNull(), new).otherwise(F.col(old)).alias(old)
    changed = {"lifecycle": of(F.lit("active"), "lifecycle"), "file_name": of(F.col("name__"), "file_name"), "size_bytes": of(F.col("size__"), "size_bytes")}
    return known.join(back, "id", "left").select(*[changed.get(c, F.col(c)) for c in known.columns])


def without_one(images: DataFrame, file_name: str, created_at: str, size_bytes: int, reason: str, order: str = "ord") -> DataFrame:
    """images without the first rejected one of that name, time, size and reason; others like it stay."""
    alike = F.col("status") == "rejected"
    for column, value in [("file_name", file_name), ("created_at", created_at), ("size_bytes", size_bytes), ("rejection_reason", reason)]:
        alike = alike & F.col(column).eqNullSafe(F.lit(value))
    first = images.where(alike).agg(F.min(order).alias("first__"))
    return images.join(F.broadcast(first), images[order] == F.col("first__"), "left_anti")


def active(images: DataFrame) -> DataFrame:
    return images.where("status = 'accepted' and lifecycle = 'active'")


def cleared(images: DataFrame, slices: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Images, slices and results without what removed images have left."""
    removed = images.where("lifecycle = 'removed'").select(F.col("id").alias("image_id"))
    kept = slices.join(removed, "image_id", "left_anti")
    gone = slices.join(removed, "image_id", "left_semi").select("slice_id")
    return images.where("lifecycle is null or lifecycle <> 'removed'"), kept, results.join(gone, "slice_id", "left_anti")


def of_active(slices: DataFrame, images: DataFrame) -> DataFrame:
    return slices.join(active(images).select(F.col("id").alias("image_id")), "image_id", "left_semi")


def whole_rect(left: Column, top: Column, width: Column, height: Column) -> Column:
    """A rectangle in whole pixels: fractions are cut off, and it has a pixel at least."""
    cut = lambda c: c.cast("int")
    return F.struct(cut(left).alias("left"), cut(top).alias("top"), F.greatest(F.lit(1), cut(width)).alias("width"), F.greatest(F.lit(1), cut(height)).alias("height"))


def line_grid(frames: DataFrame, lines: int = LINES) -> DataFrame:
    """A row for each line of each frame (image_id, left, bottom): slice_id, index from the top, display_id from the bottom, rectangle."""
    k = F.col("k")
    return frames.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(lines - 1)))).select(
        F.concat_ws("-", F.col("image_id").cast("string"), (k + 1).cast("string")).alias("slice_id"), "image_id", (k + 1).alias("index"), (F.lit(lines) - k).alias("display_id"),
        F.col("left"), (F.col("bottom") - MARGIN - lines * STEP + k * STEP).alias("top"), F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"),
    )


def result_summary(results: DataFrame) -> DataFrame:
    """total, ok, errors and rejected (the rest)."""
    ok, errors = F.count_if(F.col("status") == "accepted"), F.count_if(F.col("rejection_reason") == "ocr_error")
    return results.agg(F.count("*").alias("total"), ok.alias("ok"), (F.count("*") - ok - errors).alias("rejected"), errors.alias("errors"))


#: What a person reads for a reason code of a line or of a file, and for any other code.
REASONS = {
    "bad_time": "Could not read timestamp", "bad_player": "Could not read player name", "bad_item": "Could not read item name", "not_a_use": "No log line detected",
    "not_png": "Unsupported file type", "too_large": "Image is too large", "duplicate": "Duplicate screenshot", "no_frame": "Not a supported screenshot", "no_lines": "No log line detected",
    "decode_error": "Could not read image",
}
OTHER_REASON = "Could not read text"


def reason_text(code: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in REASONS.items() for x in pair])
    return F.coalesce(known[code], F.lit(OTHER_REASON))


def refused(results: DataFrame) -> DataFrame:
    """Rejected or failed results, with what a person reads."""
    return results.where(F.col("status").isin("rejected", "failed")).withColumn("reason", reason_text(F.col("rejection_reason")))


def saved(images: DataFrame, slices: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What a session keeps: images that are not rejected, their slices, and the results of these."""
    kept = images.where("status <> 'rejected'")
    own = slices.join(kept.select(F.col("id").alias("image_id")), "image_id", "left_semi")
    return kept, own, results.join(own.select("slice_id"), "slice_id", "left_semi")


def issues(slices: DataFrame, results: DataFrame, manual: DataFrame) -> DataFrame:
    """slice_id of slices whose result was refused, its reason, and the id of the record typed in for it, if any."""
    typed = manual.select(F.col("source_slice_id").alias("slice_id"), F.col("id").alias("manual_id"))
    return refused(results).join(slices.select("slice_id"), "slice_id", "left_semi").join(typed, "slice_id", "left").select("slice_id", "reason", "manual_id")


def openable(images: DataFrame, slices: DataFrame) -> DataFrame:
    """One row: whether there is an active image and a slice of one."""
    has = lambda df: df.limit(1).agg(F.count("*") > 0)
    return has(active(images)).toDF("image").crossJoin(has(of_active(slices, images)).toDF("slice")).select((F.col("image") & F.col("slice")).alias("openable"))
