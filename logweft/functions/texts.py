"""Texts of a log as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN = "Unknown"


def trimmed(text: Column) -> Column:
    """Without any white space of Unicode at either end (trim() takes spaces alone)."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def label(text: Column) -> Column:
    """Trimmed, or UNKNOWN if nothing is left."""
    t = F.coalesce(trimmed(text), F.lit(""))
    return F.when(t == "", UNKNOWN).otherwise(t)


def alphabetical(text: Column) -> list[Column]:
    """Order without regard to case and accents, then with regard to them."""
    return [F.collate(text, "UNICODE_CI_AI"), F.collate(text, "UNICODE"), text]


USED = r"(?U)^(.*?)(?:^|\s)used(?:\s+|\z)(.*)\z"


def log_body(body: Column) -> dict[str, Column]:
    """player, item and reason of '<player> used <item>': cut at the first 'used' that stands alone."""
    text = trimmed(body)
    player = trimmed(F.regexp_extract(text, f"(?s){USED}", 1))
    item = trimmed(F.regexp_extract(text, f"(?s){USED}", 2))
    reason = (
        F.when(~F.coalesce(text.rlike(f"(?s){USED}"), F.lit(False)), "not_a_use")
        .when(~player.rlike(r"(?U)^\S+\z"), "bad_player")
        .when(item == "", "bad_item")
    )
    return {"player": F.when(reason.isNull(), player), "item": F.when(reason.isNull(), item), "reason": reason}


def csv_cell(value: Column) -> Column:
    """Quoted only if it holds a quote, a comma or a line feed."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike('[",\\n]'), quoted).otherwise(text)


def two_places(value: Column | str) -> Column:
    """Two decimal places of the exact binary value, halves away from zero.

    round() takes a double by its shortest decimal text, so that 0.015, which is a little less, would become 0.02. Here 200 times the value is kept as
    two doubles without any error (the value is split in halves of its bits), and the half is decided on both.
    """
    v = F.abs(F.col(value) if isinstance(value, str) else value)
    wide = v * 134_217_729.0
    high = wide - (wide - v)
    product = v * 200.0
    rest = (high * 200.0 - product) + (v - high) * 200.0
    n = F.floor((product + 1) / 2)
    n = n - F.when((product == 2 * n - 1) & (rest < 0), 1).otherwise(0)
    sign = F.when((F.col(value) if isinstance(value, str) else value) < 0, "-").otherwise("")
    return F.concat(sign, F.floor(n / 100).cast("string"), F.lit("."), F.lpad((n % 100).cast("string"), 2, "0"))


def delta(value: Column | str) -> Column:
    """What was lost, with two places and a minus; nothing lost has none."""
    column = F.col(value) if isinstance(value, str) else value
    return F.when(column == 0, "0.00").otherwise(F.concat(F.lit("-"), two_places(column)))


def units(text: Column) -> Column:
    """Length in UTF-16 units, in which message limits count."""
    return F.length(text) + F.regexp_count(text, F.lit(r"[\x{10000}-\x{10FFFF}]"))


def plural(n: Column, one: str, many: str) -> Column:
    return F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, one).otherwise(many))


def file_size(n: Column) -> Column:
    return (
        F.when(n < 1024, F.format_string("%d B", n)).when(n < 1024 * 1024, F.format_string("%.1f KB", n / 1024)).otherwise(F.format_string("%.1f MB", n / (1024 * 1024)))
    )


def compact(value: Column) -> Column:
    """A number with two places at most and no zeros at the end, then a times sign."""
    return F.concat(F.regexp_replace(F.format_string("%.2f", value), r"\.?0+\z", ""), F.lit("×"))


def same_glyphs(text: Column) -> Column:
    """Text with glyphs that look alike put as one: two apostrophes as a quote, l as I."""
    return F.replace(F.replace(text, F.lit("''"), F.lit('"')), F.lit("l"), F.lit("I"))


def unique_chars(text: Column) -> Column:
    """The characters of text, each where it comes first."""
    return F.array_join(F.array_distinct(F.split(text, "")), "")
