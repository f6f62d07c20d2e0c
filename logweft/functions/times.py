"""Times of day as column expressions.

A log's times are '[HH:MM:SS]' without a date. Patterns end in \\z, since Java's $ also matches before a last line feed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400
ANY_TIME = r"(\d{1,2}):(\d{1,2}):(\d{1,2})"
WHOLE_TIME = r"^\[(\d{2}):(\d{2}):(\d{2})\]\z"


def part(text: Column, pattern: str, k: int) -> Column:
    return F.regexp_extract(text, pattern, k).try_cast("int")


def seconds_of_day(text: Column) -> Column:
    """Of the first time in text, one or two digits a part and unchecked; 0 if there is none (or text is null)."""
    h, m, s = (part(text, ANY_TIME, k) for k in (1, 2, 3))
    return F.coalesce(h * 3600 + m * 60 + s, F.lit(0))


def normalized(text: Column) -> Column:
    """'[HH:MM:SS]' of the first time in text, wherever it stands, unchecked; '' if there is none."""
    parts = [F.lpad(F.regexp_extract(text, ANY_TIME, k), 2, "0") for k in (1, 2, 3)]
    return F.when(text.rlike(ANY_TIME), F.concat(F.lit("["), F.concat_ws(":", *parts), F.lit("]"))).otherwise("")


TYPED = r"\[?(\d{0,2}):(\d{0,2}):(\d{0,2})\]?"


def typed(text: Column) -> Column:
    """hh, mm and ss of a time that is being typed: none to two digits each; empty if there is none."""
    return F.struct(*[F.regexp_extract(F.coalesce(text, F.lit("")), TYPED, k).alias(n) for k, n in ((1, "hh"), (2, "mm"), (3, "ss"))])


def pasted(text: Column) -> Column:
    """'[HH:MM:SS]' of the first three groups of one or two digits in text, whatever stands between them; null if there are fewer."""
    groups = F.regexp_extract_all(text, F.lit(r"(\d{1,2})"), 1)
    whole = F.concat(F.lit("["), F.array_join(F.transform(F.slice(groups, 1, 3), lambda g: F.lpad(g, 2, "0")), ":"), F.lit("]"))
    return F.when(F.size(groups) >= 3, whole)


def date_time(at: Column) -> Column:
    """'YYYY-MM-DD HH:MM' in the session's time zone."""
    return F.date_format(at, "yyyy-MM-dd HH:mm")


def is_complete(text: Column) -> Column:
    """Whether text is '[HH:MM:SS]' in range."""
    h, m, s = (part(text, WHOLE_TIME, k) for k in (1, 2, 3))
    return F.coalesce(text.rlike(WHOLE_TIME) & (h < 24) & (m < 60) & (s < 60), F.lit(False))


def shown(text: Column) -> Column:
    """What is inside the brackets of a whole time; else text without any bracket."""
    return F.when(text.rlike(r"^\[\d{2}:\d{2}:\d{2}\]\z"), F.substring(text, 2, 8)).otherwise(F.translate(text, "[]", ""))


def clock(seconds: Column) -> Column:
    """'HH:MM:SS' of seconds that may lie in another day."""
    s = F.pmod(seconds, F.lit(DAY))
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60)))


def duration(seconds: Column) -> Column:
    """'Xm Ys', 'Xm' or 'Ys'; nothing below zero."""
    s = F.greatest(F.lit(0), F.round(seconds).cast("bigint"))
    m, rest = F.floor(s / 60), s % 60
    return F.when(m == 0, F.format_string("%ds", rest)).when(rest == 0, F.format_string("%dm", m)).otherwise(F.format_string("%dm %ds", m, rest))


def time_range(start: Column, end: Column) -> Column:
    return F.concat(clock(start), F.lit("\u2013"), clock(end))


MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def file_label(name: Column, prefix: str) -> Column:
    """'DD Mon YYYY · HH:MM:SS' of '<prefix> DD-MM-YYYY HH-MM-SS.png'; other names, and values out of range, as they are."""
    pattern = rf"^{prefix} (\d{{2}})-(\d{{2}})-(\d{{4}}) (\d{{2}})-(\d{{2}})-(\d{{2}})\.png\z"
    day, month, _, h, m, s = (part(name, pattern, k) for k in range(1, 7))
    texts = [F.regexp_extract(name, pattern, k) for k in range(1, 7)]
    valid = name.rlike(pattern) & day.between(1, 31) & month.between(1, 12) & (h < 24) & (m < 60) & (s < 60)
    word = F.element_at(F.array(*[F.lit(x) for x in MONTHS]), F.when(month.between(1, 12), month).otherwise(1))
    label = F.concat(texts[0], F.lit(" "), word, F.lit(" "), texts[2], F.lit(" · "), F.concat_ws(":", *texts[3:]))
    return F.when(valid, label).otherwise(name)
