"""Exports: CSV and JSON rows, a text report, messages of limited size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweft.functions import texts, times
from logweft.operators import counts, packing, timeline

LIMIT = 2000
#: Ranges that a player's records are counted in, at most.
MOST_RANGES = 65_536
HEADER = "time,player,item,source,line from bottom"


def located(records: DataFrame, slices: DataFrame) -> DataFrame:
    """records with file and line of their slice (slice_id unique); unknown slices: 'unknown.png' and no line."""
    of = slices.select(F.col("slice_id").alias("source_slice_id"), "image_file_name", "display_id")
    return records.join(of, "source_slice_id", "left").withColumn("file", F.coalesce("image_file_name", F.lit("unknown.png")))


def csv_line() -> Column:
    return F.concat_ws(",", *[texts.csv_cell(c) for c in (times.shown(F.col("timestamp")), F.col("player"), F.col("item"), F.col("file"), F.col("display_id"))])


def json_row() -> Column:
    """A record as JSON in one line; the time is as it stands."""
    row = F.struct("timestamp", "player", "item", F.col("file").alias("source"), F.col("display_id").alias("lineFromBottom"))
    return F.to_json(row, {"ignoreNullFields": "false"})


def csv_document(rows: DataFrame) -> DataFrame:
    """line_no (0: the header) and line of the document; rows are located() ones, in order of ord. Lines join by line feeds, none after the last."""
    return rows.select((F.col("ord") + 1).alias("line_no"), csv_line().alias("line")).unionByName(rows.sparkSession.range(1).select(F.col("id").alias("line_no"), F.lit(HEADER).alias("line")))


def json_text(value: Column) -> Column:
    """A text as JSON writes it, quotes around it; null is null."""
    quoted = F.to_json(F.array(value))
    return F.when(value.isNull(), "null").otherwise(F.regexp_extract(quoted, r"(?s)^\[(.*)\]\z", 1))


def json_block() -> Column:
    """A record as it stands in a JSON document of two spaces a level."""
    fields = [("timestamp", json_text(F.col("timestamp"))), ("player", json_text(F.col("player"))), ("item", json_text(F.col("item"))), ("source", json_text(F.col("file"))), ("lineFromBottom", F.coalesce(F.col("display_id").cast("string"), F.lit("null")))]
    return F.concat(F.lit("    {\n"), F.concat_ws(",\n", *[F.concat(F.lit(f'      "{name}": '), value) for name, value in fields]), F.lit("\n    }"))


#: Values of ord that a part of a document holds.
PART = 4096


def document(rows: DataFrame, kind: str) -> DataFrame:
    """part and text of a CSV or JSON document of located() rows (ord from 0, unique): the texts in order of part are the document, byte by byte.

    A part is PART consecutive values of ord, put in order and joined by itself, with the separators at the joints; part -1 is the head, and the last part the foot of JSON.
    """
    line = F.concat(F.lit("\n"), csv_line()) if kind == "csv" else json_block()
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]), "" if kind == "csv" else ",\n")
    parts = rows.select("ord", line.alias("line")).groupBy(F.floor(F.col("ord") / PART).alias("part")).agg(joined.alias("text"))
    if kind == "csv":
        return parts.unionByName(rows.sparkSession.range(1).select(F.lit(-1).cast("long").alias("part"), F.lit(HEADER).alias("text")))
    bounds = rows.agg(F.floor(F.min("ord") / PART).alias("first"), F.floor(F.max("ord") / PART).alias("last"))
    parts = parts.crossJoin(F.broadcast(bounds)).select("part", F.when(F.col("part") > F.col("first"), F.concat(F.lit(",\n"), "text")).otherwise(F.col("text")).alias("text"))
    ends = bounds.select(F.inline(F.array(
        F.struct(F.lit(-1).cast("long").alias("part"), F.concat(F.lit('{\n  "schema": 1,\n  "records": ['), F.when(F.col("last").isNull(), "").otherwise("\n")).alias("text")),
        F.struct((F.coalesce("last", F.lit(-1)) + 1).alias("part"), F.concat(F.when(F.col("last").isNull(), "").otherwise("\n  "), F.lit("]\n}")).alias("text")),
    )))
    return parts.unionByName(ends)


def mime(kind: str) -> str:
    return {"csv": "text/csv", "json": "application/json"}.get(kind, "text/plain")


def file_name(at: Column, kind: str, prefix: str = "log") -> Column:
    """'<prefix>-YYYYMMDD-HHMMSS' with the ending of the kind (csv, json, plain or chat)."""
    ending = {"csv": ".csv", "json": ".json", "chat": "-chat.txt"}.get(kind, ".txt")
    return F.concat(F.lit(f"{prefix}-"), F.date_format(at, "yyyyMMdd-HHmmss"), F.lit(ending))


def headed(player: Column, n: Column, value: Column) -> Column:
    """'player · n uses (value)'."""
    return F.concat(player, F.lit(" · "), texts.plural(n, "use", "uses"), F.lit(" ("), F.coalesce(value, F.lit("0.00")), F.lit(")"))


def own_places(records: DataFrame) -> DataFrame:
    """records with own, their place (from 0, by pos) among those of their player: rank in a range of pos, and the player's records in ranges before.

    There are at most as many ranges as MOST_RANGES, whatever the number of records.
    """
    width = max(packing.RUN, -(-(records.agg(F.max("pos")).first()[0] or 0) // MOST_RANGES))
    ranged = records.withColumn("range__", F.floor(F.col("pos") / width))
    earlier = Window.partitionBy("player").orderBy("range__").rowsBetween(Window.unboundedPreceding, -1)
    before = ranged.groupBy("player", "range__").count().select("player", "range__", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before__"))
    ranked = ranged.withColumn("rank__", F.row_number().over(Window.partitionBy("player", "range__").orderBy("pos")))
    return ranked.join(before, ["player", "range__"]).withColumn("own", (F.col("before__") + F.col("rank__") - 1).cast("long")).drop("range__", "before__", "rank__")


def player_blocks(records: DataFrame, effective: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Each player's block of lines in parts of at most limit units, a heading and a line at least; records have pos, effective has player and effective.

    Runs of a player's lines are packed apart from each other (packing), so a player may have any number of them.
    Null players, times and items count as empty text.
    """
    value = effective.select(F.col("player").alias("label"), texts.two_places("effective").alias("value"))
    rows = own_places(records.withColumn("player", F.coalesce("player", F.lit(""))))
    heads = rows.groupBy("player").agg(F.count("*").alias("n")).withColumn("label", F.col("player")).join(value, "label", "left")
    heads = heads.select("player", F.concat(F.lit("### "), headed(F.col("player"), F.col("n"), F.col("value"))).alias("heading"))
    line = F.concat(F.lit("`"), F.coalesce(times.shown(F.col("timestamp")), F.lit("")), F.lit("` "), F.coalesce("item", F.lit("")))
    rows = rows.join(heads, "player").select("player", "heading", line.alias("line"), F.col("own").alias("place"), F.floor(F.col("own") / packing.RUN).alias("run"))
    start, size = texts.units(F.col("heading")), texts.units(F.col("line"))
    states = [size.alias("size"), F.least(start + 1 + size, F.lit(limit)).alias("fresh"), F.least(start, F.lit(limit)).alias("start")]
    parts = packing.packed(packing.pinned(rows.select("*", *states)), ["player"], limit).groupBy("player", F.col("number").alias("part"))
    parts = parts.agg(F.first("heading").alias("heading"), F.array_sort(F.collect_list(F.struct("place", "line"))).alias("lines"))
    shown = parts.select("player", "part", F.concat_ws("\n", "heading", F.transform("lines", lambda x: x["line"])).alias("text"))
    # a first line too long to stand below its heading leaves the heading alone in part 0
    lone = parts.where("part = 1").select("player", "heading").join(parts.where("part = 0").select("player"), "player", "left_anti")
    shown = shown.unionByName(lone.select("player", F.lit(0).cast("long").alias("part"), F.col("heading").alias("text")))
    last = parts.groupBy("player").agg((F.max("part") > 0).alias("alone"))
    return packing.pinned(shown.join(last, "player").select("player", "part", "text", texts.units(F.col("text")).alias("size"), "alone"))


def messages(blocks: DataFrame, limit: int = LIMIT) -> DataFrame:
    """message (number), text: blocks by player, as many in a message as fit; parts of a divided block stand alone.

    Only sizes are put in order and packed, in runs (packing); texts are joined to their message afterwards.
    """
    full = F.lit(limit)
    sized = blocks.select("player", "part", F.when(F.col("alone"), full + 1).otherwise(F.col("size")).alias("size"), F.when(F.col("alone"), full).otherwise(F.least("size", full)).alias("fresh"), full.alias("start"), F.lit(0).alias("all"))
    runs = packing.in_runs(sized, [*texts.alphabetical(F.col("player")), F.col("part")])
    placed = packing.packed(runs, ["all"], limit).select("player", "part", (F.col("number") - 1).alias("message"), "place")
    both = blocks.join(placed, ["player", "part"])
    return both.groupBy("message").agg(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"])).alias("text"))


def padded(text: Column, width: Column) -> Column:
    """Filled up on the right with spaces, in UTF-16 units."""
    return F.concat(text, F.repeat(F.lit(" "), (width - texts.units(text)).cast("int")))


def indented(text: Column, width: Column) -> Column:
    """Filled up on the left with spaces, in UTF-16 units."""
    return F.concat(F.repeat(F.lit(" "), (width - texts.units(text)).cast("int")), text)


def with_widths(rows: DataFrame, **least: int) -> DataFrame:
    """rows with <column>_width, the most units of each named column and its least width, from one row of aggregates."""
    widths = rows.agg(*[F.greatest(F.max(texts.units(F.col(c))), F.lit(n)).alias(f"{c}_width") for c, n in least.items()])
    return rows.crossJoin(F.broadcast(widths))


def item_lines(records: DataFrame) -> DataFrame:
    """name (the item) and line: its records, of which the first of equal time, player and item counts."""
    totals = counts.first_rows(records, ["timestamp", "player", "item"]).groupBy(F.col("item").alias("name")).agg(F.count("*").cast("string").alias("n"))
    return with_widths(totals, name=0, n=0).select("name", F.concat(padded(F.col("name"), F.col("name_width")), F.lit("  "), indented(F.col("n"), F.col("n_width"))).alias("line"))


#: Headings of the table of players.
PLAYER_COLUMNS = {"name": "Player", "uses": "Uses", "shown": "Apples"}


def player_lines(records: DataFrame, players: DataFrame, items: DataFrame) -> DataFrame:
    """place (0: heading, 1: rule, 2: players), effective, logs, name and line; players are timeline.by_player() ones."""
    uses = counts.uses_split(records.withColumn("player", texts.label(F.col("player"))), items)
    rows = players.join(uses, "player").select(F.col("player").alias("name"), "uses", F.concat(F.lit("("), texts.two_places("effective"), F.lit(")")).alias("shown"), "effective", "logs")
    rows = with_widths(rows, **{c: len(title) for c, title in PLAYER_COLUMNS.items()})
    width = {c: F.col(f"{c}_width") for c in PLAYER_COLUMNS}
    joined = lambda name, uses, shown: F.concat_ws("  ", padded(name, width["name"]), padded(uses, width["uses"]), indented(shown, width["shown"])).alias("line")
    top = rows.select(*width.values()).limit(1)
    nothing = [F.lit(0.0).alias("effective"), F.lit(0).cast("long").alias("logs"), F.lit("").alias("name")]
    rule = F.concat_ws("  ", *[F.repeat(F.lit("─"), w.cast("int")) for w in width.values()]).alias("line")
    heads = top.select(F.lit(0).alias("place"), *nothing, joined(*[F.lit(t) for t in PLAYER_COLUMNS.values()])).unionByName(top.select(F.lit(1).alias("place"), *nothing, rule))
    return rows.select(F.lit(2).alias("place"), "effective", "logs", "name", joined(F.col("name"), F.col("uses"), F.col("shown"))).unionByName(heads)


#: Lines of a report and of a summary message, by section; {0} is the count of players, {1} that of records, {2} and {3} are the mode's names.
PLAIN = {0: "Log Summary", 1: "{0} · {1} items used", 2: "", 3: "Items used", 5: "", 6: "Effective Apples ({2})"}
CHAT = {0: "# Log Summary", 1: "-# {0} · {1} items used", 2: "### Items used", 3: "```text", 5: "```", 6: "### Effective Apples", 7: "-# {3}; overlaps removed", 8: "```text", 10: "```"}
NOTHING = "No buff logs found."
MODES = {"cutoff": ("Cutoff", "100+ attack only"), "scaled": ("Scaled", "Scaled by attack")}


def report(records: DataFrame, players: DataFrame, items: DataFrame, mode: str, chat: bool = False) -> DataFrame:
    """section, place, effective, logs, name and line of a plain report, or of the summary in front of chat messages; in_order() sorts it.

    Sections 4 and 9 are tables, 11 (plain only) has each player's block: an empty line, the player with the effect, and the
    records by pos. Players are grouped as they stand; players has what timeline.by_player() gives. Without records there is one line, NOTHING.
    """
    n = records.agg(F.count_distinct("player").alias("players"), F.count_distinct("timestamp", "player", "item").alias("n"))
    fills = [texts.plural(F.col("players"), "player", "players"), F.col("n").cast("string"), *map(F.lit, MODES[mode])]

    def filled(line: str) -> Column:
        out = F.lit(line)
        for k, value in enumerate(fills):
            out = F.replace(out, F.lit(f"{{{k}}}"), value) if f"{{{k}}}" in line else out
        return out

    fixed = F.array(*[F.struct(F.lit(k).alias("section"), filled(line).alias("line")) for k, line in (CHAT if chat else PLAIN).items()])
    none = F.array(F.struct(F.lit(0).alias("section"), F.lit(NOTHING).alias("line")))
    put = lambda df, section, **known: df.select(
        section.alias("section"), *[known.get(c, F.lit(0).cast(kind) if kind != "string" else F.lit("")).alias(c) for c, kind in [("place", "long"), ("effective", "double"), ("logs", "long"), ("name", "string")]], "line"
    )
    col = F.col
    out = put(n.select(F.inline(F.when(col("n") == 0, none).otherwise(fixed))), col("section"))
    out = out.unionByName(put(item_lines(records), F.lit(4), name=col("name")))
    out = out.unionByName(put(player_lines(records, players, items), F.lit(9), place=col("place").cast("long"), effective=col("effective"), logs=col("logs"), name=col("name")))
    if chat:
        return out
    value = players.select(F.col("player").alias("label"), texts.two_places("effective").alias("value"))
    heads = records.groupBy("player").agg(F.count("*").alias("n")).withColumn("label", F.col("player")).join(value, "label", "left")
    heads = heads.select(col("player").alias("name"), F.inline(F.array(
        F.struct(F.lit(-2).cast("long").alias("place"), F.lit("").alias("line")), F.struct(F.lit(-1).cast("long").alias("place"), headed(col("player"), col("n"), col("value")).alias("line")),
    )))
    lines = records.select(col("player").alias("name"), col("pos").cast("long").alias("place"), F.concat_ws(" ", times.shown(col("timestamp")), "item").alias("line"))
    return out.unionByName(put(heads.unionByName(lines), F.lit(11), place=col("place"), name=col("name")))


def in_order(lines: DataFrame) -> DataFrame:
    """Lines of a report as they are written: the table of players by effect, the rest by name and place."""
    by_effect = F.when(F.col("section") == 9, F.col("place"))
    return lines.orderBy("section", by_effect, F.desc("effective"), F.desc("logs"), *texts.alphabetical(F.col("name")), "place")


def chat(records: DataFrame, items: DataFrame, mode: str, limit: int = LIMIT) -> DataFrame:
    """message (from 0) and text: the summary, then the players' blocks. Records have pos. Without records message 0 is NOTHING.

    The summary's text has a line for each player and item, as its table has; the other messages are of limit units at most, but for a line that is longer.
    """
    records = packing.pinned(records.select("ord", "player", "timestamp", "item", "pos"))
    players = packing.pinned(timeline.by_player(timeline.segments(records, items, mode)))
    lines = report(records, players, items, mode, chat=True)
    place = F.when(F.col("section") == 9, F.col("place")).otherwise(0)
    order = F.struct("section", place.alias("place"), (-F.col("effective")).alias("effective"), (-F.col("logs")).alias("logs"), *[c.alias(f"name_{k}") for k, c in enumerate(texts.alphabetical(F.col("name")))], "line")
    summary = lines.agg(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(order)), lambda x: x["line"])).alias("text")).select(F.lit(0).cast("long").alias("message"), "text")
    rest = messages(player_blocks(records, players, limit), limit)
    return summary.unionByName(rest.select((F.col("message") + 1).alias("message"), "text"))
