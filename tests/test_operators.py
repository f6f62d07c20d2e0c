import random
import time

import pytest
from pyspark.sql import functions as F

from logweft.functions import texts, times
from logweft.operators import assets, export, glyphs, packing, stages, timeline
from logweft.streaming.incremental import follow

ITEMS = "name string, duration int, watt int"
ROWS = "ord long, id string, timestamp string, player string, item string"


def uses(spark, *rows):
    return spark.createDataFrame([(k, f"r{k}", f"[{t}]", "A", i) for k, (t, i) in enumerate(rows)], ROWS)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([("big", 600, 100), ("bigger", 600, 120), ("other", 120, 0)], ITEMS)


@pytest.mark.parametrize(("mode", "rows", "effective", "logged"), [
    ("cutoff", [("00:00:00", "big"), ("00:05:00", "big")], 1.5, 2.0),
    ("scaled", [("00:00:00", "big"), ("00:05:00", "bigger")], 1.75, 2.25),
    ("cutoff", [("00:00:00", "big"), ("00:05:00", "other")], 1.0, 1.0),
    ("cutoff", [("00:00:00", "big"), ("00:03:00", "other"), ("00:08:00", "bigger")], 1.8, 2.0),
    ("cutoff", [("23:58:00", "big"), ("00:03:00", "big")], 1.5, 2.0),
    ("cutoff", [("10:00:00", "big"), ("10:00:00", "big"), ("10:00:00", "what")], 1.0, 2.0),
])
def test_effective(spark, items, mode, rows, effective, logged):
    got = timeline.overall(timeline.segments(uses(spark, *rows), items, mode)).first()
    assert (got.effective, got.logged, got.logs) == (effective, logged, len(rows))


def test_filter_comes_after_the_window(spark, items):
    segs = timeline.segments(uses(spark, ("00:00:00", "big"), ("00:05:00", "bigger")), items)
    assert timeline.overall(segs, F.col("item") == "big").first().effective == 0.5


def test_a_whole_day_of_seconds(spark, items):
    """One player who uses an item every second; a frame that is computed anew for each row would take minutes."""
    clock = F.format_string("[%02d:%02d:%02d]", F.floor(F.col("id") / 3600), F.floor(F.col("id") / 60) % 60, F.col("id") % 60)
    rows = spark.range(86_400).select(F.col("id").alias("ord"), F.concat(F.lit("r"), "id").alias("id"), clock.alias("timestamp"), F.lit("A").alias("player"), F.lit("big").alias("item"))
    began = time.time()
    got = timeline.overall(timeline.segments(rows, items)).first()
    assert (got.logs, got.active_s) == (86_400, 86_399 + 600) and time.time() - began < 60


def test_empty(spark, items):
    got = timeline.overall(timeline.segments(spark.createDataFrame([], ROWS), items)).first()
    assert (got.logs, got.effective) == (0, 0.0)


def test_texts(spark):
    row = spark.range(1).select(
        texts.label(F.lit("\t ")).alias("unknown"), texts.units(F.lit("a😀")).alias("units"), texts.two_places(F.lit(0.015)).alias("low"), texts.two_places(F.lit(0.125)).alias("half"),
        times.is_complete(F.lit("[12:00:00]\n")).alias("line_feed"), texts.csv_cell(F.lit('a"b')).alias("cell"), times.clock(F.lit(-1)).alias("clock"),
        times.time_range(F.lit(59), F.lit(86_400)).alias("range"),
    ).first()
    assert tuple(row) == ("Unknown", 3, "0.01", "0.13", False, '"a""b"', "23:59:59", "00:00:59\u201300:00:00")


def test_documents_as_written(spark):
    """Parts put together are what one writer would have written."""
    import json

    rows = [(k, f"[01:00:{k:02d}]", f'p "{k}"' if k % 3 else None, "a,b\nc", "f.png", None if k % 2 else k) for k in range(23)]
    located = spark.createDataFrame(rows, "ord long, timestamp string, player string, item string, file string, display_id int").repartition(4)
    join = lambda parts: "".join(r.text for r in parts.orderBy("part").collect())
    want = {"schema": 1, "records": [{"timestamp": t, "player": p, "item": i, "source": f, "lineFromBottom": d} for _, t, p, i, f, d in rows]}
    for width in (4, 4096):
        export.PART = width
        assert join(export.document(located, "json")) == json.dumps(want, indent=2)
        cell = lambda v: '"' + v.replace('"', '""') + '"' if any(c in v for c in '",\n') else v
        lines = [export.HEADER, *[",".join(cell(str("" if v is None else v)) for v in (t[1:-1], p, i, f, d)) for _, t, p, i, f, d in rows]]
        assert join(export.document(located, "csv")) == "\n".join(lines)
    export.PART = 4096
    assert join(export.document(located.limit(0), "json")) == json.dumps({"schema": 1, "records": []}, indent=2) and join(export.document(located.limit(0), "csv")) == export.HEADER


def test_one_of_several_rejected_pictures_goes(spark):
    rows = [(0, "accepted", "a", "t", 1, None), (1, "rejected", "a", "t", 1, "r"), (2, "rejected", "a", "t", 1, "r"), (3, "rejected", "b", "t", 1, "r")]
    images = spark.createDataFrame(rows, "ord long, status string, file_name string, created_at string, size_bytes long, rejection_reason string")
    assert sorted(r.ord for r in assets.without_one(images, "a", "t", 1, "r").collect()) == [0, 2, 3]
    assert assets.without_one(images, "c", "t", 1, "r").count() == 4


def test_exact_halves(spark):
    """Against the exact binary values, halves up."""
    from decimal import ROUND_HALF_UP, Decimal

    rng = random.Random(6)
    values = [0.0, 0.005, 0.015, 0.125, 1.005, 2.675, 1e9 + 0.005, 8.345, -0.125, -0.004] + [rng.randint(0, 10**6) / 200 for _ in range(3000)] + [rng.random() * 10 ** rng.randint(-3, 8) for _ in range(3000)]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", texts.two_places("v").alias("t")).collect()
    want = lambda v: ("-" if v < 0 else "") + str(Decimal(abs(v)).quantize(Decimal("0.01"), ROUND_HALF_UP))
    assert [(r.v, r.t) for r in got if r.t != want(r.v)] == []


def test_null_players_are_a_player(spark):
    rows = spark.createDataFrame([(k, f"r{k}", "[00:00:01]", p, "x") for k, p in enumerate([None, "A", None])], ROWS)
    got = {(r.ord, r.player, r.pos) for r in timeline.ordered(rows, ["player"]).collect()}
    assert got == {(0, None, 0), (1, "A", 0), (2, None, 1)}


def test_many_rows_of_one_second(spark, monkeypatch):
    monkeypatch.setattr(timeline, "PART_BITS", 3)
    rows = spark.range(500).select((F.col("id") * 7).alias("ord"), F.lit("no time").alias("timestamp"))
    got = timeline.ordered(rows, [])
    assert got.where(F.col("pos") * 7 != F.col("ord")).count() == 0 and got.count() == 500


def test_numbered(spark):
    got = assets.numbered(spark.range(50_000).withColumnRenamed("id", "k"), "k", "n", 700)
    assert got.where("k <> n").count() == 0


def test_frame(spark):
    import numpy as np

    pixels = np.zeros((608, 812, 3), dtype=np.uint8)
    pixels[605 - 16 : 605 - 10, 15 : 15 + 8] = glyphs.patch()
    images = spark.createDataFrame([(1, 608, 812, bytearray(pixels.tobytes())), (2, 608, 812, bytearray(608 * 812 * 3))], "image_id long, rows int, cols int, data binary")
    assert [tuple(r) for r in glyphs.frames(images).collect()] == [(1, 7, 5, 800, 600, 20)]


def test_stage_is_computed_once(spark, tmp_path):
    stage = stages.Stage("count", str(tmp_path), lambda rows: rows.groupBy("k").count())
    rows = spark.createDataFrame([(1,), (2,), (1,)], "k int")
    assert stage.refreshed(spark, rows)[1] and not stage.refreshed(spark, rows.orderBy("k"))[1]
    assert stage.refreshed(spark, rows.limit(2))[1]


def test_stream_adds_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"id":"a","n":1}\n{"id":"b","n":1}\n')
    for _ in range(2):
        follow(spark, str(tmp_path / "in"), "id string, n int", str(tmp_path / "out"), str(tmp_path / "at"), ["id"]).awaitTermination()
        (tmp_path / "in" / "b.json").write_text('{"id":"b","n":2}\n{"id":"c","n":2}\n')
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == [("a", 1), ("b", 1), ("c", 2)]


def one_pass(blocks, limit):
    """Messages as a single pass over ordered blocks (heading, lines) makes them."""
    out, current = [], None
    for heading, lines in blocks:
        whole = "\n".join([heading, *lines])
        if len(whole.encode("utf-16-le")) // 2 <= limit:
            if current is not None and len(f"{current}\n{whole}".encode("utf-16-le")) // 2 <= limit:
                current = f"{current}\n{whole}"
            else:
                out += [current] * (current is not None)
                current = whole
            continue
        out += [current] * (current is not None)
        current, part = None, heading
        for line in lines:
            if len(f"{part}\n{line}".encode("utf-16-le")) // 2 > limit:
                out.append(part)
                part = heading
            part = f"{part}\n{line}"
        out.append(part)
    return out + [current] * (current is not None)


@pytest.mark.parametrize(("run", "limit"), [(3, 20), (3, 200), (4096, 60)])
def test_messages_equal_one_pass(spark, monkeypatch, run, limit):
    """Runs of three items, two to a longer run: many levels, and the same messages."""
    monkeypatch.setattr(packing, "RUN", run)
    monkeypatch.setattr(packing, "FAN", 2)
    chance = random.Random(limit)
    rows = [(p, k, f"[00:00:{k % 60:02d}]", chance.choice(["a", "big one", "😀 item", "x" * 70]))
            for p, n in [("ann", 40), ("Bob", 1), ("bob", 2), ("cy", 1), ("dee", 3), *[(f"e{k}", 1) for k in range(12)]] for k in range(n)]
    records = spark.createDataFrame(rows, "player string, pos long, timestamp string, item string")
    values = spark.createDataFrame([("ann", 1.5), ("cy", 2.005)], "player string, effective double")
    got = [r.text for r in export.messages(export.player_blocks(records, values, limit), limit).orderBy("message").collect()]
    shown = {"ann": "1.50", "cy": "2.00"}
    order = ["ann", "bob", "Bob", "cy", "dee", *sorted(f"e{k}" for k in range(12))]
    n = {p: sum(r[0] == p for r in rows) for p in order}
    assert got == one_pass([(f"### {p} · {n[p]} use{'s' * (n[p] != 1)} ({shown.get(p, '0.00')})", [f"`{t[1:-1]}` {i}" for q, _, t, i in rows if q == p]) for p in order], limit)


def test_report_in_order(spark, items):
    records = uses(spark, ("00:00:00", "big"), ("00:05:00", "other"), ("00:05:00", "other")).withColumn("pos", F.col("ord"))
    lines = export.in_order(export.report(records, timeline.by_player(timeline.segments(records, items)), items, "cutoff"))
    assert [r.line for r in lines.collect()] == [
        "Log Summary", "1 player · 2 items used", "", "Items used", "big    1", "other  1", "", "Effective Apples (Cutoff)",
        "Player  Uses  Apples", "──────  ────  ──────", "A       1+2   (1.00)", "", "A · 3 uses (1.00)", "00:00:00 big", "00:05:00 other", "00:05:00 other",
    ]
    chat = [r.line for r in export.in_order(export.report(records, timeline.by_player(timeline.segments(records, items)), items, "cutoff", chat=True)).collect()]
    assert chat[:5] == ["# Log Summary", "-# 1 player · 2 items used", "### Items used", "```text", "big    1"] and chat[-1] == "```"
    none = records.where("false")
    assert [r.line for r in export.report(none, timeline.by_player(timeline.segments(none, items)), items, "cutoff").collect()] == ["No buff logs found."]
