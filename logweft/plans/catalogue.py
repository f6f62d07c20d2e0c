"""One query for each operator, over the driver's tables, and the same in SQL.

Events stand for use records, documents for image files and their crops, pages for images.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logweft.functions import pixels, texts, times
from logweft.operators import assets, counts, export, glyphs, packing, pictures, reading, review, session, stages, timeline
from logweft.sources.blobs import BlobStore, hydrated, unstored
from logweft.sources.records import ITEMS, golden, item_dimension, records, sessions, table

QUERIES, SQL = {}, {}

REC = """rec as (select event_id as ord, 'record_' || event_id as id, '[' || strftime(ts, '%H:%M:%S') || ']' as timestamp,
  'user' || user_id as player, event_type as item, 'ocr' as source, 'slice_' || event_id as source_slice_id from events)"""
DIM = "dim(item, duration, watt) as (values " + ", ".join(f"('{n}', {d}, {w})" for n, d, w in ITEMS) + ")"
SOD = "(substr(timestamp, 2, 2)::int * 3600 + substr(timestamp, 5, 2)::int * 60 + substr(timestamp, 8, 2)::int)"


def wrapped(key: str) -> str:
    by = f"partition by {key}" if key else ""
    other = f"partition by {key} " if key else ""
    return f"""g as (select *, row_number() over ({by} order by sod, ord) as rn, lead(sod) over ({by} order by sod, ord) as nx,
    count(*) over ({by}) as n, min(sod) over ({by}) as f from (select *, {SOD} as sod from rec)),
  h as (select *, row_number() over ({other}order by coalesce(nx, f + 86400) - sod desc, rn) as gr from g),
  w as (select *, (rn - 1 - st0 + n) % n as pos, case when n > 1 and rn - 1 < st0 then 86400 else 0 end as day_offset
    from (select *, max(case when gr = 1 then rn end) over ({by}) % n as st0 from h))"""


def segments_sql(mode: str) -> str:
    weight = "case when watt >= 100 then 1.0 else 0.0 end" if mode == timeline.CUTOFF else "greatest(0.0, (coalesce(watt, 0) - 20) / 80.0)"
    return f"""with {REC}, {DIM}, {wrapped('player')},
  j as (select w.*, sod + day_offset as start_s, coalesce(duration, 0) as full_s, coalesce(watt, 0) > 0 and coalesce(duration, 0) > 0 as atk,
    coalesce({weight}, 0)::double as weight from w left join dim using (item)),
  k as (select *, lead(start_s) over (partition by player, atk order by pos) as nxt from j),
  s as (select *, case when atk and nxt is not null then greatest(0, least(full_s, nxt - start_s)) else full_s end as active_s from k)"""


TOTALS = """count(*) as logs, coalesce(sum(active_s * weight) / 600, 0) as effective, coalesce(sum(full_s * weight) / 600, 0) as logged,
  greatest(0, coalesce(sum(full_s * weight) / 600 - sum(active_s * weight) / 600, 0)) as overlap_loss,
  coalesce(sum(case when weight > 0 then active_s end), 0)::bigint as active_s, count(*) filter (weight > 0 and full_s > 0) as weighted_logs,
  count(*) filter (not (weight > 0 and full_s > 0)) as unweighted_logs"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def segs(spark: SparkSession, sf_dir: str, mode: str = timeline.CUTOFF) -> DataFrame:
    return timeline.segments(records(spark, sf_dir), item_dimension(spark), mode)


@query(f"{segments_sql('cutoff')} select player, {TOTALS} from s group by player")
def effective_by_player_cutoff(spark, sf_dir):
    return timeline.by_player(segs(spark, sf_dir))


@query(f"{segments_sql('scaled')} select player, {TOTALS} from s group by player")
def effective_by_player_scaled(spark, sf_dir):
    return timeline.by_player(segs(spark, sf_dir, timeline.SCALED))


@query(f"{segments_sql('scaled')} select player, {TOTALS} from s where item in ('purchase', 'view') group by player")
def effective_view_item_filter(spark, sf_dir):
    return timeline.by_player(segs(spark, sf_dir, timeline.SCALED), F.col("item").isin("purchase", "view"))


@query(f"{segments_sql('scaled')} select {TOTALS} from s where item = 'purchase'")
def effective_total_view(spark, sf_dir):
    return timeline.overall(segs(spark, sf_dir, timeline.SCALED), F.col("item") == "purchase")


@query(f"{segments_sql('scaled')} select id, player, item, start_s, (start_s + active_s)::int as end_s, active_s, full_s, greatest(0, full_s - active_s) as lost_s, weight from s")
def segments_detail(spark, sf_dir):
    return segs(spark, sf_dir, timeline.SCALED).select("id", "player", "item", "start_s", "end_s", "active_s", "full_s", "lost_s", "weight")


@query(f"with {REC.replace('rec as', 'named as')}, rec as (select * replace (nullif(player, 'user7') as player) from named), {wrapped('player')} select id, player, sod, pos, day_offset from w")
def timeline_wrap_player(spark, sf_dir):
    """Of each player, and of those without a name as of one."""
    rows = records(spark, sf_dir).withColumn("player", F.when(F.col("player") != "user7", F.col("player")))
    return timeline.ordered(rows, ["player"]).select("id", "player", "sod", "pos", "day_offset")


TWICE = REC.replace("rec as", "one as") + ", two as (select * from one union all select ord + 100000000, id || '_again', timestamp, player, item, source, source_slice_id from one where ord % 7 = 0)"
FIRST = "(select * from (select *, row_number() over (partition by timestamp, player, item order by ord) as nth from two) where nth = 1)"


def doubled(spark, sf_dir) -> DataFrame:
    """Records, and every seventh again under another id."""
    rows = records(spark, sf_dir)
    again = rows.where("ord % 7 = 0").withColumn("ord", F.col("ord") + 100_000_000).withColumn("id", F.concat("id", F.lit("_again")))
    return rows.unionByName(again)


@query(f"with {TWICE} select id, timestamp, player, item from {FIRST}")
def dedup_first(spark, sf_dir):
    return counts.first_rows(doubled(spark, sf_dir), ["timestamp", "player", "item"]).select("id", "timestamp", "player", "item")


@query(f"with {TWICE}, rec as (select * exclude (nth) from {FIRST}), {wrapped('')} select id, sod, pos from w")
def results_wrap_global(spark, sf_dir):
    once = counts.first_rows(doubled(spark, sf_dir), ["timestamp", "player", "item"])
    return timeline.ordered(once, []).select("id", "sod", "pos")


@query(f"with {REC} select player as label, count(*) as n from rec group by 1")
def count_by_player(spark, sf_dir):
    return counts.count_by(records(spark, sf_dir), F.col("player"))


@query(f"with {REC} select item as label, count(*) as n from rec group by 1")
def count_by_item(spark, sf_dir):
    return counts.by_count(counts.count_by(records(spark, sf_dir), F.col("item")))


@query(f"with {REC} select player as outer_key, item as label, count(*) as n from rec group by 1, 2")
def nested_counts(spark, sf_dir):
    return counts.nested_counts(records(spark, sf_dir), F.col("player"), F.col("item"))


MIXED = "case ord % 4 when 0 then upper(substr(item, 1, 1)) || substr(item, 2) when 1 then 'é' || item else item end"


@query(f"""with {REC}, c as (select player, {MIXED} as item, count(*) as n from rec group by 1, 2),
  r as (select *, row_number() over (partition by player order by n desc, replace(lower(item), 'é', 'e'), case when item like 'é%' then 1 else 0 end, item desc) as nth from c)
  select player, string_agg(item || ' ×' || n, ', ' order by nth) as mix from r where nth <= 3 group by 1""")
def item_mix_top3(spark, sf_dir):
    """Items in either case and with accents: equal counts are in the order of a dictionary, small letters first."""
    return counts.item_mix(records(spark, sf_dir).withColumn("item", F.expr(MIXED)))


@query(f"""with {REC}, {DIM}, c as (select player, count(*) filter (coalesce(watt, 0) >= 100) as hi, count(*) as n from rec left join dim using (item) group by 1)
  select player, case when n = hi then hi::varchar else hi || '+' || (n - hi) end as uses from c""")
def uses_split(spark, sf_dir):
    return counts.uses_split(records(spark, sf_dir), item_dimension(spark))


@query(f"with {REC} select item, count(*) filter (player = 'user7') as n from rec group by 1")
def facet_items(spark, sf_dir):
    return counts.facet_items(records(spark, sf_dir), "user7")


@query(f"with {REC} select player, count(*) filter (item in ('error')) as n from rec group by 1")
def facet_players_zero_filled(spark, sf_dir):
    return counts.facet_players(records(spark, sf_dir), ["error"])


@query(f"""{segments_sql('cutoff')}, d as (select count(*) filter (item = 'purchase') as shown, count(*) as all_rows, count(distinct case when item = 'purchase' then player end) as players,
  count(*) filter (item = 'purchase' and full_s > active_s and weight > 0) as overlaps from s),
  {wrapped('').replace('g as', 'g2 as').replace('from g)', 'from g2)').replace('h as', 'h2 as').replace('from h)', 'from h2)').replace('w as', 'w2 as')}
  select d.*, (select substr(timestamp, 2, 8) from w2 where item = 'purchase' order by pos limit 1) as first_time,
  (select substr(timestamp, 2, 8) from w2 where item = 'purchase' order by pos desc limit 1) as last_time from d""")
def facet_header(spark, sf_dir):
    rows = timeline.ordered(records(spark, sf_dir), []).drop("sod", "day_offset")
    return counts.header(timeline.segments(rows, item_dimension(spark)), F.col("item") == "purchase")


@query("""with v as (select event_id, case event_id % 4 when 0 then '[' || strftime(ts, '%H:%M:%S') || ']' when 1 then 'at 7:8:9 x' when 2 then '[24:00:61]' else 'at noon' end as t, (event_id * 37) % 100000 as s from events)
  select event_id, case event_id % 4 when 0 then substr(t, 2, 2)::int * 3600 + substr(t, 5, 2)::int * 60 + substr(t, 8, 2)::int when 1 then 25689 when 2 then 86461 else 0 end as sod,
  case event_id % 4 when 0 then t when 1 then '[07:08:09]' when 2 then '[24:00:61]' else '' end as normal, event_id % 4 = 0 as complete,
  case event_id % 4 when 0 then substr(t, 2, 8) when 2 then '24:00:61' else t end as shown,
  case when s // 60 = 0 then s || 's' when s % 60 = 0 then (s // 60) || 'm' else (s // 60) || 'm ' || (s % 60) || 's' end as lasted,
  lpad(((s % 86400) // 3600)::varchar, 2, '0') || ':' || lpad((s % 3600 // 60)::varchar, 2, '0') || ':' || lpad((s % 60)::varchar, 2, '0') as clock from v""")
def time_scalars(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    k = F.col("event_id") % 4
    t = F.when(k == 0, F.date_format("ts", "'['HH:mm:ss']'")).when(k == 1, "at 7:8:9 x").when(k == 2, "[24:00:61]").otherwise("at noon")
    v = e.select("event_id", t.alias("t"), (F.col("event_id") * 37 % 100000).alias("s"))
    return v.select(
        "event_id", times.seconds_of_day(F.col("t")).alias("sod"), times.normalized(F.col("t")).alias("normal"), times.is_complete(F.col("t")).alias("complete"),
        times.shown(F.col("t")).alias("shown"), times.duration(F.col("s")).alias("lasted"), times.clock(F.col("s")).alias("clock"),
    )


BODY = "case event_id % 5 when 0 then 'user' || user_id || ' used ' || event_type when 1 then '  user' || user_id || ' used   the ' || event_type || ' ' when 2 then 'two words used ' || event_type when 3 then 'user' || user_id || ' used ' else 'user' || user_id || ' misused ' || event_type end"


@query(f"""with b as (select event_id, user_id, event_type from events)
  select event_id, case when event_id % 5 in (0, 1) then 'user' || user_id end as player, case event_id % 5 when 0 then event_type when 1 then 'the ' || event_type end as item,
  case event_id % 5 when 2 then 'bad_player' when 3 then 'bad_item' when 4 then 'not_a_use' end as reason from b""")
def parse_log_line(spark, sf_dir):
    parts = texts.log_body(F.expr(BODY))
    return table(spark, sf_dir, "events").select("event_id", *[c.alias(n) for n, c in parts.items()])


SPOILT = "case when ord % 5 in (1, 4) then '' else timestamp end as timestamp, case when ord % 5 in (2, 4) then ' ' else player end as player, case when ord % 5 in (3, 4) then '' else item end as item"


@query(f"with {REC} select id, case ord % 5 when 0 then 'complete' when 4 then 'empty' else 'partial' end as state from rec")
def record_completeness(spark, sf_dir):
    return records(spark, sf_dir).selectExpr("id", *SPOILT.split(", case")[:1], *["case" + x for x in SPOILT.split(", case")[1:]]).select("id", review.completeness().alias("state"))


@query(f"""with {REC} select id, timestamp, case when ord % 10 = 1 then 'renamed' else player end as player, item, ord % 10 = 1 as changed from rec where ord % 9 <> 0
  union all select 'manual_' || ord, timestamp, player, item, false from rec where ord % 50 = 3""")
def review_overlay(spark, sf_dir):
    rows = records(spark, sf_dir)
    typed = rows.where("ord % 50 in (3, 4)").withColumn("id", F.concat(F.lit("manual_"), "ord")).withColumn("item", F.when(F.col("ord") % 50 == 4, "").otherwise(F.col("item")))
    edits = rows.where("ord % 10 in (1, 2)").withColumn("player", F.when(F.col("ord") % 10 == 1, "renamed").otherwise(F.col("player")))
    return review.reviewed(review.with_manual(rows, typed), edits, rows.where("ord % 9 = 0")).select("id", *review.EDITED, "changed")


@query(f"with {REC} select id, timestamp, 'someone' as player, item from rec where player = 'user7'")
def rename_player(spark, sf_dir):
    return review.renamed(records(spark, sf_dir), "user7", "someone").select("id", *review.EDITED)


FILES = """twice as (select doc_id, doc_id as file_ord, text from documents union all select doc_id, doc_id + 10000000, text from documents where doc_id % 10 in (3, 4)),
  files as (select file_ord, 'shot_' || doc_id || case doc_id % 11 when 0 then '.txt' when 5 then '.PNG' when 7 then '' else '.png' end as name,
    case doc_id % 11 when 0 then 'text/plain' when 5 then 'application/octet-stream' when 6 then null else 'image/png' end as mime, text, coalesce(strlen(text), 0) as size_bytes from twice),
  known as (select doc_id as id, sha256(text) as checksum, 'accepted' as status, case when doc_id % 10 = 3 then 'active' else 'removed' end as lifecycle, 'old_' || doc_id as file_name, -1::bigint as size_bytes
    from documents where doc_id % 10 in (3, 7) and text is not null)"""


def files(spark, sf_dir) -> DataFrame:
    """Documents as files, some twice; types and names that say PNG, one of both, or neither."""
    d = table(spark, sf_dir, "documents")
    twice = d.withColumn("file_ord", F.col("doc_id")).unionByName(d.where("doc_id % 10 in (3, 4)").withColumn("file_ord", F.col("doc_id") + 10_000_000))
    k = F.col("doc_id") % 11
    name = F.concat(F.lit("shot_"), "doc_id", F.when(k == 0, ".txt").when(k == 5, ".PNG").when(k == 7, "").otherwise(".png"))
    mime = F.when(k == 0, "text/plain").when(k == 5, "application/octet-stream").when(k == 6, None).otherwise("image/png")
    return twice.select("file_ord", name.alias("name"), mime.alias("mime"), F.col("text").cast("binary").alias("content"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size_bytes"))


def known(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("doc_id % 10 in (3, 7) and text is not null")
    return d.select(
        F.col("doc_id").alias("id"), F.sha2("text", 256).alias("checksum"), F.lit("accepted").alias("status"), F.when(F.col("doc_id") % 10 == 3, "active").otherwise("removed").alias("lifecycle"),
        F.concat(F.lit("old_"), "doc_id").alias("file_name"), F.lit(-1).cast("long").alias("size_bytes"),
    )


ADMIT = f"""{FILES}, checked as (select *, sha256(text) as checksum, case when not (coalesce(mime, '') = 'image/png' or lower(name) like '%.png') then 'not_png' when size_bytes >= 20000 then 'too_large' end as refused from files),
  judged as (select *, checksum in (select checksum from known where lifecycle = 'active') as again, (select min(id) from known where lifecycle = 'removed' and known.checksum = checked.checksum) as rid from checked where refused is null),
  once as (select * from (select *, row_number() over (partition by checksum order by file_ord) as nth from judged where again is not true) where nth = 1),
  outcomes as (select file_ord, name, size_bytes, checksum, case when rid is null then 'accepted' else 'restored' end as outcome, coalesce(rid, 999999 + row_number() over (partition by rid is null order by file_ord)) as id from once
    union all select file_ord, name, size_bytes, checksum, 'duplicate', null from judged where again
    union all select file_ord, name, size_bytes, null, refused, null from checked where refused is not null)"""


@query(f"with {ADMIT} select * from outcomes")
def asset_admission(spark, sf_dir):
    return assets.admitted(files(spark, sf_dir), known(spark, sf_dir), 1_000_000, 20_000)


@query(f"""with {ADMIT}, r as (select id, name, size_bytes from outcomes where outcome = 'restored')
  select known.id, case when r.id is not null then 'active' else lifecycle end as lifecycle, coalesce(r.name, file_name) as file_name, coalesce(r.size_bytes, known.size_bytes) as size_bytes from known left join r using (id)""")
def asset_restore(spark, sf_dir):
    return assets.restored(known(spark, sf_dir), assets.admitted(files(spark, sf_dir), known(spark, sf_dir), 1_000_000, 20_000)).select("id", "lifecycle", "file_name", "size_bytes")


@query(f"with {ADMIT} select file_ord, name, case outcome " + " ".join(f"when '{k}' then '{v}'" for k, v in assets.REASONS.items()) + f" else '{assets.OTHER_REASON}' end as reason from outcomes where outcome not in ('accepted', 'restored')")
def refused_files(spark, sf_dir):
    found = assets.admitted(files(spark, sf_dir), known(spark, sf_dir), 1_000_000, 20_000)
    return found.where("outcome not in ('accepted', 'restored')").select("file_ord", "name", assets.reason_text(F.col("outcome")).alias("reason"))


IMAGES = """images as (select doc_id as id, case when doc_id % 6 = 5 then 'rejected' else 'accepted' end as status, case when doc_id % 6 = 5 then null when doc_id % 6 = 2 then 'removed' else 'active' end as lifecycle from documents),
  slices as (select doc_id || '-' || k as slice_id, doc_id as image_id, k, 40 - k as display_id, 'shot_' || doc_id || '.png' as image_file_name from documents, range(1, 4) t(k)),
  results as (select slice_id, case when image_id % 2 = 0 then 'fast' else 'best' end as mode, case when (image_id + k) % 5 = 0 then 'rejected' else 'accepted' end as status,
    case when (image_id + k) % 10 = 0 then 'ocr_error' when (image_id + k) % 25 = 0 then 'something_else' when (image_id + k) % 5 = 0 then 'not_a_use' end as rejection_reason from slices where (image_id + k) % 3 <> 0)"""


def images(spark, sf_dir) -> DataFrame:
    k = F.col("doc_id") % 6
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.when(k == 5, "rejected").otherwise("accepted").alias("status"), F.when(k == 5, None).when(k == 2, "removed").otherwise("active").alias("lifecycle"))


def slices(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("k"))
    return d.select(F.concat_ws("-", F.col("doc_id").cast("string"), F.col("k").cast("string")).alias("slice_id"), F.col("doc_id").alias("image_id"), "k", (40 - F.col("k")).alias("display_id"), F.concat(F.lit("shot_"), "doc_id", F.lit(".png")).alias("image_file_name"))


def results(spark, sf_dir) -> DataFrame:
    at = F.col("image_id") + F.col("k")
    return slices(spark, sf_dir).where(at % 3 != 0).select(
        "slice_id", F.when(F.col("image_id") % 2 == 0, "fast").otherwise("best").alias("mode"), F.when(at % 5 == 0, "rejected").otherwise("accepted").alias("status"),
        F.when(at % 10 == 0, "ocr_error").when(at % 25 == 0, "something_else").when(at % 5 == 0, "not_a_use").alias("rejection_reason"),
    )


@query(f"""with {IMAGES}, gone as (select slice_id from slices where image_id in (select id from images where lifecycle = 'removed'))
  select 'image' as part, id::varchar as id from images where lifecycle is null or lifecycle <> 'removed' union all select 'slice', slice_id from slices where slice_id not in (select slice_id from gone)
  union all select 'result', slice_id from results where slice_id not in (select slice_id from gone)""")
def asset_gc(spark, sf_dir):
    kept, own, found = assets.cleared(images(spark, sf_dir), slices(spark, sf_dir), results(spark, sf_dir))
    rows = lambda df, part, name: df.select(F.lit(part).alias("part"), F.col(name).cast("string").alias("id"))
    return rows(kept, "image", "id").unionByName(rows(own, "slice", "slice_id")).unionByName(rows(found, "result", "slice_id"))


@query("""select page_id || '-' || (k + 1) as slice_id, page_id as image_id, (k + 1)::int as index, (39 - k)::int as display_id, (page_id % 7)::int as left, (605 - 69 - 39 * 13 + k * 13)::int as top, 384 as width, 12 as height
  from pages, range(0, 39) t(k)""")
def slice_grid(spark, sf_dir):
    return assets.line_grid(table(spark, sf_dir, "pages").select(F.col("page_id").alias("image_id"), (F.col("page_id") % 7).cast("int").alias("left"), F.lit(605).alias("bottom")))


@query(f"with {IMAGES} select slice_id, image_id from slices where image_id in (select id from images where status = 'accepted' and lifecycle = 'active')")
def active_slices(spark, sf_dir):
    return assets.of_active(slices(spark, sf_dir), images(spark, sf_dir)).select("slice_id", "image_id")


ACTIVE = "(select slice_id from slices where image_id in (select id from images where status = 'accepted' and lifecycle = 'active'))"


@query(f"with {IMAGES} select slice_id, mode, status from results where slice_id in {ACTIVE}")
def active_ocr_results(spark, sf_dir):
    return results(spark, sf_dir).join(assets.of_active(slices(spark, sf_dir), images(spark, sf_dir)).select("slice_id"), "slice_id", "left_semi").select("slice_id", "mode", "status")


@query(f"with {IMAGES} select slice_id, 'best' as mode from slices where slice_id in {ACTIVE} and slice_id not in (select slice_id from results where mode = 'best')")
def missing_ocr(spark, sf_dir):
    wanted = assets.of_active(slices(spark, sf_dir), images(spark, sf_dir)).select("slice_id", F.lit("best").alias("mode"))
    return review.missing(wanted, results(spark, sf_dir), ["slice_id", "mode"])


@query(f"""with {IMAGES}, new as (select slice_id, 'balanced' as mode, 'accepted' as status from slices where k = 2)
  select slice_id, mode, status from results where slice_id not in (select slice_id from new) union all select * from new""")
def merge_ocr(spark, sf_dir):
    new = slices(spark, sf_dir).where("k = 2").select("slice_id", F.lit("balanced").alias("mode"), F.lit("accepted").alias("status"))
    return review.merged(results(spark, sf_dir).select("slice_id", "mode", "status"), new, ["slice_id"])


@query(f"with {IMAGES} select count(*) as total, count(*) filter (status = 'accepted') as ok, count(*) filter (status <> 'accepted' and rejection_reason <> 'ocr_error') as rejected, count(*) filter (rejection_reason = 'ocr_error') as errors from results")
def ocr_summary(spark, sf_dir):
    return assets.result_summary(results(spark, sf_dir))


PLACED = f"{REC}, spots as (select 'slice_' || event_id as source_slice_id, 'shot, ' || (event_id % 9) || '.png' as image_file_name, (event_id % 39 + 1)::int as display_id from events where event_id % 4 <> 0), e as (select * from rec left join spots using (source_slice_id))"


def exported(spark, sf_dir) -> DataFrame:
    at = table(spark, sf_dir, "events").where("event_id % 4 <> 0").select(
        F.concat(F.lit("slice_"), "event_id").alias("slice_id"), F.concat(F.lit("shot, "), F.col("event_id") % 9, F.lit(".png")).alias("image_file_name"), (F.col("event_id") % 39 + 1).cast("int").alias("display_id")
    )
    return export.located(records(spark, sf_dir), at)


@query(f"""with {PLACED} select ord, substr(timestamp, 2, 8) || ',' || player || ',' || item || ',' || case when image_file_name is null then 'unknown.png,' else '"' || image_file_name || '",' || display_id end as line from e""")
def export_rows_csv(spark, sf_dir):
    return exported(spark, sf_dir).select("ord", export.csv_line().alias("line"))


@query(f"""with {PLACED} select ord, '{{"timestamp":"' || timestamp || '","player":"' || player || '","item":"' || item || '","source":"' || coalesce(image_file_name, 'unknown.png') || '","lineFromBottom":' || coalesce(display_id::varchar, 'null') || '}}' as row_json from e""")
def export_rows_json(spark, sf_dir):
    return exported(spark, sf_dir).select("ord", export.json_row().alias("row_json"))


@query("""with n as (select page_id, lpad((page_id % 33)::varchar, 2, '0') as d, lpad((page_id % 14)::varchar, 2, '0') as m, lpad((page_id % 25)::varchar, 2, '0') as h from pages),
  f as (select *, 'shot ' || d || '-' || m || '-2024 ' || h || '-05-06.png' as name from n)
  select page_id, case when d::int between 1 and 31 and m::int between 1 and 12 and h::int < 24
    then d || ' ' || (['Jan', 'Feb', 'Mar', 'Apr', 'May', 'Jun', 'Jul', 'Aug', 'Sep', 'Oct', 'Nov', 'Dec'])[m::int] || ' 2024 · ' || h || ':05:06' else name end as label from f""")
def file_label(spark, sf_dir):
    two = lambda k: F.lpad((F.col("page_id") % k).cast("string"), 2, "0")
    name = F.concat(F.lit("shot "), two(33), F.lit("-"), two(14), F.lit("-2024 "), two(25), F.lit("-05-06.png"))
    return table(spark, sf_dir, "pages").select("page_id", times.file_label(name, "shot").alias("label"))


@query(f"with {REC} select distinct player as value from rec")
def suggestions(spark, sf_dir):
    return counts.suggestions(records(spark, sf_dir), "player")


@query(f"""with {REC}, d as (select sha256('{{"id":"' || id || '","item":"' || item || '","player":"' || player || '"}}') as d from rec)
  select count(*) as n, {" || ':' || ".join(f"coalesce(sum(('0x' || substr(d, {1 + 12 * k}, 12))::bigint), 0)::varchar" for k in range(4))} as fingerprint from d""")
def stage_fingerprint(spark, sf_dir):
    return stages.fingerprint(records(spark, sf_dir), ["id", "item", "player"])


CHARS = "abcdefghijklmnopqrstuvwxyz0123456789 :[]"  # in the order of glyphs that rank alike
WIDTHS = sorted({len(glyphs.glyph(c)) for c in CHARS})


def text_lines(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("ord"), F.concat(F.date_format("ts", "'['HH:mm:ss']'"), F.lit("user"), "user_id", F.lit(" used "), "event_type").alias("text"))


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt out evenly ahead of a map that takes long for each: a file is read by few tasks."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)


@query("select event_id as ord, '[' || strftime(ts, '%H:%M:%S') || ']user' || user_id || ' used ' || event_type as text from events")
def ocr_roundtrip(spark, sf_dir):
    return reading.plain(glyphs.rendered(spread(text_lines(spark, sf_dir)), "ord", "text", CHARS), "ord", CHARS)


def font_sql(charset: str, profiles: tuple[str, ...]) -> str:
    """The fonts as rows of SQL: profile, ch, width and columns, joined by commas."""
    made = [(p, glyphs.template(c, p)) for p in profiles for c in charset]
    return "font(profile, ch, width, columns) as (values " + ", ".join(f"('{p}', '{t.ch}', {t.width}, '{','.join(map(str, t.columns))}')" for p, t in made) + ")"


#: A picture shows 39 events, one a line; every tenth line or so is spoilt, and some pictures are.
SHOWN = """case event_id % 11 when 3 then '[24:02:03]user' || user_id || ' used ' || event_type when 5 then clock || 'user' || user_id || ' misused ' || event_type when 6 then clock || ' used ' || event_type
  when 7 then clock || 'user' || user_id || ' used ' when 9 then substr(clock, 2) || 'user' || user_id || ' used ' || event_type else clock || 'user' || user_id || ' used ' || event_type end"""
SHOTS = f"""shown as (select event_id, event_id // 39 as shot, (event_id % 39 + 1)::int as index, 'shot_' || (event_id // 39) || '.png' as path, user_id, event_type, case event_id // 39 % 2 when 0 then 'rgb' else 'bgr' end as profile,
    {SHOWN} as text, '[' || strftime(ts, '%H:%M:%S') || ']' as clock from (select *, '[' || strftime(ts, '%H:%M:%S') || ']' as clock from events)),
  shots as (select distinct shot, path, case shot % 20 when 7 then 'decode_error' when 11 then 'not_png' when 13 then 'no_frame' end as reason from shown)"""


def shots(spark, sf_dir) -> DataFrame:
    """Pictures of events as files; of each twenty one is cut off, one is no picture, one shows no frame."""
    shot, clock = F.floor(F.col("event_id") / 39), F.date_format("ts", "'['HH:mm:ss']'")
    lines = table(spark, sf_dir, "events").withColumn("clock", clock).select(shot.alias("shot"), F.struct((F.col("event_id") % 39 + 1).cast("int").alias("index"), F.expr(SHOWN).alias("text")).alias("line"))
    # few small rows make much work: without a number of parts, Spark would put them into one
    each = lines.repartition(4 * spark.sparkContext.defaultParallelism, "shot").groupBy("shot").agg(F.collect_list("line").alias("shown"))
    each = each.select("shot", F.concat(F.lit("shot_"), "shot", F.lit(".png")).alias("path"), F.when(F.col("shot") % 2 == 0, "rgb").otherwise("bgr").alias("profile"), "shown")
    number = F.regexp_extract("path", "[0-9]+", 0).cast("long") % 20
    spoilt = F.when(number == 7, F.expr("substring(content, 1, 5000)")).when(number == 11, F.encode(F.lit("no picture"), "UTF-8")).otherwise(F.col("content"))
    unframed = pictures.unframed(pictures.drawn(each.where("shot % 20 = 13")))
    return pictures.drawn(each.where("shot % 20 <> 13")).withColumn("content", spoilt).unionByName(unframed)


PICTURE_CHARS = glyphs.DIGITS + reading.LETTERS[:26] + "[]: "
INK = f"""ink as (select path, index, reason, [0, 0, 0] || flatten(list([x::int for x in string_split(columns, ',')] order by k)) as c from (select s.path, s.index, shots.reason, s.profile, unnest(string_split(s.text, '')) as ch, generate_subscripts(string_split(s.text, ''), 1) as k
    from shown s join shots using (path)) join font using (profile, ch) where reason is null group by 1, 2, 3)"""


@query(f"""with {SHOTS}, {font_sql(PICTURE_CHARS, glyphs.PROFILES)}, {INK}
  select path, index, (list_position([x > 0 for x in c], true) - 1)::int as first, (len(c) - list_position(list_reverse([x > 0 for x in c]), true))::int as last,
    md5(array_to_string(c || [0 for x in range(384 - len(c))], ',')) as columns_md5, null as reason from ink
  union all select path, t.k::int, null, null, md5(repeat('0,', 383) || '0'), null from shots, range(1, 40) t(k) where reason is null and not exists (select 1 from shown s where s.path = shots.path and s.index = t.k)
  union all select path, null, null, null, null, reason from shots where reason is not null""")
def png_columns(spark, sf_dir):
    """Every line of every picture as columns, from its file."""
    found = pictures.lines(shots(spark, sf_dir), with_pixels=False)
    return found.select("path", "index", "first", "last", F.md5(F.concat_ws(",", F.transform("columns", lambda c: c.cast("string")))).alias("columns_md5"), "reason").withColumn(
        "columns_md5", F.when(F.col("reason").isNull(), F.col("columns_md5")))


@query(f"with {SHOTS} select path, case when reason in ('not_png', 'decode_error') then 0 else 800 end as width, case when reason in ('not_png', 'decode_error') then 0 else 600 end as height, reason is null as ok, case when reason is null then 0 end as left, case when reason is null then 0 end as top, reason from shots")
def picture_analysis(spark, sf_dir):
    return pictures.analysed(shots(spark, sf_dir))


ITEM_NAMES = tuple(n for n, _, _ in ITEMS)


@query(f"""with {SHOTS}, l as (select *, case event_id % 11 when 3 then 'bad_time' when 5 then 'not_a_use' when 6 then 'bad_player' when 7 then 'bad_item' end as why from shown join shots using (path) where reason is null and event_id % 11 <> 9)
  select path || '-' || index as slice_id, 'balanced' as mode, case when why is null then 'accepted' else 'rejected' end as status, why as rejection_reason,
    case when why = 'not_a_use' then clock || 'user' || user_id else text end as text, case when why is null then 'record_' || path || '-' || index end as id, case when why is null then clock end as timestamp,
    case when why is null then 'user' || user_id end as player, case when why is null then event_type end as item from l""")
def ocr_lines(spark, sf_dir):
    """From files to records: lines with both brackets are read, with what is wrong with each of the others."""
    found = pictures.bracketed(pictures.lines(shots(spark, sf_dir)))
    read = reading.decoded(found.select("path", "index", "pixels", "columns", "profile"), ITEM_NAMES)
    return reading.judged(read, F.concat_ws("-", "path", F.col("index").cast("string"))).drop("score")


@query(f"""with {REC} select id, player, timestamp, row_number() over (partition by player order by timestamp, id)::int as nth from rec where player in ('user7', 'user8')""")
def cleanup_rows(spark, sf_dir):
    return review.of_players(records(spark, sf_dir), ["user7", "user8"]).select("id", "player", "timestamp", "nth")


REASON = "case rejection_reason " + " ".join(f"when '{k}' then '{v.replace(chr(39), chr(39) * 2)}'" for k, v in assets.REASONS.items()) + f" else '{assets.OTHER_REASON}' end as reason"


@query(f"with {IMAGES} select slice_id, {REASON} from results where status in ('rejected', 'failed')")
def refused_results(spark, sf_dir):
    return assets.refused(results(spark, sf_dir)).select("slice_id", "reason")


@query(f"""with {IMAGES}, s as (select * from slices where image_id in (select id from images where status <> 'rejected'))
  select 'image' as part, id::varchar as id from images where status <> 'rejected' union all select 'slice', slice_id from s union all select 'result', slice_id from results where slice_id in (select slice_id from s)""")
def session_saved(spark, sf_dir):
    kept, own, found = assets.saved(images(spark, sf_dir), slices(spark, sf_dir), results(spark, sf_dir))
    rows = lambda df, part, name: df.select(F.lit(part).alias("part"), F.col(name).cast("string").alias("id"))
    return rows(kept, "image", "id").unionByName(rows(own, "slice", "slice_id")).unionByName(rows(found, "result", "slice_id"))


@query(f"""with {IMAGES} select slice_id, {REASON}, case when k = 2 then 'manual_' || slice_id end as manual_id from results join slices using (slice_id)
  where results.status in ('rejected', 'failed') and slice_id in {ACTIVE}""")
def issues(spark, sf_dir):
    typed = slices(spark, sf_dir).where("k = 2").select(F.concat(F.lit("manual_"), "slice_id").alias("id"), F.col("slice_id").alias("source_slice_id"))
    return assets.issues(assets.of_active(slices(spark, sf_dir), images(spark, sf_dir)), results(spark, sf_dir), typed)


@query(f"""with {REC} select id, source_slice_id, case when ord % 4 = 1 then 'typed' else player end as player from rec where ord % 3 = 0 and ord % 4 <> 2""")
def manual_upsert(spark, sf_dir):
    rows = records(spark, sf_dir)
    old = rows.where("ord % 3 = 0")
    new = old.where("ord % 4 in (1, 2)").withColumn("player", F.when(F.col("ord") % 4 == 1, "typed").otherwise(" "))
    return review.typed_in(old, new).select("id", "source_slice_id", "player")


@query(f"with {IMAGES} select exists (select 1 from slices where slice_id in {ACTIVE}) as openable")
def stage_openable(spark, sf_dir):
    return assets.openable(images(spark, sf_dir), slices(spark, sf_dir))


@query(f"""with {PLACED} select 0::bigint as line_no, '{export.HEADER}' as line union all
  select ord + 1, substr(timestamp, 2, 8) || ',' || player || ',' || item || ',' || case when image_file_name is null then 'unknown.png,' else '"' || image_file_name || '",' || display_id end from e""")
def export_csv_document(spark, sf_dir):
    return export.csv_document(exported(spark, sf_dir))


@query("""with v as (select event_id, (event_id * 37 % 256)::int as r, (event_id * 91 % 256)::int as g, (event_id * 53 % 256)::int as b from events),
  m as (select *, greatest(r, g, b) as hi, least(r, g, b) as lo from v), h as (select *, hi - lo as span, case when hi = lo then 0.0 else (case when hi = r then (g - b) / (hi - lo)::double when hi = g then (b - r) / (hi - lo)::double + 2
    else (r - g) / (hi - lo)::double + 4 end) / 6 end as sixth from m)
  select event_id, round(case when sixth < 0 then sixth + 1 else sixth end, 6)::double as hue, round(case when hi = 0 then 0.0 else span / hi::double end, 6)::double as saturation, round(hi / 255.0, 6)::double as value,
    (r % 2) + 2 * (g % 2) + 4 * (b % 2) as bits, (list_sort([r, g, b, 7]))[3] as middle from h""")
def pixel_scalars(spark, sf_dir):
    channel = lambda k: (F.col("event_id") * k % 256).cast("int")
    v = table(spark, sf_dir, "events").select("event_id", channel(37).alias("r"), channel(91).alias("g"), channel(53).alias("b"))
    hue, saturation, value = (F.round(c, 6) for c in pixels.hsv(F.col("r"), F.col("g"), F.col("b")))
    bits = pixels.packed_bits(F.array(*[F.col(c) % 2 == 1 for c in "rgb"]))
    return v.select("event_id", hue.alias("hue"), saturation.alias("saturation"), value.alias("value"), bits.alias("bits"), pixels.upper_median(F.array("r", "g", "b", F.lit(7))).alias("middle"))


@query("""select event_id, case when event_id % 4 = 0 then (event_id // 4)::varchar when event_id % 2 = 0 then (event_id // 4) || '.5' else (event_id // 4) || case event_id % 4 when 1 then '.25' else '.75' end end || '×' as compact,
  replace(replace(event_type || chr(39) || chr(39), chr(39) || chr(39), '"'), 'l', 'I') as alike,
  case when event_id % 9 = 0 then '0.00' else '-' || (event_id * 7 // 8)::varchar || '.' || lpad((((event_id * 7 % 8) * 250 + 10) // 20)::varchar, 2, '0') end as delta,
  case when event_id < 1024 then event_id || ' B' when event_id < 1048576 then printf('%.1f KB', floor(event_id / 1024.0 * 10 + 0.5) / 10) else printf('%.1f MB', floor(event_id / 1048576.0 * 10 + 0.5) / 10) end as size from events""")
def label_scalars(spark, sf_dir):
    n = F.col("event_id")
    lost = F.when(n % 9 == 0, 0.0).otherwise(n * 7 / 8)
    return table(spark, sf_dir, "events").select("event_id", texts.compact(n / 4).alias("compact"), texts.same_glyphs(F.concat("event_type", F.lit("''"))).alias("alike"), texts.delta(lost).alias("delta"), texts.file_size(n).alias("size"))


@query("""select page_id as image_id, (page_id % 13 - 4)::int as left, (8 - (page_id % 12 - 4))::int as top, 800 as width, 600 as height,
  (abs(page_id % 13 - 4) + abs(page_id % 12 - 4) + abs(8 - (page_id % 12 - 4)) + abs(12 - (page_id % 13 - 4)))::int as adjustment from pages where page_id % 10 <> 9""")
def frame_detect(spark, sf_dir):
    """Frames with margins of -4 to 8; every tenth picture shows none."""

    def drawn(frames):
        mark = glyphs.patch()
        for f in frames:
            made = []
            for i in map(int, f["page_id"]):
                left, bottom = i % 13 - 4, i % 12 - 4
                shot = np.zeros((608, 812, 3), dtype=np.uint8)
                if i % 10 != 9:
                    y, x = 608 - bottom - glyphs.INSET[1], left + glyphs.INSET[0]
                    shot[y : y + glyphs.PATCH[0], x : x + glyphs.PATCH[1]] = mark
                made.append((i, 608, 812, shot.tobytes()))
                if len(made) == 16:
                    yield pd.DataFrame(made, columns=["image_id", "rows", "cols", "data"])
                    made = []
            yield pd.DataFrame(made, columns=["image_id", "rows", "cols", "data"])

    return glyphs.frames(table(spark, sf_dir, "pages").select("page_id").mapInPandas(drawn, "image_id bigint, rows int, cols int, data binary"))


def report_sql(mode: str, chat: bool) -> str:
    fixed = export.CHAT if chat else export.PLAIN
    fill = lambda line: "replace(replace('" + line.format("@p", "@n", *export.MODES[mode]) + "', '@p', p || ' players'), '@n', n::varchar)"
    heads = " union all ".join(f"select {k} as section, {fill(line)} as line from tally" for k, line in fixed.items())
    out = f"""{segments_sql(mode)}, tally as (select count(distinct player) as p, count(distinct (timestamp, player, item)) as n from rec), heads as ({heads}),
 itot as (select item as name, count(*)::varchar as n from (select distinct timestamp, player, item from rec) group by 1),
  il as (select name, rpad(name, (max(length(name)) over ())::int, ' ') || '  ' || lpad(n, (max(length(n)) over ())::int, ' ') as line from itot),
 ptot as (select player as name, coalesce(sum(active_s * weight) / 600, 0)::double as effective, count(*) as logs, count(*) filter (watt >= 100) as high from s left join dim using (item) group by 1),
 pval as (select name, effective, logs, printf('%.2f', case when effective * 8 = floor(effective * 8) then effective + 0.001 else effective end) as value, high || case when high < logs then '+' || (logs - high) else '' end as uses from ptot),
 pwid as (select greatest(6, max(length(name)))::int as a, greatest(4, max(length(uses)))::int as b, greatest(6, max(length(value) + 2))::int as c from pval)
  select section, 0::bigint as place, 0.0::double as effective, 0::bigint as logs, '' as name, line from heads
  union all select 4, 0, 0, 0, name, line from il
  union all select 9, 2, effective, logs, name, rpad(name, a, ' ') || '  ' || rpad(uses, b, ' ') || '  ' || lpad('(' || value || ')', c, ' ') from pval, pwid
  union all select 9, 0, 0, 0, '', rpad('Player', a, ' ') || '  ' || rpad('Uses', b, ' ') || '  ' || lpad('Apples', c, ' ') from pwid
  union all select 9, 1, 0, 0, '', repeat('─', a) || '  ' || repeat('─', b) || '  ' || repeat('─', c) from pwid"""
    return out if chat else out + f"""
  union all select 11, -2, 0, 0, name, '' from pval union all select 11, -1, 0, 0, name, name || ' · ' || logs || case logs when 1 then ' use (' else ' uses (' end || value || ')' from pval
  union all select 11, row_number() over (partition by player order by ord) - 1, 0, 0, player, substr(timestamp, 2, 8) || ' ' || item from rec"""


def in_given_order(spark, sf_dir) -> DataFrame:
    """Records with their place among those of their player, in the order they came in."""
    return records(spark, sf_dir).withColumn("pos", F.row_number().over(Window.partitionBy("player").orderBy("ord")) - 1)


@query(report_sql("cutoff", False))
def plain_report(spark, sf_dir):
    return export.report(in_given_order(spark, sf_dir), timeline.by_player(segs(spark, sf_dir)), item_dimension(spark), timeline.CUTOFF)


@query(report_sql("scaled", True))
def chat_summary(spark, sf_dir):
    return export.report(records(spark, sf_dir), timeline.by_player(segs(spark, sf_dir, timeline.SCALED)), item_dimension(spark), timeline.SCALED, chat=True)


@query(f"""with {font_sql(CHARS, ("",))}, t as (select event_id as ord, '[' || strftime(ts, '%H:%M:%S') || ']user' || user_id || ' used ' || event_type as text from events),
  c as (select ord, flatten(list(string_split(columns, ',') order by k)) as c from (select ord, unnest(string_split(text, '')) as ch, generate_subscripts(string_split(text, ''), 1) as k from t) join font using (ch) group by 1),
  s as (select ord, x, w, array_to_string(c[x:x + w - 1], ',') as columns from (select ord, c, unnest(range(1, len(c) + 1)) as x from c), (select distinct width as w from font) where x + w - 1 <= len(c))
  select ord, x::int as x, ch, width, (instr('{CHARS}', ch) - 1)::int as rank from s join font using (columns) where width = w""")
def anchor_candidates(spark, sf_dir):
    return glyphs.candidates(glyphs.rendered(text_lines(spark, sf_dir), "ord", "text", CHARS), "ord", glyphs.font(spark, CHARS), WIDTHS)


PARTS = f"{PLACED}, p as (select *, ord // {export.PART} as part from e)"


@query(f"""with {PARTS} select -1::bigint as part, '{export.HEADER}' as text union all
  select part, chr(10) || string_agg(substr(timestamp, 2, 8) || ',' || player || ',' || item || ',' || case when image_file_name is null then 'unknown.png,' else '"' || image_file_name || '",' || display_id end, chr(10) order by ord) from p group by 1""")
def export_csv_file(spark, sf_dir):
    return export.document(exported(spark, sf_dir), "csv")


@query(f"""with {PARTS}, r as (select part, ord, '    {{' || chr(10) || '      "timestamp": "' || timestamp || '",' || chr(10) || '      "player": "' || player || '",' || chr(10) || '      "item": "' || item || '",' || chr(10)
    || '      "source": "' || coalesce(image_file_name, 'unknown.png') || '",' || chr(10) || '      "lineFromBottom": ' || coalesce(display_id::varchar, 'null') || chr(10) || '    }}' as block from p)
  select -1::bigint as part, '{{' || chr(10) || '  "schema": 1,' || chr(10) || '  "records": [' || chr(10) as text union all
  select part, case when part > (select min(part) from r) then ',' || chr(10) else '' end || string_agg(block, ',' || chr(10) order by ord) from r group by 1 union all
  select max(part) + 1, chr(10) || '  ]' || chr(10) || '}}' from r""")
def export_json_file(spark, sf_dir):
    return export.document(exported(spark, sf_dir), "json")


@query("""select page_id, 'log-' || strftime(timestamp '2024-01-02 03:04:05' + page_id * interval 1 second, '%Y%m%d-%H%M%S') || case page_id % 4 when 0 then '.csv' when 1 then '.json' when 2 then '-chat.txt' else '.txt' end as name,
  case page_id % 4 when 0 then 'text/csv' when 1 then 'application/json' else 'text/plain' end as mime from pages""")
def export_names(spark, sf_dir):
    at = F.timestamp_seconds(F.lit(1_704_164_645) + F.col("page_id"))
    kinds = ("csv", "json", "chat", "plain")
    pick = lambda make: F.coalesce(*[F.when(F.col("page_id") % 4 == k, make(kind)) for k, kind in enumerate(kinds)])
    return table(spark, sf_dir, "pages").select("page_id", pick(lambda kind: export.file_name(at, kind)).alias("name"), pick(lambda kind: F.lit(export.mime(kind))).alias("mime"))


def chat_sql(limit: int = export.LIMIT) -> str:
    """Messages by recursion: over the lines of all players at once, then over their blocks."""
    return f"""with recursive rep as (select * from ({report_sql("cutoff", True)})),
  ord_rec as (select player, ord, '`' || substr(timestamp, 2, 8) || '` ' || item as line, row_number() over (partition by player order by pos) as k from (select * from ({ordered_sql()}))),
  val as (select player, printf('%.2f', case when effective * 8 = floor(effective * 8) then effective + 0.001 else effective end) as value from ({segments_sql("cutoff")} select player, {TOTALS} from s group by player)),
  head as (select player, '### ' || player || ' · ' || count(*) || case count(*) when 1 then ' use (' else ' uses (' end || any_value(value) || ')' as heading from ord_rec join val using (player) group by 1),
  part(player, k, part, size) as (select player, 0::bigint, 0::bigint, length(heading) from head union all
    select p.player, o.k, case when p.size + 1 + length(o.line) <= {limit} then p.part else p.part + 1 end, case when p.size + 1 + length(o.line) <= {limit} then p.size + 1 + length(o.line) else length(h.heading) + 1 + length(o.line) end
    from part p join ord_rec o on o.player = p.player and o.k = p.k + 1 join head h on h.player = p.player),
  block as (select player, part.part, any_value(heading) || chr(10) || string_agg(line, chr(10) order by part.k) as text, max(part.part) over (partition by player) > 0 as alone from part join ord_rec using (player, k) join head using (player) group by player, part.part),
  nth as (select *, row_number() over (order by lower(player), player, part) as r from block),
  msg(r, m, size) as (select 0::bigint, 0::bigint, {limit + 1} union all
    select n.r, case when not n.alone and msg.size + 1 + length(n.text) <= {limit} then msg.m else msg.m + 1 end, case when n.alone then {limit + 1} when msg.size + 1 + length(n.text) <= {limit} then msg.size + 1 + length(n.text) else length(n.text) end
    from msg join nth n on n.r = msg.r + 1)
  select 0::bigint as message, string_agg(line, chr(10) order by section, case when section = 9 then place else 0 end, effective desc, logs desc, lower(name), name) as text from rep
  union all select m, string_agg(text, chr(10) order by r) from msg join nth using (r) group by m"""


def ordered_sql() -> str:
    return f"with {REC}, {wrapped('')} select player, ord, timestamp, item, pos from w"


@query(chat_sql())
def chat_messages(spark, sf_dir):
    return export.chat(timeline.ordered(records(spark, sf_dir), []), item_dimension(spark), timeline.CUTOFF)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share."""
    return f"{packing.shared_folder(spark)}/{name}_{uuid.uuid4().hex}"


@query("""with v as (select doc_id, 'doc/' || doc_id as key, coalesce(text, '') as text from documents),
  now as (select key, case when doc_id % 3 = 0 then text || ' again' else text end as text from v where doc_id % 5 <> 0)
  select 'first' as version, key, sha256(text) as sha256 from v union all select 'last', key, sha256(text) from now""")
def blob_versions(spark, sf_dir):
    """Contents put, put again and deleted: the newest version, and the first as a reader keeps it that began before."""
    store = BlobStore(spark, scratch(spark, "blobs"))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("doc/"), "doc_id").alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    content = lambda text: F.encode(text, "UTF-8").alias("content")
    first = store.at(store.put(rows.select("key", content(F.col("text")))))
    store.put(rows.where("doc_id % 3 = 0").select("key", content(F.concat("text", F.lit(" again")))))
    store.delete(rows.where("doc_id % 5 = 0").select("key"))
    shown = lambda name, of: of.table().select(F.lit(name).alias("version"), "key", F.sha2("content", 256).alias("sha256"))
    return shown("first", first).unionByName(shown("last", store))


@query(f"""with {SHOTS} select path || '-' || index as slice_id, event_id // 39 % 2 = 0 as stored, case when event_id // 39 % 2 = 0 then clock end as timestamp from shown join shots using (path)
  where reason is null and event_id % 11 not in (3, 5, 6, 7, 9)""")
def restored_slices(spark, sf_dir):
    """Lines whose pictures are in the store are read from it again; others have no content."""
    found = pictures.bracketed(pictures.lines(shots(spark, sf_dir)))
    even = F.regexp_extract("path", "[0-9]+", 0).cast("long") % 2 == 0
    # a table of lines, so that pictures are drawn and looked through once
    folder = scratch(spark, "lines")
    pictures.as_files(found.select(pictures.line_key(), F.concat_ws("-", "path", F.col("index").cast("string")).alias("slice_id"), "profile", F.when(even, F.col("pixels")).alias("pixels"))).write.parquet(folder)
    lines = spark.read.parquet(folder)
    store = BlobStore(spark, scratch(spark, "slices"))
    store.put(lines.where("content is not null").select("key", "content"))
    slices_ = lines.select("key", "slice_id", "profile", F.lit(None).cast("string").alias("reason"))
    read = reading.judged(reading.decoded(pictures.stored_columns(hydrated(slices_, "key", store)), ITEM_NAMES), F.col("slice_id"))
    kept = read.where("status = 'accepted'").select("slice_id", F.lit(True).alias("stored"), "timestamp")
    rest = unstored(slices_, "key", store).select("slice_id", F.lit(False).alias("stored"), F.lit(None).cast("string").alias("timestamp"))
    number = F.regexp_extract("slice_id", "shot_([0-9]+)", 1).cast("long") * 39 + F.regexp_extract("slice_id", "-([0-9]+)$", 1).cast("long") - 1
    return kept.unionByName(rest.where(~(number % 11).isin(3, 5, 6, 7, 9)))


SPLIT = "(select event_id, '[' || strftime(ts, '%H:%M:%S') || ']' as timestamp, 'user' || user_id as player, event_type as item from events)"


def read_session(spark, sf_dir) -> stages.Session:
    """A session of events as read lines of pictures."""
    rows = records(spark, sf_dir)
    shot = F.floor(F.col("ord") / 39)
    pictures_ = rows.select(shot.alias("id")).distinct().select("id", F.lit("accepted").alias("status"), F.lit("active").alias("lifecycle"), F.sha2(F.col("id").cast("string"), 256).alias("checksum"))
    lines = rows.select(F.col("source_slice_id").alias("slice_id"), shot.alias("image_id"))
    refused = F.col("ord") % 7 == 3
    read = rows.select("ord", F.col("source_slice_id").alias("slice_id"), F.lit("balanced").alias("mode"), F.when(refused, "rejected").otherwise("accepted").alias("status"), F.when(refused, "bad_time").alias("rejection_reason"),
                       *[F.when(~refused, F.col(c)).alias(c) for c in session.COLUMNS])
    return session.started(spark, packing.pinned(pictures_), packing.pinned(lines), packing.pinned(read))


@query(f"""with r as {SPLIT}, b as (select * from r where event_id % 7 <> 3), u as (select distinct timestamp, player, item from b), e as (select distinct timestamp, case when player = 'user7' then 'someone' else player end as player, item from b)
  select 'entered' as step, 4 as reachable, (select count(*) from u) as results union all select 'renamed', 3, (select count(*) from u) union all select 'back', 4, (select count(*) from u)
  union all select 'mode', 1, (select count(*) from u) union all select 'results again', 4, (select count(*) from e)""")
def stage_chain(spark, sf_dir):
    """A session entered up to its export; then a player is renamed in cleanup, and back, the way of reading is changed, and the results are entered again."""
    chain = session.chain()
    all_in = chain.entered(read_session(spark, sf_dir), 4)
    renamed = all_in.having(edits=review.renamed(session.base(all_in), "user7", "someone"))
    steps = {"entered": all_in, "renamed": renamed, "back": renamed.having(edits=all_in.parts["edits"]), "mode": session.with_setting(all_in, "import_settings", mode="best"), "results again": chain.entered(renamed, 4)}
    out = None
    for name, state in steps.items():
        row = state.parts["results"].agg(F.count("*").alias("results")).select(F.lit(name).alias("step"), F.lit(chain.reachable(state)).alias("reachable"), "results")
        out = row if out is None else out.unionByName(row)
    return out


@query("""with v as (select event_id, ts, (event_id % 24)::varchar as h, (event_id % 61)::varchar as m, event_type, user_id from events)
  select event_id, case event_id % 3 when 0 then '[' || lpad(h, 2, '0') || ':' || lpad(m, 2, '0') || ':07]' end as pasted, case event_id % 3 when 1 then h || ',' || m || ',' else ',,' end as typed, strftime(ts, '%Y-%m-%d %H:%M') as at,
    (select string_agg(c, '' order by k) from (select c, min(k) as k from (select unnest(string_split(event_type, '')) as c, generate_subscripts(string_split(event_type, ''), 1) as k) group by 1)) as chars,
    trunc((event_id - 50) / 4.0)::int || ',' || greatest(1, trunc((event_id % 9 - 4) / 2.0)::int) as rect from v""")
def entry_scalars(spark, sf_dir):
    """Times as they are typed and pasted, dates, characters that occur, rectangles in whole pixels."""
    n = F.col("event_id")
    h, m = (n % 24).cast("string"), (n % 61).cast("string")
    text = F.when(n % 3 == 0, F.concat(F.lit("at "), h, F.lit("h"), m, F.lit("m 7s 99"))).when(n % 3 == 1, F.concat(F.lit("["), h, F.lit(":"), m, F.lit(":"))).otherwise("7 8")
    v = table(spark, sf_dir, "events").withColumn("text", text).withColumn("part", times.typed(F.col("text")))
    rect = assets.whole_rect((n - 50) / 4, n / 3, (n % 9 - 4) / 2, n / 2)
    return v.select("event_id", times.pasted(F.col("text")).alias("pasted"), F.concat_ws(",", "part.hh", "part.mm", "part.ss").alias("typed"), times.date_time(F.col("ts")).alias("at"), texts.unique_chars(F.col("event_type")).alias("chars"),
                    F.concat_ws(",", rect["left"].cast("string"), rect["width"].cast("string")).alias("rect"))


@query("""select 's' || page_id as id, case when page_id % 4 = 1 then 'best' else 'balanced' end as mode, case when page_id % 4 = 1 then 2 else 0 end as images, case when page_id % 4 = 2 then 1 else 0 end as deleted, false as corrupt from pages where page_id % 4 <> 3
  union all select null, 'balanced', 0, 0, true from pages where page_id % 4 = 3""")
def stored_sessions(spark, sf_dir):
    """Saved sessions, with parts missing and with lines that are no JSON."""
    k, path = F.col("page_id") % 4, scratch(spark, "sessions")
    head = F.concat(F.lit('{"id":"s'), "page_id", F.lit('"'))
    line = F.when(k == 0, F.concat(head, F.lit("}"))).when(k == 1, F.concat(head, F.lit(',"mode":"best","images":[{"id":1,"status":"accepted"},{"id":2,"status":"rejected"}]}'))).when(k == 2, F.concat(head, F.lit(',"deletedRecordIds":["r"]}'))).otherwise("no json")
    table(spark, sf_dir, "pages").select(line.alias("value")).write.text(path)
    return sessions(spark, path).select("id", "mode", F.size("images").alias("images"), F.size("deletedRecordIds").alias("deleted"), "corrupt")


@query("""select 'line_' || event_id as id, event_type as text from events where event_id % 5 not in (2, 4)""")
def golden_entries(spark, sf_dir):
    """Expected texts from documents of entries, a file each, some without an id or a text."""
    path, k = scratch(spark, "golden"), F.col("event_id") % 5
    rows = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 1000).alias("document"), F.struct(F.when(k != 2, F.concat(F.lit("line_"), "event_id")).alias("id"), F.when(k != 4, F.col("event_type")).alias("text")).alias("e"))
    rows.groupBy("document").agg(F.collect_list("e").alias("results")).select("document", F.to_json(F.struct(F.lit(1).alias("version"), "results")).alias("value")).write.partitionBy("document").text(path)
    return golden(spark, path).select("id", "text")


@query("select count(*) as expected, count(*) filter (event_id % 10 <> 4) as decoded, count(*) filter (event_id % 10 not in (3, 4)) as matches, count(*) filter (event_id % 10 = 3) as diffs, count(*) filter (event_id % 10 = 4) as errors from events")
def reading_benchmark(spark, sf_dir):
    """How much of what is written is read as it stands; one line in ten has another text, one can't be read."""
    written = spread(text_lines(spark, sf_dir))
    spoilt = written.withColumn("text", F.when(F.col("ord") % 10 == 3, F.concat("text", F.lit("x"))).when(F.col("ord") % 10 == 4, F.concat("text", F.lit("Q"))).otherwise(F.col("text")))
    lines = glyphs.rendered(spoilt, "ord", "text", CHARS + "Q")
    return reading.compared(written, reading.plain(lines, "ord", CHARS), "ord")


@query(f"with {REC} select player as label, count(*) as n, true as first, false as again from rec group by 1")
def stage_kept(spark, sf_dir):
    """A stage that is computed once: refreshed again with the same rows in another order, it is read back."""
    stage = stages.Stage("count", scratch(spark, "stages"), lambda rows: counts.count_by(rows, F.col("player")))
    rows = records(spark, sf_dir).select("ord", "player")
    _, first = stage.refreshed(spark, rows)
    kept, again = stage.refreshed(spark, rows.orderBy(F.desc("ord")))
    return kept.select("label", "n", F.lit(first).alias("first"), F.lit(again).alias("again"))
