"""The stages of a session, from read lines to an export: import, issues, cleanup, results, export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweft.operators import assets, counts, packing, review, timeline
from logweft.operators.stages import Chain, Session, Step

RECORD = "ord long, id string, source_slice_id string, timestamp string, player string, item string, source string"
COLUMNS = [c.split()[0] for c in RECORD.split(", ")][1:]
#: Tables of a session that hold a person's work, all empty at first.
EMPTY = {"manual": RECORD, "edits": RECORD, "deleted": "id string", "results": RECORD}
#: Added to ord of records that were typed in, so that they come after all that were read.
AFTER = 1 << 61


def started(spark: SparkSession, images: DataFrame, slices: DataFrame, read: DataFrame, mode: str = "balanced") -> Session:
    """A session of images, slices and read lines (ord, slice_id, mode, status, rejection_reason and the columns of a record, null if there is none)."""
    settings = lambda **values: spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    empty = {name: spark.createDataFrame([], schema) for name, schema in EMPTY.items()}
    return Session({"images": images, "slices": slices, "read": read, "import_settings": settings(mode=mode), "export_settings": settings(format="plain", effect=timeline.CUTOFF), **empty})


def with_setting(session: Session, part: str, **values: str) -> Session:
    return session.having(**{part: session.parts[part].withColumns({k: F.lit(v) for k, v in values.items()})})


def of_active(read: DataFrame, slices: DataFrame, images: DataFrame) -> DataFrame:
    return read.where("status <> 'failed'").join(assets.of_active(slices, images).select("slice_id"), "slice_id", "left_semi")


def active_read(session: Session) -> DataFrame:
    """Results of active slices that have not failed."""
    return session.known.table(of_active, *[session.parts[name] for name in ("read", "slices", "images")])


def base(session: Session) -> DataFrame:
    """Records as read, then the complete ones of those typed in; ord is their order."""
    own = active_read(session).where("id is not null").select("ord", *COLUMNS)
    both = review.with_manual(own, session.parts["manual"].select("ord", *COLUMNS))
    return both.withColumn("ord", F.col("ord") + F.when(F.col("part") == 1, AFTER).otherwise(0)).drop("part")


def final(session: Session) -> DataFrame:
    """Records after edits and deletions."""
    return review.reviewed(base(session), session.parts["edits"], session.parts["deleted"])


def results(session: Session) -> DataFrame:
    """Final records, the first of equal ones, in the order of the log; ord is their place in it."""
    # ordered() looks at its rows twice
    once = packing.pinned(counts.first_rows(final(session), ["timestamp", "player", "item"]))
    return timeline.ordered(once, []).select(F.col("pos").cast("long").alias("ord"), *COLUMNS)


def import_output(session: Session) -> DataFrame:
    """What was read of each slice, and a row with the way of reading that is chosen."""
    rows = active_read(session).select("slice_id", "mode", "status", "rejection_reason", "timestamp", "player", "item")
    return rows.unionByName(session.parts["import_settings"].select("mode"), allowMissingColumns=True)


def chain() -> Chain:
    records = lambda of: lambda s: of(s).select(*COLUMNS)
    empty = lambda s, *names: s.having(**{n: s.parts[n].limit(0) for n in names})
    return Chain([
        Step("import", lambda s: assets.active(s.parts["images"]).where("checksum is not null").select("checksum"), import_output),
        Step("issues", lambda s: assets.refused(active_read(s)).select("slice_id", "status", "rejection_reason"), records(base), lambda s: empty(s, "manual")),
        Step("cleanup", records(base), records(final), lambda s: empty(s, "edits", "deleted")),
        Step("results", records(final), lambda s: s.parts["results"], lambda s: s.having(results=packing.pinned(results(s)))),
        Step("export", lambda s: s.parts["results"].select(*COLUMNS), lambda s: s.parts["export_settings"]),
    ])
