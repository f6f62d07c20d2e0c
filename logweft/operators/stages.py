"""Stages that are computed again only if what they start from has changed."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweft.operators import packing


def row_digest(columns: list[str]) -> Column:
    """SHA-256 of a row as JSON with its nulls, in a fixed order of columns."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def fingerprint(rows: DataFrame, columns: list[str]) -> DataFrame:
    """n and a digest that does not depend on the order of rows: sums of four 48-bit parts of the rows' digests.

    Partial sums are made in every task, so no task sorts or gathers the rows.
    """
    digests = rows.select(row_digest(columns).alias("d"))
    parts = []
    for k in range(4):
        part = F.conv(F.substring("d", 1 + 12 * k, 12), 16, 10).cast("long")
        # halves are summed as longs, which hold those of 2 ** 39 rows
        high, low = (F.coalesce(F.sum(half), F.lit(0)).cast("decimal(20,0)") for half in (F.shiftright(part, 24), part.bitwiseAND((1 << 24) - 1)))
        parts.append((high * F.lit(1 << 24).cast("decimal(8,0)") + low).cast("decimal(30,0)"))
    return digests.agg(F.count("*").alias("n"), F.concat_ws(":", *[p.cast("string") for p in parts]).alias("fingerprint"))


class Stage:
    """A result kept as Parquet under the fingerprint of its input."""

    def __init__(self, name: str, folder: str, compute: Callable[[DataFrame], DataFrame]):
        self.name, self.folder, self.compute = name, folder, compute

    def path(self, rows: DataFrame) -> str:
        got = fingerprint(rows, sorted(rows.columns)).first()
        return f"{self.folder}/{self.name}/{got.n}-{got.fingerprint.replace(':', '-')}"

    def refreshed(self, spark: SparkSession, rows: DataFrame) -> tuple[DataFrame, bool]:
        """The stage's result, and whether it was computed now."""
        path = self.path(rows)
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
            return spark.read.parquet(path), False
        self.compute(rows).write.mode("overwrite").parquet(path)
        return spark.read.parquet(path), True


@dataclass(frozen=True)
class Step:
    """A stage of a chain: what it starts from and what it gives, as rows to be fingerprinted, and the session once it starts anew."""

    name: str
    initial: Callable[[Session], DataFrame]
    output: Callable[[Session], DataFrame]
    started: Callable[[Session], Session] = lambda session: session


@dataclass(frozen=True)
class Session:
    """Tables and settings by name, with the fingerprints that each stage has started from and given, the furthest stage entered, and fingerprints that hold for good."""

    parts: dict[str, DataFrame]
    initial: dict[str, str] = field(default_factory=dict)
    given: dict[str, str] = field(default_factory=dict)
    current: int = 0
    known: Known = field(default_factory=lambda: Known(), compare=False, repr=False)

    def having(self, **parts: DataFrame) -> Session:
        return replace(self, parts={**self.parts, **parts})


def told(rows: DataFrame) -> str:
    """The fingerprint of rows, over all their columns."""
    got = fingerprint(rows, sorted(rows.columns)).first()
    return f"{got.n}:{got.fingerprint}"


class Known:
    """What is known of rows that can't change, whatever session it belongs to: the same plan over checkpoints and constants is told once."""

    def __init__(self):
        self.plans: dict[int, list[tuple]] = {}
        self.tables: list[tuple] = []

    def table(self, make: Callable[..., DataFrame], *parts: DataFrame) -> DataFrame:
        """What make gives for these very parts, read back from a checkpoint that is made once; as it is if it could be other rows by then."""
        for maker, own, rows in self.tables:
            if maker is make and len(own) == len(parts) and all(a is b for a, b in zip(own, parts)):
                return rows
        rows = make(*parts)
        if lasting(rows._jdf.queryExecution().optimizedPlan()):
            rows = packing.pinned(rows)
        self.tables.append((make, parts, rows))
        return rows

    def told(self, rows: DataFrame) -> str:
        # the order of columns is no part of a fingerprint
        rows = rows.select(*sorted(rows.columns))
        plan = rows._jdf.queryExecution().optimizedPlan()
        if not lasting(plan):
            return told(rows)
        alike = self.plans.setdefault(plan.semanticHash(), [])
        for other, names, known in alike:
            if names == rows.columns and other.sameResult(plan):
                return known
        alike.append((plan, rows.columns, told(rows)))
        return alike[-1][2]


def lasting(plan) -> bool:
    """Whether a plan gives the same rows each time: a table that is read from files may be another one by then."""
    leaves = plan.collectLeaves()
    return plan.deterministic() and all(constant(leaves.apply(k)) for k in range(leaves.size()))


def constant(leaf) -> bool:
    kind = leaf.getClass().getSimpleName()
    return kind in ("LocalRelation", "Range", "OneRowRelation") or (kind == "LogicalRDD" and leaf.rdd().isCheckpointed())


class Chain:
    """Stages in order. A stage that is entered starts anew only if what it starts from has changed since; whatever was changed by hand in it stays otherwise."""

    def __init__(self, steps: list[Step]):
        self.steps = steps

    def entered(self, session: Session, target: int) -> Session:
        """session with all stages up to target brought up to date, in order."""
        for k, step in enumerate(self.steps[: target + 1] if target > 0 else []):
            if k:
                before = self.steps[k - 1]
                session = replace(session, given={**session.given, before.name: session.known.told(before.output(session))})
            now = session.known.told(step.initial(session))
            if session.initial.get(step.name) != now:
                session = step.started(replace(session, initial={**session.initial, step.name: now}))
                session = replace(session, given={**session.given, step.name: session.known.told(step.output(session))})
        return replace(session, current=max(session.current, target))

    def reachable(self, session: Session) -> int:
        """The furthest stage that may be entered: the one after the first whose output, or whose successor's start, is not what it was."""
        last = len(self.steps) - 1
        for k in range(session.current + 1):
            step = self.steps[k]
            if step.name in session.given and session.given[step.name] != session.known.told(step.output(session)):
                return min(k + 1, last)
            if k < last and self.steps[k + 1].name in session.initial and session.initial[self.steps[k + 1].name] != session.known.told(self.steps[k + 1].initial(session)):
                return k + 1
        return min(session.current + 1, last)

    def forgotten(self, session: Session) -> Session:
        """session after its pictures have changed: the first stage has to start anew, everything else is kept."""
        return replace(session, initial={k: v for k, v in session.initial.items() if k != self.steps[0].name})
