"""Secrets by patterns, and multipart credentials linked by an interval join.

Base spans come from three patterns (assign, access, hex). Parts that prove nothing by themselves are candidates: other
identifiers (runs of 16 and more capitals and digits), keys (runs of 24 and more letters and digits, of mixed kinds), endpoints
(addresses). A weak identifier is reported as access if a secret part (base assign or hex, or a weak key) starts within SCOPE
code points of it in the same text; a weak key is reported as assign if an identifier or an endpoint does. Weak
candidates that meet a base span are not reported again.

Matches are positioned from the lengths of the texts between them, summed in a window. The interval join is on bins of
SCOPE code points: a candidate looks at its own bin and the two beside it, of each of which only the least and
greatest start of every part is kept, which decides exactly whether one lies within SCOPE. All window frames only grow, so
it is linear however many candidates a text holds. All of it is DataFrame operations.

Null and empty texts have no spans; repeated rows are told apart by a row number of the scan, kept in the checkpoint. An empty table gives
an empty result; other columns of the input are not read, and redacted() passes them on, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweft.llm.common import cut, free_name

KINDS = ("assign", "access", "hex")
SCOPE, LEAST_VALUE, LEAST_ACCESS = 240, 12, 18
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
RUN = r"[A-Za-z0-9+/_-]{16,}"
ENDPOINT = r"https?://[A-Za-z0-9.-]+"
#: What a run must match to be a weak identifier, or a weak key.
WEAK_ID = (r"^[A-Z0-9]+\z", r"[A-Z]", r"[0-9]")
WEAK_KEY = (r"^[A-Za-z0-9+/]{24,}\z", r"[A-Z]", r"[a-z]", r"[0-9]")
RULES = (ASSIGN, ACCESS, HEX, RUN, ENDPOINT)
#: number of what a match is, span kind, part, strong
PATTERNS = (
    (0, 0, "secret", True),
    (1, 1, "id", True),
    (2, 2, "secret", True),
    (3, 1, "id", False),
    (4, 0, "secret", False),
    (5, -1, "endpoint", False),
)


def every(text: Column, patterns: tuple[str, ...]) -> Column:
    out = text.rlike(patterns[0])
    for p in patterns[1:]:
        out = out & text.rlike(p)
    return out


def judged(rule: int, found: Column, value: Column) -> Column:
    """Number in PATTERNS of a match of a rule, null for one that fails; value is an assignment's."""
    if rule == 0:
        return F.when(F.length(value) >= LEAST_VALUE, 0)
    if rule == 1:
        return F.when(F.length(found) >= LEAST_ACCESS, 1)
    if rule == 3:
        return F.when(every(found, WEAK_ID), 3).when(every(found, WEAK_KEY), 4)
    return F.lit(2 if rule == 2 else 5)


MATCH = "array<struct<rule:int,place:int,gap:int,n:int,pattern:int>>"


def matches(text: Column, rule: int) -> Column:
    """An array of (rule, place among its matches, code points since the last match, length, number in PATTERNS)."""
    regex = RULES[rule]
    gaps = F.transform(F.split(text, regex, -1), lambda p: F.length(p))
    found = F.regexp_extract_all(text, F.lit(regex), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(regex), F.lit(2)) if rule == 0 else found
    rows = F.transform(F.arrays_zip(found.alias("found"), values.alias("value"), gaps.alias("gap")), lambda x, k: F.struct(
        F.lit(rule).alias("rule"), k.alias("place"), x["gap"].alias("gap"), F.length(x["found"]).alias("n"), judged(rule, x["found"], x["value"]).alias("pattern")
    ))
    rows = F.filter(rows, lambda x: x["n"].isNotNull()).cast(MATCH)
    return F.when(text.rlike(regex), rows).otherwise(F.array().cast(MATCH))


def candidates(documents: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """row, keep, pattern, start, end of every match; pattern is null for those that fail and for texts without any."""
    text = F.coalesce(F.col("text"), F.lit(""))
    own = documents.select(F.monotonically_increasing_id().alias("row"), *keep, text.alias("text"))
    found = own.select("row", *keep, F.explode_outer(F.concat(*[matches(F.col("text"), r) for r in range(len(RULES))])).alias("m"))
    found = found.select("row", *keep, "m.*")
    upto = Window.partitionBy("row", "rule").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.col("n")).over(upto)
    return cut(found.withColumn("end", end.cast("int")).withColumn("start", (F.col("end") - F.col("n")).cast("int")).drop("gap", "n", "place", "rule"))


def is_in(numbers) -> Column:
    return F.coalesce(F.col("pattern").isin([int(n) for n in numbers]), F.lit(False))


STRONG = [n for n, _, _, s in PATTERNS if s]


def linked(found: DataFrame) -> DataFrame:
    """(row, pattern, start, end) of the weak candidates of found that complementary parts lie near to."""
    weak = [n for n, _, part, s in PATTERNS if not s and part != "endpoint"]
    whole = found.where("pattern is not null")
    # of the base spans that start before a candidate, does one end after its start; of those after it, does one start before its end?
    before = Window.partitionBy("row").orderBy("start").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    after = Window.partitionBy("row").orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    base = F.when(is_in(STRONG), F.col("end"))
    meets = (F.coalesce(F.max(base).over(before), F.lit(-1)) > F.col("start")) | (F.coalesce(F.min(F.when(is_in(STRONG), F.col("start"))).over(after), F.col("end")) < F.col("end"))
    whole = whole.withColumn("meets", meets)
    weak_rows = whole.where(is_in(weak) & ~F.col("meets"))

    part = F.expr("case " + " ".join(f"when pattern = {n} then '{p}'" for n, _, p, _ in PATTERNS) + " end")
    bins = (
        whole.where(is_in(STRONG) | ~F.col("meets")).select("row", part.alias("part"), F.floor(F.col("start") / SCOPE).alias("bin"), F.col("start").alias("s"))
        .groupBy("row", "bin", "part").agg(F.min("s").alias("low"), F.max("s").alias("high"))
    )
    offers = F.when(part == "id", F.array(F.lit("secret"))).otherwise(F.array(F.lit("id"), F.lit("endpoint")))
    looking = (
        weak_rows.select("row", "pattern", "start", "end", F.explode(offers).alias("part"))
        .withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / SCOPE) - 1, F.floor(F.col("start") / SCOPE) + 1)))
    )
    near = (F.abs(F.col("low") - F.col("start")) <= SCOPE) | (F.abs(F.col("high") - F.col("start")) <= SCOPE)
    return looking.join(bins, ["row", "bin", "part"]).where(near).select("row", "pattern", "start", "end").distinct()


def spans(documents: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """row, keep, base (array of start, kind, end) and every (the same with the linked candidates), in order."""
    found = candidates(documents, keep)
    kind = F.expr("case " + " ".join(f"when pattern = {n} then {k}" for n, k, _, _ in PATTERNS) + " end")
    weak = linked(found)
    reported = found.withColumn("base", is_in(STRONG)).withColumn("added", F.lit(False)).select("row", *keep, "pattern", "start", "end", "base", "added")
    # links carry no kept columns: their text has a row of its own in found
    extra = weak.select("row", *[F.lit(None).cast(found.schema[c].dataType).alias(c) for c in keep], "pattern", "start", "end", F.lit(False).alias("base"), F.lit(True).alias("added"))
    span = F.struct("start", kind.alias("kind"), "end")
    return reported.unionByName(extra).groupBy("row").agg(
        *[F.max(c).alias(c) for c in keep],
        F.array_sort(F.collect_list(F.when(F.col("base"), span))).alias("base"),
        F.array_sort(F.collect_list(F.when(F.col("base") | F.col("added"), span))).alias("every"),
    )


def joined(column: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(column, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))))


def secrets(documents: DataFrame) -> DataFrame:
    """doc_id, counts of base spans by kind, the digest of the base spans, and all spans as kind:start:end."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return spans(documents).select(
        "doc_id", *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)],
        F.sha2(joined("base"), 256).alias("base_sha256"), joined("every").alias("spans"),
    )


def redacted(documents: DataFrame, mask: str = "[secret]") -> DataFrame:
    """documents with every reported span of text put as mask, and n_chars to match; columns as before.

    Only texts that some pattern matches are shuffled: their spans come back to them by doc_id and a hash of the text. Spans that meet are one mask.
    """
    hit = F.lit(False)
    for regex in RULES[:4]:
        hit = hit | F.coalesce(F.col("text").rlike(regex), F.lit(False))
    digest, spans_name, id_name, digest_name = "digest", "spans", "id", "id_digest"
    row = documents.where(hit).select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("of"), F.col("doc_id").alias(id_name), F.col("text").alias("text"), F.xxhash64("text").alias(digest))
    found = spans(row.select(F.col(id_name).alias("doc_id"), digest, "text"), ("doc_id", digest)).where(F.size("every") > 0)
    # repeated rows have the same spans; each span with the end of all before it in its text
    found = found.groupBy("doc_id", digest).agg(F.max("every").alias("every")).select("doc_id", digest, F.posexplode("every").alias("nth", "s"))
    earlier = Window.partitionBy("doc_id", digest).orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    found = found.select("doc_id", digest, "nth", F.struct(F.col("nth"), F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.coalesce(F.max("s.end").over(earlier), F.lit(0)).alias("at")).alias("s"))
    found = found.groupBy(F.col("doc_id").alias("found_id"), F.col(digest).alias(digest_name)).agg(F.array_sort(F.collect_list("s")).alias(spans_name))
    both = row.join(found, F.col(id_name).eqNullSafe(F.col("found_id")) & (F.col(digest) == F.col(digest_name)), "left")
    piece = lambda s: F.when(s["start"] >= s["at"], F.concat(F.substring(F.col("text"), s["at"] + 1, s["start"] - s["at"]), F.lit(mask))).otherwise("")
    rest = F.array_max(F.transform(spans_name, lambda s: s["end"]))
    made = F.concat(F.array_join(F.transform(spans_name, piece), ""), F.substring(F.col("text"), rest + 1, F.length("text")))
    changed = both.withColumn("text", F.when(F.col(spans_name).isNull(), F.col("text")).otherwise(made))
    columns = []
    for c in documents.columns:
        own = F.col(f"of.`{c}`")
        if c == "text":
            own = F.col("text")
        elif c == "n_chars":
            own = F.when(F.col(spans_name).isNull(), own).otherwise(F.length("text")).cast(documents.schema[c].dataType)
        columns.append(own.alias(c))
    return documents.where(~hit).unionByName(changed.select(*columns))


def oracle_sql() -> str:
    """secrets() for DuckDB over the view documents, with a join of intervals in place of bins."""
    quoted = lambda regex: "'" + regex.replace("'", "''").replace(r"\z", "$") + "'"
    either = "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in ASSIGN.split(")", 2)[1] + ")")
    assign = either + ASSIGN.split(")", 2)[2]
    whole = lambda patterns: " and ".join(f"regexp_matches(f, {quoted(p)})" for p in patterns)
    of = lambda rule, regex, value, number: f"""
  select row, {rule} as rule, k, length(gaps[k]) + length(found[k]) as step, length(found[k]) as n, {number} as pattern
  from (select row, k, gaps, found, found[k] as f, val[k] as v from (select row, regexp_extract_all(text, {quoted(regex)}) as found, string_split_regex(text, {quoted(regex)}) as gaps,
    {value} as val from d), unnest(range(1, len(found) + 1)) t(k))"""  # noqa: E731
    none = "[]::varchar[]"
    rules = [
        of(0, assign, f"regexp_extract_all(text, {quoted(assign)}, 2)", f"case when length(v) >= {LEAST_VALUE} then 0 end"),
        of(1, ACCESS, none, f"case when length(f) >= {LEAST_ACCESS} then 1 end"),
        of(2, HEX, none, "2"),
        of(3, RUN, none, f"case when {whole(WEAK_ID)} then 3 when {whole(WEAK_KEY)} then 4 end"),
        of(4, ENDPOINT, none, "5"),
    ]
    kind = "case pattern " + " ".join(f"when {n} then {k}" for n, k, _, _ in PATTERNS) + " end"
    part = "case pattern " + " ".join(f"when {n} then '{p}'" for n, _, p, _ in PATTERNS) + " end"
    text = "case kind when 0 then 'assign' when 1 then 'access' else 'hex' end || ':' || a || ':' || b"
    count = ", ".join(f"count(*) filter (base and kind = {k}) as n_{name}" for k, name in enumerate(KINDS))
    return f"""
with d as (select row_number() over () as row, doc_id, coalesce(text, '') as text from documents),
m as ({' union all '.join(rules)}),
p as (select row, pattern, b, b - n as a from (select *, (sum(step) over (partition by row, rule order by k))::int as b from m) where pattern is not null),
base as (select * from p where pattern < 3),
x as (select *, {part} as part, pattern < 3 or not exists (select 1 from base where base.row = p.row and base.a < p.b and base.b > p.a) as counts from p),
added as (select row, pattern, a, b from x where counts and pattern in (3, 4) and exists (select 1 from x y where y.row = x.row and y.counts and abs(y.a - x.a) <= {SCOPE}
  and case when x.part = 'id' then y.part = 'secret' else y.part in ('id', 'endpoint') end)),
s as (select *, {kind} as kind from (select row, pattern, a, b, true as base from base union all select row, pattern, a, b, false from added))
select doc_id, {count}, sha256(coalesce(string_agg({text}, ',' order by a, kind, b) filter (base), '')) as base_sha256,
  coalesce(string_agg({text}, ',' order by a, kind, b) filter (kind is not null), '') as spans
from d left join s using (row) group by row, doc_id"""
