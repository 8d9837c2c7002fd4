"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Base spans are the leftmost non-overlapping matches of three kinds. Every
candidate value, base or not, is hashed; per hash the distinct owners and
repositories are counted over the whole corpus. A value that one owner alone
has looks live; one that WIDE owners or WIDE_REPOSITORIES repositories have is
a copied example, whoever owns it. The method adds spans of kind `owned`: long mixed runs outside the base spans,
without a telling name, that look random and belong to one owner.

Positions without positions: a text is split at its matches, so a match starts
after all pieces and matches before it (lengths in code points).

Counts are aggregated by (hash, owner, repository), then up, so that a widely
copied value is one row a task. Joined back, values with more than 1 / HOT of
all spans (fewer than HOT values) are broadcast, so that no task gets one.

Defined results: null text is empty and has no span; each row is scanned for
itself, so repeated rows repeat their result; null owners count as one owner;
other columns are ignored; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.sources.shared import written

#: Fixed patterns: name, pattern, and the group that is the secret itself.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
OWNED = r"[A-Za-z0-9+/_-]{20,}"
#: kind, pattern, group of the value, least length of the value, rank among kinds.
KINDS = (("assign", ASSIGN, 2, 12), ("access", ACCESS, 0, 18), ("hex", HEX, 0, 16), ("owned", OWNED, 0, 20))
#: Owners from which a value is a copied example.
WIDE = 3
WIDE_REPOSITORIES = 6
#: Distinct characters from which a run looks random.
VARIED = 10
#: Spans that one fold appends at most.
UNIT = 64
HOT = 10_000
LEAST_HOT = 256
MARK = "<SECRET>"
_SPANS = "array<struct<start:bigint,rank:int,end:bigint,kind:string,value:string>>"


def _spans(text: Column, rank: int) -> Column:
    kind, pattern, group, least = KINDS[rank]
    regex = F.lit(pattern)
    found = F.regexp_extract_all(text, regex, F.lit(0))
    values = F.regexp_extract_all(text, regex, F.lit(group)) if group else found
    gaps = F.split(text, pattern, -1)
    piece = lambda g, m: F.struct(F.length(g).cast("bigint").alias("gap"), F.length(m["m"]).cast("bigint").alias("n"), m["v"].alias("v"))
    parts = _let(found, lambda f: F.zip_with(F.slice(gaps, F.lit(1), F.size(f)), F.arrays_zip(f.alias("m"), (values if group else f).alias("v")), piece))

    def one(at, x):
        a, b = at + x["gap"], at + x["gap"] + x["n"]
        return F.struct(a.alias("start"), F.lit(rank).alias("rank"), b.alias("end"), F.lit(kind).alias("kind"), x["v"].alias("value"))

    placed = running(parts, lambda at, x: at + x["gap"] + x["n"], one, lambda at, more: at + more, _SPANS)
    return F.when(text.rlike(pattern), F.filter(placed, lambda x: F.length(x["value"]) >= least)).otherwise(F.array().cast(_SPANS))


def running(xs: Column, step: Callable, emit: Callable, join: Callable, kind: str) -> Column:
    """emit(state before x, x) of each x, in order; a state is a long that starts at 0, step(state, x) is the next one.

    A fold that appends copies what it has, so it runs over UNIT elements at a time; what comes before a unit is folded from the
    units' own results by join(state before, a unit's state from 0). Cost grows with n * UNIT + (n / UNIT)^2, not with n^2.
    """
    zero = F.lit(0).cast("bigint")
    begin = F.struct(zero.alias("at"), F.array().cast("array<bigint>").alias("out"))

    def inner(at, unit):
        first = F.struct(at.alias("at"), F.array().cast(kind).alias("out"))
        return F.aggregate(unit, first, lambda acc, x: F.struct(step(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(emit(acc["at"], x)).cast(kind)).alias("out")), lambda acc: acc["out"])

    def over(units):
        ends = F.transform(units, lambda u: F.aggregate(u, zero, step))
        starts = F.aggregate(ends, begin, lambda acc, e: F.struct(join(acc["at"], e).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])
        return F.flatten(F.zip_with(starts, units, inner))

    return _let(xs, lambda xs: F.when(F.size(xs) > 0, _let(_units(xs), over)).otherwise(F.array().cast(kind)))


def _let(value: Column, body: Callable) -> Column:
    """body(value) with the value computed once: an expression within a function of an array's elements is computed for each of them."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _units(xs: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / UNIT).cast("int")), lambda j: F.slice(xs, j * UNIT + 1, F.lit(UNIT)))


def _free(owned: Column, base: Column) -> Column:
    """Of spans that don't meet each other those that meet no base span; by order of start, so that no pairs are tried."""
    mark = lambda spans, own: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(own).alias("own"), s["end"].alias("end"), s["value"].alias("value")))
    both = F.array_sort(F.concat(mark(base, 0), mark(owned, 1)))  # a base span first of two that start together
    with_next = lambda both: F.zip_with(both, F.slice(both, F.lit(2), F.greatest(F.size(both), F.lit(1))), lambda s, t: F.struct(s["start"].alias("start"), s["own"].alias("own"), s["end"].alias("end"), s["value"].alias("value"), F.when(t["own"] == 0, t["start"]).alias("next")))
    following = _let(both, with_next)
    kind = "array<struct<start:bigint,end:bigint,value:string,clear:boolean>>"

    def one(reached, s):
        clear = (s["own"] == 1) & (reached <= s["start"]) & (s["next"].isNull() | (s["next"] >= s["end"]))
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), clear.alias("clear"))

    told = running(following, lambda reached, s: F.when(s["own"] == 0, F.greatest(reached, s["end"])).otherwise(reached), one, lambda a, b: F.greatest(a, b), kind)
    return F.transform(F.filter(told, lambda s: s["clear"]), lambda s: F.struct(s["start"].alias("start"), F.lit(3).alias("rank"), s["end"].alias("end"), F.lit("owned").alias("kind"), s["value"].alias("value")))


def _candidates(docs: DataFrame, text: Column, owner: Column, repository: Column, *kept: Column) -> DataFrame:
    """A row number, owner, repository, base spans and further candidates outside them; written down, as rows get their numbers here."""
    one = docs.select(*kept, F.coalesce(text.cast("string"), F.lit("")).alias("_text"), F.coalesce(owner.cast("string"), F.lit("")).alias("_owner"), F.coalesce(repository.cast("string"), F.lit("")).alias("_repository"))
    one = one.select("*", *(_spans(F.col("_text"), k).alias(f"_{KINDS[k][0]}") for k in range(4)))
    base = F.array_sort(F.concat("_assign", "_access", "_hex"))
    one = one.select("*", base.alias("_base"))
    varied = lambda v: (F.size(F.array_distinct(F.split(v, ""))) >= VARIED) & v.rlike("[0-9]") & v.rlike("[A-Za-z]")
    further = _free(F.filter("_owned", lambda s: varied(s["value"])), F.col("_base"))
    return one.select("*", further.alias("_further"), F.monotonically_increasing_id().alias("_row")).drop("_assign", "_access", "_hex", "_owned")


def _owners(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each span of each row with its value's hash; and each hash's distinct owners and repositories."""
    every = found.select("_row", "_owner", "_repository", F.posexplode(F.concat("_base", "_further")).alias("_at", "_span"))
    every = every.select("_row", "_owner", "_repository", "_span", F.sha2("_span.value", 256).alias("_hash"))
    counts = every.groupBy("_hash", "_owner", "_repository").agg(F.count("*").alias("n"))
    counts = counts.groupBy("_hash", "_owner").agg(F.count("*").alias("r"), F.sum("n").alias("n"))
    return every, counts.groupBy("_hash").agg(F.count("*").alias("owners"), F.sum("r").alias("repositories"), F.sum("n").alias("copies"))


def _judged(found: DataFrame) -> DataFrame:
    """found with _spans: all spans that stay (base ones, and further ones of one owner), each with its owners."""
    every, counts = _owners(found)
    total = found.agg(F.sum(F.size("_base") + F.size("_further")).alias("n")).first()["n"] or 0
    many = max(LEAST_HOT, total // HOT)
    hot = F.broadcast(counts.where(F.col("copies") > many))
    marked = every.join(hot, "_hash").unionByName(every.join(hot.select("_hash"), "_hash", "left_anti").join(counts.where(F.col("copies") <= many), "_hash"))
    span = F.struct("_span.start", "_span.rank", "_span.end", "_span.kind", "owners", "repositories", "copies")
    kept = marked.where((F.col("_span.kind") != "owned") | (F.col("owners") == 1)).groupBy("_row").agg(F.array_sort(F.collect_list(span)).alias("_spans"))
    return found.join(kept, "_row", "left").withColumn("_spans", F.coalesce("_spans", F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string,owners:bigint,repositories:bigint,copies:bigint>>")))


def _is_example(s: Column) -> Column:
    return (s["owners"] >= WIDE) | (s["repositories"] >= WIDE_REPOSITORIES)


def _told(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def scan_secrets(docs: DataFrame, owner: Column, repository: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, found (spans with kind, place, owners, repositories, copies), base_spans, n_live, n_example and the most repositories of a value, of each row."""
    found = written(_candidates(docs, F.col(text), owner, repository, F.col(doc_id).alias("doc_id")).drop("_text"), "secrets")
    judged = _judged(found)
    return judged.select(
        "doc_id",
        F.col("_spans").alias("found"),
        F.transform("_base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("base_spans"),
        F.size(F.filter("_spans", lambda s: s["owners"] == 1)).cast("long").alias("n_live"),
        F.size(F.filter("_spans", _is_example)).cast("long").alias("n_example"),
        F.coalesce(F.array_max(F.transform("_spans", lambda s: s["repositories"])), F.lit(0)).cast("long").alias("most_repositories"),
    )


def digest(scanned: DataFrame) -> DataFrame:
    """The scan as counts and strings."""
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scanned.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(_told(F.col("base_spans")), 256).alias("base_sha256"), _told(F.col("found")).alias("spans"), "n_live", "n_example", "most_repositories")


def redact_live(docs: DataFrame, owner: Column, repository: Column, text: str = "text") -> DataFrame:
    """docs with each span that is no copied example replaced by MARK; examples stay. Same columns, every row kept.

    Rows without any candidate aren't shuffled.
    """
    telling = F.coalesce(F.col(text).cast("string"), F.lit("")).rlike("|".join(f"(?:{k[1]})" for k in KINDS))
    whole = F.struct(*docs.columns).alias("_whole")
    found = written(_candidates(docs.where(telling), F.col(text), owner, repository, whole), "redact")
    judged = _judged(found)
    live = F.filter("_spans", lambda s: ~_is_example(s))
    # the text is cut before every UNIT-th span, so that a span is looked for within its own stretch
    reached = lambda live: running(live, lambda r, s: F.greatest(r, s["end"]), lambda r, s: r, lambda a, b: F.greatest(a, b), "array<bigint>")
    cut = lambda text, a, b: text.substr((a + 1).cast("int"), (b - a).cast("int"))
    size = F.length("_text").cast("bigint")

    def stretches(live):
        def stretch(unit, over, j, following):
            begin = F.when(j == 0, F.lit(0).cast("bigint")).otherwise(F.get(unit, F.lit(0))["start"])
            return F.struct(unit.alias("own"), begin.alias("begin"), F.coalesce(F.get(following, F.lit(0))["start"], size).alias("end"), F.get(over, F.lit(0)).alias("over"))

        units = _let(_units(live), lambda u: F.arrays_zip(u.alias("unit"), F.concat(F.slice(u, F.lit(2), F.size(u)), F.array(F.slice(live, 1, 0))).alias("following")))
        return F.transform(F.arrays_zip(units.alias("u"), _units(reached(live)).alias("over")), lambda x, j: stretch(x["u"]["unit"], x["over"], j, x["u"]["following"]))

    def clear(x):
        text = cut(F.col("_text"), x["begin"], x["end"])

        def redacted(text):
            def step(acc, s):
                more = F.concat(acc["out"], F.when(s["start"] > acc["at"], cut(text, acc["at"] - x["begin"], s["start"] - x["begin"])).otherwise(F.lit("")), F.when(s["start"] >= acc["at"], F.lit(MARK)).otherwise(F.lit("")))
                return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), more.alias("out"))

            first = F.struct(F.greatest(x["begin"], x["over"]).alias("at"), F.lit("").alias("out"))  # where spans before reach over
            return F.aggregate(x["own"], first, step, lambda acc: F.concat(acc["out"], F.when(x["end"] > acc["at"], cut(text, acc["at"] - x["begin"], x["end"] - x["begin"])).otherwise(F.lit(""))))

        return _let(text, redacted)

    clean = F.array_join(F.transform(_let(live, stretches), clear), "")
    changed = judged.select("_whole", F.when(F.size(live) > 0, clean).otherwise(F.col("_whole")[text]).alias("_clean"))
    changed = changed.select(*(F.col("_clean").alias(c) if c == text else F.col("_whole")[c].alias(c) for c in docs.columns))
    return docs.where(~telling).unionByName(changed)
