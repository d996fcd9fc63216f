"""Secret scans over an incremental ledger of content-addressed blobs.

Every version of every path is addressed by the SHA-256 of its content. A ledger
row says which rules (by kind and version) one blob was scanned with and which
spans each of them found. A run looks up which pairs of blob and rule are not in
the ledger, reads only one version of each such blob, scans it by those rules
alone, appends ledger rows, and joins the findings of all blobs back to all paths
that hold them. A second run over the same versions scans nothing; a new rule, or a
new version of a rule, scans all blobs by that rule only.

The ledger names rules, never their numbers, so rules may be added, dropped or put
in another order between runs; a span's kind_no is its rule's place in the run
that reads it. Appending the same rows again (a retried run) changes nothing.

Everything is DataFrame functions: positions come from splitting a text at the
matches of a pattern, whose pieces and matches add up to code-point offsets.

Groups of copies meet their one ledger row in a join whose large side Spark
splits; finding one version for each blob is a combined minimum.

Defined results: null contents are empty; a null path is a path like another;
rows that repeat share a blob and get equal findings; spans that start together
stand in the order of the rules; very long contents are scanned whole, their spans
gathered in runs; empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.base import same, saved


@dataclass(frozen=True)
class Rule:
    """A match counts if its group ``part`` has at least ``least`` characters (0: any)."""

    kind: str
    version: int
    pattern: str
    part: int = 0
    least: int = 0

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


ASSIGNED = "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
#: The order of the kinds is the order of spans that start together. A run that is
#: too short cannot hold a longer one, so the least length is in the pattern where
#: the pattern is a plain run.
RULES = (
    Rule("assign", 1, ASSIGNED, 2, 12),
    Rule("access", 1, "AKIA[A-Z0-9]{14,}"),
    Rule("hex", 1, "[0-9a-f]{16,}"),
    Rule("pem", 1, "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", 1, "gh[pousr]_[A-Za-z0-9]{36,}"),
)
BASE_KINDS = ("assign", "access", "hex")
#: What the ledger holds of a span, and what findings say of it.
SPAN = "array<struct<start:int,stop:int,rule:string>>"
FOUND = "array<struct<start:int,kind_no:int,kind:string,stop:int>>"
#: Matches that are gathered together.
RUN = 256
LEDGER = f"blob string, rules array<string>, found {SPAN}"


def spans(text: Column, rule: Rule) -> Column:
    """The spans of one rule: start and stop in code points, stop exclusive.

    Spans are gathered in runs of ``RUN`` matches, so the work stays in proportion
    to a text's matches however many it has.
    """
    pieces = F.transform(F.split(text, rule.pattern, -1), F.length)
    whole = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), F.length)
    part = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.part)), F.length) if rule.part else whole
    steps = F.arrays_zip(pieces.alias("piece"), whole.alias("whole"), part.alias("part"))
    none = F.array().cast(SPAN)

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["piece"]
        stop = start + x["whole"]
        here = F.array(F.struct(start.alias("start"), stop.alias("stop"), F.lit(rule.name).alias("rule")))
        # the last piece has no match after it
        found = F.when(x["part"] >= max(rule.least, 1), F.concat(acc["found"], here)).otherwise(acc["found"])
        return F.struct(F.coalesce(stop, acc["at"]).alias("at"), found.alias("found"))

    def walk(own: Column) -> Column:
        def run(acc: Column, i: Column) -> Column:
            begin = F.struct(acc["at"].alias("at"), none.alias("found"))
            add = lambda r: F.struct(r["at"].alias("at"), F.concat(acc["found"], F.array(r["found"])).alias("found"))
            return F.aggregate(F.slice(own, i * RUN + 1, RUN), begin, step, add)

        begin = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("found"))
        return F.aggregate(F.sequence(F.lit(0), F.floor((F.size(own) - 1) / RUN).cast("int")), begin, run, lambda acc: F.flatten(acc["found"]))

    # an array of one: its element is made once and has a name in the walk
    return F.when(text.rlike(rule.pattern), F.transform(F.array(steps), walk)[0]).otherwise(none)


def addressed(versions: DataFrame, path_col: str, content_col: str) -> DataFrame:
    """path, blob."""
    return versions.select(F.col(f"`{path_col}`").alias("path"), F.sha2(F.coalesce(F.col(f"`{content_col}`").cast("string"), F.lit("")), 256).alias("blob"))


def unseen_blobs(named: DataFrame, rules: tuple[Rule, ...], ledger: DataFrame | None) -> DataFrame:
    """blob, path of one version that holds it, todo: the rules it was never scanned with."""
    blobs = named.groupBy("blob").agg(F.min("path").alias("path"))
    every = F.array(*[F.lit(r.name) for r in rules])
    if ledger is None:
        return blobs.withColumn("todo", every)
    # a blob has a ledger row for each run that scanned it, so its rules are few
    seen = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("seen"))
    todo = F.array_except(every, F.coalesce("seen", F.array().cast("array<string>")))
    return blobs.join(seen, "blob", "left").select("blob", "path", todo.alias("todo")).filter(F.size("todo") > 0)


def scan(versions: DataFrame, unseen: DataFrame, rules: tuple[Rule, ...], path_col: str, content_col: str) -> DataFrame:
    """New ledger rows for the unseen pairs."""
    text = F.coalesce(F.col(f"`{content_col}`").cast("string"), F.lit(""))
    contents = versions.select(F.col(f"`{path_col}`").alias("at"), text.alias("content"))
    u = unseen.alias("u")
    picked = contents.join(u, same(F.col("at"), F.col("u.path")) & (F.sha2("content", 256) == F.col("u.blob"))).select("blob", "todo", "content")
    none = F.array().cast(SPAN)
    each = [F.when(F.array_contains("todo", r.name), spans(F.col("content"), r)).otherwise(none) for r in rules]
    found = reduce(F.concat, each) if each else none
    return picked.select("blob", F.col("todo").alias("rules"), found.alias("found")).dropDuplicates(["blob"])


def numbered(found: Column, rules: tuple[Rule, ...]) -> Column:
    """Ledger spans of ``rules`` as findings, by start and then by the order of the rules; others are left out."""
    if not rules:
        return F.array().cast(FOUND)
    numbers = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.name, i)])
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    own = F.filter(found, lambda s: F.map_contains_key(numbers, s["rule"]))
    number = lambda s: F.element_at(numbers, s["rule"])
    return F.array_sort(F.transform(own, lambda s: F.struct(s["start"].alias("start"), number(s).alias("kind_no"), F.element_at(kinds, number(s) + 1).alias("kind"), s["stop"].alias("stop"))))


def update(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, path_col: str = "path", content_col: str = "content") -> tuple[DataFrame, DataFrame]:
    """(new ledger rows to append, findings for every version: path, blob, found).

    Findings are those of the given rules only; a ledger may hold others and other
    versions, and the same rows more than once.
    """
    named = saved(addressed(versions, path_col, content_col), "blobs")
    fresh = saved(scan(versions, unseen_blobs(named, rules, ledger), rules, path_col, content_col), "ledger")
    if ledger is None:
        asked = fresh.select("blob", "found")
    else:
        # a blob has a row for each run that scanned it
        rows = ledger.select("blob", "found").unionByName(fresh.select("blob", "found"))
        asked = rows.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("found"))).alias("found"))
    findings = named.join(asked.select("blob", numbered(F.col("found"), rules).alias("found")), "blob").select("path", "blob", "found")
    return fresh, findings


def span_text(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
