"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Every text is searched for secrets of three base kinds (assign, access, hex) and for long mixed-case tokens (entropy) that
are only candidates. The hashes of all candidate values are counted over the whole corpus by distinct repositories and
owners. Equal texts have one vote, that of their least owner, so a copied document doesn't make its credential an example. A
value of more than MAX_OWNERS owners, or of several owners and more than MAX_REPOSITORIES repositories, is a widely copied
example; another that looks random is a live credential. Base findings always stay; an entropy candidate becomes a finding if
it is live. Tables written on the way hold hashes of values, never the values.

Defined cases: a null text is empty and has no spans; spans that overlap between kinds are all kept, but an entropy candidate
that touches a base span is dropped; a null owner or repository counts as one owner or repository of its own; repeated rows
give repeated results; an empty table gives an empty result; the work on a very long text is about in proportion to its length
and spans, as places are summed in two levels. Only the named columns are read, so others can't clash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import before_each, let, row_hash, runs_of, staged, sums_before, text_of

# The patterns of the base kinds and the least length of what they find.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 12
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ["assign", "access", "hex", "entropy"]

#: A candidate only: a whole token of 20 characters or more.
ENTROPY = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}(?![A-Za-z0-9+/_=-])"
PLACEHOLDER = r"(?i)example|sample|dummy|changeme|placeholder|your[_-]|xxxx|0000|1234"

#: Up to so many owners a value is their own; with several owners, up to so many repositories.
MAX_OWNERS, MAX_REPOSITORIES = 2, 20

SPAN = "struct<kind:string,start:bigint,end:bigint,value_hash:string,live:boolean>"
JUDGED = "struct<kind:string,start:bigint,end:bigint,verdict:string>"


def looks_live(value: Column) -> Column:
    """Eight different characters or more, and none of the usual placeholders."""
    return (F.size(F.array_distinct(F.split(value, ""))) >= 8) & ~value.rlike(PLACEHOLDER)


def _spans(text: Column, pattern: str, kind: str, value_group: int, wanted: Callable[[Column], Column]) -> Column:
    """Spans of the matches whose value is wanted, left to right: their starts follow from the lengths of the matches and of
    what is between."""
    gaps = let(F.split(text, pattern, -1), lambda g: F.slice(g, F.lit(1), F.size(g) - 1))
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    found = F.arrays_zip(whole.alias("all"), (F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)) if value_group else whole).alias("value"), gaps.alias("gap"))

    def placed(matches: Column) -> Column:
        before = sums_before(F.transform(matches, lambda x: (F.length(x["gap"]) + F.length(x["all"])).cast("bigint")))
        spans = F.zip_with(matches, before, lambda x, at: F.struct((at + F.length(x["gap"])).alias("start"), (at + F.length(x["gap"]) + F.length(x["all"])).alias("end"), x["value"].alias("value")))
        shown = lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.sha2(s["value"], 256).alias("value_hash"), looks_live(s["value"]).alias("live"))
        return F.transform(F.filter(spans, lambda s: wanted(s["value"])), shown)

    return F.when(text.rlike(pattern), let(found, placed)).otherwise(F.array()).cast(f"array<{SPAN}>")


def base_spans(text: Column) -> Column:
    every = lambda v: F.lit(True)
    assign = _spans(text, ASSIGN, "assign", 2, lambda v: F.length(v) >= ASSIGN_LEAST)
    return F.concat(assign, _spans(text, ACCESS, "access", 0, every), _spans(text, HEX, "hex", 0, every))


def entropy_spans(text: Column) -> Column:
    return _spans(text, ENTROPY, "entropy", 0, lambda v: v.rlike("[a-z]") & v.rlike("[A-Z]") & v.rlike("[0-9]"))


def _ordered(spans: Column) -> Column:
    """By start, then kind in the order of KINDS."""
    rank = lambda s: F.array_position(F.array(*map(F.lit, KINDS)), s["kind"])
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank(s).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_sort(keyed)


def span_text(spans: Column) -> Column:
    """kind:start:end of each span in order, joined by commas."""
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(_ordered(spans), one), ",")


def ownership(candidates: DataFrame) -> DataFrame:
    """candidates: value_hash, owner, repository, text_hash. value_hash, owners, repositories. Equal texts are brought together
    first and then owners, each in a step of its own, so that a value that a third of all rows hold is spread over them. A
    repository belongs to one owner."""
    texts = candidates.groupBy("value_hash", "text_hash").agg(F.min(F.struct(F.col("owner").isNull().alias("none"), "owner", "repository")).alias("first"))
    owned = texts.groupBy("value_hash", F.col("first.owner").alias("owner"), F.pmod(F.xxhash64("first.repository"), F.lit(64)).alias("part"))
    parts = owned.agg(F.count_distinct(F.coalesce(F.col("first.repository").cast("string"), F.lit(""))).alias("n"))
    return (
        parts.groupBy("value_hash", "owner").agg(F.sum("n").alias("n"))
        .groupBy("value_hash").agg(F.count("*").alias("owners"), F.sum("n").alias("repositories"))
    )


def scan(docs: DataFrame, repository: str = "doc_id", owner: str = "source", max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """Per document: doc_id, row_hash, base (spans), spans (base ones and those that the frequencies add, each with the
    verdict live, copied or weak)."""
    text = text_of()
    hashes = F.struct(F.xxhash64("_text").alias("a"), F.xxhash64(F.lit(1), "_text").alias("b")).alias("text_hash")
    found = staged(
        docs.select("doc_id", row_hash().alias("row_hash"), F.col(repository).alias("repository"), F.col(owner).alias("owner"), text.alias("_text"))
        .select("doc_id", "row_hash", "repository", "owner", hashes, base_spans(F.col("_text")).alias("base"), entropy_spans(F.col("_text")).alias("entropy")),
        "secret-spans",
    )
    clear = F.when(F.size("base") == 0, F.col("entropy")).otherwise(F.filter("entropy", lambda e: ~F.exists("base", lambda b: (b["start"] < e["end"]) & (e["start"] < b["end"]))))
    candidates = (
        found.filter((F.size("base") > 0) | (F.size("entropy") > 0))
        .select("row_hash", "repository", "owner", "text_hash", F.explode(F.concat("base", clear)).alias("span"))
        .withColumn("value_hash", F.col("span.value_hash"))
    )
    copied = (F.col("owners") > max_owners) | ((F.col("owners") > 1) & (F.col("repositories") > max_repositories))
    verdict = F.when(copied, "copied").when(F.col("span.live"), "live").otherwise("weak")
    judged = (
        candidates.join(staged(ownership(candidates), "secret-owners"), "value_hash")
        .withColumn("verdict", verdict)
        .filter((F.col("span.kind") != "entropy") | (F.col("verdict") == "live"))
        .select("row_hash", F.struct("span.kind", "span.start", "span.end", "verdict").alias("span"))
    )
    # equal rows have one row_hash and equal spans: keep each span once
    spans = judged.groupBy("row_hash").agg(F.collect_set("span").alias("spans"))
    return found.select("doc_id", "row_hash", "base").join(spans, "row_hash", "left").withColumn("spans", F.coalesce("spans", F.array().cast(f"array<{JUDGED}>")))


def redact(text: Column, spans: Column) -> Column:
    """The text with each run of overlapping spans replaced by [EXAMPLE] if its first one is widely copied, else by [SECRET].
    Runs of RUN spans and the text up to the next run are worked off on their own."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["verdict"].alias("verdict"))))

    def of_runs(runs: Column) -> Column:
        first = F.lit(0).cast("bigint")
        reach = before_each(F.transform(runs, lambda r: F.array_max(F.transform(r, lambda s: s["end"]))), first, F.greatest)
        begins = F.transform(runs, lambda r, i: F.when(i == 0, first).otherwise(r[0]["start"]))
        ends = F.concat(F.transform(F.slice(runs, F.lit(2), F.size(runs)), lambda r: r[0]["start"]), F.array(F.length(text).cast("bigint")))
        return F.array_join(F.transform(F.arrays_zip(runs.alias("run"), reach.alias("reach"), begins.alias("begin"), ends.alias("end")), _redacted_run(text)), "")

    return F.when(F.size(spans) == 0, text).otherwise(let(ordered, lambda o: let(runs_of(o), of_runs)))


def _redacted_run(text: Column) -> Callable[[Column], Column]:
    def cut(part: Column, run: Column, start: Column, end: Column) -> Column:
        return F.substring(part, (start - run["begin"] + 1).cast("int"), F.greatest(end - start, F.lit(0)).cast("int"))

    def one(run: Column) -> Column:
        def over(part: Column) -> Column:
            def cover(state: Column, s: Column) -> Column:
                mark = F.when(s["verdict"] == "copied", "[EXAMPLE]").otherwise("[SECRET]")
                fresh = F.struct(s["end"].alias("at"), F.concat(state["out"], cut(part, run, state["at"], s["start"]), mark).alias("out"))
                longer = F.struct(F.greatest(state["at"], s["end"]).alias("at"), state["out"].alias("out"))
                return F.when(s["start"] >= state["at"], fresh).otherwise(longer)

            none = F.struct(F.greatest(run["begin"], run["reach"]).alias("at"), F.lit("").alias("out"))
            return F.aggregate(run["run"], none, cover, lambda s: F.concat(s["out"], cut(part, run, s["at"], run["end"])))

        return let(F.substring(text, (run["begin"] + 1).cast("int"), (run["end"] - run["begin"]).cast("int")), over)

    return one
