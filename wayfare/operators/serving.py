"""Lists of places ordered by impact, and the exact best places of a profile read from them until a bound rules out the rest.

A request that gives nothing of its own to a place scores it by its profile only: the time bucket and the set of recent
categories. Requests of one profile share their best places, so these are found once for each profile, by a threshold algorithm:

* base: of each bucket the best places by popularity and time, for places that share no recent category;
* singles: of each (bucket, category) the best places of this category alone, whose score is known in advance;
* pairs: places of two categories, for each set of one or both of them that may be recent, with the score that this set gives. A
  place among the best k of a profile is among the best k of the list of those of its categories that are recent: all others
  of that list score at least what the list says. So k entries of each list are enough;
* several: places of more categories, in blocks of like bound for each (bucket, category). A place's score depends on which
  of its categories are recent, but it can't pass the bound that counts all its visits.

The k-th best score among base, singles, pairs and the first entries of several is a floor. Blocks whose bound is below the floor
are never read; from the others only places that reach it leave. So what a request meets is k places, and what is read follows how
many places are bounded by the floor, not the catalog. The first HEADS voted categories of the ranking come the same way.

Bucket "*" stands for scores without time. All lists follow from the index: they can be built once and kept (see bundles).
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfare.functions.scalars import TIME_BUCKETS
from wayfare.operators.index import Index
from wayfare.session import BRIEF_SHUFFLES, evaluated, settings, stored

# Weights of the signals.
WEIGHTS = {"global_popularity": 1.0, "time_popularity": 1.25, "transition": 2.0, "recent_revisit": 1.5, "history_category": 0.75}
#: Scores that agree in so many decimals are ties: sums of logarithms of equal products differ by rounding only.
SCORE_DIGITS = 12
#: Voted categories of a ranking whose first place is always there.
HEADS = 3
#: Entries of a block, and blocks' levels of bound for each unit of score.
BLOCK, LEVELS = 256, 4
#: Levels for each unit of score by which places are counted before any are sorted.
FINE = 8
#: A catalog of at most so many places is its own pool: that is less work than lists, and as bounded.
WHOLE = 512
#: Bounds and floors are sums in another order than scores: this covers their rounding.
SLACK = 1e-9
ANY_TIME = "*"
#: Lists of sets of categories, or of profiles, that go to all tasks, in entries; more are joined by shuffle.
BROADCAST_ENTRIES = 1_000_000
#: A target's visits of each time bucket are kept as the logarithm rounded up to a STEP, one byte each: up to 7e13 visits.
STEP = 1 / 8


def term(signal: str, value: Column) -> Column:
    return value * WEIGHTS[signal] if signal == "recent_revisit" else F.log1p(value) if signal == "global_popularity" else F.log1p(value) * WEIGHTS[signal]


TABLES = ("base", "singles", "first", "several", "targets", "places", "whole", "pairs")


@dataclass(frozen=True)
class Lists:
    """base(bucket, entries), singles(bucket, category, entries), first(bucket, category, entries),
    several(bucket, category, bound, entries), targets(src, bound, entries: what target_bound() needs), places(poi_id, category,
    model_poi_id, g, buckets, categorys: what the signals of a place are made of), pairs(bucket, category, other, entries; other is empty where one category
    is recent); depth: of the ranking that they serve. first and several are None where no place has more than two categories, pairs
    where none has two; a catalog of WHOLE places has whole(pois, floor), one row, and targets only."""

    depth: int
    base: DataFrame | None
    singles: DataFrame | None
    first: DataFrame | None
    several: DataFrame | None
    targets: DataFrame
    places: DataFrame
    whole: DataFrame | None = None
    pairs: DataFrame | None = None

    def tables(self) -> dict[str, DataFrame]:
        return {k: df for k in TABLES if (df := getattr(self, k)) is not None}

    def kept(self) -> Lists:
        """The same lists, held by the executors; of a large catalog those that grow with it are stored."""
        long = () if self.whole is not None else ("several", "targets", "places")
        keep = lambda k, df: df if hasattr(df, "stored_at") else stored(df) if k in long else df.persist()
        return replace(self, **{k: keep(k, df) for k, df in self.tables().items()})


def _order(score: Column) -> list[Column]:
    return [F.round(score, SCORE_DIGITS).desc(), F.col("poi_id")]


def _best(df: DataFrame, keys: list[str], score: Column, k: int) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*_order(score)))
    return df.withColumn("nth", nth).filter(F.col("nth") <= k).drop("nth")


def _promising(df: DataFrame, keys: list[str], score: Column, k: int, heads: bool = False) -> DataFrame:
    """Those of the rows, with their score, that can be among the best k of their keys or, with heads, the first of a voted category.
    Levels of score are counted first, so that of all others none is sorted; what is left is held by the executors."""
    rows, each = df.withColumn("score", score), [*keys, "voted"] if heads else keys
    sizes = rows.groupBy(*each, F.floor(F.col("score") * FINE).alias("level")).agg(F.count("*").alias("n"), F.max("score").alias("first"))
    of_keys = Window.partitionBy(*keys)
    sizes = sizes.withColumn("above", F.sum("n").over(of_keys.orderBy(F.col("level").desc())))
    least = F.coalesce(F.max(F.when(F.col("above") >= k, F.col("level"))).over(of_keys), F.min("level").over(of_keys)) / FINE
    least = sizes.withColumn("least", least).groupBy(*each).agg(F.any_value("least").alias("least"), F.max("first").alias("first")).persist()
    met = rows.join(F.broadcast(least) if least.count() <= BROADCAST_ENTRIES else least, each)
    reach = F.col("score") >= F.col("least") - SLACK
    return met.filter(reach | (F.col("score") >= F.col("first") - SLACK) if heads else reach).drop("least", "first").persist()


def in_blocks(rows: DataFrame, keys: list[str], bound: Column, name: str, entry: Column) -> DataFrame:
    """keys, bound, entries: entries of like bound together, about BLOCK in a row whatever their number."""
    r = rows.select(*keys, bound.alias("bound"), F.xxhash64(name).alias("spread"), entry.alias("entry")).withColumn("level", F.floor(F.col("bound") * LEVELS))
    full = r.groupBy(*keys, "level").agg(F.count("*").alias("full"))
    part = F.pmod("spread", F.ceil(F.col("full") / BLOCK)).alias("part")
    blocks = r.join(full, [*keys, "level"]).groupBy(*keys, "level", part).agg((F.max("bound") + SLACK).alias("bound"), F.collect_list("entry").alias("entries"))
    return blocks.select(*keys, "bound", "entries")


def wide_rows(index: Index) -> DataFrame:
    """A row for each place with its counts by time bucket and by category."""
    as_map = lambda df, key: df.groupBy("poi_id").agg(F.map_from_entries(F.collect_list(F.struct(key, "n"))).alias(f"{key}s"))
    wide = index.poi_stats.join(as_map(index.time_counts, "bucket"), "poi_id", "left").join(as_map(index.category_counts, "category"), "poi_id", "left")
    return wide.select("poi_id", "category", "model_poi_id", F.col("n").alias("g"), "buckets", "categorys")


def is_whole(index: Index) -> bool:
    """Whether the catalog is its own pool."""
    return index.poi_stats.limit(WHOLE + 1).count() <= WHOLE


def build_lists(index: Index, depth: int) -> Lists:
    """The lists of an index, for rankings of depth places."""
    never = F.lit(float("inf"))
    with settings(index.poi_stats.sparkSession, BRIEF_SHUFFLES):
        whole = is_whole(index)
    if whole:
        moves = index.transition_counts.groupBy("src").agg(never.alias("bound"), F.collect_list(F.struct(F.col("dst").alias("poi_id"), "n", never.alias("bound"))).alias("entries"))
        whole = index.poi_stats.agg(F.collect_list("poi_id").alias("pois"), (-F.first(never)).alias("floor"))
        return Lists(depth, None, None, None, None, moves, wide_rows(index), whole)
    # read by every list: a row for each place, and those of its time buckets are made in each task
    places = stored(wide_rows(index))
    place = places.filter(F.col("categorys").isNotNull()).select("poi_id", F.col("category").alias("voted"), F.col("model_poi_id").cast("long").alias("model"), "g", "buckets", F.col("categorys").alias("counts"))
    bucket = F.explode(F.array(*map(F.lit, [*TIME_BUCKETS, ANY_TIME]))).alias("bucket")
    timed = place.select("*", bucket).withColumn("t", F.coalesce(F.try_element_at("buckets", F.col("bucket")), F.lit(0).cast("long")))
    base = timed.withColumn("base", term("global_popularity", F.col("g")) + term("time_popularity", F.col("t")))
    base = base.select("bucket", "poi_id", "voted", "model", "g", "t", "base", "counts")
    entry = F.struct("poi_id", "voted", "base", "counts", "model", "g", "t")
    near = _promising(base, ["bucket"], F.col("base"), depth, heads=True).drop("score")
    heads = _best(_best(near, ["bucket", "voted"], F.col("base"), 1), ["bucket"], F.col("base"), HEADS)
    top = _best(near, ["bucket"], F.col("base"), depth).unionAll(heads)
    # depth places of each time bucket and HEADS more at most
    of_bucket = top.groupBy("bucket", "poi_id").agg(F.any_value(entry).alias("entry")).groupBy("bucket").agg(F.collect_list("entry").alias("entries"))
    alone = F.col("base") + term("history_category", F.col("n"))
    scored = F.struct((-F.round(F.col("score"), SCORE_DIGITS)).alias("nth"), "poi_id", "voted", "model", "g", "t", F.col("n").alias("k"))
    one = _promising(base.filter(F.size("counts") == 1).select("*", F.explode("counts").alias("category", "n")), ["bucket", "category"], alone, depth)
    singles = _best(one, ["bucket", "category"], F.col("score"), depth).groupBy("bucket", "category").agg(F.collect_list(scored).alias("entries"))
    first = several = pairs = None
    sizes = place.agg(F.count_if(F.size("counts") == 2).alias("two"), F.count_if(F.size("counts") > 2).alias("more")).first()
    if sizes["two"]:
        pairs = _pairs(base.filter(F.size("counts") == 2), depth)
    if sizes["more"]:
        many = base.filter(F.size("counts") > 2).select("*", F.explode("counts").alias("category", "n")).withColumn("score", alone)
        first = _best(_promising(many, ["bucket", "category"], alone, depth), ["bucket", "category"], F.col("score"), depth).groupBy("bucket", "category").agg(F.collect_list(entry).alias("entries"))
        several = in_blocks(many, ["bucket", "category"], F.col("base") + term("history_category", F.col("g")), "poi_id", entry)
    return Lists(depth, of_bucket, singles, first, several, _targets(index, place), places, pairs=pairs)


def _targets(index: Index, place: DataFrame) -> DataFrame:
    """src, bound, entries: the targets of each place, in one row up to BLOCK of them, else in blocks of like bound. An entry holds
    what target_bound() needs in a few numbers: visits, those of each time bucket in a byte, and a bit for each category."""
    code = lambda b: F.ceil(F.log1p(F.coalesce(F.try_element_at("buckets", F.lit(b)), F.lit(0))) / STEP).cast("long")
    times = reduce(lambda x, y: x.bitwiseOR(y), (F.shiftleft(code(b), 8 * i) for i, b in enumerate(TIME_BUCKETS)))
    busiest = F.coalesce(F.array_max(F.map_values("buckets")), F.lit(0))
    of_place = place.select(F.col("poi_id").alias("dst"), "g", times.alias("times"), busiest.alias("t"), bits_of(F.map_keys("counts")).alias("kinds"))
    most = reduce(lambda a, b: a + b, (term(s, F.col(c)) for s, c in (("global_popularity", "g"), ("time_popularity", "t"), ("transition", "n"), ("history_category", "g"))))
    moves = index.transition_counts.join(of_place, "dst").select("src", F.struct(F.col("dst").alias("poi_id"), "n", "g", "times", "kinds").alias("entry"), (most + SLACK).alias("bound"))
    sized = moves.withColumn("all", F.count("*").over(Window.partitionBy("src")))
    many = F.col("all") > BLOCK
    level = F.when(many, F.floor(F.col("bound") * LEVELS)).otherwise(0).alias("level")
    part = F.when(many, F.pmod(F.xxhash64("entry.poi_id"), F.ceil(F.col("all") / BLOCK))).otherwise(0).alias("part")
    return sized.groupBy("src", level, part).agg(F.max("bound").alias("bound"), F.collect_list("entry").alias("entries")).select("src", "bound", "entries")


def bits_of(categories: Column) -> Column:
    """A bit for each category, of 64: sets without a common bit have no common category."""
    return F.aggregate(categories, F.lit(0).cast("long"), lambda a, c: a.bitwiseOR(bit_of(c)))


def bit_of(category: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(category), F.lit(64)).cast("int"))


def shift_of(bucket: Column) -> Column:
    """Where a time bucket's byte begins."""
    return (F.array_position(F.array(*map(F.lit, TIME_BUCKETS)), bucket).cast("int") - 1) * 8


def target_bound(e: Column, shift: Column, kinds: Column, revisit: Column) -> Column:
    """What a target's score can't pass in the time bucket of a shift, with recent categories of these bits."""
    visits, code = F.log1p(e["g"]), F.call_function("shiftrightunsigned", e["times"], shift).bitwiseAND(F.lit(255))
    of_kinds = F.when(e["kinds"].bitwiseAND(kinds) != 0, visits * WEIGHTS["history_category"]).otherwise(F.lit(0.0))
    return visits + code * (STEP * WEIGHTS["time_popularity"]) + term("transition", e["n"]) + of_kinds + term("recent_revisit", revisit) + SLACK


def _pairs(two: DataFrame, depth: int) -> DataFrame:
    """bucket, category, other, entries: of places of two categories the best depth, and the first of HEADS voted categories, for
    each set of theirs that may be recent. rest is the category that then isn't."""
    cats = F.array_sort(F.map_keys("counts"))
    n = lambda i: F.element_at("counts", F.col("cats")[i])
    of = lambda category, other, n, rest: F.struct(category.alias("category"), other.alias("other"), n.alias("n"), rest.alias("rest"))
    a, b, none = F.col("cats")[0], F.col("cats")[1], F.lit("")
    sets = F.explode(F.array(of(a, none, n(0), b), of(b, none, n(1), a), of(a, b, n(0) + n(1), none))).alias("set")
    rows = two.withColumn("cats", cats).select("bucket", "poi_id", "voted", "model", "g", "t", "base", sets).select("*", "set.*").drop("set")
    keys, score = ["bucket", "category", "other"], F.col("score")
    rows = _promising(rows, keys, F.col("base") + term("history_category", F.col("n")), depth, heads=True)
    heads = _best(_best(rows, [*keys, "voted"], score, 1), keys, score, HEADS)
    entry = F.struct((-F.round(score, SCORE_DIGITS)).alias("nth"), "poi_id", "voted", "model", "g", "t", F.col("n").alias("k"), "rest")
    return _best(rows, keys, score, depth).unionAll(heads).groupBy(*keys).agg(F.collect_set(entry).alias("entries"))


def seen(counts: Column, recent: Column) -> Column:
    """Visits in recent categories."""
    none = F.lit(0).cast("long")
    return F.aggregate(recent, none, lambda a, c: a + F.coalesce(F.try_element_at(counts, c), none))


def _scores(entries: Column, recent: Column) -> Column:
    """Entries with their scores, in the form of singles."""
    met = F.transform(entries, lambda e: F.struct(e.alias("e"), seen(e["counts"], recent).alias("k")))
    nth = lambda x: (-F.round(x["e"]["base"] + term("history_category", x["k"]), SCORE_DIGITS)).alias("nth")
    return F.transform(met, lambda x: F.struct(nth(x), *(x["e"][c].alias(c) for c in ("poi_id", "voted", "model", "g", "t")), x["k"].alias("k")))


def _own(entry: Column, recent: Column, category: Column) -> Column:
    """Whether category is the first recent one that a place has: in the lists of the others it is passed over."""
    return ~F.exists(recent, lambda c: (c < category) & F.map_contains_key(entry["counts"], c))


def _voted(entries: Column) -> Column:
    """The first HEADS voted categories of ordered entries."""
    return F.slice(F.array_distinct(F.transform(entries, lambda e: e["voted"])), 1, HEADS)


def _sets(categories: Column, pairs: bool) -> Column:
    """The sets of one, and with pairs of two, of ordered categories, as (category, other)."""
    of = lambda c, d: F.struct(c.alias("category"), d.alias("other"))
    ones = F.transform(categories, lambda c: of(c, F.lit("")))
    if not pairs:
        return ones
    return F.concat(ones, F.flatten(F.transform(categories, lambda c: F.transform(F.filter(categories, lambda d: d > c), lambda d: of(c, d)))))


def best_places(profiles: DataFrame, lists: Lists, kinds: set[tuple[bool, bool]], heads: bool = True) -> DataFrame:
    """bucket, recent, pois, floor, tops: of each profile (bucket, ordered recent categories) the best places of every kind of score
    (with time, with categories) and the first places of the first HEADS voted categories; no place outside reaches the floor. tops
    has what the profile gives to these places: visits (g), those of the bucket (t) and of the categories (k) where a kind that
    ranks the place counts them. Without heads the floor is that of the best places only: the first place of a voted category can be far
    below them."""
    keys, with_heads = ["bucket", "recent", "list", "of"], heads
    nothing = F.array().cast("array<string>")
    wanted = F.array(*(F.struct((F.col("bucket") if t else F.lit(ANY_TIME)).alias("list"), (F.col("recent") if c else nothing).alias("of")) for t, c in sorted(kinds)))
    # few bytes, much work: adaptive execution would put them into a few tasks
    spread = profiles.select("bucket", "recent").repartition(int(profiles.sparkSession.conf.get("spark.sql.shuffle.partitions")), "bucket", "recent")
    asked = spread.select("bucket", "recent", F.explode(F.array_distinct(wanted)).alias("w")).select("bucket", "recent", "w.*")
    none = F.array().cast("array<struct<nth:double,poi_id:string,voted:string,model:bigint,g:bigint,t:bigint,k:bigint>>")
    by_set = asked.withColumn("set", F.explode_outer(_sets(F.col("of"), lists.pairs is not None))).select(*keys, "set.*")
    of_list = lambda df, name, *more: df.select(F.col("bucket").alias("list"), "category", *more, F.col("entries").alias(name))
    alone = lambda c: F.when(F.col("other") == "", F.col(c))
    met = by_set.join(of_list(lists.singles, "singles"), ["list", "category"], "left").withColumn("singles", alone("singles"))
    gathered = [F.flatten(F.collect_list("singles")).alias("singles")]
    if lists.first is not None:
        met = met.join(of_list(lists.first, "first"), ["list", "category"], "left")
        own = F.filter(alone("first"), lambda e: _own(e, F.col("of"), F.col("category")))
        met = met.withColumn("first", _scores(own, F.col("of")))
        gathered.append(F.flatten(F.collect_list("first")).alias("first"))
    else:
        gathered.append(F.first(none).alias("first"))
    if lists.pairs is not None:
        met = met.join(small(of_list(lists.pairs, "pairs", "other"), lists.pairs), ["list", "category", "other"], "left")
        # those of whose categories just this set is recent
        just = F.filter("pairs", lambda e: ~F.array_contains("of", e["rest"]) | (F.col("other") != ""))
        met = met.withColumn("pairs", F.transform(just, lambda e: F.struct(*(e[c].alias(c) for c in ("nth", "poi_id", "voted", "model", "g", "t", "k")))))
        gathered.append(F.flatten(F.collect_list("pairs")).alias("pairs"))
    else:
        gathered.append(F.first(none).alias("pairs"))
    base = lists.base.select(F.col("bucket").alias("list"), F.col("entries").alias("base"))
    round1 = met.groupBy(*keys).agg(*gathered).join(F.broadcast(base), "list")
    shares = lambda e: F.exists("of", lambda c: F.map_contains_key(e["counts"], c))
    round1 = evaluated(round1, known=F.concat(_scores(F.filter("base", lambda e: ~shares(e)), F.col("of")), "singles", "pairs"))
    lowest = F.lit(float("-inf"))

    def floor_of(ordered: str, heads: str) -> tuple[Column, Column]:
        """The last of the first voted categories, and the least of its and the depth-th score."""
        last = F.try_element_at(_voted(F.col(heads)), F.lit(-1))
        head = F.aggregate(heads, F.lit(None).cast("double"), lambda a, e: F.coalesce(a, F.when(e["voted"] == F.col("last"), e["nth"])))
        deepest = F.coalesce(-F.get(ordered, F.lit(lists.depth - 1))["nth"], lowest)
        return last, (F.least(deepest, F.coalesce(-head, lowest)) if with_heads else deepest) - SLACK

    if lists.several is None:
        done = evaluated(round1.select(*keys, "known"), ordered=F.array_sort("known"))
        last, floor = floor_of("ordered", "ordered")
        done = evaluated(done, last=last).withColumn("floor", floor)
    else:
        round1 = evaluated(round1, deep=F.array_sort(F.concat("known", "first")), heads=F.array_sort(F.concat(_scores(F.col("base"), F.col("of")), "singles", "pairs", "first")))
        last, floor = floor_of("deep", "heads")
        round1 = evaluated(round1, last=last).withColumn("floor", floor).select(*keys, "known", "floor")
        # one row more carries what is known already
        spread = round1.withColumn("category", F.explode(F.concat("of", F.array(F.lit(None).cast("string")))))
        blocks = lists.several.select(F.col("bucket").alias("list"), F.col("category"), "bound", "entries")
        near = spread.join(blocks, (spread["list"] == blocks["list"]) & (spread["category"] == blocks["category"]) & (blocks["bound"] >= spread["floor"]), "left")
        reach = F.filter(_scores(F.filter("entries", lambda e: _own(e, F.col("of"), spread["category"])), F.col("of")), lambda x: -x["nth"] >= F.col("floor"))
        found = near.select(*(spread[k] for k in keys), "floor", F.when(spread["category"].isNull(), F.col("known")).otherwise(reach).alias("found"))
        done = found.groupBy(*keys, "floor").agg(F.flatten(F.collect_list("found")).alias("known"))
        done = evaluated(done, ordered=F.array_sort("known"))
    firsts = F.transform(_voted(F.col("ordered")), lambda v: F.get(F.filter("ordered", lambda e: e["voted"] == v), F.lit(0)))
    tops = evaluated(done.select("bucket", "recent", "floor", "ordered"), tops=F.array_union(F.slice("ordered", 1, lists.depth), F.array_compact(firsts)))
    plain = lambda e: F.struct(*(e[c].alias(c) for c in ("poi_id", "voted", "model", "g", "t", "k")))
    tops = tops.select("bucket", "recent", "floor", F.transform("tops", plain).alias("tops"))
    if len(kinds) > 1:
        # a kind without time or categories counts none of them
        one = tops.select("bucket", "recent", "floor", F.explode("tops").alias("x")).select("bucket", "recent", "floor", "x.*")
        one = one.groupBy("bucket", "recent", "poi_id").agg(F.min("floor").alias("floor"), *(F.max(c).alias(c) for c in ("voted", "model", "g", "t", "k")))
        tops = one.groupBy("bucket", "recent").agg(F.min("floor").alias("floor"), F.collect_list(plain(one)).alias("tops"))
    return tops.select("bucket", "recent", F.transform("tops", lambda e: e["poi_id"]).alias("pois"), "floor", "tops")


def small(df: DataFrame, table: DataFrame) -> DataFrame:
    """df for all tasks, if its lists have few entries."""
    entries = table.agg(F.sum(F.size("entries"))).first()[0] or 0
    return F.broadcast(df) if entries <= BROADCAST_ENTRIES else df
