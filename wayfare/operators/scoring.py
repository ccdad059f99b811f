"""Scores and ranks of places for requests, exact without scoring the whole catalog for each request.

All signals are at least 0 and add up. What a request itself gives to places (transitions from its latest place, revisits of its
history) is explicit; every other place is scored by the request's profile alone, so it can be among the best only if it is
among the best of that profile. The pool of a request is therefore: the best places of its profile (see serving: k places,
whatever the catalog), the places of its history, and those targets of its latest place that the floor of the profile doesn't
rule out. All variants share one pool and one join of the signals.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfare import session
from wayfare.functions.contracts import assert_target_blind
from wayfare.functions.scalars import TIME_BUCKETS, rounded, time_bucket
from wayfare.operators.index import Index
from wayfare.operators.serving import BROADCAST_ENTRIES, HEADS, SCORE_DIGITS, SLACK, WEIGHTS, Lists, best_places, bit_of, bits_of, build_lists, seen, shift_of, target_bound
from wayfare.operators.serving import term as _term
from wayfare.session import BRIEF_SHUFFLES, evaluated, settings, stored

# The signals of each variant, in the order in which they add up.
VARIANTS = {
    "b0": ["global_popularity"],
    "b1": ["global_popularity", "time_popularity"],
    "b2": ["global_popularity", "time_popularity", "transition"],
    "b3": ["global_popularity", "time_popularity", "transition", "recent_revisit", "history_category"],
    "b3_no_time": ["global_popularity", "transition", "recent_revisit", "history_category"],
    "b3_no_transition": ["global_popularity", "time_popularity", "recent_revisit", "history_category"],
    "b3_no_history": ["global_popularity", "time_popularity", "transition"],
}
TRACE = 100
RECENT = 10
#: Up to so many categories a small catalog has an array of its counts for each; with more, each place keeps its own. Both are exact.
CATEGORIES = 128


def check_variants(variants: list[str]) -> list[str]:
    if not variants or len(set(variants)) != len(variants) or not set(variants) <= set(VARIANTS):
        raise ValueError(f"variants must be different and among {sorted(VARIANTS)}")
    return variants


def request_facts(requests: DataFrame, dataset: str = "", beside: tuple[str, ...] = ()) -> DataFrame:
    """What scoring needs of a request: bucket, latest place, places from the latest on, recent categories. With a dataset,
    a request of another one is an error, as its places aren't those of the index. Columns of beside are passed on."""
    visits = F.array_sort(F.transform("history", lambda h: F.struct(h["timestamp"], h["poi_id"], h["category_name"])))
    other = F.raise_error(F.concat(F.lit(f"the index is of {dataset}, a request is of "), F.coalesce("dataset", F.lit("no dataset")))).cast("string")
    sample = F.when(F.col("dataset").eqNullSafe(F.lit(dataset)), F.col("sample_id")).otherwise(other) if dataset else F.col("sample_id")
    v = requests.select(sample.alias("sample_id"), "top_k", time_bucket(F.col("target_time")).alias("bucket"), F.reverse(visits).alias("v"), *beside)
    return v.select(
        "sample_id", "top_k", "bucket", F.get("v", F.lit(0))["poi_id"].alias("latest"), F.transform("v", lambda h: h["poi_id"]).alias("back"),
        F.array_distinct(F.transform(F.slice("v", 1, RECENT), lambda h: h["category_name"])).alias("recent"), *beside,
    )


def candidate_pool(facts: DataFrame, lists: Lists, variants: list[str]) -> DataFrame:
    """sample_id, poi_id, transition, recent_revisit: every place that one of the variants can rank within the depth of the
    lists, and what the categories need, with what the request itself gives to it. Only narrow rows are dealt: the history stays
    where it is."""
    kinds = {("time_popularity" in VARIANTS[v], "history_category" in VARIANTS[v]) for v in variants}
    known = facts.withColumn("recent", F.sort_array(F.array_compact("recent")))
    if lists.whole is not None:
        met = known.join(F.broadcast(lists.whole), F.lit(True))
    else:
        best = stored(best_places(known.select("bucket", "recent").distinct(), lists, kinds))
        met = known.join(best, ["bucket", "recent"])
    none, gives = F.lit(0).cast("long"), lambda poi, m, r: F.struct(poi.alias("poi_id"), m.cast("long").alias("m"), r.cast("double").alias("r"))
    plain = F.transform("pois", lambda p: gives(p, none, F.lit(0.0)))
    back = F.transform("back", lambda p, i: gives(p, none, F.lit(1.0) / (i + 1)))
    parts = [met.select("sample_id", F.concat(plain, back).alias("gives"))]
    if any("transition" in VARIANTS[v] for v in variants):
        t = lists.targets
        reached = met.join(t, (met["latest"] == t["src"]) & (t["bound"] + WEIGHTS["recent_revisit"] >= met["floor"]))
        near = F.col("entries")
        if lists.whole is None:
            reached = evaluated(reached, shift=shift_of(F.col("bucket")), kinds=bits_of(F.col("recent")))
            bound = lambda e: target_bound(e, F.col("shift"), F.col("kinds"), F.lit(0.0))
            near = F.filter("entries", lambda e: (bound(e) >= F.col("floor")) | F.array_contains("back", e["poi_id"]))
        parts.append(reached.select("sample_id", F.transform(near, lambda e: gives(e["poi_id"], e["n"], F.lit(0.0))).alias("gives")))
    rows = reduce(DataFrame.unionAll, parts).select("sample_id", F.explode("gives").alias("x")).select("sample_id", "x.*")
    # dealt by sample, as are all steps after it
    return rows.repartition("sample_id").groupBy("sample_id", "poi_id").agg(F.max("m").alias("transition"), F.max("r").alias("recent_revisit"))


def signals(pool: DataFrame, facts: DataFrame, places: DataFrame) -> DataFrame:
    """The five raw signals of each (request, place) of the pool that the index knows."""
    joined = pool.join(facts.select("sample_id", "top_k", "bucket", "recent"), "sample_id").join(places, "poi_id")
    count = lambda m, key: F.coalesce(F.try_element_at(m, key), F.lit(0).cast("long"))
    return joined.select(
        "sample_id", "top_k", "poi_id", "category", "model_poi_id",
        F.col("g").alias("global_popularity"), count(F.col("buckets"), F.col("bucket")).alias("time_popularity"), "transition", "recent_revisit",
        F.aggregate("recent", F.lit(0).cast("long"), lambda a, c: a + count(F.col("categorys"), c)).alias("history_category"),
    )


def scored(signal_rows: DataFrame, variants: list[str]) -> DataFrame:
    """One row for each variant, with its score and gives, the bits of the signals that are above 0."""

    def of(variant: str) -> Column:
        return F.struct(F.lit(variant).alias("variant"), reduce(lambda a, b: a + b, (_term(s, F.col(s)) for s in VARIANTS[variant])).alias("score"))

    bits = reduce(lambda a, b: a + b, (F.when(F.lit(s == "global_popularity") | (F.col(s) > 0), 1 << i).otherwise(0) for i, s in enumerate(WEIGHTS)))
    rows = signal_rows.withColumn("gives", bits).withColumn("v", F.explode(F.array(*map(of, variants))))
    return rows.select("v.variant", "sample_id", "top_k", "poi_id", "model_poi_id", "category", "v.score", "gives")


def candidate_sources(variant: Column, gives: Column) -> Column:
    """The names of a variant's signals that a place has, in the order of the variant; popularity always is one."""
    order = list(WEIGHTS)
    names_of = lambda names, bits: F.array(*(F.lit(s) for s in names if bits >> order.index(s) & 1)).cast("array<string>")
    named = lambda names: F.get(F.array(*(names_of(names, bits) for bits in range(1 << len(order)))), gives)
    return reduce(lambda rest, v: F.when(variant == v, named(VARIANTS[v])).otherwise(rest), VARIANTS, F.array().cast("array<string>"))


def _by_score() -> Window:
    return Window.partitionBy("variant", "sample_id").orderBy(F.round("score", SCORE_DIGITS).desc(), "poi_id")


def ranked(rows: DataFrame, limit: int = TRACE) -> DataFrame:
    top = rows.withColumn("rank", F.row_number().over(_by_score())).filter(F.col("rank") <= limit)
    return top.withColumn("candidate_sources", candidate_sources(F.col("variant"), F.col("gives"))).drop("gives")


def macro_categories(rows: DataFrame, limit: int = 3) -> DataFrame:
    """variant, sample_id, rank, category: categories in the order in which they first come in the ranking."""
    first = Window.partitionBy("variant", "sample_id", "category").orderBy(F.round("score", SCORE_DIGITS).desc(), "poi_id")
    heads = rows.withColumn("nth", F.row_number().over(first)).filter("nth = 1")
    return heads.withColumn("rank", F.row_number().over(_by_score())).filter(F.col("rank") <= limit).select("variant", "sample_id", "rank", "category", "score")


def score_requests(requests: DataFrame, index: Index, variants: list[str], depth: int = TRACE, lists: Lists | None = None) -> DataFrame:
    """All rows of the pools with their scores: ranked() and macro_categories() give the results, down to depth, or that of the
    lists where they are given. Only requests come in here: labels can't change a score."""
    check_variants(variants)
    facts = request_facts(assert_target_blind(requests), index.dataset)
    lists = lists or build_lists(index, depth)
    return scored(signals(candidate_pool(facts, lists, variants), facts, lists.places), variants)


def _of_whole(facts: DataFrame, lists: Lists, variants: list[str]) -> DataFrame:
    """facts with pool, every place of a catalog of at most WHOLE places by poi_id, and beside it an array of its numbers for each
    signal that the variants have. All that facts are joined with is one row of the catalog, one of counts for each bucket and one
    for each latest place, so all are broadcast and no request is moved. Whole arrays are passed on, no struct is made of a place."""
    needed = {s for v in variants for s in VARIANTS[v]}
    by_id = lambda a, b: F.when(a["poi_id"] < b["poi_id"], -1).when(a["poi_id"] > b["poi_id"], 1).otherwise(0)
    places = lists.places.agg(F.array_sort(F.collect_list(F.struct("poi_id", "category", "model_poi_id", "g", "buckets", "categorys")), by_id).alias("places"))
    zero = F.lit(0).cast("long")
    count = lambda m, key: F.coalesce(F.try_element_at(m, key), zero)
    numbers = lambda f: F.transform("places", f)
    catalog = places.select(numbers(lambda p: F.struct(*(p[c].alias(c) for c in ("poi_id", "category", "model_poi_id")))).alias("pool"), numbers(lambda p: p["g"]).alias("global_popularity"), numbers(lambda p: p["categorys"]).alias("categorys"))
    inverted = "history_category" in needed and _few_categories(lists)
    if inverted:
        names = F.array_distinct(F.flatten(F.transform("categorys", lambda m: F.coalesce(F.map_keys(m), F.array().cast("array<string>")))))
        of_category = F.transform(names, lambda c: F.struct(c.alias("c"), F.transform("categorys", lambda m: count(m, c)).alias("n")))
        catalog = catalog.withColumn("of_category", F.map_from_entries(of_category))
    met = facts.join(F.broadcast(catalog.drop(*(() if "history_category" in needed and not inverted else ("categorys",)))), F.lit(True))
    found = {"global_popularity": F.col("global_popularity")}
    at = lambda numbers: F.transform("pool", lambda p, i: F.coalesce(F.get(numbers, i), zero))
    if "time_popularity" in needed:
        times = places.select("places", F.explode(F.array(*map(F.lit, TIME_BUCKETS))).alias("bucket")).select("bucket", numbers(lambda p: count(p["buckets"], F.col("bucket"))).alias("times"))
        met = met.join(F.broadcast(times), "bucket", "left")
        found["time_popularity"] = F.coalesce("times", at(F.col("times")))
    if "transition" in needed:
        moves = evaluated(lists.targets.groupBy("src").agg(F.map_from_entries(F.flatten(F.collect_list(F.transform("entries", lambda e: F.struct(e["poi_id"], e["n"]))))).alias("to")), to=F.col("to"))
        moves = moves.join(F.broadcast(places), F.lit(True)).select(F.col("src").alias("latest"), numbers(lambda p: count(F.col("to"), p["poi_id"])).alias("moves"))
        met = met.join(F.broadcast(moves), "latest", "left")
        found["transition"] = F.coalesce("moves", at(F.col("moves")))
    if "recent_revisit" in needed:
        first = lambda p: F.coalesce(F.array_position("back", p["poi_id"]), zero)
        ranks = evaluated(met, first=F.transform("pool", first))
        met, found["recent_revisit"] = ranks, F.transform("first", lambda n: F.when(n > 0, F.lit(1.0) / n).otherwise(F.lit(0.0)))
    if "history_category" in needed:
        if inverted:
            # the counts of the categories that are recent and known, added place by place
            met = evaluated(met, seen=F.array_compact(F.transform("recent", lambda c: F.try_element_at("of_category", c))))
            added = F.aggregate("seen", F.transform("pool", lambda p: zero), lambda a, n: F.zip_with(a, n, lambda x, y: x + y))
            found["history_category"] = F.when(F.size("seen") == 1, F.get("seen", F.lit(0))).otherwise(added)
        else:
            found["history_category"] = F.transform("categorys", lambda m: F.aggregate("recent", zero, lambda a, c: a + count(m, c)))
    return evaluated(met, **found).select(*(c for c in facts.columns if c not in ("latest", "back", "recent", "bucket")), "pool", *found)


def _few_categories(lists: Lists) -> bool:
    """Whether counts of every place for every category are few enough to go with the catalog's row."""
    sizes = lists.places.select(F.explode(F.map_keys("categorys")).alias("c")).agg(F.count_distinct("c").alias("n")).first()
    return sizes["n"] <= CATEGORIES


def _scores_of(p: Column | dict[str, Column] | None, variants: list[str]) -> list[Column]:
    """The variants' scores of the signals in a struct or dictionary, or in the columns of a row."""
    return [reduce(lambda a, b: a + b, (_term(s, F.col(s) if p is None else p[s]) for s in VARIANTS[v])) for v in variants]


def _entry(p: Column | dict[str, Column], gives: Column, score: Column) -> Column:
    """A place in an ordered array."""
    return F.struct((-rounded(score, SCORE_DIGITS)).alias("nth"), *(p[c].alias(c) for c in ("poi_id", "model_poi_id", "category")), score.alias("score"), gives.alias("gives"))


def _bits(p: Column | dict[str, Column], known: list[str]) -> Column:
    """The bits of the signals that are above 0."""
    return reduce(lambda a, b: a + b, (F.when(F.lit(s == "global_popularity") | (p[s] > 0), 1 << list(WEIGHTS).index(s)).otherwise(0) for s in known))


def _of_lists(facts: DataFrame, lists: Lists, variants: list[str], heads: bool) -> DataFrame:
    """facts with best_ and the name of each variant, the ordered places that can be among its best. What a request gives (visited
    places, targets of the latest one) meets the places in narrow rows with a short number, and only what can reach the floor of its
    profile comes back; the profile's best places are ordered once for all its requests. Each step is stored, so that its shuffle
    files are gone when the next begins."""
    kinds = {("time_popularity" in VARIANTS[v], "history_category" in VARIANTS[v]) for v in variants}
    zero, none = F.lit(0).cast("long"), F.lit(0.0)
    profile = ["bucket", "recent"]
    # where rows aren't stored their numbers could change: two hashes of all that scores depend on then
    number = F.monotonically_increasing_id() if session.shared_folder(facts.sparkSession) else F.struct(*(F.xxhash64(F.lit(n), "sample_id", *profile, "back").alias(f"h{n}") for n in range(2)))
    known = stored(facts.withColumn("recent", F.sort_array(F.array_compact("recent"))).withColumn("number", number))
    best = best_places(known.select(*profile).distinct(), lists, kinds, heads)
    plain = lambda e: {
        "poi_id": e["poi_id"], "model_poi_id": e["model"], "category": e["voted"],
        "global_popularity": e["g"], "time_popularity": e["t"], "transition": zero, "recent_revisit": none, "history_category": e["k"],
    }
    order = lambda entries, signals, v: F.transform(entries, lambda e: _entry(signals(e), _bits(signals(e), list(WEIGHTS)), _scores_of(signals(e), [v])[0]))
    best = stored(best.select(*profile, "floor", *(F.sort_array(order(F.col("tops"), plain, v)).alias(f"top_{v}") for v in variants)))
    # few profiles go to all tasks; the floor is rounded down
    send = F.broadcast if best.count() * (lists.depth + HEADS) * len(variants) <= BROADCAST_ENTRIES else (lambda df: df)
    low = (F.col("floor") - 1e-5).cast("float").alias("floor")
    met = known.select("number", *profile, "latest", "back").join(send(best.select(*profile, low)), profile)
    met = met.select("number", "latest", "back", "floor", shift_of(F.col("bucket")).alias("shift"), bits_of(F.col("recent")).alias("kinds"))
    narrow = ["number", "floor", "shift", "kinds"]
    revisit = lambda p: F.when(F.array_contains("back", p), F.lit(1.0) / F.array_position("back", p)).otherwise(none)
    visited = met.select(*narrow, "back", F.explode(F.array_distinct(F.array_compact("back"))).alias("poi_id"))
    given = [_reaching(visited.select(*narrow, "poi_id", zero.alias("transition"), revisit(F.col("poi_id")).alias("recent_revisit")), lists.places)]
    if any("transition" in VARIANTS[v] for v in variants):
        t = lists.targets
        reached = met.join(t, (met["latest"] == t["src"]) & (t["bound"] + WEIGHTS["recent_revisit"] >= met["floor"]))
        most = lambda r: target_bound(F.col("e"), F.col("shift"), F.col("kinds"), r) >= F.col("floor")
        moved = reached.select(*narrow, "back", F.explode("entries").alias("e")).filter(most(F.lit(1.0)) & most(revisit(F.col("e.poi_id"))))
        given.append(_reaching(moved.select(*narrow, "e.poi_id", F.col("e.n").alias("transition"), revisit(F.col("e.poi_id")).alias("recent_revisit")), lists.places))
    # a visited place that is a target too can come twice, and once with its moves
    rows = reduce(DataFrame.unionAll, given).repartition("number").groupBy("number", "poi_id").agg(F.max("transition").alias("transition"), F.max("recent_revisit").alias("recent_revisit"), F.any_value("place").alias("place"))
    rows = rows.groupBy("number").agg(F.collect_list(F.struct("poi_id", "transition", "recent_revisit", "place")).alias("given"))
    met = known.drop("latest", "back").join(rows, "number", "left").drop("number").join(send(best.drop("floor")), profile)
    met = evaluated(met, given=F.transform("given", lambda e: F.struct(e.alias("e"), seen(e["place"]["categorys"], F.col("recent")).alias("k"))))
    own = lambda x: {
        "poi_id": x["e"]["poi_id"], "model_poi_id": x["e"]["place"]["model_poi_id"], "category": x["e"]["place"]["category"], "global_popularity": x["e"]["place"]["g"],
        "time_popularity": x["e"]["place"]["t"], "transition": x["e"]["transition"], "recent_revisit": x["e"]["recent_revisit"], "history_category": x["k"],
    }
    met = evaluated(met, ids=F.transform("given", lambda x: x["e"]["poi_id"]))
    rest = lambda v: F.filter(f"top_{v}", lambda e: ~F.array_contains("ids", e["poi_id"]))
    merged = lambda v: F.when(F.col("given").isNull(), F.col(f"top_{v}")).otherwise(F.sort_array(F.concat(order(F.col("given"), own, v), rest(v))))
    return met.select(*(c for c in known.columns if c not in ("latest", "back", "number", *profile)), *(merged(v).alias(f"best_{v}") for v in variants))


def _reaching(rows: DataFrame, places: DataFrame) -> DataFrame:
    """number, poi_id, transition, recent_revisit, place: those of the rows that can reach their floor, with what signals are made of."""
    bucket = F.get(F.array(*map(F.lit, TIME_BUCKETS)), (F.col("shift") / 8).cast("int"))
    met = rows.join(places.filter(F.col("categorys").isNotNull()), "poi_id").withColumn("t", F.coalesce(F.try_element_at("buckets", bucket), F.lit(0).cast("long")))
    # visits of the categories whose bits are among the recent ones'
    common = F.aggregate(F.map_entries("categorys"), F.lit(0).cast("long"), lambda a, c: a + F.when(bit_of(c["key"]).bitwiseAND(F.col("kinds")) != 0, c["value"]).otherwise(F.lit(0)))
    bound = _term("global_popularity", F.col("g")) + _term("time_popularity", F.col("t")) + _term("transition", F.col("transition")) + _term("recent_revisit", F.col("recent_revisit")) + SLACK
    reach = (bound + _term("history_category", F.col("g")) >= F.col("floor")) & (bound + _term("history_category", common) >= F.col("floor"))
    place = F.struct("category", F.col("model_poi_id").cast("long").alias("model_poi_id"), F.col("g").cast("long").alias("g"), "t", "categorys")
    return stored(met.filter(reach).select("number", "poi_id", "transition", "recent_revisit", place.alias("place")))


def scored_lists(requests: DataFrame, index: Index, variants: list[str], depth: int = TRACE, lists: Lists | None = None, beside: tuple[str, ...] = (), heads: bool = True) -> DataFrame:
    """variant, sample_id, top_k, beside, best: the rows of score_requests, down to the depth of the lists, as one ordered array for
    each variant and request, of (nth, poi_id, model_poi_id, category, score, gives). Where the catalog is its own pool, the array is
    made where the request is: no (request, place) row is dealt or sorted with others. Else the rows of what the request gives are
    dealt, and no others. Columns of beside are passed on; scores don't see them. Without heads only depth places are sure to
    be there, not the first ones of the first categories, and fewer places can reach them."""
    check_variants(variants)
    assert_target_blind(requests.drop(*beside))
    lists = lists or build_lists(index, depth)
    facts = request_facts(requests, index.dataset, beside)
    facts = evaluated(facts, **{c: F.col(c) for c in ("bucket", "latest", "back", "recent")})
    if lists.whole is not None:
        met = _of_whole(facts, lists, variants)
        known = [s for s in WEIGHTS if s in met.columns]
        signal = lambda i: {s: F.get(F.col(s), i) for s in known}
        score_of = lambda v: lambda p, i: _scores_of(signal(i), [v])[0]
        scores = {f"scores_{v}": F.transform("pool", score_of(v)) for v in variants}
        met = evaluated(met, gives=F.transform("pool", lambda p, i: _bits(signal(i), known)), **scores)
        ordered = lambda v: F.sort_array(F.transform("pool", lambda p, i: _entry(p, F.get("gives", i), F.get(F.col(f"scores_{v}"), i))))
    else:
        with settings(facts.sparkSession, BRIEF_SHUFFLES):
            met = _of_lists(facts, lists, variants, heads)
        ordered = lambda v: F.col(f"best_{v}")
    of = lambda v: F.struct(F.lit(v).alias("variant"), ordered(v).alias("best"))
    return met.select("sample_id", "top_k", *beside, F.explode(F.array(*map(of, variants))).alias("v")).select("v.variant", "sample_id", "top_k", *beside, "v.best")


def recommended(lists: DataFrame) -> DataFrame:
    """recommendations() of scored_lists()."""
    top = lists.select("variant", "sample_id", F.posexplode(F.slice("best", 1, F.least("top_k", F.lit(TRACE)))).alias("at", "x"))
    return top.select("variant", "sample_id", "x.poi_id", "x.model_poi_id", "x.category", "x.score", (F.col("at") + 1).alias("rank"), candidate_sources(F.col("variant"), F.col("x.gives")).alias("candidate_sources"))


def first_categories(best: Column, limit: int) -> Column:
    """The first categories of an ordered array."""
    return F.slice(F.array_distinct(F.transform(best, lambda e: e["category"])), 1, limit)


def recommendations(rows: DataFrame) -> DataFrame:
    """The first top_k of each request."""
    return ranked(rows, TRACE).filter(F.col("rank") <= F.col("top_k")).drop("top_k")
