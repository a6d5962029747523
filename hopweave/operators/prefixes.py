"""Evidence prefixes of all queries at once: a round a slot, each a few joins and one aggregation.

A pool holds a query's bounded candidates (80 passages), as rows (query_id, passage, base, goals, tokens): goals a map of
goal to score, tokens the passage's distinct words. The utility of a list is a sum in order: 0.4 base + 0.25 best goal
score + 0.45 share of goals newly covered - 0.15 greatest overlap with what is already there. Overlaps of a pool's
passages are computed once. Every round is written, so lineage does not grow with the slots.

The functions over lists in ``selection`` state the same rules for one query.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from hopweave.operators.selection import BASE_WEIGHT, GAIN_WEIGHT, GOAL_WEIGHT, MEANINGFUL_GAIN, TWIN_WEIGHT, WEAK_ROUTE

Keep = Callable[[DataFrame], DataFrame]
_NAMES = "array<string>"


def items(pool: DataFrame, keep: Keep) -> DataFrame:
    """(query_id, n_goals, item): item a struct of passage, base, best (goal score), goals and twins (overlap by passage).
    Goals may also be an array, with the best score in a column goal_score."""
    scored = dict(pool.dtypes)["goals"].startswith("map")
    goals = F.map_keys("goals") if scored else F.array_distinct("goals")
    best = F.coalesce(F.array_max(F.map_values("goals")), F.lit(0.0)) if scored else F.col("goal_score")
    rows = keep(pool.select("query_id", "passage", "base", best.alias("best"), goals.alias("goals"), F.array_distinct("tokens").alias("tokens")))
    left, right = (rows.select("query_id", F.col("passage").alias(p), F.col("tokens").alias(t)) for p, t in (("passage", "own"), ("other", "others")))
    shared = F.size(F.array_intersect("own", "others"))
    overlap = shared / F.greatest(F.lit(1), F.size("own") + F.size("others") - shared)
    # Pairs of one bounded pool, each looked at once.
    pairs = left.join(right, "query_id").where("passage < other").select("query_id", "passage", "other", overlap.alias("v")).where("v > 0")
    both = pairs.unionByName(pairs.select("query_id", F.col("other").alias("passage"), F.col("passage").alias("other"), "v"))
    twins = both.groupBy("query_id", "passage").agg(F.collect_list(F.struct("other", "v")).alias("twins"))
    counts = rows.select("query_id", F.explode("goals").alias("g")).groupBy("query_id").agg(F.count_distinct("g").alias("n_goals"))
    item = F.struct("passage", "base", "best", "goals", F.coalesce("twins", F.expr("cast(array() AS array<struct<other:string,v:double>>)")).alias("twins"))
    return keep(rows.join(twins, ["query_id", "passage"], "left").join(counts, "query_id", "left").select("query_id", F.coalesce("n_goals", F.lit(0)).alias("n_goals"), item.alias("item")))


def _worth(item: Column, covered: Column, names: Column, n_goals: Column) -> Column:
    """What an item adds to a list that covers goals and holds passages."""
    twin = F.coalesce(F.array_max(F.transform(F.filter(item["twins"], lambda t: F.array_contains(names, t["other"])), lambda t: t["v"])), F.lit(0.0))
    fresh = F.size(F.array_except(item["goals"], covered))
    return BASE_WEIGHT * item["base"] + GOAL_WEIGHT * item["best"] + GAIN_WEIGHT * fresh / F.greatest(F.lit(1), n_goals) - TWIN_WEIGHT * twin


def utility(chosen: Column, n_goals: Column) -> Column:
    """The utility of an array of items, in its order."""
    zero = F.struct(F.lit(0.0).alias("total"), F.array().cast(_NAMES).alias("covered"), F.array().cast(_NAMES).alias("names"))
    step = lambda acc, p: F.struct((acc["total"] + _worth(p, acc["covered"], acc["names"], n_goals)).alias("total"), F.array_union(acc["covered"], p["goals"]).alias("covered"), F.concat(acc["names"], F.array(p["passage"])).alias("names"))
    return F.aggregate(chosen, zero, step, lambda acc: acc["total"])


def _names(chosen: str) -> Column:
    return F.transform(chosen, lambda p: p["passage"])


def greedy(rows: DataFrame, slots: int, keep: Keep) -> DataFrame:
    """rows: items. (query_id, step, passage, objective): the passage that adds most, slot by slot; ties to the least name."""
    state = keep(rows.select("query_id", "n_goals").distinct().withColumns({"covered": F.array().cast(_NAMES), "names": F.array().cast(_NAMES)}))
    out = None
    for step in range(slots):
        met = rows.join(state.drop("n_goals"), "query_id").where(~F.array_contains("names", F.col("item.passage")))
        worth = _worth(F.col("item"), F.col("covered"), F.col("names"), F.col("n_goals"))
        scored = met.select("query_id", "covered", "names", "n_goals", F.struct((-F.round(worth, 12)).alias("loss"), F.col("item.passage").alias("passage"), worth.alias("objective"), F.col("item.goals").alias("goals")).alias("s"))
        picked = keep(scored.groupBy("query_id").agg(F.min("s").alias("s"), F.any_value("covered").alias("covered"), F.any_value("names").alias("names"), F.any_value("n_goals").alias("n_goals")))
        row = picked.select("query_id", F.lit(step).alias("step"), "s.passage", "s.objective")
        out = row if out is None else out.unionByName(row)
        state = picked.select("query_id", "n_goals", F.array_union("covered", "s.goals").alias("covered"), F.concat("names", F.array("s.passage")).alias("names"))
    return out


def starts(rows: DataFrame, proven: DataFrame, slots: int, keep: Keep) -> DataFrame:
    """proven: query_id, goal, bundle. (query_id, n_goals, begin): the empty set and every union of bundles that fits the
    slots; bundles with a passage outside the pool are left out."""
    pools = rows.groupBy("query_id").agg(F.any_value("n_goals").alias("n_goals"), F.collect_set("item.passage").alias("pool"))
    whole = proven.join(pools, "query_id").where(F.size(F.array_except("bundle", "pool")) == 0).select("query_id", F.array_sort(F.array_distinct("bundle")).alias("bundle")).distinct()
    listed = whole.groupBy("query_id").agg(F.array_sort(F.collect_set("bundle")).alias("bundles"))  # as many as a plan has goals
    sets = pools.select("query_id", "n_goals").join(listed, "query_id", "left").withColumns({"bundles": F.coalesce("bundles", F.array().cast("array<array<string>>")), "begin": F.array().cast(_NAMES)})
    most = listed.agg(F.max(F.size("bundles"))).first()[0] or 0
    for i in range(most):
        more = sets.where(F.size("bundles") > i).withColumn("begin", F.array_sort(F.array_union("begin", F.get("bundles", F.lit(i))))).where(F.size("begin") <= slots)
        sets = keep(sets.unionByName(more).distinct())
    return sets.select("query_id", "n_goals", "begin")


def joint_prefix(pool: DataFrame, proven: DataFrame, keep: Keep, slots: int = 5) -> DataFrame:
    """(query_id, passages): from every start, slots filled by utility, then single passages outside the start swapped while
    that raises the whole. The list that holds most bundles, then of the greatest utility, then of the first names."""
    rows = items(pool, keep)
    state = starts(rows, proven, slots, keep)
    held = state.join(rows.select("query_id", "item"), "query_id").where(F.array_contains("begin", F.col("item.passage")))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("item.base")).alias("b"), F.col("item.passage").alias("p"), "item"))), lambda s: s["item"])
    begun = held.groupBy("query_id", "begin").agg(ordered.alias("chosen"))
    none = F.array().cast(rows.select(F.array("item").alias("x")).schema["x"].dataType)
    size = rows.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    state = keep(state.join(begun, ["query_id", "begin"], "left").join(size, "query_id").select("query_id", "n_goals", "begin", "n", F.coalesce("chosen", none).alias("chosen")))
    for _ in range(slots):
        open_ = state.where((F.size("chosen") < slots) & (F.size("chosen") < F.col("n")))
        met = open_.join(rows.select("query_id", "item"), "query_id").where(~F.array_contains(_names("chosen"), F.col("item.passage")))
        scored = met.withColumn("s", F.struct((-F.round(utility(F.concat("chosen", F.array("item")), F.col("n_goals")), 12)).alias("loss"), F.col("item.passage").alias("passage")))
        best = scored.groupBy("query_id", "begin").agg(F.min("s").alias("s"))
        added = open_.join(best, ["query_id", "begin"]).join(rows.select("query_id", F.col("item.passage").alias("passage"), "item"), ["query_id"]).where("passage = s.passage")
        added = added.select("query_id", "n_goals", "begin", "n", F.concat("chosen", F.array("item")).alias("chosen"))
        state = keep(state.where((F.size("chosen") >= slots) | (F.size("chosen") >= F.col("n"))).unionByName(added))
    done, moving = None, state
    while not moving.isEmpty():
        places = moving.withColumn("now", utility(F.col("chosen"), F.col("n_goals"))).withColumn("i", F.explode(F.sequence(F.lit(0), F.size("chosen") - 1)))
        places = places.where(~F.array_contains("begin", F.get("chosen", F.col("i"))["passage"]))
        met = places.join(rows.select("query_id", "item"), "query_id").where(~F.array_contains(_names("chosen"), F.col("item.passage")))
        new = F.transform("chosen", lambda p, k: F.when(k == F.col("i"), F.col("item")).otherwise(p))
        scored = met.select("query_id", "begin", "now", new.alias("new"), "i", F.col("item.passage").alias("passage"), "n_goals").withColumn("value", utility(F.col("new"), F.col("n_goals")))
        best = scored.groupBy("query_id", "begin").agg(F.min_by(F.struct("new", "value", "now"), F.struct(-F.round("value", 12), "i", "passage")).alias("b"))
        swapped = keep(moving.join(best.where("b.value > b.now + 1e-9"), ["query_id", "begin"], "left"))
        rest = swapped.where("b IS NULL").drop("b")
        done = rest if done is None else done.unionByName(rest)
        moving = keep(swapped.where("b IS NOT NULL").select("query_id", "n_goals", "begin", "n", F.col("b.new").alias("chosen")))
    if done is None:
        done = state
    bundles = proven.groupBy("query_id").agg(F.collect_list(F.struct("goal", "bundle")).alias("proven"))  # as many as a plan has goals
    last = done.join(bundles, "query_id", "left").withColumn("passages", _names("chosen"))
    holds = F.coalesce(F.size(F.filter("proven", lambda b: F.size(F.array_except(b["bundle"], F.col("passages"))) == 0)), F.lit(0))
    mark = F.struct(-F.when(F.col("proven").isNull(), 0).otherwise(holds), -F.round(utility(F.col("chosen"), F.col("n_goals")), 12), "passages")
    return last.groupBy("query_id").agg(F.min(mark).alias("m")).select("query_id", "m.passages")


def continuous_prefix(ranked: DataFrame, pool: DataFrame, proven: DataFrame, keep: Keep, slots: int = 5) -> DataFrame:
    """ranked: query_id, passage, rank from 1. (query_id, passage, rank): the base order, in which a passage from further
    down takes the place of the weakest unprotected one of the prefix where that raises the prefix by MEANINGFUL_GAIN.

    Candidates come in a fixed order, passages of bundles first. A round finds each query's next candidate whose swap is
    worth it; as nothing changes up to there, all candidates of a round are tried against the same prefix, and there are as
    many rounds as swaps."""
    rows = items(pool, keep)
    named = rows.select("query_id", F.col("item.passage").alias("passage"), "item", "n_goals").join(ranked.select("query_id", "passage", "rank"), ["query_id", "passage"])
    first = named.where(F.col("rank") <= slots).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "item"))), lambda s: s["item"]).alias("prefix"), F.any_value("n_goals").alias("n_goals"))
    listed = proven.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("goal", "bundle"))), lambda b: b["bundle"]).alias("bundles"))
    state = first.join(listed, "query_id", "left").withColumn("bundles", F.coalesce("bundles", F.array().cast("array<array<string>>")))
    inside = F.filter("bundles", lambda b: F.size(F.array_except(b, _names("prefix"))) == 0)
    state = state.withColumn("protected", F.array_distinct(F.flatten(inside))).withColumn("wanted", F.array_distinct(F.flatten("bundles"))).withColumn("from", F.lit(0))
    state = keep(state.select("query_id", "n_goals", "prefix", "protected", "wanted", "from"))
    # The order of the candidates: passages of bundles in theirs, then the tail by rank.
    place = F.when(F.array_contains("wanted", F.col("passage")), F.array_position("wanted", F.col("passage"))).otherwise(F.lit(1 << 20) + F.col("rank"))
    line = named.join(state.select("query_id", "wanted"), "query_id").where((F.col("rank") > slots) | F.array_contains("wanted", F.col("passage")))
    line = keep(line.select("query_id", "item", "passage", place.cast("int").alias("place"), F.array_contains("wanted", F.col("passage")).alias("proof")))
    done, moving = None, state
    while not moving.isEmpty():
        met = moving.join(line, "query_id").where((F.col("place") > F.col("from")) & ~F.array_contains(_names("prefix"), F.col("passage")))
        tried = met.withColumn("now", utility(F.col("prefix"), F.col("n_goals"))).withColumn("i", F.explode(F.sequence(F.lit(0), F.size("prefix") - 1)))
        tried = tried.where(~F.array_contains("protected", F.get("prefix", F.col("i"))["passage"]))
        new = F.concat(F.filter("prefix", lambda p, k: k != F.col("i")), F.array("item"))
        scored = tried.select("query_id", "place", "passage", "proof", "now", "i", new.alias("new"), "n_goals").withColumn("value", utility(F.col("new"), F.col("n_goals")))
        each = scored.groupBy("query_id", "place", "passage", "proof").agg(F.max_by(F.struct("new", "value", "now"), F.struct(F.round("value", 12), "i")).alias("b"))
        next_ = each.where(F.expr(f"b.value > b.now + {MEANINGFUL_GAIN}D * abs(b.now)")).groupBy("query_id").agg(F.min_by(F.struct("place", "passage", "proof", F.col("b.new").alias("new")), "place").alias("s"))
        turned = keep(moving.join(next_, "query_id", "left"))
        rest = turned.where("s IS NULL").select("query_id", "prefix")
        done = rest if done is None else done.unionByName(rest)
        guard = F.when(F.col("s.proof"), F.array_union("protected", F.array("s.passage"))).otherwise(F.col("protected"))
        moving = keep(turned.where("s IS NOT NULL").select("query_id", "n_goals", F.col("s.new").alias("prefix"), guard.alias("protected"), "wanted", F.col("s.place").alias("from")))
    if done is None:
        done = state.select("query_id", "prefix")
    places = done.select("query_id", F.posexplode(_names("prefix")).alias("at", "passage"))
    order = ranked.select("query_id", "passage", "rank").join(places, ["query_id", "passage"], "left")
    key = F.struct(F.when(F.col("at").isNull(), 1).otherwise(0).alias("tail"), F.coalesce("at", "rank").alias("k"))
    lists = order.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(key.alias("key"), "passage"))).alias("l"))  # a bounded pool
    return lists.select("query_id", F.posexplode("l").alias("p", "s")).select("query_id", "s.passage", (F.col("p") + 1).alias("rank"))


def dependency_prefix(ranked: DataFrame, proofs: DataFrame, depends: DataFrame, keep: Keep, slots: int = 5) -> DataFrame:
    """ranked: query_id, passage, rank from 1; proofs: query_id, passage, goal, quality, accepted; depends: query_id, goal,
    needs. (query_id, passage, rank): each slot goes to the passage that proves most of goals whose needs are proven, with
    its base rank as a prior of at most WEAK_ROUTE; queries without an accepted proof keep their order."""
    good = proofs.where("accepted").groupBy("query_id", "passage", "goal").agg(F.max("quality").alias("quality"))
    good = keep(good.join(depends.select("query_id", "goal", "needs"), ["query_id", "goal"], "left").withColumn("needs", F.coalesce("needs", F.array().cast(_NAMES))))
    size = ranked.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    line = keep(ranked.join(size, "query_id").join(good.select("query_id").distinct(), "query_id", "left_semi").select("query_id", "passage", "rank", (WEAK_ROUTE * (1 - (F.col("rank") - 1) / F.greatest(F.lit(1), F.col("n")))).alias("prior")))
    state = keep(line.groupBy("query_id").agg(F.array().cast(_NAMES).alias("chosen"), F.array().cast(_NAMES).alias("proven")))
    ready = (F.size(F.array_except("needs", "proven")) == 0) & ~F.array_contains("proven", F.col("goal"))
    for _ in range(slots):
        gains = good.join(state, "query_id").where(ready).groupBy("query_id", "passage").agg(F.sum("quality").alias("gain"))
        met = line.join(state, "query_id").where(~F.array_contains("chosen", F.col("passage"))).join(gains, ["query_id", "passage"], "left")
        best = met.groupBy("query_id").agg(F.min(F.struct((-F.round(F.coalesce("gain", F.lit(0.0)) + F.col("prior"), 12)).alias("loss"), "rank", "passage")).alias("b"))
        state = keep(state.join(best, "query_id", "left").select("query_id", F.when(F.col("b").isNull(), F.col("chosen")).otherwise(F.concat("chosen", F.array("b.passage"))).alias("chosen"), "proven"))
        while True:  # as many turns as the plan is deep
            fresh = good.join(state, "query_id").where(ready & F.array_contains("chosen", F.col("passage"))).groupBy("query_id").agg(F.collect_set("goal").alias("fresh"))
            fresh = keep(fresh)
            if fresh.isEmpty():
                break
            state = keep(state.join(fresh, "query_id", "left").select("query_id", "chosen", F.array_union("proven", F.coalesce("fresh", F.array().cast(_NAMES))).alias("proven")))
    places = state.select("query_id", F.posexplode("chosen").alias("at", "passage"))
    order = ranked.select("query_id", "passage", "rank").join(places, ["query_id", "passage"], "left")
    key = F.struct(F.when(F.col("at").isNull(), 1).otherwise(0).alias("tail"), F.coalesce("at", "rank").alias("k"))
    lists = order.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(key.alias("key"), "passage"))).alias("l"))  # a bounded pool
    return lists.select("query_id", F.posexplode("l").alias("p", "s")).select("query_id", "s.passage", (F.col("p") + 1).alias("rank"))


def bundles(proofs: DataFrame, depends: DataFrame, keep: Keep, least: float = 0.5) -> DataFrame:
    """proofs: query_id, goal, passage, quality, accepted; depends: query_id, goal, needs. (query_id, goal, bundle): passages
    of the best reliable proof of each goal and of all goals it depends on; goals with an unproven ancestor have none."""
    sure = proofs.where(F.col("accepted") & (F.col("quality") >= least))
    best = keep(sure.groupBy("query_id", "goal").agg(F.min(F.struct((-F.col("quality")).alias("q"), "passage")).alias("b")).select("query_id", "goal", "b.passage"))
    edges = depends.select("query_id", "goal", F.explode("needs").alias("need")).distinct()
    reach = keep(best.select("query_id", "goal", F.col("goal").alias("need")))
    new = reach
    while True:  # as many turns as the plan is deep
        step = new.join(edges.select("query_id", F.col("goal").alias("need"), F.col("need").alias("next")), ["query_id", "need"]).select("query_id", "goal", F.col("next").alias("need")).distinct()
        new = keep(step.join(reach, ["query_id", "goal", "need"], "left_anti"))
        if new.isEmpty():
            break
        reach = keep(reach.unionByName(new))
    held = reach.join(best.select("query_id", F.col("goal").alias("need"), "passage"), ["query_id", "need"], "left")
    whole = held.groupBy("query_id", "goal").agg(F.count_if(F.col("passage").isNull()).alias("gaps"), F.array_sort(F.collect_set("passage")).alias("bundle"))
    return whole.where("gaps = 0").select("query_id", "goal", "bundle")
