"""Which passages stand in the evidence prefix: goal coverage, proof bundles, prefixes, beams over plans, and swaps.

A query's pool is bounded (80 passages, a plan of at most eight nodes), so each query is one group. Functions over plain
lists state a rule; the operators run them for all queries.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from hopweave.functions.numeric import beam_score
from hopweave.functions.text import branch_matches

# Fixed values of the scores.
BASE_WEIGHT, GOAL_WEIGHT, GAIN_WEIGHT, TWIN_WEIGHT = 0.4, 0.25, 0.45, 0.15
MEANINGFUL_GAIN = 0.15
WEAK_ROUTE = 0.032
TWIN = 0.85


def goal_coverage(routes: DataFrame, proofs: DataFrame, bindings: DataFrame) -> DataFrame:
    """routes: query_id, passage, goal, score, requirements (map); proofs: query_id, passage, goal, score; bindings: query_id,
    bound (map). The best score of each goal in each passage, by routes whose requirements agree with the bindings, and by
    proofs."""
    fitting = routes.join(bindings, "query_id").where(branch_matches(F.col("requirements"), F.col("bound"))).select("query_id", "passage", "goal", "score")
    return fitting.unionByName(proofs.select("query_id", "passage", "goal", "score")).groupBy("query_id", "passage", "goal").agg(F.max("score").alias("score"))


def overlap(a: set, b: set) -> float:
    return len(a & b) / max(1, len(a | b))


def utility(passages: list[dict], goals: set) -> float:
    """Sum of marginal utilities in order: base, best goal score, share of goals newly covered, less likeness to what is
    already there. A passage: base, goals (goal -> score), tokens."""
    total, covered, seen = 0.0, set(), []
    for p in passages:
        fresh = set(p["goals"]) - covered
        total += BASE_WEIGHT * p["base"] + GOAL_WEIGHT * max(p["goals"].values(), default=0.0) + GAIN_WEIGHT * len(fresh) / max(1, len(goals)) - TWIN_WEIGHT * max((overlap(p["tokens"], t) for t in seen), default=0.0)
        covered |= set(p["goals"])
        seen.append(p["tokens"])
    return total


def bundles(proofs: list[dict], depends: dict[str, list[str]], least: float = 0.5) -> dict[str, tuple[str, ...]]:
    """proofs: goal, passage, quality, accepted. Passages of the best reliable proof of each goal and of all goals it depends
    on; goals with an unproven ancestor have no bundle."""
    best: dict[str, dict] = {}
    for p in sorted(proofs, key=lambda p: (-p["quality"], p["passage"])):
        if p["accepted"] and p["quality"] >= least:
            best.setdefault(p["goal"], p)
    out = {}
    for goal in best:
        need, todo = [], [goal]
        while todo:
            g = todo.pop()
            if g not in need:
                need.append(g)
                todo += depends.get(g, [])
        if all(g in best for g in need):
            out[goal] = tuple(dict.fromkeys(best[g]["passage"] for g in need))
    return out


def joint_prefix(pool: dict[str, dict], proven: dict[str, tuple[str, ...]], slots: int = 5) -> list[str]:
    """Starts from every set of bundles that fits the slots, fills by marginal utility, then swaps single passages while
    that raises the whole; the best of all, first names among equals."""
    goals = {g for p in pool.values() for g in p["goals"]}
    value = lambda names: utility([pool[n] for n in names], goals)
    sets: list[tuple[str, ...]] = [()]
    for bundle in sorted(set(proven.values())):
        if all(p in pool for p in bundle):
            sets += [s for old in list(sets) if len(s := tuple(dict.fromkeys((*old, *bundle)))) <= slots]
    best: tuple | None = None
    for begin in sorted(set(sets)):
        chosen = sorted(begin, key=lambda n: (-pool[n]["base"], n))
        while len(chosen) < min(slots, len(pool)):
            chosen.append(min((n for n in pool if n not in chosen), key=lambda n: (-round(value([*chosen, n]), 12), n)))
        while True:
            now = value(chosen)
            options = [(value([*chosen[:i], n, *chosen[i + 1 :]]), i, n) for i, old in enumerate(chosen) if old not in begin for n in pool if n not in chosen]
            gain = min(options, key=lambda o: (-round(o[0], 12), o[1], o[2]), default=None)
            if gain is None or gain[0] <= now + 1e-9:
                break
            chosen[gain[1]] = gain[2]
        mark = (-len([g for g, b in proven.items() if set(b) <= set(chosen)]), -round(value(chosen), 12), tuple(chosen))
        if best is None or mark < best[0]:
            best = (mark, chosen)
    return best[1] if best else []


def continuous_prefix(ranked: list[str], pool: dict[str, dict], proven: dict[str, tuple[str, ...]], slots: int = 5) -> list[str]:
    """The base order, in which a passage from further down takes the place of the weakest unprotected one of the prefix
    where that raises the prefix by MEANINGFUL_GAIN of its utility; the tail keeps its order."""
    goals = {g for p in pool.values() for g in p["goals"]}
    value = lambda names: utility([pool[n] for n in names], goals)
    prefix, protected = ranked[:slots], {p for b in proven.values() if set(b) <= set(ranked[:slots]) for p in b}
    wanted = [p for b in proven.values() for p in b if p in pool]
    for n in [*dict.fromkeys(wanted), *(n for n in ranked[slots:] if n not in wanted)]:
        if n in prefix:
            continue
        now = value(prefix)
        options = [(value([*prefix[:i], *prefix[i + 1 :], n]), i) for i, old in enumerate(prefix) if old not in protected]
        if options:
            new, i = max(options, key=lambda o: (round(o[0], 12), o[1]))
            if new > now + MEANINGFUL_GAIN * abs(now):
                prefix = [*prefix[:i], *prefix[i + 1 :], n]
                if n in wanted:
                    protected.add(n)
    return [*prefix, *(n for n in ranked if n not in prefix)]


def dependency_prefix(ranked: list[str], proofs: list[dict], depends: dict[str, list[str]], slots: int = 5) -> list[str]:
    """Passages by what they prove of the plan: a proof counts once all goals its goal depends on are proven by passages
    taken before; a passage's base rank is a prior of at most WEAK_ROUTE. Without any proof the base order stays."""
    good = [p for p in proofs if p["accepted"]]
    if not good:
        return list(ranked)
    prior = {n: WEAK_ROUTE * (1 - i / max(1, len(ranked))) for i, n in enumerate(ranked)}
    chosen, proven = [], set()
    while len(chosen) < min(slots, len(ranked)):
        def worth(n: str) -> float:
            goals: dict[str, float] = {}
            for p in good:
                if p["passage"] == n and p["goal"] not in proven and set(depends.get(p["goal"], [])) <= proven:
                    goals[p["goal"]] = max(goals.get(p["goal"], 0.0), p["quality"])
            return sum(goals.values()) + prior[n]
        best = min((n for n in ranked if n not in chosen), key=lambda n: (-round(worth(n), 12), ranked.index(n)))
        chosen.append(best)
        while more := {p["goal"] for p in good if p["passage"] in chosen and set(depends.get(p["goal"], [])) <= proven} - proven:
            proven |= more
    return [*chosen, *(n for n in ranked if n not in chosen)]


def ancestor_support(prefix: list[str], tail: list[str], proven: dict[str, tuple[str, ...]], tokens: dict[str, set], most: int = 2) -> list[str]:
    """Up to ``most`` passages that a partly present bundle still lacks come from the tail to its front; if two of the prefix
    are twins, the first missing one takes the later twin's place instead."""
    lacking = [p for b in proven.values() if set(b) & set(prefix) for p in b if p not in prefix and p in tail]
    lacking = list(dict.fromkeys(lacking))[:most]
    held = {p for b in proven.values() for p in b}
    prefix, tail = list(prefix), list(tail)
    twin = next((j for j in range(len(prefix) - 1, 0, -1) if prefix[j] not in held and any(overlap(tokens[prefix[i]], tokens[prefix[j]]) >= TWIN for i in range(j))), None)
    if lacking and twin is not None:
        tail = [prefix[twin], *tail]
        prefix[twin] = lacking.pop(0)
    tail = [p for p in tail if p not in prefix]
    return [*prefix, *lacking, *(p for p in tail if p not in lacking)]


def terminal_evidence(order: list[str], chain: list[str], complete: bool, slots: int = 5, mode: str = "prefix") -> list[str]:
    """The last passage of a complete winning chain, if the prefix lacks it: into the prefix's last place that the chain does
    not use, or to the front of the tail."""
    if not complete or not chain or chain[-1] in order[:slots] or chain[-1] not in order:
        return list(order)
    rest = [p for p in order if p != chain[-1]]
    if mode == "tail":
        return [*rest[:slots], chain[-1], *rest[slots:]]
    free = next((i for i in range(min(slots, len(rest)) - 1, -1, -1) if rest[i] not in chain), None)
    if free is None:
        return list(order)
    return [*rest[:free], chain[-1], *rest[free + 1 : slots], rest[free], *rest[slots:]]


def condition_package(order: list[str], packages: list[tuple[str, ...]], most: int = 2) -> list[str]:
    """Packages that lie whole in ranks 1 to 10 and partly in 6 to 10 come into ranks 3 to 5, in place of passages of no
    package, at most ``most`` of them."""
    order, used = list(order), {p for pack in packages for p in pack}
    moved = 0
    for pack in packages:
        late = [p for p in order[5:10] if p in pack]
        if not late or not set(pack) <= set(order[:10]) or moved + len(late) > most:
            continue
        free = [i for i in range(4, 1, -1) if i < len(order) and order[i] not in used]
        if len(free) < len(late):
            continue
        for p, i in zip(late, free):
            j = order.index(p)
            order[i], order[j] = order[j], order[i]
            moved += 1
    return order


def one_swap(order: list[str], found: str | None, protected: set[str], slots: int = 5) -> list[str]:
    """A companion passage for the last unprotected place of the prefix; the passage that leaves heads the tail."""
    if found is None or found not in order or found in order[:slots]:
        return list(order)
    free = next((i for i in range(min(slots, len(order)) - 1, -1, -1) if order[i] not in protected), None)
    if free is None:
        return list(order)
    rest = [p for p in order if p != found]
    return [*rest[:free], found, *rest[free + 1 : slots], rest[free], *rest[slots:]]


_ORDER = "query_id long, passage string, rank int"


def reorder(ranked: DataFrame, rule: Callable[[list[str], pd.DataFrame], list[str]]) -> DataFrame:
    """ranked: query_id, passage, rank, and what the rule reads, one row a passage. The rule's order of each query, ranks
    from 1; a query has a bounded pool."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["rank", "passage"])
        out = rule(group["passage"].tolist(), group)
        if sorted(out) != sorted(group["passage"]):
            raise ValueError("a rule may only change the order")
        return pd.DataFrame({"query_id": int(group["query_id"].iloc[0]), "passage": out, "rank": range(1, len(out) + 1)})

    return ranked.groupBy("query_id").applyInPandas(run, _ORDER)


def anchor_companion(ranked: DataFrame, mentions: DataFrame, top: int = 10, slots: int = 5) -> DataFrame:
    """ranked: query_id, passage, rank, title; mentions: query_id, term. The first passage of ranks 6 to 10 whose title is
    named in the query comes into the prefix, in place of the last passage without such a title."""
    terms = mentions.select("query_id", F.lower(F.trim("term")).alias("title_key")).distinct().withColumn("named", F.lit(True))
    marked = ranked.where(F.col("rank") <= top).withColumn("title_key", F.lower(F.trim("title"))).join(terms, ["query_id", "title_key"], "left").withColumn("named", F.coalesce("named", F.lit(False)))

    def rule(order: list[str], group: pd.DataFrame) -> list[str]:
        named = set(group.loc[group["named"], "passage"])
        return one_swap(order, next((p for p in order[slots:] if p in named), None), named, slots)

    return reorder(marked.select("query_id", "passage", "rank", "named"), rule)


def condition_companion(ranked: DataFrame, tokens: DataFrame, conditions: DataFrame, top: int = 10, slots: int = 5, least: float = 0.5) -> DataFrame:
    """ranked: query_id, passage, rank; tokens: passage, tokens; conditions: query_id, terms. Condition terms weigh by their
    rarity among the query's first passages. If the prefix covers less than all of them, the passage of the tail that adds
    the most weight (``least`` of what lacks) comes into the prefix."""
    held = ranked.where(F.col("rank") <= top).join(tokens, "passage").join(conditions, "query_id")
    hits = held.select("query_id", "passage", "rank", F.array_intersect("terms", "tokens").alias("hits"))
    n = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    df = hits.select("query_id", F.explode("hits").alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("df"))
    weights = df.join(n, "query_id").withColumn("w", F.ln((F.col("n") + 1) / (F.col("df") + 1)) + 1).groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "w"))).alias("weights"))  # few terms a query
    rows = hits.join(weights, "query_id", "left")

    def rule(order: list[str], group: pd.DataFrame) -> list[str]:
        own = {p: set(h) for p, h in zip(group["passage"], group["hits"])}
        w = group["weights"].iloc[0]
        w = dict(w) if isinstance(w, (dict, list)) else {}
        covered = set().union(*(own[p] for p in order[:slots])) if order else set()
        lacking = set(w) - covered
        adds = {p: sum(w[t] for t in own[p] & lacking) for p in order[slots:]}
        best = min(adds, key=lambda p: (-round(adds[p], 12), order.index(p)), default=None)
        if best is None or not lacking or adds[best] < least * sum(w[t] for t in lacking):
            return order
        single = {p for p in order[:slots] if own[p] - set().union(*(own[o] for o in order[:slots] if o != p))}
        return one_swap(order, best, single, slots)

    return reorder(rows, rule)


def expand_beams(beams: DataFrame, level: DataFrame, hypotheses: DataFrame, total: int, width: int = 3) -> DataFrame:
    """One level of a search over plans. beams: query_id, bound (map goal -> answer), qualities, proofs; level: query_id,
    goal; hypotheses: query_id, goal, given (map of what it assumes), answer, passage, quality.

    Every goal of the level is bound in turn by each hypothesis that agrees with the beam; a beam that none fits goes on
    unbound. After each goal the best ``width`` beams of a query stay, so a level is as many joins as it has goals."""
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "key")
    for goal in [r.goal for r in level.select("goal").distinct().orderBy("goal").collect()]:  # a plan has few goals
        own = hypotheses.where(F.col("goal") == goal).withColumn("hit", F.lit(True)).drop("goal")
        asked = beams.join(level.where(F.col("goal") == goal).select("query_id", F.lit(True).alias("asked")), "query_id", "left")
        met = asked.join(own, "query_id", "left").withColumn("fits", F.coalesce(F.col("asked") & F.col("hit") & F.forall(F.map_entries("given"), lambda e: F.try_element_at("bound", e["key"]).eqNullSafe(e["value"])), F.lit(False)))
        bound = met.where("fits").select(
            "query_id", F.map_concat("bound", F.create_map(F.lit(goal), "answer")).alias("bound"), F.concat("qualities", F.array("quality")).alias("qualities"), F.concat("proofs", F.array("passage")).alias("proofs")
        )
        unmet = met.groupBy("query_id", F.to_json(F.map_from_entries(F.array_sort(F.map_entries("bound")))).alias("k"), "proofs").agg(F.any_value("bound").alias("bound"), F.any_value("qualities").alias("qualities"), F.bool_or("fits").alias("any"))
        beams = bound.unionByName(unmet.where("NOT any").select("query_id", "bound", "qualities", "proofs"))
        scored = beams.withColumns({"score": F.round(beam_score(F.col("qualities"), F.lit(total)), 6), "key": F.concat(F.to_json(F.map_from_entries(F.array_sort(F.map_entries("bound")))), F.array_join("proofs", "\x1f"))})
        beams = scored.withColumn("_rank", F.row_number().over(rank)).where(F.col("_rank") <= width).select("query_id", "bound", "qualities", "proofs")
    return beams


def search_plans(queries: DataFrame, plan: DataFrame, hypotheses: DataFrame, keep, width: int = 3, total: int | None = None) -> DataFrame:
    """plan: query_id, goal, depth. Levels in order, each written before the next; (query_id, bound, qualities, proofs, score)."""
    empty = F.create_map().cast("map<string,string>")
    beams = queries.select("query_id", empty.alias("bound"), F.array().cast("array<double>").alias("qualities"), F.array().cast("array<string>").alias("proofs"))
    bounds = plan.agg(F.max("depth").alias("d"), F.count_distinct("goal").alias("n")).first()
    goals = total or bounds.n or 1
    for depth in range((bounds.d if bounds.d is not None else -1) + 1):
        beams = keep(expand_beams(beams, plan.where(F.col("depth") == depth), hypotheses, goals, width))
    return beams.withColumn("score", F.round(beam_score(F.col("qualities"), F.lit(goals)), 6))


def review_swaps(proposals: DataFrame, ranked: DataFrame, texts: DataFrame, supported: DataFrame, reviews: DataFrame, least: float = 0.7, slots: int = 5, pool: int = 10) -> DataFrame:
    """proposals: query_id, removed, added, quote, confidence. The first reason against each swap, null if it is accepted:
    its ranks, its literal quote, its confidence, the support guard (supported: query_id, passage) and the reviewer's verdict
    (reviews: query_id, removed, added, accepts)."""
    at = lambda name: ranked.select("query_id", F.col("passage").alias(name), F.col("rank").alias(f"{name}_rank"))
    joined = proposals.join(at("removed"), ["query_id", "removed"], "left").join(at("added"), ["query_id", "added"], "left")
    joined = joined.join(texts.select(F.col("passage").alias("added"), F.col("text").alias("_text")), "added", "left")
    joined = joined.join(supported.select("query_id", F.col("passage").alias("removed"), F.lit(True).alias("_held")).distinct(), ["query_id", "removed"], "left")
    joined = joined.join(reviews.select("query_id", "removed", "added", "accepts"), ["query_id", "removed", "added"], "left")
    reason = (
        F.when(F.col("removed_rank").isNull() | (F.col("removed_rank") > slots), "removed_outside_prefix")
        .when(F.col("added_rank").isNull() | (F.col("added_rank") <= slots) | (F.col("added_rank") > pool), "added_outside_tail")
        .when((F.length(F.trim("quote")) < 8) | F.col("_text").isNull() | ~F.contains("_text", F.trim("quote")), "quote_not_literal")
        .when(F.col("confidence") < least, "low_confidence").when(F.coalesce("_held", F.lit(False)), "removes_support")
        .when(F.col("accepts").isNull(), "not_reviewed").when(~F.col("accepts"), "reviewer_refused")
    )
    return joined.select("query_id", "removed", "added", reason.alias("reason"))


def apply_swaps(ranked: DataFrame, accepted: DataFrame) -> DataFrame:
    """ranked: query_id, passage, rank; accepted: query_id, removed, added, one a query. Both passages change places."""
    first = accepted.groupBy("query_id").agg(F.min(F.struct("removed", "added")).alias("s")).select("query_id", "s.removed", "s.added")
    at = ranked.join(first, "query_id").groupBy("query_id", "removed", "added").agg(F.max(F.when(F.col("passage") == F.col("removed"), F.col("rank"))).alias("r"), F.max(F.when(F.col("passage") == F.col("added"), F.col("rank"))).alias("a"))
    both = ranked.join(at.where("r IS NOT NULL AND a IS NOT NULL"), "query_id", "left")
    return both.select("query_id", "passage", F.when(F.col("passage") == F.col("removed"), F.col("a")).when(F.col("passage") == F.col("added"), F.col("r")).otherwise(F.col("rank")).alias("rank"))
