"""Counterfactual verification: remove a path's mediators, look for other ways, and judge paths, evidence and questions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from causeway.functions.text import clamp

# The verifier's defaults, weights and scores.
MAX_HOPS, MAX_PATHS, MAX_MEDIATORS, KEEP, REJECT, TOP_K = 3, 30, 5, 0.52, 0.34, 10
EDGE_DECAY, ALTERNATIVE, DIRECT, CONTRADICTED, UNRESOLVED = 0.84, 0.35, 0.70, 0.10, 0.35
NECESSITY = {"NECESSARY": 0.85, "PARTIALLY_NECESSARY": 0.60, "NON_NECESSARY": 0.25}
EVIDENCE = {"path": 0.38, "cf": 0.32, "semantic": 0.16, "graph": 0.14}


def check_arguments(keep: float = KEEP, reject: float = REJECT, max_hops: int = MAX_HOPS) -> None:
    if not 0 <= reject <= keep <= 1:
        raise ValueError(f"0 <= reject <= keep <= 1 does not hold for {reject} and {keep}")
    if max_hops < 1:
        raise ValueError("max_hops must be 1 or more")


def struct_score(supports):
    """The mean of each edge's support, cut at 1 edge by edge, and less by EDGE_DECAY for each hop beyond the first."""
    hops = F.size(supports)
    total = F.aggregate(supports, F.lit(0.0), lambda s, x: s + F.least(F.lit(1.0), F.log1p(x) / F.log(F.lit(4.0))))
    return F.when(hops > 0, clamp(total / hops * F.pow(F.lit(EDGE_DECAY), hops - 1))).otherwise(F.lit(0.0))


def path_nodes(paths: DataFrame, events: DataFrame, key: list[str]) -> DataFrame:
    """``paths`` with nodes: the events that a path means, known ones alone, each once.

    The first of event_nodes ("EVENT::" and id) and event_ids that has two known events at least; else events (of event_node or
    event_id), if there is such a list, and else what event_nodes has. events: event_id.
    """
    bare = lambda x: F.regexp_replace(x, "^EVENT::", "")
    lists = [F.transform("event_nodes", bare), F.col("event_ids"), F.transform("events", lambda e: F.coalesce(F.nullif(bare(e["event_node"]), F.lit("")), e["event_id"]))]
    named = paths.select(*key, F.posexplode(F.array(*lists)).alias("_k", "_l")).select(*key, "_k", F.posexplode("_l").alias("_pos", "event_id"))
    known = named.join(events.select("event_id").distinct(), "event_id").groupBy(*key, "_k").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "event_id"))), lambda x: x["event_id"])).alias("_n"), F.count(F.lit(1)).alias("_c"))
    per = known.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("_k", F.struct("_n", "_c")))).alias("_m"))
    out = paths.join(per, key, "left")
    of, none = (lambda k: F.col("_m")[F.lit(k)]), F.array().cast("array<string>")
    pick = F.when(of(0)["_c"] >= 2, of(0)["_n"]).when(of(1)["_c"] >= 2, of(1)["_n"]).when(F.col("events").isNotNull(), of(2)["_n"]).otherwise(of(0)["_n"])
    return out.withColumn("nodes", F.coalesce(pick, none)).drop("_m")


def _pairs(column: str):
    return F.expr(f"transform(filter(sequence(1, size({column})), i -> i < size({column})), i -> struct({column}[i - 1] AS src, {column}[i] AS dst))")


def inferred_ids(paths: DataFrame, edges: DataFrame, key: list[str], nodes: str = "nodes") -> DataFrame:
    """``paths`` whose rule_ids or article_ids are empty get those of the edges along their nodes, in order, each once."""
    steps = paths.where(F.least(F.size(F.coalesce("rule_ids", F.array())), F.size(F.coalesce("article_ids", F.array()))) == 0).select(*key, F.posexplode(_pairs(nodes)).alias("_pos", "_e")).select(*key, "_pos", "_e.*")
    along = steps.join(edges.select("src", "dst", F.col("rule_ids").alias("_r"), F.col("article_ids").alias("_a")), ["src", "dst"])
    flat = lambda c: F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_pos", c))), lambda x: x[c])))
    out = paths.join(along.groupBy(*key).agg(flat("_r").alias("_r"), flat("_a").alias("_a")), key, "left")
    fill = lambda c, f: F.when(F.size(F.coalesce(c, F.array())) > 0, F.col(c)).otherwise(F.coalesce(f, F.array().cast("array<string>")))
    return out.withColumns({"rule_ids": fill("rule_ids", "_r"), "article_ids": fill("article_ids", "_a")}).drop("_r", "_a")


def oriented(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes in causal order (chain) and the supports of their edges.

    The order is that of the path's direction if all its pairs are edges, else the other way round if they are so; where neither
    holds, the first stays without supports.
    """
    turned = paths.withColumn("chain", F.when(F.col("direction") == "backward", F.reverse("nodes")).otherwise(F.col("nodes")))
    ways = turned.select("question_id", "path_id", F.posexplode(F.array("chain", F.reverse("chain"))).alias("_v", "_way"))
    pairs = ways.select("question_id", "path_id", "_v", F.posexplode(_pairs("_way")).alias("pos", "p"))
    found = pairs.select("question_id", "path_id", "_v", "pos", "p.*").join(edges.select("src", "dst", "support"), ["src", "dst"], "left")
    found = found.groupBy("question_id", "path_id", "_v").agg(F.bool_and(F.col("support").isNotNull()).alias("_sound"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "support"))), lambda x: x["support"]).alias("_supports"))
    best = found.where("_sound").groupBy("question_id", "path_id").agg(F.min(F.struct("_v", "_supports")).alias("_b"))
    out = turned.join(best, ["question_id", "path_id"], "left")
    return out.withColumns({"chain": F.when(F.col("_b._v") == 1, F.reverse("chain")).otherwise(F.col("chain")), "chain_supports": F.coalesce("_b._supports", F.array().cast("array<bigint>"))}).drop("_b")


def alternatives(asked: DataFrame, edges: DataFrame, max_hops: int = MAX_HOPS, max_paths: int = MAX_PATHS) -> DataFrame:
    """Simple paths from ``start`` to ``goal`` that avoid ``mediator``; of each question triple the first ``max_paths`` in depth-first order."""
    step = edges.select(F.col("src").alias("_s"), F.col("dst").alias("_d"), "succ_ord", "support")
    live = asked.select("start", "mediator", "goal", F.array("start").alias("nodes"), F.array().cast("array<bigint>").alias("ordvec"), F.array().cast("array<bigint>").alias("supports"))
    found = []
    for hop in range(1, max_hops + 1):
        on = (F.element_at("nodes", -1) == F.col("_s")) & (F.col("_d") != F.col("mediator")) & ~F.array_contains("nodes", F.col("_d"))
        # The last hop can only be the one to the goal: an equality that the join can use.
        grown = live.join(step, on & (F.col("_d") == F.col("goal")) if hop == max_hops else on)
        grown = grown.select("start", "mediator", "goal", F.array_append("nodes", F.col("_d")).alias("nodes"), F.array_append("ordvec", F.col("succ_ord")).alias("ordvec"), F.array_append("supports", F.col("support")).alias("supports"))
        found.append(grown.where(F.element_at("nodes", -1) == F.col("goal")))
        live = grown.where(F.element_at("nodes", -1) != F.col("goal"))
    out = reduce(DataFrame.unionByName, found)
    place = Window.partitionBy("start", "mediator", "goal").orderBy("ordvec")
    return out.withColumn("dfs_rank", F.row_number().over(place)).where(F.col("dfs_rank") <= max_paths).withColumn("score", F.round(struct_score(F.col("supports")), 9))


def mediators(paths: DataFrame, edges: DataFrame, threshold: float = ALTERNATIVE) -> DataFrame:
    """(question_id, path_id, mediator_index, mediator, best_score, status, necessity) for the first five inner nodes of each path."""
    inner = paths.where(F.size("chain") > 2).select("question_id", "path_id", F.element_at("chain", 1).alias("start"), F.element_at("chain", -1).alias("goal"), F.posexplode(F.slice("chain", 2, F.least(F.lit(MAX_MEDIATORS), F.size("chain") - 2))).alias("_i", "mediator"))
    best = alternatives(inner.select("start", "mediator", "goal").distinct(), edges).groupBy("start", "mediator", "goal").agg(F.max("score").alias("best_score"))
    out = inner.join(best, ["start", "mediator", "goal"], "left")
    status = F.when(F.col("best_score").isNull(), "NECESSARY").when(F.col("best_score") >= threshold, "NON_NECESSARY").otherwise("PARTIALLY_NECESSARY")
    necessity = reduce(lambda c, kv: c.when(F.col("status") == kv[0], kv[1]), NECESSITY.items(), F)
    return out.withColumn("status", status).select("question_id", "path_id", (F.col("_i") + 1).alias("mediator_index"), "mediator", F.coalesce("best_score", F.lit(0.0)).alias("best_score"), "status", necessity.alias("necessity"))


def verified_paths(paths: DataFrame, mediated: DataFrame) -> DataFrame:
    """paths: oriented. Adds struct_score, path_score, status and consistency."""
    per = mediated.groupBy("question_id", "path_id").agg(F.avg("necessity").alias("_need"), F.count(F.lit(1)).alias("_n"), F.count_if(F.col("status") == "NON_NECESSARY").alias("_non"))
    out = paths.withColumn("struct_score", F.round(struct_score(F.col("chain_supports")), 9)).join(per, ["question_id", "path_id"], "left")
    own = F.when(F.col("struct_score") <= 0, 0.0).when(F.col("graph_score") <= 0, F.col("struct_score")).otherwise(clamp(0.55 * F.col("graph_score") + 0.45 * F.col("struct_score")))
    out = out.withColumn("path_score", F.round(own, 9))
    status = F.when(F.col("struct_score") <= 0, "CONTRADICTED").when(F.size("chain") == 2, "SUPPORTED").when(F.col("_n").isNull() | (F.col("_non") > F.col("_n") / 2), "UNRESOLVED").otherwise("SUPPORTED")
    value = F.when(F.col("struct_score") <= 0, CONTRADICTED).when(F.size("chain") == 2, clamp(F.greatest(F.lit(DIRECT), F.col("path_score")))).when(F.col("_n").isNull(), UNRESOLVED).otherwise(clamp(0.55 * F.col("_need") + 0.45 * F.col("path_score")))
    return out.withColumns({"status": status, "consistency": F.round(value, 9)}).drop("_need", "_n", "_non")


def verified_evidence(evidence: DataFrame, paths: DataFrame, keep: float = KEEP, reject: float = REJECT) -> DataFrame:
    """Evidence with its related paths (by rule, else by path id) and a decision."""
    check_arguments(keep, reject)
    facts = F.struct("path_id", "status", "path_score", "consistency").alias("_p")
    by_rule = paths.select("question_id", F.explode("rule_ids").alias("rule_id"), facts).distinct()
    first = evidence.select("question_id", "rule_id", "path_ids").join(by_rule, ["question_id", "rule_id"], "left")
    lost = first.where("_p IS NULL").select("question_id", "rule_id", F.explode("path_ids").alias("path_id"))
    by_id = lost.join(paths.select("question_id", "path_id", facts), ["question_id", "path_id"]).select("question_id", "rule_id", "_p")
    related = first.where("_p IS NOT NULL").select("question_id", "rule_id", "_p").unionByName(by_id)
    ids = lambda s: F.array_sort(F.collect_list(F.when(F.col("_p.status") == s, F.col("_p.path_id"))))
    per = related.groupBy("question_id", "rule_id").agg(F.count(F.lit(1)).alias("_n"), ids("SUPPORTED").alias("verified_path_ids"), ids("CONTRADICTED").alias("rejected_path_ids"), ids("UNRESOLVED").alias("unresolved_path_ids"), F.avg("_p.path_score").alias("_path"), F.avg("_p.consistency").alias("_cf"))
    none = F.array().cast("array<int>")
    out = evidence.join(per, ["question_id", "rule_id"], "left").withColumns({c: F.coalesce(c, none) for c in ("verified_path_ids", "rejected_path_ids", "unresolved_path_ids")})
    out = out.withColumns({"path_support": F.round(F.coalesce("_path", "graph_score"), 9), "cf_support": F.round(F.coalesce("_cf", F.lit(UNRESOLVED)), 9)})
    score = EVIDENCE["path"] * F.col("path_support") + EVIDENCE["cf"] * F.col("cf_support") + EVIDENCE["semantic"] * F.col("semantic_score") + EVIDENCE["graph"] * F.col("graph_score")
    out = out.withColumn("verification_score", F.round(clamp(score), 9))
    supported = F.size("verified_path_ids") > 0
    verdict = F.when((F.col("_n") > 0) & (F.size("rejected_path_ids") / F.col("_n") >= 0.5), "REMOVE").when(supported & (F.col("verification_score") >= keep), "KEEP").when((F.col("verification_score") < reject) & ~supported, "REMOVE").otherwise("UNCERTAIN")
    return out.withColumn("decision", verdict).drop("_n", "_path", "_cf")


def decided(evidence: DataFrame, top_k: int = TOP_K) -> DataFrame:
    """Within each decision by score, REMOVE from the lowest; only KEEP is cut to ``top_k``."""
    sign = F.when(F.col("decision") == "REMOVE", 1).otherwise(-1)
    place = F.row_number().over(Window.partitionBy("question_id", "decision").orderBy(sign * F.col("verification_score"), "rank"))
    return evidence.withColumn("decision_rank", place).where((F.col("decision") != "KEEP") | (F.col("decision_rank") <= top_k))


def judged(questions: DataFrame, paths: DataFrame, evidence: DataFrame) -> DataFrame:
    """A row for each question: status counts, consistency, confidence and the decision on the claim."""
    count = lambda s: F.count_if(F.col("status") == s)
    p = paths.groupBy("question_id").agg(count("SUPPORTED").alias("n_supported"), count("CONTRADICTED").alias("n_contradicted"), count("UNRESOLVED").alias("n_unresolved"), F.avg("consistency").alias("consistency"))
    e = evidence.groupBy("question_id").agg(F.count_if(F.col("decision") == "KEEP").alias("n_keep"), F.count_if(F.col("decision") == "REMOVE").alias("n_remove"))
    out = questions.select("question_id").join(p, "question_id", "left").join(e, "question_id", "left").na.fill(0)
    s, c, u = F.col("n_supported"), F.col("n_contradicted"), F.col("n_unresolved")
    resolved = F.coalesce(F.try_divide((s + c).cast("double"), (s + c + u).cast("double")), F.lit(0.0))
    verdict = F.when((c > 0) & (s == 0) & (c >= u), "REJECT_DIRECT_CLAIM").when((s > 0) | (F.col("n_keep") > 0), "SUPPORTED").when((c > 0) & (F.col("n_remove") > 0), "REJECT_DIRECT_CLAIM").otherwise("UNCERTAIN")
    return out.withColumns({"confidence": F.round(clamp(0.65 * resolved + 0.35 * F.col("consistency")), 9), "consistency": F.round("consistency", 9), "decision": verdict})
