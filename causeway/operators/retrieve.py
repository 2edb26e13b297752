"""From questions to ranked evidence: seeds, bounded paths, path scores, candidate rules, reranking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causeway.functions.text import clamp

# The retriever's defaults and weights.
TOP_K, FLOORS = 8, {"EVENT": 0.20, "RULE": 0.15}
MAX_HOPS, MAX_PATHS, MAX_CANDIDATES, FINAL_TOP_K = 2, 30, 200, 12
SEED_WEIGHT, SUPPORT_WEIGHT, BRIDGE_STEP, BRIDGE_MOST, HOP_DECAY, HOP_PENALTY = 0.62, 0.28, 0.05, 0.15, 0.82, 0.03
RERANK = {"semantic": 0.58, "graph": 0.24, "seed": 0.12, "direct": 0.06}


def check_arguments(max_hops: int = MAX_HOPS, max_paths: int = MAX_PATHS, top_k: int = TOP_K, final_top_k: int = FINAL_TOP_K) -> None:
    for name, value in {"max_hops": max_hops, "max_paths": max_paths, "top_k": top_k, "final_top_k": final_top_k}.items():
        if value < 1:
            raise ValueError(f"{name} must be 1 or more, is {value}")


def _rounded(x: Column) -> Column:
    """Scores are compared to nine digits, so the order of a sum does not decide a tie."""
    return F.round(x, 9)


def neighbours(edges: DataFrame, events: DataFrame, direction: str, max_hops: int = MAX_HOPS, max_paths: int = MAX_PATHS) -> DataFrame:
    """The steps a path search can take: of each node its first ``max_paths + max_hops`` neighbours in the search's order.

    No more are needed: at most ``max_paths`` children of a path are kept, and fewer than ``max_hops`` neighbours can lie on it
    already. A hub is thereby cut once, not for each question that reaches it.
    """
    near, far = ("src", "dst") if direction == "forward" else ("dst", "src")
    facts = events.select("event_id", "node_ord", (F.col("is_condition") & F.col("is_effect")).cast("int").alias("bridge"))
    step = edges.join(facts.withColumnRenamed("event_id", far), far)
    step = step.select(F.col(near).alias("_near"), F.col(far).alias("_far"), F.col("succ_ord" if direction == "forward" else "node_ord").alias("_ord"), "bridge", "support", F.col("rule_ids").alias("_rules"))
    place = F.rank().over(Window.partitionBy("_near").orderBy("_ord"))
    return step.withColumn("_n", place).where(F.col("_n") <= max_paths + max_hops).drop("_n")


def bounded_paths(seeds: DataFrame, edges: DataFrame, events: DataFrame, direction: str, max_hops: int = MAX_HOPS, max_paths: int = MAX_PATHS, step: DataFrame | None = None) -> DataFrame:
    """Simple paths from each seed in breadth-first order, at most ``max_paths`` of a seed.

    seeds: question_id, seed_rank, event_id, score. edges: causal_edges. events: event_nodes. step: the
    ``neighbours`` of this direction, if they are at hand. The order
    within a hop is that of the ordinals along the path: a successor's first edge, a predecessor's first
    sight. Every hop is cut to ``max_paths`` before it grows, which is exact since children keep their
    parents' order and a longer path comes after every shorter one.
    """
    step = neighbours(edges, events, direction, max_hops, max_paths) if step is None else step
    live = seeds.select("question_id", "seed_rank", "event_id", F.col("score").alias("seed_score"), F.array("event_id").alias("nodes"), F.array().cast("array<bigint>").alias("ordvec"),
                        F.array().cast("array<bigint>").alias("supports"), F.array().cast("array<int>").alias("bridges"), F.array().cast("array<array<string>>").alias("step_rules"))
    found = []
    for hop in range(1, max_hops + 1):
        live = live.join(step, (F.element_at("nodes", -1) == F.col("_near")) & ~F.array_contains("nodes", F.col("_far")))
        live = live.select("question_id", "seed_rank", "event_id", "seed_score", F.array_append("nodes", F.col("_far")).alias("nodes"), F.array_append("ordvec", F.col("_ord")).alias("ordvec"),
                           F.array_append("supports", F.col("support")).alias("supports"), F.array_append("bridges", F.col("bridge")).alias("bridges"), F.array_append("step_rules", F.col("_rules")).alias("step_rules"))
        place = Window.partitionBy("question_id", "seed_rank").orderBy("ordvec")
        live = live.withColumn("_n", F.row_number().over(place)).where(F.col("_n") <= max_paths).drop("_n")
        found.append(live.withColumn("hop", F.lit(hop)))
    out = reduce(DataFrame.unionByName, found)
    place = Window.partitionBy("question_id", "seed_rank").orderBy("hop", "ordvec")
    return out.withColumn("bfs_rank", F.row_number().over(place)).where(F.col("bfs_rank") <= max_paths).withColumn("direction", F.lit(direction))


def path_score(seed: Column, supports: Column, bridges: Column, hop: Column) -> Column:
    """The mean support is cut at 1 as a mean; bridges count inside the path only."""
    total = F.aggregate(supports, F.lit(0.0), lambda s, x: s + F.log1p(F.greatest(F.lit(1), x)))
    support = F.least(F.lit(1.0), total / hop / F.log(F.lit(4.0)))
    inside = F.aggregate(F.slice(bridges, 1, hop - 1), F.lit(0), lambda s, x: s + x)
    bridge = F.least(F.lit(BRIDGE_MOST), F.lit(BRIDGE_STEP) * inside)
    return clamp((SEED_WEIGHT * seed + SUPPORT_WEIGHT * support + bridge) * F.pow(F.lit(HOP_DECAY), hop - 1) - HOP_PENALTY * (hop - 1))


def ranked_paths(seeds: DataFrame, edges: DataFrame, events: DataFrame, max_hops: int = MAX_HOPS, max_paths: int = MAX_PATHS, steps: dict[str, DataFrame] | None = None) -> DataFrame:
    """Both directions of each seed, the best ``max_paths`` of these, and path_id: their order within the question from 0.

    steps: ``neighbours`` by direction, if they are at hand.
    """
    check_arguments(max_hops=max_hops, max_paths=max_paths)
    both = reduce(DataFrame.unionByName, (bounded_paths(seeds, edges, events, d, max_hops, max_paths, (steps or {}).get(d)) for d in ("forward", "backward")))
    both = both.withColumn("graph_score", _rounded(path_score(F.col("seed_score"), F.col("supports"), F.col("bridges"), F.col("hop")))).withColumn("_back", (F.col("direction") == "backward").cast("int"))
    order = [F.desc("graph_score"), "_back", "hop", "ordvec"]
    kept = both.withColumn("_n", F.row_number().over(Window.partitionBy("question_id", "seed_rank").orderBy(*order))).where(F.col("_n") <= max_paths)
    path_id = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("graph_score"), "seed_rank", "_back", "hop", "ordvec")) - 1
    return kept.withColumn("path_id", path_id).withColumn("rule_ids", F.array_distinct(F.flatten("step_rules"))).drop("_n", "_back")


def candidate_rules(seeds: DataFrame, direct: DataFrame, paths: DataFrame, edges: DataFrame, max_candidates: int = MAX_CANDIDATES) -> DataFrame:
    """Rules on paths, rules that touch a seed and direct hits, with their best graph and seed scores; the best ``max_candidates``."""
    zero = F.lit(0).cast("bigint")
    key = lambda *k: F.struct(*(x.cast("bigint").alias(f"k{i}") for i, x in enumerate([*k, *[zero] * (5 - len(k))])))
    on_path = paths.select("question_id", "path_id", "graph_score", "seed_score", F.col("event_id").alias("seed"), F.posexplode("rule_ids").alias("pos", "rule_id"))
    on_path = on_path.select("question_id", "rule_id", "graph_score", "seed_score", "path_id", F.struct(F.lit(1).alias("a"), F.col("path_id").cast("bigint").alias("b"), "seed").alias("name"), key(zero, F.col("path_id"), F.col("pos")).alias("ord"))
    sides = edges.select(F.explode(F.array(*(F.struct(F.col(c).alias("event_id"), F.lit(i).alias("side")) for i, c in enumerate(("src", "dst"))))).alias("t"), "succ_ord", "rule_ids").select("t.*", "succ_ord", "rule_ids")
    touch = seeds.join(sides, "event_id").select("question_id", "seed_rank", "event_id", "score", "side", "succ_ord", F.posexplode("rule_ids").alias("pos", "rule_id"))
    none = F.lit(None)
    touch = touch.select("question_id", "rule_id", none.cast("double").alias("graph_score"), F.col("score").alias("seed_score"), none.cast("int").alias("path_id"),
                         F.struct(F.lit(0).alias("a"), F.col("seed_rank").cast("bigint").alias("b"), F.col("event_id").alias("seed")).alias("name"), key(F.lit(1), F.col("seed_rank"), F.col("side"), F.col("succ_ord"), F.col("pos")).alias("ord"))
    hits = direct.select("question_id", "rule_id", none.cast("double").alias("graph_score"), none.cast("double").alias("seed_score"), none.cast("int").alias("path_id"),
                         none.cast("struct<a: int, b: bigint, seed: string>").alias("name"), key(F.lit(2), F.col("rank")).alias("ord"))
    every = on_path.unionByName(touch).unionByName(hits)
    out = every.groupBy("question_id", "rule_id").agg(
        F.coalesce(F.max("graph_score"), F.lit(0.0)).alias("graph_score"), F.coalesce(F.max("seed_score"), F.lit(0.0)).alias("seed_score"), F.array_sort(F.collect_set("path_id")).alias("path_ids"),
        F.array_distinct(F.transform(F.array_sort(F.collect_list("name")), lambda x: x["seed"])).alias("seed_names"), F.min("ord").alias("cand_ord"))
    place = Window.partitionBy("question_id").orderBy(F.desc(_rounded(F.col("graph_score") + F.col("seed_score"))), "cand_ord")
    return out.withColumn("cand_rank", F.row_number().over(place)).where(F.col("cand_rank") <= max_candidates)


def reranked(queries: DataFrame, candidates: DataFrame, direct: DataFrame, rule_memory: DataFrame, top_k: int = FINAL_TOP_K) -> DataFrame:
    """Evidence: candidates that have a vector, by semantic, graph, seed and direct score; the best ``top_k`` of a question, ranked."""
    semantic = F.round(F.aggregate(F.zip_with("qv", "vector", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x), 9)
    rows = candidates.join(rule_memory.select("rule_id", "vector"), "rule_id").join(queries.select("question_id", F.col("vector").alias("qv")), "question_id")
    rows = rows.join(direct.select("question_id", "rule_id", F.col("score").alias("direct_score")), ["question_id", "rule_id"], "left").withColumns({"semantic_score": semantic, "direct_score": F.coalesce("direct_score", F.lit(0.0))})
    final = RERANK["semantic"] * F.col("semantic_score") + RERANK["graph"] * F.col("graph_score") + RERANK["seed"] * F.col("seed_score") + RERANK["direct"] * F.col("direct_score")
    rows = rows.withColumn("final_score", _rounded(final))
    rank = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("final_score"), "cand_rank"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= top_k).drop("qv", "vector")
