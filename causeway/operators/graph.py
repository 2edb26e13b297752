"""The typed property graph, the collapsed causal graph, and what is computed on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causeway.plans.stage import stage


def in_order(value: Column, order: Column) -> Column:
    """Aggregate: the distinct non-empty values by the order they were first seen in."""
    rows = F.array_sort(F.collect_list(F.when(value != "", F.struct(order.alias("o"), value.alias("v")))))
    return F.array_distinct(F.transform(rows, lambda x: x["v"]))


def first_seen(rows: DataFrame, key: str, values: dict[str, Column], order: str) -> DataFrame:
    """(key, an array for each of ``values``): distinct non-empty values by the order they were first seen in.

    Each value is reduced to its first row before any array is made, so a hot key gathers what is distinct and no more.
    """
    fields = F.array(*(F.struct(F.lit(n).alias("f"), v.alias("v")) for n, v in values.items()))
    seen = rows.select(key, F.col(order).alias("_o"), F.explode(fields).alias("_x")).where("_x.v <> ''").groupBy(key, "_x.f", "_x.v").agg(F.min("_o").alias("_o"))
    lists = (F.transform(F.array_sort(F.collect_list(F.when(F.col("f") == n, F.struct("_o", "v")))), lambda x: x["v"]).alias(n) for n in values)
    return seen.groupBy(key).agg(*lists)


def as_set(value: Column) -> Column:
    """Aggregate: the distinct non-empty values, sorted as strings."""
    return F.array_sort(F.collect_set(F.when(value != "", value)))


def occurrences(rules: DataFrame) -> DataFrame:
    """Two rows for each rule, its condition's and its effect's event."""
    side = lambda role, k: F.struct(
        F.lit(role).alias("role"), F.lit(k).alias("role_ord"), F.col(f"{role.lower()}_event").alias("event_id"), F.col(f"{role.lower()}_event_name").alias("name"), F.col(role.lower()).alias("text"),
        F.col(f"{role.lower()}_event_original").alias("original"), F.col(f"{role.lower()}_event_modality").alias("modality"),
    )
    out = rules.select("row_pos", "rule_id", "article_id", F.explode(F.array(side("CONDITION", 0), side("EFFECT", 1))).alias("s"))
    return out.select("row_pos", "rule_id", "article_id", "s.*", (F.col("row_pos") * 2 + F.col("s.role_ord")).alias("ord"))


def article_nodes(rules: DataFrame) -> DataFrame:
    out = rules.groupBy("article_id").agg(F.min(F.when(F.col("content") != "", F.struct("row_pos", "content")))["content"].alias("content"))
    out = out.join(first_seen(rules, "article_id", {"titles": F.col("article_title")}, "row_pos"), "article_id", "left")
    label = F.when(F.col("article_id") != "", F.concat(F.lit("Điều "), "article_id")).otherwise(F.lit("Không xác định điều luật"))
    return out.select(F.concat(F.lit("ARTICLE::"), "article_id").alias("node_id"), "article_id", F.coalesce(F.array_join("titles", " || "), F.lit("")).alias("article_title"), F.coalesce("content", F.lit("")).alias("content"), label.alias("label"))


def rule_nodes(rules: DataFrame) -> DataFrame:
    keep = ["rule_id", "article_id", "legal_subject", "condition", "effect", "condition_event", "effect_event", "article_title", "causal_type", "rule_text", "quality_status", "source_scope"]
    return rules.select(F.concat(F.lit("RULE::"), "rule_id").alias("node_id"), *keep, F.concat(F.lit("Rule "), "rule_id").alias("label"))


def event_nodes(rules: DataFrame) -> DataFrame:
    o = occurrences(rules)
    on = lambda role: F.when(F.col("role") == role, F.col("text")).otherwise("")
    lists = first_seen(o, "event_id", {"names": F.col("name"), "texts": F.col("text"), "condition_texts": on("CONDITION"), "effect_texts": on("EFFECT")}, "ord")
    out = o.groupBy("event_id").agg(
        F.min("ord").alias("node_ord"),
        F.count_if(F.col("role") == "CONDITION").alias("condition_count"), F.count_if(F.col("role") == "EFFECT").alias("effect_count"),
        as_set(F.col("rule_id")).alias("rule_ids"), as_set(F.col("article_id")).alias("article_ids"), as_set(F.col("original")).alias("originals"), as_set(F.col("modality")).alias("modalities"),
    )
    out = out.join(lists, "event_id", "left")
    joined = {c: F.coalesce(F.array_join(c, " || "), F.lit("")) for c in ("names", "texts", "condition_texts", "effect_texts")} | {c: F.array_join(c, ",") for c in ("rule_ids", "article_ids", "originals", "modalities")}
    out = out.withColumns(joined | {"is_condition": F.col("condition_count") > 0, "is_effect": F.col("effect_count") > 0})
    return out.withColumn("node_id", F.concat(F.lit("EVENT::"), "event_id"))


def event_facts(rules: DataFrame) -> DataFrame:
    """What path search needs of events: event_id, node_ord, is_condition, is_effect; counts only, no lists."""
    side = lambda role, k: F.struct(F.col(role).alias("event_id"), (F.col("row_pos") * 2 + k).alias("ord"), F.lit(k).alias("k"))
    o = rules.select(F.explode(F.array(side("condition_event", 0), side("effect_event", 1))).alias("s")).select("s.*")
    return o.groupBy("event_id").agg(F.min("ord").alias("node_ord"), (F.count_if(F.col("k") == 0) > 0).alias("is_condition"), (F.count_if(F.col("k") == 1) > 0).alias("is_effect"))


def subject_nodes(rules: DataFrame) -> DataFrame:
    named = rules.where("subject_norm <> ''")
    out = named.groupBy("subject_norm").agg(F.min_by("legal_subject", "row_pos").alias("label"), F.count(F.lit(1)).alias("n_rules"), F.count_distinct("article_id").alias("n_articles"))
    texts = first_seen(named, "subject_norm", {"_t": F.col("legal_subject")}, "row_pos")
    out = out.join(texts, "subject_norm", "left").withColumn("texts", F.coalesce(F.array_join("_t", " || "), F.lit("")))
    return out.select("subject_norm", "label", "texts", "n_rules", "n_articles", F.concat(F.lit("SUBJECT::"), "subject_norm").alias("node_id"))


def all_edges(rules: DataFrame) -> DataFrame:
    """Five relations for each rule; no HAS_SUBJECT without a subject, no CAUSES for a loop."""
    rule = F.concat(F.lit("RULE::"), "rule_id")
    cause, effect = F.concat(F.lit("EVENT::"), "condition_event"), F.concat(F.lit("EVENT::"), "effect_event")
    one = lambda relation, a, b: F.struct(F.lit(relation).alias("relation"), a.alias("src"), b.alias("dst"))
    made = F.array(
        one("HAS_RULE", F.concat(F.lit("ARTICLE::"), "article_id"), rule), F.when(F.col("subject_norm") != "", one("HAS_SUBJECT", rule, F.concat(F.lit("SUBJECT::"), "subject_norm"))),
        one("HAS_CONDITION", rule, cause), one("HAS_EFFECT", rule, effect), F.when(F.col("condition_event") != F.col("effect_event"), one("CAUSES", cause, effect)),
    )
    out = rules.select("rule_id", "article_id", "row_pos", F.explode(F.array_compact(made)).alias("e"))
    return out.select("e.*", F.concat_ws("::", "e.relation", "rule_id").alias("edge_key"), "rule_id", "article_id", "row_pos")


def causal_edges(rules: DataFrame) -> DataFrame:
    """Parallel CAUSES edges as one, with support, ids sorted and in order, and the order of the edge."""
    return rules.where("condition_event <> effect_event").groupBy(F.col("condition_event").alias("src"), F.col("effect_event").alias("dst")).agg(
        F.count(F.lit(1)).alias("support"), as_set(F.col("rule_id")).alias("rule_ids_sorted"), as_set(F.col("article_id")).alias("article_ids_sorted"),
        in_order(F.col("rule_id"), F.col("row_pos")).alias("rule_ids"), in_order(F.col("article_id"), F.col("row_pos")).alias("article_ids"), F.min("row_pos").alias("succ_ord"))


def bridges(events: DataFrame) -> DataFrame:
    return events.where("is_condition AND is_effect").select("event_id", "condition_count", "effect_count", (F.col("condition_count") + F.col("effect_count")).alias("total"))


def two_hop(edges: DataFrame) -> DataFrame:
    """A to B to C, all distinct. Edges are keyed by their ends, so no chain comes twice."""
    ab = edges.select(F.col("src").alias("event_a"), F.col("dst").alias("event_b"), F.col("support").alias("support_ab"))
    bc = edges.select(F.col("src").alias("_b"), F.col("dst").alias("event_c"), F.col("support").alias("support_bc"))
    return ab.join(bc, F.col("event_b") == F.col("_b")).where("event_a <> event_c").drop("_b")


def event_names(rules: DataFrame) -> DataFrame:
    """(event_id, event_name): the first name of each event, or else its id."""
    o = occurrences(rules)
    return o.groupBy("event_id").agg(F.coalesce(F.min(F.when(F.col("name") != "", F.struct("ord", "name")))["name"], F.col("event_id")).alias("event_name"))


def two_hop_named(chains: DataFrame, names: DataFrame) -> DataFrame:
    """Chains with each event's node id and name; an event that is no node goes by its id."""
    for side in "abc":
        own = names.select(F.col("event_id").alias(f"event_{side}"), F.col("event_name").alias(f"event_{side}_name"))
        chains = chains.join(own, f"event_{side}", "left").withColumns({f"event_{side}_name": F.coalesce(f"event_{side}_name", f"event_{side}"), f"event_{side}_id": F.concat(F.lit("EVENT::"), f"event_{side}")})
    return chains


def relation_edges(edges: DataFrame, relation: str) -> DataFrame:
    """Edges of a loaded graph by relation, in any case of letters."""
    return edges.where(F.upper(F.trim(F.coalesce("relation", F.lit("")))) == relation.upper())


def typed_nodes(nodes: DataFrame, node_type: str) -> DataFrame:
    """Nodes of a loaded graph by type, in any case of letters, or by the prefix of their id."""
    return nodes.where((F.upper(F.trim(F.coalesce("node_type", F.lit("")))) == node_type.upper()) | F.col("node_id").startswith(f"{node_type.upper()}::"))


def degrees(edges: DataFrame) -> DataFrame:
    both = edges.select(F.explode(F.array(F.struct(F.col("src").alias("event_id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("event_id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x"))
    return both.groupBy("x.event_id").agg(F.sum("x.o").alias("out_degree"), F.sum("x.i").alias("in_degree"))


def roots(edges: DataFrame) -> DataFrame:
    return degrees(edges).where("in_degree = 0 AND out_degree > 0")


def leaves(edges: DataFrame) -> DataFrame:
    return degrees(edges).where("out_degree = 0 AND in_degree > 0")


def long_chains(edges: DataFrame, min_nodes: int = 4, max_depth: int = 20) -> DataFrame:
    """Simple paths from roots that cannot go on, or have ``max_depth`` nodes; those of ``min_nodes`` or more.

    One outer join for each further node. A path whose successors are all on it, or that has none, finds no
    match and comes out of this join and all later ones as it is, so ended and growing paths need only one plan.
    """
    step = edges.select(F.col("src").alias("_s"), F.col("dst").alias("_d"))
    paths = roots(edges).select(F.array("event_id").alias("path"))
    for depth in range(2, max_depth + 1):
        unseen = (F.element_at("path", -1) == F.col("_s")) & ~F.array_contains("path", F.col("_d"))
        paths = paths.join(step, unseen, "left").select(F.when(F.col("_d").isNull(), F.col("path")).otherwise(F.array_append("path", F.col("_d"))).alias("path"))
        if depth == min_nodes:
            paths = paths.where(F.size("path") >= min_nodes)
    return paths.where(F.size("path") >= min_nodes).select("path", F.size("path").alias("n_nodes"))


def sorted_chains(chains: DataFrame) -> DataFrame:
    """Long ones first, then by their nodes."""
    return chains.orderBy(F.desc("n_nodes"), "path")


def weak_components(events: DataFrame, edges: DataFrame) -> DataFrame:
    """(event_id, component): components are named by their smallest event; events without edges are their own.

    In each round every node goes to its smallest neighbour, or stays if it is smaller, and these ways are followed to their ends. Only
    edges between different ends are left for the next round, each once, so rounds get shorter fast.
    """
    left = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).where("a <> b")
    out = events.select("event_id", F.col("event_id").alias("component"))
    while True:
        both = left.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x")).select("x.*")
        ends = stage(both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("b")), "wcc-hooked")
        if not ends.limit(1).count():
            return out
        while True:
            over = ends.select(F.col("a").alias("b"), F.col("b").alias("c"))
            jumped = stage(ends.join(over, "b").select("a", F.col("c").alias("b"), (F.col("b") != F.col("c")).alias("moved")), "wcc-jumped")
            ends = jumped.drop("moved")
            if not jumped.where("moved").limit(1).count():
                break
        to = lambda c: ends.select(F.col("a").alias(c), F.col("b").alias(f"_{c}"))
        left = left.join(to("a"), "a").join(to("b"), "b").where("_a <> _b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct()
        left = stage(left, "wcc-left")
        out = stage(out.join(ends.select(F.col("a").alias("component"), F.col("b").alias("_to")), "component", "left").select("event_id", F.coalesce("_to", "component").alias("component")), "wcc")


def cyclic_core(edges: DataFrame) -> DataFrame:
    """What is left when nodes without predecessors are taken off again and again: empty if and only if the graph has no cycle."""
    left = stage(edges.select("src", "dst"), "core-0")
    n = left.count()
    while n:
        peeled = left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
        left = stage(peeled, "core")
        if (m := left.count()) == n:
            break
        n = m
    return left


def graph_statistics(rules: DataFrame) -> DataFrame:
    """(kind, name, n): nodes by type and edges by relation."""
    nodes = article_nodes(rules).select(F.lit("ARTICLE").alias("name")).unionAll(rules.select(F.lit("RULE"))).unionAll(occurrences(rules).select("event_id").distinct().select(F.lit("EVENT"))).unionAll(subject_nodes(rules).select(F.lit("SUBJECT")))
    kinds = nodes.groupBy("name").agg(F.count(F.lit(1)).alias("n")).select(F.lit("node").alias("kind"), "name", "n")
    return kinds.unionByName(all_edges(rules).groupBy(F.col("relation").alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("edge").alias("kind"), "name", "n"))


def event_roles(events: DataFrame) -> DataFrame:
    c, e = F.col("is_condition"), F.col("is_effect")
    return events.agg(F.count_if(c & ~e).alias("condition_only"), F.count_if(~c & e).alias("effect_only"), F.count_if(c & e).alias("both"), F.count_if(~c & ~e).alias("neither"))
