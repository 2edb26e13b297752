"""Hand-computed fixtures for the rule table, the graph, paths and verification."""

import pytest
from pyspark.sql import functions as F

from causeway.operators import graph as G
from causeway.operators import retrieve as R
from causeway.operators import rules as RU
from causeway.operators import verify as C

RAW = [
    (0, "1", "2.0", "Người phạm tội", "c1", "e1", "a", "b"),
    (1, "1", "2", "người phạm tội", "c1 bis", "e1", "a", "b"),
    (2, "3.0", "10", "Pháp nhân", "c2", "e2", "b", "c"),
    (3, "4", "10", "Pháp nhân", "c3", "e3", "d", "d"),
    (4, "4", "11", "Tòa án", "c4", None, "x", None),
    (5, None, "11", "Tòa án", "c5", "e5", "b", "e"),
]


@pytest.fixture(scope="module")
def raw(spark):
    return spark.createDataFrame(RAW, "row_pos long, index string, article_id string, legal_subject string, condition string, effect string, condition_event string, effect_event string")


@pytest.fixture(scope="module")
def rules(raw):
    return RU.normalised(raw).cache()


def test_ids(rules):
    assert [(r.row_pos, r.rule_id, r.article_id) for r in rules.orderBy("row_pos").collect()] == [(0, "1", "2"), (1, "1_2", "2"), (2, "3", "10"), (3, "4", "10"), (5, "6", "11")]


def test_ids_do_not_depend_on_partitions(raw, rules):
    again = RU.normalised(raw.repartition(7))
    assert {(r.row_pos, r.rule_id) for r in again.collect()} == {(r.row_pos, r.rule_id) for r in rules.collect()}


def test_skipped(raw):
    r = RU.skipped(RU.with_defaults(raw)).first()
    assert (r.skipped_missing_norm, r.skipped_causal_self_loop) == (1, 1)


def test_missing_columns(raw):
    with pytest.raises(ValueError, match="effect_event"):
        RU.with_defaults(raw.drop("effect_event"))


def test_edges_and_nodes(rules):
    edges = {(r.src, r.dst): (r.support, ",".join(r.rule_ids_sorted)) for r in G.causal_edges(rules).collect()}
    assert edges == {("a", "b"): (2, "1,1_2"), ("b", "c"): (1, "3"), ("b", "e"): (1, "6")}
    events = {r.event_id: r for r in G.event_nodes(rules).collect()}
    assert set(events) == set("abcde") and events["a"].texts == "c1 || c1 bis" and (events["b"].condition_count, events["b"].effect_count) == (2, 2)
    assert {r.event_id for r in G.bridges(G.event_nodes(rules)).collect()} == {"b", "d"}
    assert {(r.subject_norm, r.label) for r in G.subject_nodes(rules).collect()} == {("NGUOI_PHAM_TOI", "Người phạm tội"), ("PHAP_NHAN", "Pháp nhân"), ("TOA_AN", "Tòa án")}
    assert {r.article_id for r in G.article_nodes(rules).collect()} == {"2", "10", "11"}


def test_chains_components_cycles(rules):
    edges = G.causal_edges(rules)
    assert {(r.event_a, r.event_b, r.event_c) for r in G.two_hop(edges).collect()} == {("a", "b", "c"), ("a", "b", "e")}
    assert {tuple(r.path) for r in G.long_chains(edges, 3, 4).collect()} == {("a", "b", "c"), ("a", "b", "e")}
    parts = {}
    for r in G.weak_components(G.event_nodes(rules), edges).collect():
        parts.setdefault(r.component, set()).add(r.event_id)
    assert sorted(map(sorted, parts.values())) == [["a", "b", "c", "e"], ["d"]]
    assert G.cyclic_core(edges).count() == 0
    assert G.cyclic_core(edges.unionByName(edges.limit(1).withColumns({"src": F.lit("c"), "dst": F.lit("a")}))).count() > 0


def test_long_chains_are_whole_by_default(spark):
    """A chain of seven comes back whole, one of three not at all."""
    edges = spark.createDataFrame([(f"n{k}", f"n{k + 1}") for k in range(6)] + [("x", "y"), ("y", "z")], "src string, dst string").coalesce(1)
    assert [(tuple(r.path), r.n_nodes) for r in G.long_chains(edges).collect()] == [(tuple(f"n{k}" for k in range(7)), 7)]


def test_long_chains_against_depth_first_search(spark):
    """A sparse graph with branches, cycles and a line of 30 nodes, at the defaults and beside them."""
    import random

    rnd = random.Random(12)
    pairs = {(f"n{a}", f"n{b}") for a, b in ((rnd.randrange(60), rnd.randrange(60)) for _ in range(75)) if a != b}
    pairs |= {(f"m{k}", f"m{k + 1}") for k in range(29)} | {("r", "c1"), ("c1", "c2"), ("c2", "c3"), ("c3", "c1")}
    after = {}
    for a, b in pairs:
        after.setdefault(a, []).append(b)
    reached = {b for _, b in pairs}

    def walk(path, deepest):
        on = [x for x in after.get(path[-1], []) if x not in path] if len(path) < deepest else []
        return [p for x in on for p in walk((*path, x), deepest)] or [path]

    edges = spark.createDataFrame(sorted(pairs), "src string, dst string").coalesce(1)
    for least, deepest in ((4, 20), (1, 20), (3, 4), (6, 4)):
        want = sorted(p for a in after if a not in reached for p in walk((a,), deepest) if len(p) >= least)
        assert sorted(tuple(r.path) for r in G.long_chains(edges, least, deepest).collect()) == want
        assert want or least > deepest


def test_components_against_union_find(spark):
    import random

    rnd = random.Random(5)
    pairs = [(f"n{rnd.randrange(300)}", f"n{rnd.randrange(300)}") for _ in range(220)]
    nodes = sorted({x for p in pairs for x in p} | {"alone"})
    parent = {x: x for x in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = G.weak_components(spark.createDataFrame([(x,) for x in nodes], "event_id string"), spark.createDataFrame(pairs, "src string, dst string"))
    assert {r.event_id: r.component for r in got.collect()} == {x: find(x) for x in nodes}


def _edges(spark, pairs):
    return spark.createDataFrame([(a, b, 1, [f"r{a}{b}"], ["1"], i) for i, (a, b) in enumerate(pairs)], "src string, dst string, support long, rule_ids array<string>, article_ids array<string>, succ_ord long")


@pytest.mark.parametrize(
    ("pairs", "nodes", "threshold", "status", "consistency", "score"),
    [
        ([("a", "b")], ["a", "b"], 0.35, "SUPPORTED", 0.70, 0.555),
        ([("a", "b"), ("b", "c")], ["a", "b", "c"], 0.35, "SUPPORTED", 0.70105, 0.519),
        ([("a", "b"), ("b", "c"), ("a", "c")], ["a", "b", "c"], 0.35, "UNRESOLVED", 0.37105, 0.519),
        ([("a", "b"), ("b", "c"), ("a", "x"), ("x", "y"), ("y", "c")], ["a", "b", "c"], 0.40, "SUPPORTED", 0.56355, 0.519),
        ([("a", "b")], ["a", "z"], 0.35, "CONTRADICTED", 0.10, 0.0),
    ],
)
def test_verification(spark, pairs, nodes, threshold, status, consistency, score):
    edges = _edges(spark, pairs)
    paths = C.oriented(spark.createDataFrame([(1, 0, "forward", nodes, 0.6)], "question_id long, path_id int, direction string, nodes array<string>, graph_score double"), edges)
    r = C.verified_paths(paths, C.mediators(paths, edges, threshold)).first()
    assert (r.status, round(r.consistency, 6), round(r.path_score, 6)) == (status, consistency, score)


def test_backward_paths_are_turned(spark):
    edges = _edges(spark, [("a", "b"), ("b", "c")])
    paths = spark.createDataFrame([(1, 0, "backward", ["c", "b", "a"], 0.6)], "question_id long, path_id int, direction string, nodes array<string>, graph_score double")
    assert C.oriented(paths, edges).first().chain == ["a", "b", "c"]


@pytest.mark.parametrize("direction", ["forward", "backward"])
@pytest.mark.parametrize("cap", [3, 7])
def test_bounded_paths_against_a_queue(spark, direction, cap):
    import random
    from collections import deque

    rnd = random.Random(cap)
    pairs = list(dict.fromkeys((a, b) for a, b in ((f"v{rnd.randrange(9)}", f"v{rnd.randrange(9)}") for _ in range(30)) if a != b))
    first = {}
    for a, b in pairs:
        for x in (a, b):
            first.setdefault(x, len(first))
    events = spark.createDataFrame([(x, o, False, False) for x, o in first.items()], "event_id string, node_ord long, is_condition boolean, is_effect boolean")
    seeds = spark.createDataFrame([(1, 1, "v0", 0.5)], "question_id long, seed_rank int, event_id string, score double")
    got = [tuple(r.nodes) for r in R.bounded_paths(seeds, _edges(spark, pairs), events, direction, 3, cap).orderBy("bfs_rank").collect()]
    near = {}
    for a, b in pairs:
        near.setdefault(*((a, []) if direction == "forward" else (b, []))).append(b if direction == "forward" else a)
    if direction == "backward":
        for xs in near.values():
            xs.sort(key=first.get)
    want, queue = [], deque([("v0",)])
    while queue and len(want) < cap:
        p = queue.popleft()
        for x in near.get(p[-1], []):
            if x not in p and len(p) <= 3 and len(want) < cap:
                want.append(p + (x,))
                queue.append(p + (x,))
    assert got == want


@pytest.mark.parametrize("direction", ["forward", "backward"])
def test_a_hub_is_cut_without_losing_a_path(spark, direction):
    pairs = [("s", f"h{i}") for i in range(3)] + [(f"h{i}", f"x{j}") for i in range(3) for j in range(40)] + [(f"h{i}", x) for i in range(3) for x in ("s", "h0", "h1", "h2") if x != f"h{i}"]
    pairs = pairs if direction == "forward" else [(b, a) for a, b in pairs]
    names = list(dict.fromkeys(x for p in pairs for x in p))
    events = spark.createDataFrame([(x, o, False, False) for o, x in enumerate(names)], "event_id string, node_ord long, is_condition boolean, is_effect boolean")
    seeds = spark.createDataFrame([(1, 1, "s", 0.5)], "question_id long, seed_rank int, event_id string, score double")
    edges = _edges(spark, pairs)
    every, cut = R.neighbours(edges, events, direction, 3, 1000), R.neighbours(edges, events, direction, 3, 5)
    assert every.count() == len(pairs)
    assert cut.groupBy("_near").count().agg({"count": "max"}).first()[0] == 8
    paths = lambda step: [tuple(r.nodes) for r in R.bounded_paths(seeds, edges, events, direction, 3, 5, step).orderBy("bfs_rank").collect()]
    assert paths(cut) == paths(every)


def test_arguments():
    with pytest.raises(ValueError):
        C.check_arguments(keep=0.2, reject=0.5)
    with pytest.raises(ValueError):
        R.check_arguments(max_hops=0)
