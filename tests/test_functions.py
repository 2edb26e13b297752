"""Text functions against Python restatements, metrics of both generations, replies, answers."""

import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from causeway.functions import text as T
from causeway.operators import answer as A
from causeway.operators import catalog as CA
from causeway.operators import metrics as M

PROBES = ["Người phạm tội", "  bị cáo\t", "Đường ĐI", "Straße", "ｆｕｌｌ ｗｉｄｔｈ", "한국어", "éâ", "İstanbul", "", None, "a_b--c", "“quoted” `x`", "điều 7.1", "x" * 50]


def _accents(x):
    x = x.replace("Đ", "D").replace("đ", "d")
    return "".join(c for c in unicodedata.normalize("NFD", x) if unicodedata.category(c) != "Mn")


def test_text(spark):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(PROBES)], "i int, x string").select("i", "x", T.identifier(F.col("x")).alias("id"), T.match_key(F.col("x")).alias("mk"), T.text_v7(F.col("x")).alias("t7"), T.slug(F.col("x")).alias("slug")).collect()
    for r in rows:
        x = (r.x or "").strip()
        if all(ord(c) < 0xAC00 for c in x):
            assert r.id == re.sub(r"[^A-Z0-9]+", "_", _accents(x).upper()).strip("_"), x
            if "İ" not in x:
                assert r.mk == re.sub(r"\s+", " ", re.sub(r"[^a-z0-9\s]", " ", _accents(x.lower()))).strip(), x
        assert r.slug


@pytest.mark.parametrize(("x", "want"), [("2.0", "2"), ("10", "10"), ("1.5", "1.5"), (None, "")])
def test_num_id(spark, x, want):
    assert spark.createDataFrame([(x,)], "x string").select(T.num_id(F.col("x"))).first()[0] == want


def test_safe_casts(spark):
    got = spark.createDataFrame([("1.9",), ("-1.9",), ("inf",), ("NaN",), ("x",), (None,)], "x string").select(T.safe_int(F.col("x"), 7).alias("i"), T.safe_float(F.col("x"), 0.5).alias("f")).collect()
    assert [r.i for r in got] == [1, -1, 7, 7, 7, 7] and [r.f for r in got] == [1.9, -1.9, 0.5, 0.5, 0.5, 0.5]


def test_lists_and_decisions(spark):
    got = spark.createDataFrame([('["a", "b "]',), ("a, ,b",), (None,)], "x string").select(T.ensure_list(F.col("x"))).collect()
    assert [r[0] for r in got] == [["a", "b"], ["a", "b"], []]
    got = spark.createDataFrame([("No direct edge",), ("keep",), ("other thing",)], "x string").select(T.decision(F.col("x"))).collect()
    assert [r[0] for r in got] == ["REJECT_DIRECT_CLAIM", "SUPPORTED", "OTHER_THING"]


def _one(spark, p, g, column):
    return spark.createDataFrame([(p, g)], "p array<string>, g array<string>").select(column(F.col("p"), F.col("g"))).first()[0]


def test_empty_sets(spark):
    for k in ("precision", "recall", "f1"):
        assert _one(spark, [], [], lambda p, g: M.set_metrics_v6(p, g)[k]) == 0 and _one(spark, None, [], lambda p, g: M.set_metrics_v7(p, g)[k]) == 1
    assert _one(spark, [], [], lambda p, g: M.hit_at_k(p, g, 3)) == 0 and _one(spark, [], [], lambda p, g: M.hit_at_k(p, g, 3, 1.0)) == 1
    assert _one(spark, [], [], lambda p, g: M.recall_at_k(p, g, 3)) == 1


def test_ranking(spark):
    p, g = ["x", "a", "b", "a"], ["a", "b"]
    assert _one(spark, p, g, M.reciprocal_rank) == 0.5
    assert _one(spark, p, g, M.average_precision) == pytest.approx((1 / 2 + 2 / 3) / 2)
    assert _one(spark, ["x", "x", "a"], ["a"], lambda p, g: M.average_precision(p, g, repeats_take_ranks=True)) == pytest.approx(1 / 3)
    assert _one(spark, ["x", "x", "a"], ["a"], M.average_precision) == pytest.approx(1 / 2)
    assert _one(spark, ["a", "b"], ["a", "b", "c"], lambda p, g: M.hop_accuracy(p, g)) == pytest.approx(2 / 3)


def test_token_f1_of_both_generations(spark):
    rows = spark.createDataFrame([(1, "trách nhiệm", "trach nhiem"), (2, "", ""), (3, "a a b", "a c"), (4, "x", "")], "k int, a string, b string")
    for tokens, want in ((T.tokens_v6, [0, 1, 0.4, 0]), (T.tokens_v7, [1, 1, 0.4, 0])):
        got = M.with_token_f1(rows, ["k"], tokens(F.col("a")), tokens(F.col("b")), "f1").orderBy("k").collect()
        assert [r.f1 for r in got] == pytest.approx(want)


def test_lcs():
    import random

    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
            row = new
        return row[-1]

    rnd = random.Random(1)
    for _ in range(200):
        a, b = ([rnd.choice("abcd") for _ in range(rnd.randrange(20))] for _ in range(2))
        assert M.lcs(a, b) == plain(a, b)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('{"rules": [{"a": 1}, 2]}', [{"a": 1}]), ('noise {"data": [{"x": "}"}]} more', [{"x": "}"}]), ('[{"a": "\\"]"}, 1]', [{"a": '"]'}]), ('[{"a": 1}] tail', None),
        ('{"condition": "c", "effect": "e"}', [{"condition": "c", "effect": "e"}]), ('{"k": 1}', None), ("nothing", None), ("", None),
    ],
)
def test_payload(text, want):
    assert CA.payload(text) == want


def test_repair(spark):
    rows = spark.createDataFrame([(1, "See [E1] and [E9].", 2), (2, "Nothing cited", 2), (3, "x", 0)], "question_id long, answer string, n_evidence int")
    got = {r.question_id: r for r in A.repaired(rows).collect()}
    assert "[E9]" not in got[1].repaired and got[1].citations_used == ["E1"] and got[1].n_invalid == 1
    assert "Căn cứ evidence: [E1], [E2]." in got[2].repaired and got[2].citations_used == ["E1", "E2"]
    assert got[3].citations_used == [] and A.NO_ADVICE in got[3].repaired


def test_answers_without_evidence(spark):
    none = spark.createDataFrame([], "question_id long, evidence_index int, article_id string, article_title string, condition string, effect string")
    got = A.extractive_answers(spark.createDataFrame([(1, 0.5)], "question_id long, confidence double"), none).first().answer
    assert A.TOO_LITTLE in got and A.NOTHING_FOUND in got


def test_lexical_ranking(spark):
    catalog = spark.createDataFrame([(0, "e0", "phạt tiền", "", ["tiền phạt"], "SANCTION"), (1, "e1", "cải tạo", "", [], "ACTION")], "cat_pos long, event_id string, event_name string, description string, aliases array<string>, event_type string")
    phrases = spark.createDataFrame([(1, "Tiền  phạt", "effect", []), (2, "Tiền phạt", "condition", [])], "phrase_id long, phrase string, role string, excluded array<string>")
    got = {r.phrase_id: r.event_id for r in CA.alias_matches(phrases, catalog).collect()}
    assert got == {1: "e0", 2: None}
    best = CA.ranked_candidates(phrases, catalog).where("rank = 1").collect()
    assert {r.phrase_id: r.event_id for r in best} == {1: "e0", 2: "e1"}


@pytest.mark.parametrize(
    ("value", "edges", "events"),
    [
        ({"edges": [{"source": "a", "target": "b"}, {"from": "b", "to": 3.0}]}, [("a", "b"), ("b", "3")], ["a", "b", "3"]), ("a -> b→c", [("a", "b"), ("b", "c")], ["a", "b", "c"]),
        (["x", {"event_id": "y"}], [("x", "y")], ["x", "y"]), ({"id": 7}, [], ["7"]), (None, [], []), ([], [], []), ("alone", [], ["alone"]),
    ],
)
def test_paths_of_many_shapes(value, edges, events):
    from causeway.functions import shapes

    assert shapes.path_of(value) == (edges, events)


def test_deep_fields_and_ids(spark):
    from causeway.functions import shapes

    rows = spark.createDataFrame([('{"out": {"answer": "x", "rules": [{"rule_id": 2.0}, {"id": "b"}, "c"]}}',), ("broken",), (None,)], "j string")
    got = rows.select(shapes.field(F.col("j"), ["final", "answer"]).alias("f"), shapes.ids(F.col("j"), ["rule_id", "id"]).alias("i"), shapes.path(F.col("j")).alias("p")).collect()
    assert [r.f for r in got] == ['"x"', None, None] and got[1].i == [] and got[0].p.events == []
    assert shapes.ids_of([{"rule_id": 2.0}, {"id": "b"}, "c", {"k": [{"id": "d"}]}], ["rule_id", "id"]) == ["2", "b", "c", "d"]


def test_memory_problems(spark):
    from causeway.operators.memory import problems

    nodes = spark.createDataFrame([("a",), ("b",)], "node_id string")
    memory = spark.createDataFrame([(0, "RULE", "a"), (2, "RULE", "c")], "memory_id long, memory_type string, graph_node_id string")
    got = {r.problem: r.n for r in problems(memory, nodes, spark.createDataFrame([(0,), (5,)], "memory_id long")).collect()}
    assert got == {"ids are not 0 to n - 1": 1, "no EVENT": 1, "memory without a node": 1, "memory without a vector": 1, "vector without memory": 1}
