"""Readers, writers and resumable batches."""

import json
import re
import xml.etree.ElementTree as ET

import pytest

from causeway.functions.text import utc_now
from causeway.operators.rules import normalised
from causeway.sources import clients, readers, writers
from causeway.streaming.resume import run_available


def test_rules_of_all_suffixes(spark, tmp_path):
    row = {"article_id": "2.0", "legal_subject": "s", "condition": "c", "effect": "e", "condition_event": "a", "effect_event": "b", "index": 1}
    (tmp_path / "r.json").write_text(json.dumps([row, row | {"index": 2}]))
    (tmp_path / "w.json").write_text(json.dumps({"rules": [row]}))
    (tmp_path / "r.jsonl").write_text(json.dumps(row))
    (tmp_path / "r.csv").write_text(",".join(row) + "\n" + ",".join(map(str, row.values())))
    assert [r["index"] for r in readers.rules(spark, str(tmp_path / "r.json")).orderBy("row_pos").collect()] == ["1", "2"]
    for name in ("w.json", "r.jsonl", "r.csv"):
        got = readers.rules(spark, str(tmp_path / name)).collect()
        assert len(got) == 1 and got[0].effect_event == "b" and got[0].causal_type == ""
    with pytest.raises(ValueError, match="xlsx"):
        readers.rules(spark, "r.xlsx")


def test_benchmark_and_predictions(spark, tmp_path):
    (tmp_path / "b.json").write_text(json.dumps({"questions": [{"question": "q1", "gold_rule_ids": ["1"]}, {"id": "x", "query": "q2"}, {"id": "none"}]}))
    got = readers.benchmark(spark, str(tmp_path / "b.json")).orderBy("row_pos").collect()
    assert [(r.id, r.question, r.gold_rule_ids) for r in got] == [("question_0001", "q1", ["1"]), ("x", "q2", [])]
    (tmp_path / "p.jsonl").write_text('{"id": "x", "decision": "a"}\n\nbroken\n{"id": "x", "decision": "b"}\n')
    assert [(r.id, r.decision) for r in readers.predictions(spark, str(tmp_path / "p.jsonl")).collect()] == [("x", "b")]


@pytest.mark.parametrize("suffix", ["csv", "jsonl"])
def test_places_over_several_partitions(spark, tmp_path, suffix):
    """Rules without an index take their place + 1, whatever partitions the file falls into."""
    row = {"article_id": 1, "legal_subject": "s", "condition": "c", "effect": "e", "condition_event": "a", "effect_event": "b"}
    n = 5000
    lines = [",".join(row)] + [",".join(map(str, (row | {"condition": f"c{k}"}).values())) for k in range(n)] if suffix == "csv" else [json.dumps(row | {"condition": f"c{k}"}) for k in range(n)]
    (tmp_path / f"r.{suffix}").write_text("\n".join(lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        found = readers.rules(spark, str(tmp_path / f"r.{suffix}"))
        assert spark.read.text(str(tmp_path / f"r.{suffix}")).rdd.getNumPartitions() > 3
        got = normalised(found).select("rule_id", "condition").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(int(r.rule_id) for r in got) == list(range(1, n + 1)) and all(r.condition == f"c{int(r.rule_id) - 1}" for r in got)


def test_a_broken_line_is_named(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"condition": "a"}\n\n[1]\n')
    with pytest.raises(Exception, match="line 3 is no JSON object"):
        readers.rules(spark, str(tmp_path / "r.jsonl")).collect()


def test_all_forms_of_predictions(spark, tmp_path):
    a, b = {"id": "x", "rule_ids": ["1", 2], "verdict": "yes"}, {"question_id": "y", "retrieval": {"rule_ids": ["3"]}, "final": {"answer": "so"}}
    forms = {"l.json": [a, b], "w.json": {"results": [a, b]}, "d.json": {"x": {k: v for k, v in a.items() if k != "id"}, "y": b}, "m.json": {"data": {"x": a, "y": b}}}
    for name, value in forms.items():
        (tmp_path / name).write_text(json.dumps(value))
    (tmp_path / "p.jsonl").write_text("\n".join([json.dumps(a | {"verdict": "no"}), "broken", "7", json.dumps(a), json.dumps(b)]))
    for name in [*forms, "p.jsonl"]:
        got = {r.id: r for r in readers.predictions(spark, str(tmp_path / name)).collect()}
        assert set(got) == {"x", "y"} and got["x"].rule_ids == ["1", "2"] and got["x"].decision == "yes" and got["y"].rule_ids == ["3"] and got["y"].final_answer == "so", name
    (tmp_path / "old.json").write_text(json.dumps({"predictions": [a | {"verdict": "old"}, {"id": "z"}]}))
    got = {r.id: r.decision for r in readers.resumed_predictions(spark, str(tmp_path / "old.json"), str(tmp_path / "p.jsonl")).collect()}
    assert got == {"x": "yes", "y": None, "z": None}


def test_gold_of_both_generations(spark, tmp_path):
    six = {"id": "q", "question": "?", "evaluation": {"gold_event_ids": ["a", "b"], "gold_path": [{"source_event_id": "a", "target_event_id": "b"}], "gold_citations": ["Điều 1"], "gold_article_ids": ["1"]}}
    (tmp_path / "b.json").write_text(json.dumps({"samples": [six, {"question": "no id", "supporting_event_chain": [{"event_id": "c"}]}]}))
    got = readers.benchmark(spark, str(tmp_path / "b.json")).orderBy("row_pos").collect()
    assert got[0].gold_event_ids == ["a", "b"] and tuple(got[0].gold_path[0]) == ("a", "b") and got[0].gold_citations == ["Điều 1"] and (got[1].id, got[1].gold_event_ids) == ("question_0002", ["c"])
    assert [r.id for r in readers.benchmark(spark, str(tmp_path / "b.json"), invent_ids=False).collect()] == ["q"]
    (tmp_path / "twice.json").write_text(json.dumps([six, six]))
    with pytest.raises(Exception, match="repeats the id q"):
        readers.benchmark(spark, str(tmp_path / "twice.json")).collect()
    seven = {"question_id": "q", "gold_rule_ids": [1], "gold_path": {"nodes": ["a", "b"], "edges": [["a", "b"]]}, "gold_final_effect_reachable": True}
    (tmp_path / "g.json").write_text(json.dumps({"samples": [seven]}))
    r = readers.gold(spark, str(tmp_path / "g.json")).first()
    assert (r.question_id, r.gold_rule_ids, r.gold_nodes, r.gold_edges, r.gold_final_effect_reachable) == ("q", ["1"], ["a", "b"], ["a>>b"], True)


def test_memory_and_vectors(spark, tmp_path):
    (tmp_path / "m.csv").write_text('memory_id,memory_type,graph_node_id,embedding_text,rule_id\n0,RULE,RULE::007,"two\nlines, ""quoted""",007\n1,EVENT,EVENT::a,NA,\n')
    got = readers.memory(spark, str(tmp_path / "m.csv")).orderBy("memory_id").collect()
    assert [(r.memory_id, r.embedding_text, r.rule_id) for r in got] == [(0, 'two\nlines, "quoted"', "007"), (1, "NA", "")]
    (tmp_path / "bad.csv").write_text("memory_id,memory_type,graph_node_id,embedding_text\nx,RULE,a,b\n")
    with pytest.raises(Exception, match="no whole number: x"):
        readers.memory(spark, str(tmp_path / "bad.csv")).collect()
    (tmp_path / "few.csv").write_text("memory_id\n1\n")
    with pytest.raises(ValueError, match="memory_type"):
        readers.memory(spark, str(tmp_path / "few.csv"))
    (tmp_path / "v.jsonl").write_text('{"embedding": [1, 0]}\n{"embedding": [0, 1]}\n')
    assert [(r.memory_id, r.vector) for r in readers.vectors(spark, str(tmp_path / "v.jsonl")).orderBy("memory_id").collect()] == [(0, [1.0, 0.0]), (1, [0.0, 1.0])]


def test_ranges(spark):
    rows = spark.createDataFrame([(k, str(x)) for k, x in enumerate(["1", "2.0", "x", "3", "4"])], "row_pos long, index string")
    assert [r.row_pos for r in readers.index_range(rows, 2, 4, 2).collect()] == [1, 3] and readers.index_range(rows).count() == 5


def test_csv_order_and_gexf(spark, tmp_path):
    df = spark.createDataFrame([(1, [1, 2], "x")], "b long, a array<int>, c string")
    assert writers.column_order(df, ["c", "zz"]) == ["c", "a", "b"]
    writers.csv(df, str(tmp_path / "out"), writers.column_order(df, ["c"]))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).first().asDict() == {"c": "x", "a": "[1,2]", "b": "1"}
    writers.csv(df.limit(0), str(tmp_path / "none"))
    assert spark.read.option("header", True).csv(str(tmp_path / "none")).columns == ["b", "a", "c"]
    nodes, edges = spark.createDataFrame([("a", "A & B", True, 2)], "node_id string, label string, flag boolean, n int"), spark.createDataFrame([("a", "a", "CAUSES")], "src string, dst string, relation string")
    root = ET.fromstring(writers.gexf_text(nodes, edges))
    assert [n.get("label") for n in root.iter("{http://www.gexf.net/1.2draft}node")] == ["A & B"] and len(list(root.iter("{http://www.gexf.net/1.2draft}edge"))) == 1
    kinds = {k.get("attr.name"): k.get("attr.type") for k in ET.fromstring(writers.graphml_text(nodes, edges)).iter("{http://graphml.graphdrawing.org/xmlns}key")}
    assert (kinds["flag"], kinds["n"], kinds["label"]) == ("boolean", "int", "string")
    assert "## Part" in writers.markdown_sections("All", {"Part": df})


class Vectors:
    def embed(self, texts):
        if "fail" in texts:
            raise OSError("down")
        return [[float(len(t))] for t in texts]


def test_embeddings_and_fallback(spark):
    rows = spark.createDataFrame([(1, "ab"), (2, None), (3, "fail")], "id long, text string").coalesce(1)
    assert {r.id: r.embedding for r in clients.embedded(rows, Vectors(), batch=2).collect()} == {1: [2.0], 2: [0.0], 3: None}
    prompts = spark.createDataFrame([(2, "", "fail", "own answer")], "id long, system_prompt string, user_prompt string, extractive string")
    assert clients.replies(prompts, Echo(), fallback_column="extractive").first().reply == "own answer"
    chat = clients.content_chat("http://x", "key")
    assert chat.read({"candidates": [{"content": {"parts": [{"text": "a"}, {"text": "b"}]}}]}) == "ab" and chat.shape("s", "u")["contents"][0]["parts"] == [{"text": "u"}]


def test_utc_now(spark):
    assert re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\+00:00", spark.range(1).select(utc_now().alias("t")).first().t)


def test_graphml_round_trip(spark, tmp_path):
    nodes = spark.createDataFrame([("EVENT::a", "A & B"), ("EVENT::b", None)], "node_id string, label string")
    edges = spark.createDataFrame([("EVENT::a", "EVENT::b", "CAUSES")], "src string, dst string, relation string")
    (tmp_path / "g.graphml").write_text(writers.graphml_text(nodes, edges))
    n, e = readers.graphml(spark, str(tmp_path / "g.graphml"))
    assert {r.node_id: r.attributes.get("label") for r in n.collect()} == {"EVENT::a": "A & B", "EVENT::b": None}
    assert e.first().attributes["relation"] == "CAUSES"


def test_resumable_batches(spark, tmp_path):
    source, sink, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text('{"id": 1}\n{"id": 2}')
    once = lambda: run_available(spark, source, "id long", lambda df: df, sink, mark, "id")
    once()
    (tmp_path / "in/2.json").write_text('{"id": 2}\n{"id": 3}')
    once()
    assert sorted(r.id for r in spark.read.parquet(sink).collect()) == [1, 2, 3]


class Echo:
    def generate(self, system_prompt, user_prompt):
        if user_prompt == "fail":
            raise OSError("down")
        return user_prompt.upper()


def test_clients(spark):
    prompts = spark.createDataFrame([(1, "", "hi"), (2, "", "fail")], "id long, system_prompt string, user_prompt string")
    got = {r.id: (r.reply, r.error) for r in clients.replies(prompts, Echo(), "extractive").collect()}
    assert got == {1: ("HI", None), 2: ("extractive", "OSError: down")}


def test_report(spark):
    text = writers.markdown_report(spark.createDataFrame([("all", 0.5, None)], "level string, f1 double, x double"), "Report")
    assert "| all | 0.5000 | N/A |" in text
