"""Scans: rules, articles, catalogs, benchmarks, predictions and graphs, with declared schemas.

A relational row has no place in its file, so readers of files whose order has a meaning take it from the
JSON array's position, or count the rows of the file's blocks. Missing values become '' where the engine's
tables want text.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from causeway.operators.rules import OPTIONAL, REQUIRED, with_defaults

RULE = T.StructType([T.StructField(c, T.StringType()) for c in REQUIRED + OPTIONAL])
ARTICLE = "article_id string, article_title string, content string"
CATALOG = "event_id string, event_name string, event_type string, description string, aliases array<string>, source_article_ids array<int>, occurrences array<struct<article_id: int, rule_index: int, role: string>>, status string"


def json_array(spark: SparkSession, path: str, schema: T.StructType | str, under: tuple[str, ...] = ()) -> DataFrame:
    """The elements of a JSON array with row_pos, their place. ``under``: keys of an object that may hold the array.

    The file is one value for the parser; arrays too large for that belong in JSON lines or Parquet.
    """
    row = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    kind = T.ArrayType(row)
    whole = spark.read.text(path, wholetext=True)
    rows = F.coalesce(*(F.from_json(F.get_json_object("value", f"$.{k}"), kind) for k in under), F.from_json("value", kind))
    return whole.select(F.posexplode(rows).alias("row_pos", "r")).select(F.col("row_pos").cast("bigint"), "r.*")


def numbered(found: DataFrame, name: str = "row_pos") -> DataFrame:
    """``found``, just read from files, with each row's place from 0 on: by file, block of the file and row of the block.

    Two scans: the first counts the rows of each block, and only these counts meet in one task.
    """
    placed = found.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")).withColumn("_m", F.monotonically_increasing_id())
    sizes = placed.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_m").alias("_m0"))
    before = F.sum("_n").over(Window.orderBy("_file", "_block")) - F.col("_n")
    sizes = sizes.select(F.col("_file").alias("_f"), F.col("_block").alias("_b"), before.alias("_before"), "_m0")
    out = placed.join(F.broadcast(sizes), (F.col("_file") == F.col("_f")) & (F.col("_block") == F.col("_b")))
    return out.withColumn(name, F.col("_before") + F.col("_m") - F.col("_m0")).drop("_file", "_block", "_m", "_f", "_b", "_before", "_m0")


def rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules from .json (an array), .jsonl, .csv or .parquet, told apart by the suffix; all columns as text, and row_pos.

    A line of JSON that does not parse is an error that names the line.
    """
    suffix = PurePosixPath(path.split("?")[0]).suffix.lower()
    if suffix == ".json":
        return with_defaults(json_array(spark, path, ", ".join(f"`{f.name}` string" for f in RULE.fields), ("rules", "data")))
    if suffix == ".csv":
        found = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    elif suffix == ".jsonl":
        lines = numbered(spark.read.text(path))
        v = F.try_parse_json("value")
        bad = F.raise_error(F.concat(F.lit(f"{path}: line "), (F.col("row_pos") + 1).cast("string"), F.lit(" is no JSON object"))).cast("variant")
        v = F.when(F.schema_of_variant(v).startswith("OBJECT"), v).otherwise(bad)
        lines = lines.where(F.trim("value") != "").select("row_pos", v.alias("v"))
        return with_defaults(lines.select("row_pos", *(F.try_variant_get("v", f"$.{f.name}", "string").alias(f.name) for f in RULE.fields)))
    elif suffix == ".parquet":
        found = spark.read.parquet(path)
    else:
        raise ValueError(f"no reader for {suffix or 'a file without a suffix'}: .json, .jsonl, .csv and .parquet are read")
    if "row_pos" not in found.columns:
        found = numbered(found)
    return with_defaults(found)


MEMORY_COLUMNS = ["memory_id", "memory_type", "graph_node_id", "embedding_text"]


def memory(spark: SparkSession, path: str) -> DataFrame:
    """Memory records from a CSV file: ids as text, '' for what is missing, memory_id a whole number (anything else is an error)."""
    found = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", "UTF-8").csv(path)
    if missing := [c for c in MEMORY_COLUMNS if c not in found.columns]:
        raise ValueError(f"{path}: missing columns: {', '.join(missing)}")
    whole = F.when(F.col("memory_id").rlike(r"^\s*[+-]?[0-9]+(\.0*)?\s*$"), F.regexp_replace(F.trim("memory_id"), r"\.0*$", "").cast("bigint")).otherwise(F.raise_error(F.concat(F.lit("memory_id is no whole number: "), F.coalesce("memory_id", F.lit("")))).cast("bigint"))
    return found.select(*(whole.alias(c) if c == "memory_id" else F.coalesce(c, F.lit("")).alias(c) for c in found.columns))


def vectors(spark: SparkSession, path: str, name: str = "embedding") -> DataFrame:
    """(memory_id, vector): Parquet, or JSON lines with an array; a row without an id takes its place as one."""
    if PurePosixPath(path).suffix.lower() == ".jsonl":
        found = spark.read.schema(f"memory_id bigint, {name} array<float>").json(path)
        found = numbered(found, "_place").withColumn("memory_id", F.coalesce("memory_id", "_place"))
    else:
        found = spark.read.parquet(path)
    return found.select("memory_id", F.col(name).alias("vector"))


def articles(spark: SparkSession, path: str, first: int | None = None, last: int | None = None, limit: int | None = None) -> DataFrame:
    """Articles whose id is a number, within [first, last] if given; ``limit`` counts what is within."""
    found = json_array(spark, path, ARTICLE, ("articles", "data")).withColumn("article_id", F.col("article_id").try_cast("int")).where("article_id IS NOT NULL")
    if first is not None:
        found = found.where(F.col("article_id") >= first)
    if last is not None:
        found = found.where(F.col("article_id") <= last)
    return found.orderBy("row_pos").limit(limit) if limit else found


def index_range(rules: DataFrame, first: int | None = None, last: int | None = None, limit: int | None = None) -> DataFrame:
    """Rules whose index is a number within [first, last]; ``limit`` counts what is within, in the order of rows."""
    at = F.col("index").try_cast("double").cast("bigint")
    found = rules if first is None and last is None else rules.where(at.isNotNull())
    found = found.where(at >= first) if first is not None else found
    found = found.where(at <= last) if last is not None else found
    return found.orderBy("row_pos").limit(limit) if limit else found


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """A valid catalog: events with id and name, the first of each id, known types, digits as article ids, CANDIDATE by default."""
    from causeway.operators.catalog import EVENT_TYPES

    found = json_array(spark, path, CATALOG).withColumnRenamed("row_pos", "cat_pos").where("coalesce(event_id, '') <> '' AND coalesce(event_name, '') <> ''")
    found = found.withColumn("_n", F.row_number().over(Window.partitionBy("event_id").orderBy("cat_pos"))).where("_n = 1").drop("_n")
    kind = F.upper("event_type")
    return found.withColumns({"event_type": F.when(kind.isin(EVENT_TYPES), kind).otherwise("OTHER"), "source_article_ids": F.array_sort(F.array_distinct(F.coalesce("source_article_ids", F.array().cast("array<int>")))), "status": F.coalesce("status", F.lit("CANDIDATE"))})


# The names that fields of gold and predictions go by, in order of preference, and the keys that lists stand under.
RULE_FIELDS = ["retrieved_rule_ids", "predicted_rule_ids", "rule_ids", "retrieval.rule_ids", "retrieval.retrieved_rule_ids", "verification.verified_rule_ids", "verified_rule_ids"]
EVENT_FIELDS = ["retrieved_event_ids", "event_ids", "retrieval.event_ids", "retrieval.retrieved_event_ids"]
PATH_FIELDS = ["reasoning_path", "retrieved_path", "path", "paths", "graph_path", "causal_path", "retrieval.reasoning_path", "verification.reasoning_path", "verified_path"]
DECISION_FIELDS = ["verification_decision", "gold_decision", "decision", "verdict", "status", "verification.final_decision", "verification.decision", "verification.verdict"]
ANSWER_FIELDS = ["final_answer", "answer", "generated_answer", "generation.answer", "final.answer", "response", "output_text"]
CITATION_FIELDS = ["citations", "expected_citations", "generation.citations", "final.citations", "used_citations", "article_ids", "supporting_article_ids"]
ID_FIELDS = ["id", "question_id", "sample_id"]
QUESTION_LISTS, PREDICTION_LISTS = ["questions", "samples", "data"], ["predictions", "results", "questions", "samples", "data"]


def _first(v: Column, paths: list[str], kind: str) -> Column:
    return F.coalesce(*(F.try_variant_get(v, p if p.startswith("$") else f"$.{p}", kind) for p in paths))


def _ids(v: Column, paths: list[str]) -> Column:
    return F.coalesce(_first(v, paths, "array<string>"), F.array().cast("array<string>"))


def _listed(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """(row_pos, key, v): the elements of a JSON list; of the list, or object by id, under the first of ``keys`` that is there; or of a whole
    object by id. Lines of JSON if the suffix says so (those that do not parse are left out); their numbers are places."""
    none = F.lit(None).cast("string")
    if PurePosixPath(path).suffix.lower() == ".jsonl":
        lines = numbered(spark.read.text(path)).where(F.trim("value") != "")
        found = lines.select("row_pos", none.alias("key"), F.try_parse_json("value").alias("v"))
    else:
        whole = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("w"))
        as_list = lambda p: F.transform(F.try_variant_get("w", p, "array<variant>"), lambda v: F.struct(none.alias("key"), v.alias("v")))
        as_map = lambda p: F.transform(F.map_entries(F.try_variant_get("w", p, "map<string,variant>")), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("v")))
        every = F.coalesce(as_list("$"), *(f(f"$.{k}") for k in keys for f in (as_list, as_map)), as_map("$"))
        found = whole.select(F.posexplode(every).alias("row_pos", "e")).select(F.col("row_pos").cast("bigint").alias("row_pos"), "e.*")
    return found.where(F.schema_of_variant("v").startswith("OBJECT"))


def _refused(rows: DataFrame, key: str, what: str) -> DataFrame:
    """``rows``; ids that repeat are an error when they are read."""
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    return rows.withColumn(key, F.when(n == 1, F.col(key)).otherwise(F.raise_error(F.concat(F.lit(f"{what} repeats the id "), F.col(key)))))


def benchmark(spark: SparkSession, path: str, invent_ids: bool = True) -> DataFrame:
    """Questions of a benchmark (a list, or one under questions, samples or data), with gold rules, articles, events, path, citations and decision.

    With ``invent_ids`` a question without an id is question_0001 and so on by place, and rows without a question go; without it rows
    without an id go. An id that repeats is an error.
    """
    found, v = _listed(spark, path, QUESTION_LISTS), F.col("v")
    question, own = _first(v, ["question", "query"], "string"), _first(v, ID_FIELDS, "string")
    made = F.concat(F.lit("question_"), F.lpad((F.col("row_pos") + 1).cast("string"), 4, "0"))
    rows = found.where(F.coalesce(question, F.lit("")) != "") if invent_ids else found.where(F.coalesce(own, F.lit("")) != "")
    edge = "array<struct<source_event_id: string, target_event_id: string>>"
    chain = F.transform(F.try_variant_get("v", "$.supporting_event_chain", "array<struct<event_id: string>>"), lambda e: e["event_id"])
    path_of = F.coalesce(F.try_variant_get("v", "$.evaluation.gold_path", edge), F.try_variant_get("v", "$.gold_path", edge), F.array().cast(edge))
    events = F.coalesce(_first(v, ["evaluation.gold_event_ids", "gold_event_ids"], "array<string>"), chain, F.array().cast("array<string>"))
    rows = rows.select(
        "row_pos", (F.coalesce(own, made) if invent_ids else own).alias("id"), question.alias("question"), _first(v, ["answer", "evaluation.gold_answer", "gold_answer"], "string").alias("answer"), _first(v, ["question_type", "task_type"], "string").alias("question_type"),
        _first(v, ["evaluation.difficulty.overall_level", "difficulty"], "string").alias("difficulty"), _ids(v, ["evaluation.gold_rule_ids", "supporting_rule_ids", "gold_rule_ids"]).alias("gold_rule_ids"), _ids(v, ["evaluation.gold_article_ids", "supporting_article_ids"]).alias("gold_article_ids"),
        events.alias("gold_event_ids"), path_of.alias("gold_path"), _ids(v, ["evaluation.gold_citations", "expected_citations"]).alias("gold_citations"), _first(v, ["evaluation.gold_decision", "expected_label"], "string").alias("gold_decision"),
        F.coalesce(F.try_variant_get("v", "$.evaluation.requires_counterfactual", "boolean"), F.lit(False)).alias("requires_counterfactual"),
    )
    return _refused(rows, "id", "the benchmark")


def gold(spark: SparkSession, path: str) -> DataFrame:
    """Gold of the second generation: a list, or one under samples; nodes and edges ("source>>target") of its path."""
    v = F.col("v")
    edges = F.transform(F.try_variant_get("v", "$.gold_path.edges", "array<array<string>>"), lambda e: F.array_join(e, ">>"))
    rows = _listed(spark, path, ["samples"]).where(F.col("key").isNull()).select(
        "row_pos", F.try_variant_get("v", "$.question_id", "string").alias("question_id"), *(F.try_variant_get("v", f"$.{c}", "string").alias(c) for c in ("source_chain_id", "task_type", "difficulty", "gold_counterfactual_status", "gold_answer_label", "gold_answer")),
        F.try_variant_get("v", "$.gold_final_effect_reachable", "boolean").alias("gold_final_effect_reachable"), _ids(v, ["gold_rule_ids"]).alias("gold_rule_ids"), _ids(v, ["gold_article_ids"]).alias("gold_article_ids"),
        _ids(v, ["gold_path.nodes"]).alias("gold_nodes"), F.coalesce(edges, F.array().cast("array<string>")).alias("gold_edges"),
    )
    return _refused(rows.where("question_id IS NOT NULL"), "question_id", "gold")


def _prediction(found: DataFrame, *order: str) -> DataFrame:
    v = F.col("v")
    fields = {"rule_ids": _ids(v, RULE_FIELDS), "event_ids": _ids(v, EVENT_FIELDS), "path": F.to_json(_first(v, PATH_FIELDS, "variant")), "decision": _first(v, DECISION_FIELDS, "string"), "final_answer": _first(v, ANSWER_FIELDS, "string"), "citations": _ids(v, CITATION_FIELDS), "error": _first(v, ["error"], "string"),
              "runtime_seconds": _first(v, ["runtime_seconds", "elapsed_seconds"], "double")}
    rows = found.select(F.coalesce(_first(v, ID_FIELDS, "string"), "key").alias("id"), F.struct(*order).alias("_o"), F.struct(*(c.alias(n) for n, c in fields.items())).alias("r"))
    return rows.where("coalesce(id, '') <> ''").groupBy("id").agg(F.max_by("r", "_o").alias("r")).select("id", "r.*")


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """Predictions by id from a JSON list, a list or object by id under predictions, results, questions, samples or data, an object by id, or
    JSON lines; fields by any of their names. The last of a repeated id wins; the path is JSON, as its shape varies."""
    return _prediction(_listed(spark, path, PREDICTION_LISTS), "row_pos")


def resumed_predictions(spark: SparkSession, json_path: str | None, jsonl_path: str | None) -> DataFrame:
    """What an interrupted run has left: the lines of ``jsonl_path`` win over what ``json_path`` has, later lines over earlier ones."""
    parts = [_listed(spark, p, PREDICTION_LISTS[:2]).withColumn("_rank", F.lit(k)) for k, p in enumerate((json_path, jsonl_path)) if p]
    return _prediction(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]), "_rank", "row_pos")


def graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a GraphML file, attributes as maps of strings. One file is one task; large graphs are kept as Parquet."""
    ns = "{http://graphml.graphdrawing.org/xmlns}"

    def parse(batches):
        import pandas as pd

        for pdf in batches:
            for text in pdf["value"]:
                root = ET.fromstring(text)
                names = {k.get("id"): k.get("attr.name") for k in root.iter(f"{ns}key")}
                data = lambda e: {names.get(d.get("key"), d.get("key")): d.text or "" for d in e.findall(f"{ns}data")}
                rows = [("node", n.get("id"), None, data(n)) for n in root.iter(f"{ns}node")] + [("edge", e.get("source"), e.get("target"), data(e)) for e in root.iter(f"{ns}edge")]
                yield pd.DataFrame(rows, columns=["kind", "a", "b", "attributes"])

    found = spark.read.text(path, wholetext=True).mapInPandas(parse, "kind string, a string, b string, attributes map<string, string>")
    return found.where("kind = 'node'").select(F.col("a").alias("node_id"), "attributes"), found.where("kind = 'edge'").select(F.col("a").alias("src"), F.col("b").alias("dst"), "attributes")
