"""Memory records: texts to embed, modality of event wordings, and checks of memory against graph and vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The lines of the texts that are embedded, and prefixes that say an event's modality.
RULE_LINES = [
    ("Chủ thể pháp lý: ", "legal_subject"), ("Điều kiện pháp lý: ", "condition"), ("Hệ quả pháp lý: ", "effect"), ("Sự kiện điều kiện: ", "condition_event_name"), ("Mã sự kiện điều kiện: ", "condition_event"),
    ("Tình thái điều kiện: ", "condition_event_modality"), ("Sự kiện hệ quả: ", "effect_event_name"), ("Mã sự kiện hệ quả: ", "effect_event"), ("Tình thái hệ quả: ", "effect_event_modality"), ("Loại quan hệ nhân quả: ", "causal_type"),
]
EVENT_LINES = [
    ("Tên sự kiện: ", "names"), ("Mã sự kiện: ", "event_id"), ("Vai trò trong đồ thị: ", "event_role"), ("Các cách diễn đạt: ", "texts"), ("Ngữ cảnh điều kiện: ", "condition_texts"), ("Ngữ cảnh hệ quả: ", "effect_texts"),
    ("Số lần làm điều kiện: ", "condition_count"), ("Số lần làm hệ quả: ", "effect_count"), ("Các điều luật liên quan: ", "article_ids"),
]
ROLE_LABELS = {"CONDITION": "Sự kiện điều kiện", "EFFECT": "Sự kiện hệ quả", "BRIDGE": "Sự kiện cầu nối"}
MODALITY = [("^có thể bị ", "POSSIBLE_IMPOSED"), ("^có thể được ", "POSSIBLE_GRANTED"), ("^bị ", "IMPOSED"), ("^được ", "GRANTED")]


def _lines(lines) -> list[Column]:
    return [F.concat(F.lit(label), F.coalesce(F.col(c).cast("string"), F.lit(""))) for label, c in lines]


def rule_text() -> Column:
    """The text to embed for a rule; its own wording is the last line, if it has one."""
    place = F.concat(F.lit("Điều luật: Điều "), "article_id", F.lit(". "), "article_title")
    said = F.when(F.coalesce("rule_text", F.lit("")) != "", F.concat(F.lit("Diễn đạt quy tắc: "), "rule_text"))
    return F.concat_ws("\n", F.lit("Loại bộ nhớ: Quy tắc pháp lý"), *_lines(RULE_LINES), place, said)


def event_role() -> Column:
    c, e = F.col("is_condition"), F.col("is_effect")
    return F.when(c & e, "BRIDGE").when(c, "CONDITION").when(e, "EFFECT").otherwise("EVENT")


def event_text() -> Column:
    label = F.lit("Sự kiện pháp lý")
    for role, text in ROLE_LABELS.items():
        label = F.when(F.col("event_role") == role, text).otherwise(label)
    return F.concat_ws("\n", F.concat(F.lit("Loại bộ nhớ: "), label), *_lines(EVENT_LINES))


def modality(text: Column) -> tuple[Column, Column]:
    """(text without its modal prefix, modality)."""
    low, label = F.lower(text), F.lit("UNSPECIFIED")
    for pattern, name in reversed(MODALITY):
        label = F.when(low.rlike(pattern), name).otherwise(label)
    return F.regexp_replace(text, "(?i)^(có thể )?(bị|được) ", ""), label


def problems(memory: DataFrame, nodes: DataFrame, vectors: DataFrame) -> DataFrame:
    """(problem, n) of what must not be: memory without a node or a vector, ids that repeat or leave gaps, a type that is missing."""
    kinds = ("RULE", "EVENT")
    ids = memory.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("memory_id").alias("d"), F.min("memory_id").alias("lo"), F.max("memory_id").alias("hi"), *(F.count_if(F.col("memory_type") == k).alias(k) for k in kinds))
    row = lambda problem, n: F.struct(F.lit(problem).alias("problem"), n.cast("bigint").alias("n"))
    dense = (F.col("lo") == 0) & (F.col("hi") == F.col("n") - 1)
    found = [row("repeated memory_id", F.col("n") - F.col("d")), row("ids are not 0 to n - 1", F.when(dense, 0).otherwise(1)), *(row(f"no {k}", F.col(k) == 0) for k in kinds)]
    found = ids.select(F.explode(F.array(*found)).alias("p")).select("p.*")
    for name, other, key in (("memory without a node", nodes.select(F.col("node_id").alias("graph_node_id")), "graph_node_id"), ("memory without a vector", vectors, "memory_id"), ("vector without memory", None, "memory_id")):
        rows = vectors.join(memory, key, "left_anti") if other is None else memory.join(other, key, "left_anti")
        found = found.unionByName(rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("problem"), "n"))
    return found.where("n > 0")
