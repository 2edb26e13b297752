"""Final evidence and paths, prompt context, the extractive answer, citation repair and the prediction record."""

from __future__ import annotations

import re
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causeway.functions.text import article_label, clamp, truncated

# The defaults, and the texts of answers.
MAX_EVIDENCE, MAX_PATHS, MIN_VERIFICATION, CONTEXT_CHARS = 8, 6, 0.45, 18_000
SELECTION = {"verification": 0.55, "original": 0.30, "cf": 0.15}
CONCLUSION, GROUNDS, CERTAINTY = "### Kết luận", "### Căn cứ và lập luận", "### Lưu ý về độ chắc chắn"
TOO_LITTLE = "Chưa đủ căn cứ từ dữ liệu được cung cấp để trả lời câu hỏi."
NOT_FULL = "Chưa đủ căn cứ từ dữ liệu được cung cấp để đưa ra kết luận đầy đủ."
NOTHING_FOUND = "Hệ thống không tìm được evidence đã xác minh."
NO_ADVICE = "Nội dung này không thay thế tư vấn pháp lý chính thức."
UNNAMED, NOT_GIVEN, NO_EVIDENCE, NO_PATH, NONE_GIVEN = "không nêu rõ", "Không nêu rõ", "Không có evidence pháp lý đạt ngưỡng.", "Không có causal path phù hợp.", "Không có"
PROMPT = """CÂU HỎI:
{query}

ĐỘ TIN CẬY TOÀN CỤC:
- confidence = {confidence}
- consistency_score = {consistency}

EVIDENCE ĐÃ CHỌN:
{evidence}

CAUSAL PATH HỖ TRỢ:
{paths}

YÊU CẦU TRẢ LỜI:
- Trả lời trực tiếp câu hỏi.
- Dùng đúng citation [E1], [E2], ... tương ứng với evidence.
- Không dùng citation không tồn tại.
- Nếu có nhiều điều kiện hoặc hệ quả, trình bày theo đúng thứ tự logic.
- Nếu evidence mâu thuẫn hoặc chưa chắc chắn, nêu rõ giới hạn.
- Không nhắc tới tên file, JSON, pipeline hoặc điểm số kỹ thuật trừ phần “Lưu ý về độ chắc chắn”.
"""


class Generator(Protocol):
    """Anything that answers a prompt: a model behind HTTP, or a test's stand-in."""

    def generate(self, system_prompt: str, user_prompt: str) -> str: ...


def selected_evidence(decided: DataFrame, most: int = MAX_EVIDENCE, floor: float = MIN_VERIFICATION, include_uncertain: bool = True) -> DataFrame:
    """KEEP (and UNCERTAIN) evidence not below the floor, or else the single best, by selection score; numbered from 1."""
    rows = decided.where(F.col("decision").isin(["KEEP", "UNCERTAIN"] if include_uncertain else ["KEEP"]))
    score = SELECTION["verification"] * F.col("verification_score") + SELECTION["original"] * F.col("final_score") + SELECTION["cf"] * F.col("cf_support")
    rows = rows.withColumn("selection_score", F.round(clamp(score), 9)).withColumn("_ok", F.col("verification_score") >= floor)
    order = [F.desc("selection_score"), F.desc("verification_score"), F.desc("final_score"), "rule_id"]
    rows = rows.withColumns({"_any": F.max("_ok").over(Window.partitionBy("question_id")), "_best": F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("verification_score"), *order))})
    rows = rows.where("_ok OR (NOT _any AND _best = 1)")
    rows = rows.withColumn("evidence_index", F.row_number().over(Window.partitionBy("question_id").orderBy(*order)))
    return rows.where(F.col("evidence_index") <= most).withColumn("selected_path_ids", F.array_distinct(F.concat("verified_path_ids", "unresolved_path_ids"))).drop("_ok", "_any", "_best")


def selected_paths(evidence: DataFrame, paths: DataFrame, most: int = MAX_PATHS) -> DataFrame:
    """The paths that the selected evidence names, or all if it names none; supported ones first."""
    named = evidence.select("question_id", F.explode("selected_path_ids").alias("path_id")).distinct()
    some = named.select("question_id").distinct()
    rows = paths.join(named, ["question_id", "path_id"], "left_semi").unionByName(paths.join(some, "question_id", "left_anti"))
    place = Window.partitionBy("question_id").orderBy((F.col("status") != "SUPPORTED").cast("int"), F.desc("consistency"), "path_id")
    return rows.withColumn("path_index", F.row_number().over(place)).where(F.col("path_index") <= most)


def _or(x: str, other: str) -> Column:
    return F.when(F.coalesce(F.col(x), F.lit("")) == "", F.lit(other)).otherwise(F.col(x))


def extractive_answers(questions: DataFrame, evidence: DataFrame, show_confidence: bool = False) -> DataFrame:
    """(question_id, answer): three sections put together from the evidence.

    evidence: evidence_index, article_id, article_title, condition, effect. As the provider that was asked
    for, confidence prints as 0.00; ``show_confidence`` prints the question's own, as for a fallback.
    """
    line = F.concat(F.lit("[E"), "evidence_index", F.lit("] "), article_label(F.col("article_id"), F.col("article_title")), F.lit(": điều kiện “"), _or("condition", UNNAMED), F.lit("” dẫn tới hệ quả “"), _or("effect", UNNAMED), F.lit("”."))
    rows = evidence.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("evidence_index", line.alias("line"), "condition", "effect"))).alias("_e"))
    out = questions.join(rows, "question_id", "left")
    first = F.col("_e")[0]
    has = lambda c: F.coalesce(first[c], F.lit("")) != ""
    claim = F.when(has("condition") & has("effect"), F.concat(F.lit("Khi "), first["condition"], F.lit(", hệ quả pháp lý là "), first["effect"], F.lit(" [E1].")))
    claim = claim.when(has("effect"), F.concat(F.lit("Hệ quả pháp lý được ghi nhận là "), first["effect"], F.lit(" [E1]."))).otherwise(F.lit(NOT_FULL))
    shown = F.format_number("confidence", 2) if show_confidence else F.lit("0.00")
    last = F.concat(F.lit("Câu trả lời được tổng hợp trực tiếp từ evidence đã truy hồi và xác minh. Độ tin cậy toàn cục: "), shown, F.lit("."))
    full = F.concat_ws("\n", F.lit(CONCLUSION), claim, F.lit(""), F.lit(GROUNDS), F.array_join(F.transform("_e", lambda x: x["line"]), "\n"), F.lit(""), F.lit(CERTAINTY), last, F.lit(NO_ADVICE))
    none = F.lit(f"{CONCLUSION}\n{TOO_LITTLE}\n\n{CERTAINTY}\n{NOTHING_FOUND}")
    return out.withColumn("answer", F.when(F.col("_e").isNull(), none).otherwise(full)).drop("_e")


def repaired(answers: DataFrame) -> DataFrame:
    """answers: answer, n_evidence. Citations of evidence that is not there go; if none is left all are listed; the notice is added if missing."""
    cited = F.transform(F.regexp_extract_all("answer", F.lit(r"\[E(\d+)\]"), 1), lambda x: x.cast("int"))
    known = lambda x: (x >= 1) & (x <= F.col("n_evidence"))
    out = answers.withColumn("_bad", F.array_sort(F.array_distinct(F.filter(cited, lambda x: ~known(x)))))
    cleaned = F.aggregate("_bad", F.col("answer"), lambda s, x: F.replace(s, F.concat(F.lit("[E"), x.cast("string"), F.lit("]")), F.lit("")))
    out = out.withColumns({"_used": F.array_sort(F.array_distinct(F.filter(cited, known))), "_text": cleaned})
    every = F.when(F.col("n_evidence") > 0, F.sequence(F.lit(1), F.greatest(F.col("n_evidence"), F.lit(1)))).otherwise(F.array().cast("array<int>"))
    listed = F.array_join(F.transform(every, lambda x: F.concat(F.lit("[E"), x.cast("string"), F.lit("]"))), ", ")
    missing = (F.col("n_evidence") > 0) & (F.size("_used") == 0)
    rstrip = lambda x: F.regexp_replace(x, r"(?U)\s+$", "")
    text = F.when(missing, F.concat(rstrip(F.col("_text")), F.lit("\n\nCăn cứ evidence: "), listed, F.lit("."))).otherwise(F.col("_text"))
    out = out.withColumn("_text", text)
    text = F.when(F.lower("_text").contains("không thay thế tư vấn pháp lý"), F.col("_text")).otherwise(F.concat(rstrip(F.col("_text")), F.lit("\n\nLưu ý: "), F.lit(NO_ADVICE)))
    used = F.when(missing, every).otherwise(F.col("_used"))
    return out.withColumns({"repaired": F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), "citations_used": F.transform(used, lambda x: F.concat(F.lit("E"), x.cast("string"))), "n_invalid": F.size("_bad")}).drop("_bad", "_used", "_text")


def path_names(paths: DataFrame, names: DataFrame, key: list[str]) -> DataFrame:
    """``paths`` with event_names: the ends of each step, source first, each once. A backward path's steps end at the node before."""
    steps = F.expr("flatten(transform(filter(sequence(1, size(nodes)), i -> i < size(nodes)), i -> if(direction = 'backward', array(nodes[i], nodes[i - 1]), array(nodes[i - 1], nodes[i]))))")
    named = paths.select(*key, F.posexplode(F.array_distinct(steps)).alias("_pos", "event_id")).join(names, "event_id", "left")
    lists = named.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_pos", F.coalesce("event_name", "event_id").alias("_n")))), lambda x: x["_n"]).alias("event_names"))
    return paths.join(lists, key, "left").withColumn("event_names", F.coalesce("event_names", F.array().cast("array<string>")))


def _either(*columns: str) -> Column:
    return F.coalesce(*(F.nullif(F.coalesce(F.col(c), F.lit("")), F.lit("")) for c in columns), F.lit(NOT_GIVEN))


def prompts(questions: DataFrame, evidence: DataFrame, paths: DataFrame, most: int = CONTEXT_CHARS) -> DataFrame:
    """(question_id, user_prompt): the question, its confidence, evidence blocks, path blocks and what is asked for, cut at ``most`` characters.

    questions: query, confidence, consistency. Evidence may have reasons (an array), paths an explanation.
    """
    label = lambda name, value: F.concat(F.lit(f"- {name}: "), value)
    reasons = F.when(F.size(F.coalesce("reasons", F.array())) > 0, label("Ghi chú xác minh", F.array_join("reasons", " | "))) if "reasons" in evidence.columns else F.lit(None).cast("string")
    block = F.concat_ws("\n", F.concat(F.lit("[E"), "evidence_index", F.lit("]")), label("Rule ID", F.col("rule_id")), label("Căn cứ", article_label(F.col("article_id"), F.col("article_title"))), label("Chủ thể pháp lý", _either("legal_subject")),
                        label("Điều kiện", _either("condition")), label("Hệ quả pháp lý", _either("effect")), label("Sự kiện điều kiện", _either("condition_event_name", "condition_event")), label("Sự kiện hệ quả", _either("effect_event_name", "effect_event")),
                        label("Loại quan hệ", _either("causal_type")), label("Trạng thái xác minh", F.col("decision")), F.format_string("- Verification score: %.4f", "verification_score"), reasons)
    explained = _either("explanation") if "explanation" in paths.columns else F.lit(NONE_GIVEN)
    rules = F.when(F.size(F.coalesce("rule_ids", F.array())) > 0, F.array_join("rule_ids", ", ")).otherwise(F.lit(NOT_GIVEN))
    way = F.concat_ws("\n", F.concat(F.lit("[P"), "path_index", F.lit("]")), label("Trạng thái", F.col("status")), F.format_string("- Consistency score: %.4f", "consistency"), label("Chuỗi sự kiện", F.array_join("event_names", " → ")),
                      label("Rule IDs trên path", rules), label("Giải thích xác minh", explained))
    joined = lambda df, i, b, name: df.groupBy("question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(i, b.alias("b")))), lambda x: x["b"]), "\n\n").alias(name))
    out = questions.join(joined(evidence, "evidence_index", block, "_e"), "question_id", "left").join(joined(paths, "path_index", way, "_p"), "question_id", "left")
    values = {"query": F.col("query"), "confidence": F.format_string("%.4f", "confidence"), "consistency": F.format_string("%.4f", "consistency"), "evidence": F.coalesce("_e", F.lit(NO_EVIDENCE)), "paths": F.coalesce("_p", F.lit(NO_PATH))}
    pieces = [values[x] if k % 2 else F.lit(x) for k, x in enumerate(re.split(r"\{(\w+)\}", PROMPT))]
    return out.select("question_id", truncated(F.concat(*pieces), most).alias("user_prompt"))


def predictions(questions: DataFrame, seeds: DataFrame, evidence: DataFrame, paths: DataFrame, selected: DataFrame, judged: DataFrame, answers: DataFrame) -> DataFrame:
    """The record of each question: retrieved ids in order, the first path, the decision, the answer and what it cites."""
    listed = lambda df, order, value, name: df.groupBy("question_id").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value])).alias(name))
    out = questions.select("question_id").join(listed(evidence, "rank", "rule_id", "retrieved_rule_ids"), "question_id", "left").join(listed(seeds, "seed_rank", "event_id", "retrieved_event_ids"), "question_id", "left")
    out = out.join(paths.where("path_id = 0").select("question_id", F.col("nodes").alias("reasoning_path")), "question_id", "left")
    out = out.join(listed(selected, "evidence_index", "article_id", "cited_article_ids"), "question_id", "left").join(judged.select("question_id", F.col("decision").alias("verification_decision"), "confidence"), "question_id", "left")
    return out.join(answers.select("question_id", F.col("repaired").alias("final_answer"), "citations_used"), "question_id", "left")
