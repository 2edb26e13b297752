"""Queries of the evaluation: gold is an order's parts, the prediction mixes them with those of the customer's order before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from causeway.functions import text as T
from causeway.operators import metrics as M
from causeway.plans.bindings import table


def _in_order(value: str):
    return F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("rn", value))), lambda x: x[value]))


def _article(x):
    return F.concat(F.lit("Điều "), F.substring_index(x, "_", -1))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question for each order. Rules are its parts, events its suppliers, the answer its lines' flags, citations its first suppliers;
    predictions mix these with those of the customer's order before (null: missing)."""
    place = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.concat(F.lit("part_"), "l_partkey").alias("p"), F.concat(F.lit("supp_"), "l_suppkey").alias("e"), F.concat("l_returnflag", "l_linestatus").alias("f"), F.row_number().over(place).alias("rn"))
    answer = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "f"))), lambda x: x["f"]), " ")
    items = lines.groupBy("l_orderkey").agg(_in_order("p").alias("items"), _in_order("e").alias("events"), answer.alias("answer"))
    before = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    empty = F.array().cast("array<string>")
    orders = table(spark, sf_dir, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    orders = orders.withColumns({"gold": F.coalesce("items", empty), "gold_events": F.coalesce("events", empty), "gold_answer": F.coalesce("answer", F.lit("")), "cf": F.col("o_totalprice") > 250_000})
    orders = orders.withColumn("gold_citations", F.transform(F.slice("gold_events", 1, 3), _article))
    orders = orders.withColumns({"prev": F.lag("gold").over(before), "prev_events": F.lag("gold_events").over(before), "prev_answer": F.lag("gold_answer").over(before), "prev_status": F.lag("o_orderstatus").over(before), "pred_cf": F.lag("cf").over(before)})
    mixed = lambda prev, gold, n, k: F.array_distinct(F.concat(F.slice(prev, 1, n), F.slice(gold, k, 100), F.slice(gold, 1, 1)))
    return orders.select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("question_type"), F.col("o_orderstatus").alias("difficulty"), "gold", mixed("prev", "gold", 2, 3).alias("pred"), "prev", "gold_events", mixed("prev_events", "gold_events", 1, 2).alias("pred_events"), "prev_events",
        "gold_answer", F.concat_ws(" ", F.substring("prev_answer", 1, 5), F.substring("gold_answer", 1, 5)).alias("pred_answer"), "gold_citations", F.concat(F.transform(F.slice("prev_events", 1, 1), _article), F.slice("gold_citations", 1, 2)).alias("pred_citations"),
        F.when(F.col("o_orderstatus") == "F", "SUPPORTED").when(F.col("o_orderstatus") == "O", "REJECT_DIRECT_CLAIM").otherwise("UNCERTAIN").alias("gold_decision"),
        T.decision(F.when(F.col("prev_status") == "F", "keep").when(F.col("prev_status") == "O", "No direct edge").otherwise("")).alias("pred_decision"), "cf", "pred_cf",
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("gold_status"), F.col("prev_status").alias("pred_status"), (F.col("prev").isNotNull() & (F.col("o_orderkey") % 17 != 0)).alias("successful"), F.round(F.col("o_totalprice") / 100_000, 6).alias("runtime_seconds"),
    )


def _mixed_sql(prev: str, gold: str, n: int, k: int) -> str:
    return f"CASE WHEN {prev} IS NOT NULL THEN list_concat(list_concat({prev}[1:{n}], {gold}[{k}:]), {gold}[1:1]) END"


def _distinct_sql(column: str, name: str) -> str:
    return f"SELECT id, list(p ORDER BY i) AS {name} FROM (SELECT id, p, min(i) AS i FROM (SELECT id, unnest({column}) AS p, generate_subscripts({column}, 1) AS i FROM s0) GROUP BY ALL) GROUP BY id"


_ARTICLES = "list_transform({x}, lambda e: 'Điều ' || substr(e, 6))"
SAMPLES = f"""
li AS (SELECT l_orderkey AS k, 'part_' || l_partkey AS p, 'supp_' || l_suppkey AS e, l_returnflag || l_linestatus AS f, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rn FROM lineitem
), items AS (SELECT k, list(p ORDER BY o) AS items FROM (SELECT k, p, min(rn) AS o FROM li GROUP BY ALL) GROUP BY k
), evs AS (SELECT k, list(e ORDER BY o) AS events FROM (SELECT k, e, min(rn) AS o FROM li GROUP BY ALL) GROUP BY k
), said AS (SELECT k, string_agg(f, ' ' ORDER BY rn) AS answer FROM li GROUP BY k
), o AS (SELECT *, coalesce(items, []::VARCHAR[]) AS gold, coalesce(events, []::VARCHAR[]) AS gold_events, coalesce(answer, '') AS gold_answer, o_totalprice > 250000 AS cf
  FROM orders LEFT JOIN items ON items.k = o_orderkey LEFT JOIN evs ON evs.k = o_orderkey LEFT JOIN said ON said.k = o_orderkey
), o2 AS (SELECT *, {_ARTICLES.format(x="gold_events[1:3]")} AS gold_citations, lag(gold) OVER w AS prev, lag(gold_events) OVER w AS prev_events, lag(gold_answer) OVER w AS prev_answer, lag(o_orderstatus) OVER w AS prev_status, lag(cf) OVER w AS pred_cf FROM o WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)
), s0 AS (SELECT o_orderkey AS id, o_orderpriority AS question_type, o_orderstatus AS difficulty, gold, prev, {_mixed_sql("prev", "gold", 2, 3)} AS pred0, gold_events, prev_events, {_mixed_sql("prev_events", "gold_events", 1, 2)} AS pe0, gold_answer, concat_ws(' ', prev_answer[1:5], gold_answer[1:5]) AS pred_answer,
  gold_citations, CASE WHEN prev IS NOT NULL THEN list_concat({_ARTICLES.format(x="prev_events[1:1]")}, gold_citations[1:2]) ELSE [] END AS pred_citations, CASE o_orderstatus WHEN 'F' THEN 'SUPPORTED' WHEN 'O' THEN 'REJECT_DIRECT_CLAIM' ELSE 'UNCERTAIN' END AS gold_decision,
  CASE prev_status WHEN 'F' THEN 'SUPPORTED' WHEN 'O' THEN 'REJECT_DIRECT_CLAIM' ELSE '' END AS pred_decision, cf, pred_cf, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS gold_status, prev_status AS pred_status, prev IS NOT NULL AND o_orderkey % 17 <> 0 AS successful, round(o_totalprice / 100000, 6) AS runtime_seconds FROM o2
), dd AS ({_distinct_sql("pred0", "pred")}
), de AS ({_distinct_sql("pe0", "pred_events")}
), s AS (SELECT s0.*, CASE WHEN pred0 IS NOT NULL THEN coalesce(dd.pred, []) END AS pred, coalesce(dd.pred, []) AS pr, coalesce(de.pred_events, []) AS pe_ FROM s0 LEFT JOIN dd USING (id) LEFT JOIN de USING (id)
), m AS (
  SELECT *, len(list_intersect(pr, gold)) AS tp, len(pr) AS np, len(gold) AS ng,
    CASE WHEN np > 0 THEN tp / np ELSE 0 END AS p6, CASE WHEN ng > 0 THEN tp / ng ELSE 0 END AS r6, CASE WHEN tp > 0 THEN 2 * tp / (np + ng) ELSE 0 END AS f6, (list_sort(pr) = list_sort(gold))::INT::DOUBLE AS exact FROM s
)"""


def _rounded(columns: dict) -> list:
    return [F.round(c, 6).alias(k) for k, c in columns.items()]


def _rows(s, d, make) -> DataFrame:
    rows = samples(s, d)
    return rows.select("id", *_rounded(make(F.col("pred"), F.col("gold"))))


def _turns(s, d) -> DataFrame:
    """Each turn of a conversation as the answer to the one before."""
    place = Window.partitionBy("conv_id").orderBy("turn")
    return table(s, d, "conversations").withColumn("before", F.lag("text").over(place)).where("before IS NOT NULL")


def _token_f1(s, d) -> DataFrame:
    rows = _turns(s, d).select("conv_id", "turn", *(t(F.col(c)).alias(f"{n}{v}") for v, t in ((6, T.tokens_v6), (7, T.tokens_v7)) for n, c in (("p", "before"), ("g", "text"))))
    for v in (6, 7):
        rows = M.with_token_f1(rows, ["conv_id", "turn"], F.col(f"p{v}"), F.col(f"g{v}"), f"f1_v{v}")
    return rows.select("conv_id", "turn", F.round("f1_v6", 6).alias("f1_v6"), F.round("f1_v7", 6).alias("f1_v7"))


def _at_k(p, g):
    out = {}
    for k in M.KS:
        out |= {f"hit_{k}": M.hit_at_k(p, g, k), f"hit7_{k}": M.hit_at_k(p, g, k, 1.0), f"recall_{k}": M.recall_at_k(p, g, k), f"precision_{k}": M.precision_at_k(p, g, k)}
    return out


def _best_path(s, d) -> DataFrame:
    rows = samples(s, d)
    two = F.array(F.struct(F.col("pred").alias("nodes"), F.col("pred_events").alias("rules")), F.struct(F.col("prev").alias("nodes"), F.col("prev_events").alias("rules")))
    rows = rows.select("id", F.col("gold").alias("gold_nodes"), F.col("gold_events").alias("gold_rules"), F.posexplode(two).alias("rank", "_p")).select("id", "gold_nodes", "gold_rules", "rank", "_p.*")
    best = M.best_path(rows, "id")
    return best.select("id", "rank", *(F.round(c, 6).alias(c) for c in ("exact_path", "edge_f1", "node_f1", "path_rule_f1", "final_event")))


def _edges(c):
    return M.pairs(F.coalesce(F.col(c), F.array().cast("array<string>")))


def _scored(s, d) -> DataFrame:
    rows = samples(s, d)
    k = M.primary_k()
    out = M.with_token_f1(rows, ["id"], T.tokens_v6(F.col("pred_answer")), T.tokens_v6(F.col("gold_answer")), "answer_f1")
    exact = F.when(F.size(_edges("gold")) > 0, (_edges("pred") == _edges("gold")).cast("double"))
    out = out.withColumns({"missing": F.col("pred").isNull(), "rule_recall": M.recall_at_k(F.col("pred"), F.col("gold"), k), "event_recall": M.recall_at_k(F.col("pred_events"), F.col("gold_events"), k), "rr": M.reciprocal_rank(F.col("pred"), F.col("gold")), "exact_path": exact,
                           "citation_recall": M.set_metrics_v6(F.col("pred_citations"), F.col("gold_citations"))["recall"], "verification_correct": ((F.col("pred_decision") != "") & (F.col("pred_decision") == F.col("gold_decision"))).cast("double")})
    return out.withColumn("errors", M.errors_v6({c: F.col(c) for c in ("missing", "rule_recall", "event_recall", "exact_path", "verification_correct", "answer_f1", "citation_recall")}))


SEVEN = ["rule_recall", "rule_f1", "top1_exact_path", "edge_f1", "path_rule_f1", "cf_status_accuracy", "reachability_accuracy", "answer_label_accuracy", "answer_f1"]


def _scored_v7(s, d) -> DataFrame:
    rows = samples(s, d)
    out = M.with_token_f1(rows, ["id"], T.tokens_v7(F.col("pred_answer")), T.tokens_v7(F.col("gold_answer")), "answer_f1")
    rule, path = M.set_metrics_v7(F.col("pred"), F.col("gold")), M.path_metrics_v7(F.col("pred"), F.col("gold"))
    out = out.withColumns({"rule_recall": rule["recall"], "rule_f1": rule["f1"], "top1_exact_path": path["exact_path"], "edge_f1": path["edge_f1"], "path_rule_f1": M.path_rule_metrics_v7(F.col("pred_events"), F.col("gold_events"))["path_rule_f1"],
                           "cf_status_accuracy": M.label_accuracy_v7(F.col("pred_status"), F.col("gold_status")), "reachability_accuracy": M.label_accuracy_v7(F.col("pred_cf"), F.col("cf")), "answer_label_accuracy": M.label_accuracy_v7(F.col("pred_decision"), F.col("gold_decision"))})
    return out.withColumn("errors", M.errors_v7({c: F.col(c) for c in ["successful", *SEVEN]}))


def _path_v6(s, d) -> DataFrame:
    m = M.path_metrics_v6(_edges("pred"), _edges("gold"), F.col("pred_events"), F.col("gold_events"))
    return samples(s, d).select("id", *_rounded(m))


def _micro(s, d) -> DataFrame:
    rows = samples(s, d).where("pred IS NOT NULL")
    seven = M.set_metrics_v7(F.col("pred"), F.col("gold"))
    out = M.micro(rows.select(seven["true_positive"].alias("tp"), F.size("pred").alias("np"), F.size("gold").alias("ng")), "tp", "np", "ng")
    return out.select("tp", "n_predicted", "n_gold", *(F.round(c, 6).alias(c) for c in ("micro_precision", "micro_recall", "micro_f1")))


QUERIES = {
    "set_metrics_v6": lambda s, d: _rows(s, d, M.set_metrics_v6),
    "set_metrics_v7": lambda s, d: _rows(s, d, lambda p, g: {k: v for k, v in M.set_metrics_v7(p, g).items() if k != "true_positive"}),
    "hit_recall_precision_at_k": lambda s, d: _rows(s, d, _at_k),
    "mrr_map": lambda s, d: _rows(s, d, lambda p, g: {"mrr": M.reciprocal_rank(p, g), "map": M.average_precision(p, g)}),
    "token_f1": lambda s, d: _token_f1(s, d),
    "answer_exact": lambda s, d: _turns(s, d).select("conv_id", "turn", (T.text_v6(F.col("before")) == T.text_v6(F.col("text"))).alias("em_v6"), (T.text_v7(F.col("before")) == T.text_v7(F.col("text"))).alias("em_v7")),
    "rouge_l": lambda s, d: _turns(s, d).select("conv_id", "turn", F.round(M.rouge_l(T.tokens_v6(F.col("before")), T.tokens_v6(F.col("text"))), 6).alias("rouge_l")),
    "hop_accuracy": lambda s, d: _rows(s, d, lambda p, g: {"hop_accuracy": M.hop_accuracy(M.pairs(F.coalesce(p, F.array().cast("array<string>"))), M.pairs(g))}),
    "path_metrics_v7": lambda s, d: _rows(s, d, M.path_metrics_v7),
    "oracle_best_path": _best_path,
    "confusion_matrix": lambda s, d: M.confusion(samples(s, d), "gold_decision", "pred_decision"),
    "binary_cf": lambda s, d: M.binary(samples(s, d), "gold_decision", "pred_decision", "cf").select("cf", "tp", "fp", "tn", "fn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "accuracy"))),
    "micro_scores": _micro,
    "grouped_report": lambda s, d: M.grouped_report(_scored(s, d), ["rule_recall", "answer_f1", "rr", "verification_correct"], "question_type", "difficulty").select("level", "value", "n", *(F.round(c, 6).alias(c) for c in ("rule_recall", "answer_f1", "rr", "verification_correct"))),
    "error_taxonomy": lambda s, d: _scored(s, d).select("id", F.array_join("errors", "|").alias("errors")),
    "error_report": lambda s, d: M.error_report(_scored(s, d), "errors", "id"),
    "error_rows": lambda s, d: M.error_rows(_scored(s, d), "errors", "id"),
    "anti_missing_predictions": lambda s, d: samples(s, d).select("id").join(samples(s, d).where("pred IS NOT NULL").select("id"), "id", "left_anti"),
    "unmatched_ids": lambda s, d: M.unmatched(samples(s, d).where("id % 3 <> 0"), samples(s, d).where("pred IS NOT NULL"), "id"),
    "path_metrics_v6": _path_v6,
    "path_rule_metrics_v7": lambda s, d: samples(s, d).select("id", *_rounded(M.path_rule_metrics_v7(F.col("pred_events"), F.col("gold_events")))),
    "errors_v7": lambda s, d: _scored_v7(s, d).where(F.size("errors") > 0).select("id", F.array_join("errors", "|").alias("errors")),
    "macro_v7": lambda s, d: M.macro_v7(_scored_v7(s, d), SEVEN, "question_type", "difficulty").select("level", "value", "n", "n_successful", "n_failed", *(F.round(c, 6).alias(c) for c in ["success_rate", *SEVEN])),
    "runtime_stats": lambda s, d: M.macro_v7(samples(s, d), [], "question_type").select("level", "value", "n_successful", F.round("mean_runtime", 6).alias("mean_runtime"), F.round("median_runtime", 6).alias("median_runtime")),
    "citation_metrics": lambda s, d: samples(s, d).select("id", *_rounded(M.set_metrics_v6(F.col("pred_citations"), F.col("gold_citations")))),
    "label_accuracy_v7": lambda s, d: samples(s, d).select("id", M.label_accuracy_v7(F.col("pred_status"), F.col("gold_status")).alias("accuracy")),
    "report_numbers": lambda s, d: table(s, d, "orders").select("o_orderkey", M.percentage(F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderkey") % 1000 / 1024)).alias("share"), M.finite(F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).otherwise(float("nan")), 1).alias("number")),
    "oracle_mode": lambda s, d: samples(s, d).select(*_rounded({k: F.avg(c) for k, c in {**{f"v6_{n}": c for n, c in M.set_metrics_v6(F.col("gold"), F.col("gold")).items()}, "v7_f1": M.set_metrics_v7(F.col("gold"), F.col("gold"))["f1"]}.items()})),
    "citations": lambda s, d: table(s, d, "orders").select("o_orderkey", F.array_join(T.article_citations(F.array(F.col("o_custkey").cast("string"), F.concat(F.lit("điều "), "o_orderkey"), F.col("o_orderpriority")), F.concat(F.lit("Theo Điều "), "o_custkey", F.lit(" và điều 7.1"))), ",").alias("citations")),
}


def _k(k: int) -> str:
    top, hit = f"pr[1:{k}]", f"len(list_intersect(pr[1:{k}], gold))"
    return f"CASE WHEN {hit} > 0 THEN 1.0::DOUBLE ELSE 0.0 END AS hit_{k}, CASE WHEN ng = 0 OR {hit} > 0 THEN 1.0::DOUBLE ELSE 0.0 END AS hit7_{k}, round(CASE WHEN ng = 0 THEN 1 ELSE {hit} / ng END, 6) AS recall_{k}, round(CASE WHEN len({top}) > 0 THEN {hit} / len({top}) ELSE 0 END, 6) AS precision_{k}"


def _tok(x: str, v: int) -> str:
    if v == 6:
        return f"regexp_extract_all(lower({x}), '[0-9A-Za-zÀ-ỹĐđ]+(?:[''’-][0-9A-Za-zÀ-ỹĐđ]+)?')"
    return rf"list_filter(string_split(trim(regexp_replace(lower(strip_accents(replace(replace({x}, 'đ', 'd'), 'Đ', 'D'))), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' '), lambda t: t <> '')"


TURNS = "t AS (SELECT * FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) WHERE before IS NOT NULL)"


def _f1(v: int) -> str:
    return f"""SELECT conv_id, turn, CASE WHEN na = 0 AND nb = 0 THEN 1 WHEN na + nb = 0 OR coalesce(both_, 0) = 0 THEN 0 ELSE 2 * both_ / (na + nb) END AS f1 FROM (SELECT conv_id, turn, len({_tok("before", v)}) AS na, len({_tok("text", v)}) AS nb FROM t) LEFT JOIN (
      SELECT conv_id, turn, sum(least(a, b)) AS both_ FROM (SELECT conv_id, turn, w, count(*) FILTER (WHERE side = 0) AS a, count(*) FILTER (WHERE side = 1) AS b FROM (
        SELECT conv_id, turn, 0 AS side, unnest({_tok("before", v)}) AS w FROM t UNION ALL SELECT conv_id, turn, 1, unnest({_tok("text", v)}) FROM t) GROUP BY ALL) GROUP BY ALL) USING (conv_id, turn)"""


_PAIRS = "list_transform(range(1, len({x})), lambda i: {x}[i] || '>>' || {x}[i + 1])"
_PATH = f"""pm AS (SELECT *, {_PAIRS.format(x="pr")} AS pe, {_PAIRS.format(x="gold")} AS ge FROM m), pn AS (
  SELECT *, len(list_intersect(pe, ge)) AS etp, len(list_distinct(pe)) AS ep, len(list_distinct(ge)) AS eg FROM pm)"""


def _p7(tp: str, a: str, b: str) -> tuple[str, str, str]:
    p = f"CASE WHEN {a} > 0 THEN {tp} / {a} WHEN {b} = 0 THEN 1 ELSE 0 END"
    r = f"CASE WHEN {b} > 0 THEN {tp} / {b} WHEN {a} = 0 THEN 1 ELSE 0 END"
    return p, r, f"CASE WHEN {a} = 0 AND {b} = 0 THEN 1 WHEN {tp} = 0 THEN 0 ELSE 2 * {tp} / ({a} + {b}) END"


_N7, _E7 = _p7("tp", "np", "ng"), _p7("etp", "ep", "eg")
def _answer_f1(v: int) -> str:
    """id, f1 of the predicted answer's tokens against gold's, as multisets. Flags are words of two letters."""
    t = lambda x: f"list_filter(string_split(lower({x}), ' '), lambda t: t <> '')"
    return f"""SELECT id, CASE WHEN na = 0 AND nb = 0 THEN 1 WHEN na + nb = 0 OR coalesce(both_, 0) = 0 THEN 0 ELSE 2 * both_ / (na + nb) END AS f1 FROM (SELECT id, len({t("pred_answer")}) AS na, len({t("gold_answer")}) AS nb FROM s) LEFT JOIN (
      SELECT id, sum(least(a, b)) AS both_ FROM (SELECT id, w, count(*) FILTER (WHERE side = 0) AS a, count(*) FILTER (WHERE side = 1) AS b FROM (
        SELECT id, 0 AS side, unnest({t("pred_answer")}) AS w FROM s UNION ALL SELECT id, 1, unnest({t("gold_answer")}) FROM s) GROUP BY ALL) GROUP BY ALL) USING (id)"""


_SCORED = f"""{_PATH}, af AS ({_answer_f1(6)}), sc AS (
  SELECT *, pred IS NULL AS missing, CASE WHEN ng = 0 THEN 1 ELSE len(list_intersect(pr[1:5], gold)) / ng END AS rule_recall, CASE WHEN len(gold_events) = 0 THEN 1 ELSE len(list_intersect(pe_[1:5], gold_events)) / len(gold_events) END AS event_recall, f1 AS answer_f1,
    CASE WHEN len(gold_citations) > 0 THEN len(list_intersect(pred_citations, gold_citations)) / len(gold_citations) ELSE 0 END AS citation_recall,
    coalesce(1 / list_min(list_filter(range(1, len(pr) + 1), lambda i: list_contains(gold, pr[i]))), 0) AS rr, (pred_decision <> '' AND pred_decision = gold_decision)::INT::DOUBLE AS verification_correct, CASE WHEN len(ge) > 0 THEN (pe = ge)::INT END AS exact_path FROM pn JOIN af USING (id)
), er AS (SELECT *, CASE WHEN missing THEN ['MISSING_PREDICTION'] ELSE list_filter([CASE WHEN rule_recall < 1 THEN 'RULE_RETRIEVAL_MISS' END, CASE WHEN event_recall < 1 THEN 'EVENT_RETRIEVAL_MISS' END, CASE WHEN exact_path < 1 THEN 'PATH_MISMATCH' END,
    CASE WHEN verification_correct < 1 THEN 'VERIFICATION_ERROR' END, CASE WHEN answer_f1 < 0.5 THEN 'LOW_ANSWER_F1' END, CASE WHEN citation_recall < 1 THEN 'CITATION_MISS' END], lambda x: x IS NOT NULL) END AS errors FROM sc)"""


def _sets(a: str, b: str) -> str:
    return f"len(list_intersect({a}, {b}))"


_R7 = _p7(_sets("pe_", "gold_events"), "len(pe_)", "len(gold_events)")
_SCORED7 = f"""{_PATH}, af AS ({_answer_f1(7)}), s7 AS (
  SELECT *, {_N7[1]} AS rule_recall, {_N7[2]} AS rule_f1, (pr = gold)::INT::DOUBLE AS top1_exact_path, {_E7[2]} AS edge_f1, {_R7[2]} AS path_rule_f1, CASE WHEN gold_status IS NOT NULL THEN coalesce(pred_status = gold_status, false)::INT::DOUBLE END AS cf_status_accuracy,
    coalesce(pred_cf = cf, false)::INT::DOUBLE AS reachability_accuracy, (pred_decision = gold_decision)::INT::DOUBLE AS answer_label_accuracy, f1 AS answer_f1 FROM pn JOIN af USING (id)
), e7 AS (SELECT *, CASE WHEN NOT successful THEN ['PIPELINE_ERROR'] ELSE list_filter([CASE WHEN rule_recall < 1 THEN 'MISSED_GOLD_RULE' END, CASE WHEN top1_exact_path < 1 THEN 'TOP1_PATH_MISMATCH' END, CASE WHEN cf_status_accuracy < 1 THEN 'COUNTERFACTUAL_STATUS_MISMATCH' END,
    CASE WHEN reachability_accuracy < 1 THEN 'REACHABILITY_MISMATCH' END, CASE WHEN answer_label_accuracy < 1 THEN 'ANSWER_LABEL_MISMATCH' END, CASE WHEN answer_f1 < 0.5 THEN 'LOW_ANSWER_TOKEN_F1' END], lambda x: x IS NOT NULL) END AS errors FROM s7)"""
_MEANS7 = "count(*) AS n, count(*) FILTER (WHERE successful) AS n_successful, count(*) FILTER (WHERE NOT successful) AS n_failed, round(avg(successful::INT), 6) AS success_rate, " + ", ".join(f"round(avg({c}) FILTER (WHERE successful), 6) AS {c}" for c in SEVEN)
_RUNTIME = "count(*) FILTER (WHERE successful) AS n_successful, round(avg(runtime_seconds) FILTER (WHERE successful), 6) AS mean_runtime, round(median(runtime_seconds) FILTER (WHERE successful), 6) AS median_runtime"
_BEST = f"""z AS (SELECT id, 0 AS rank, pr AS nodes, pe_ AS rules, gold, gold_events FROM m UNION ALL SELECT id, 1, coalesce(prev, []), coalesce(prev_events, []), gold, gold_events FROM m
), z1 AS (SELECT *, {_PAIRS.format(x="nodes")} AS pe, {_PAIRS.format(x="gold")} AS ge FROM z
), z2 AS (SELECT id, rank, (nodes = gold)::INT::DOUBLE AS exact_path, round({_p7(_sets("pe", "ge"), "len(list_distinct(pe))", "len(list_distinct(ge))")[2]}, 9) AS edge_f1, round({_p7(_sets("nodes", "gold"), "len(list_distinct(nodes))", "len(list_distinct(gold))")[2]}, 9) AS node_f1,
    round({_p7(_sets("rules", "gold_events"), "len(rules)", "len(gold_events)")[2]}, 9) AS path_rule_f1, (len(nodes) > 0 AND len(gold) > 0 AND nodes[-1] = gold[-1])::INT::DOUBLE AS final_event FROM z1)"""


def _v6(tp: str, a: str, b: str) -> tuple[str, str, str]:
    return f"CASE WHEN {a} > 0 THEN {tp} / {a} ELSE 0 END", f"CASE WHEN {b} > 0 THEN {tp} / {b} ELSE 0 END", f"CASE WHEN {tp} > 0 THEN 2 * {tp} / ({a} + {b}) ELSE 0 END"


_PE6, _PV6 = _v6("etp", "ep", "eg"), _v6(_sets("pe_", "gold_events"), "len(pe_)", "len(gold_events)")
_PC6 = _v6(_sets("pred_citations", "gold_citations"), "len(list_distinct(pred_citations))", "len(gold_citations)")
_ONLY = "CASE WHEN len(ge) > 0 THEN round({x}, 6)::DOUBLE END"
_MEANS = "count(*) AS n, round(avg(rule_recall), 6) AS rule_recall, round(avg(answer_f1), 6) AS answer_f1, round(avg(rr), 6) AS rr, round(avg(verification_correct), 6) AS verification_correct"
_LABELS = "['SUPPORTED', 'REJECT_DIRECT_CLAIM', 'UNCERTAIN', 'MISSING']"

SQL = {
    "set_metrics_v6": f'WITH {SAMPLES} SELECT id, round(p6, 6) AS "precision", round(r6, 6) AS recall, round(f6, 6) AS f1, exact FROM m',
    "set_metrics_v7": f'WITH {SAMPLES} SELECT id, round({_N7[0]}, 6) AS "precision", round({_N7[1]}, 6) AS recall, round({_N7[2]}, 6) AS f1, exact FROM m',
    "hit_recall_precision_at_k": f"WITH {SAMPLES} SELECT id, {', '.join(_k(k) for k in M.KS)} FROM m",
    "mrr_map": f"""WITH {SAMPLES}, r AS (SELECT id, ng, list_filter(range(1, len(pr) + 1), lambda i: list_contains(gold, pr[i])) AS ranks FROM m)
      SELECT id, round(coalesce(1 / ranks[1], 0), 6) AS mrr, round(CASE WHEN ng = 0 THEN 1 ELSE coalesce(list_sum(list_transform(range(1, len(ranks) + 1), lambda i: i / ranks[i])), 0) / ng END, 6) AS map FROM r""",
    "token_f1": f"WITH {TURNS} SELECT conv_id, turn, round(a.f1, 6) AS f1_v6, round(b.f1, 6) AS f1_v7 FROM ({_f1(6)}) a JOIN ({_f1(7)}) b USING (conv_id, turn)",
    "hop_accuracy": f"""WITH {SAMPLES}, {_PATH} SELECT id, round(CASE WHEN len(ge) = 0 THEN (len(pe) = 0)::INT ELSE len(list_filter(range(1, len(ge) + 1), lambda i: pe[i] = ge[i])) / len(ge) END, 6)::DOUBLE AS hop_accuracy FROM pn""",
    "path_metrics_v7": f"""WITH {SAMPLES}, {_PATH} SELECT id, round({_N7[0]}, 6) AS node_precision, round({_N7[1]}, 6) AS node_recall, round({_N7[2]}, 6) AS node_f1, round({_E7[0]}, 6) AS edge_precision, round({_E7[1]}, 6) AS edge_recall, round({_E7[2]}, 6) AS edge_f1,
      (np > 0 AND ng > 0 AND pr[-1] = gold[-1])::INT::DOUBLE AS final_event, (pr = gold)::INT::DOUBLE AS exact_path FROM pn""",
    "confusion_matrix": f"""WITH {SAMPLES}, c AS (SELECT gold_decision AS gold, CASE WHEN pred_decision = '' THEN 'MISSING' ELSE pred_decision END AS predicted, count(*) AS n FROM s GROUP BY ALL), g AS (SELECT a AS gold, b AS predicted FROM (SELECT unnest({_LABELS}) AS a), (SELECT unnest({_LABELS}) AS b))
      SELECT gold, predicted, coalesce(n, 0) AS n FROM g LEFT JOIN c USING (gold, predicted)""",
    "binary_cf": f"""WITH {SAMPLES}, b AS (SELECT cf, count(*) FILTER (WHERE g AND p) AS tp, count(*) FILTER (WHERE NOT g AND p) AS fp, count(*) FILTER (WHERE NOT g AND NOT p) AS tn, count(*) FILTER (WHERE g AND NOT p) AS fn
        FROM (SELECT cf, gold_decision = 'REJECT_DIRECT_CLAIM' AS g, pred_decision = 'REJECT_DIRECT_CLAIM' AS p FROM s) GROUP BY cf)
      SELECT *, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS "precision", round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy FROM b""",
    "micro_scores": f"""WITH {SAMPLES} SELECT sum(tp)::BIGINT AS tp, sum(np)::BIGINT AS n_predicted, sum(ng)::BIGINT AS n_gold, round(sum(tp) / sum(np), 6) AS micro_precision, round(sum(tp) / sum(ng), 6) AS micro_recall, round(2 * sum(tp) / (sum(np) + sum(ng)), 6) AS micro_f1 FROM m WHERE pred IS NOT NULL""",
    "grouped_report": f"""WITH {SAMPLES}, {_SCORED} SELECT 'all' AS level, 'all' AS value, {_MEANS} FROM sc UNION ALL SELECT 'question_type', question_type, {_MEANS} FROM sc GROUP BY question_type UNION ALL SELECT 'difficulty', difficulty, {_MEANS} FROM sc GROUP BY difficulty""",
    "error_taxonomy": f"WITH {SAMPLES}, {_SCORED} SELECT id, array_to_string(errors, '|') AS errors FROM er",
    "error_report": f"WITH {SAMPLES}, {_SCORED} SELECT error, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM (SELECT id, unnest(errors) AS error FROM er) GROUP BY error",
    "error_rows": f"WITH {SAMPLES}, {_SCORED} SELECT id, unnest(errors) AS error FROM er",
    "unmatched_ids": f"WITH {SAMPLES} SELECT id, 'missing' AS side FROM s WHERE id % 3 <> 0 AND pred IS NULL UNION ALL SELECT id, 'unexpected' FROM s WHERE id % 3 = 0 AND pred IS NOT NULL",
    "path_metrics_v6": f"WITH {SAMPLES}, {_PATH} SELECT id, " + ", ".join(f"{_ONLY.format(x=x)} AS {n}" for n, x in {
        "exact_path_accuracy": "(pe = ge)::INT", "hop_accuracy": "len(list_filter(range(1, len(ge) + 1), lambda i: pe[i] = ge[i])) / len(ge)", "path_edge_precision": _PE6[0], "path_edge_recall": _PE6[1], "path_edge_f1": _PE6[2],
        "path_length_accuracy": "(len(pe) = len(ge))::INT", "path_event_precision": _PV6[0], "path_event_recall": _PV6[1], "path_event_f1": _PV6[2]}.items()) + " FROM pn",
    "path_rule_metrics_v7": f"WITH {SAMPLES} SELECT id, round({_R7[0]}, 6) AS path_rule_precision, round({_R7[1]}, 6) AS path_rule_recall, round({_R7[2]}, 6) AS path_rule_f1, (pe_ = gold_events)::INT::DOUBLE AS exact_rule_path FROM s",
    "oracle_best_path": f"""WITH {SAMPLES}, {_BEST} SELECT id, rank::BIGINT AS rank, exact_path, round(edge_f1, 6) AS edge_f1, round(node_f1, 6) AS node_f1, round(path_rule_f1, 6) AS path_rule_f1, final_event
      FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY exact_path DESC, edge_f1 DESC, node_f1 DESC, path_rule_f1 DESC, final_event DESC, rank) AS k FROM z2) WHERE k = 1""",
    "errors_v7": f"WITH {SAMPLES}, {_SCORED7} SELECT id, array_to_string(errors, '|') AS errors FROM e7 WHERE len(errors) > 0",
    "macro_v7": f"""WITH {SAMPLES}, {_SCORED7} SELECT 'all' AS level, 'all' AS value, {_MEANS7} FROM s7 UNION ALL SELECT 'question_type', question_type, {_MEANS7} FROM s7 GROUP BY question_type UNION ALL SELECT 'difficulty', difficulty, {_MEANS7} FROM s7 GROUP BY difficulty""",
    "runtime_stats": f"WITH {SAMPLES} SELECT 'all' AS level, 'all' AS value, {_RUNTIME} FROM s UNION ALL SELECT 'question_type', question_type, {_RUNTIME} FROM s GROUP BY question_type",
    "citation_metrics": f'WITH {SAMPLES} SELECT id, round({_PC6[0]}, 6) AS "precision", round({_PC6[1]}, 6) AS recall, round({_PC6[2]}, 6) AS f1, (list_sort(list_distinct(pred_citations)) = list_sort(gold_citations))::INT::DOUBLE AS exact FROM s',
    "label_accuracy_v7": f"WITH {SAMPLES} SELECT id, CASE WHEN gold_status IS NOT NULL THEN coalesce(pred_status = gold_status, false)::INT::DOUBLE END AS accuracy FROM s",
    "report_numbers": "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'N/A' ELSE printf('%.2f%%', (o_orderkey % 1000) / 1024 * 100) END AS share, CASE WHEN o_orderkey % 7 <> 0 THEN round(o_totalprice, 1) END AS number FROM orders",
    "anti_missing_predictions": f"WITH {SAMPLES} SELECT id FROM s WHERE pred IS NULL",
    "oracle_mode": f'WITH {SAMPLES}, z AS (SELECT avg((ng > 0)::INT) AS a FROM m) SELECT round(a, 6) AS "v6_precision", round(a, 6) AS v6_recall, round(a, 6) AS v6_f1, 1.0::DOUBLE AS v6_exact, 1.0::DOUBLE AS v7_f1 FROM z',
    "citations": "SELECT o_orderkey, array_to_string(list_filter([CASE WHEN true THEN 'Điều ' || o_custkey END, CASE WHEN o_orderkey <> o_custkey THEN 'Điều ' || o_orderkey END, o_orderpriority, 'Điều 7.1'], lambda x: x IS NOT NULL), ',') AS citations FROM orders",
    "answer_exact": rf"WITH {TURNS} SELECT conv_id, turn, trim(regexp_replace(lower(before), '[^\p{{L}}\p{{N}}_]+', ' ', 'g')) = trim(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}_]+', ' ', 'g')) AS em_v6, {_tok('before', 7)} = {_tok('text', 7)} AS em_v7 FROM t",
}
