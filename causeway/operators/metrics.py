"""Retrieval and answer metrics of both generations.

v6 and v7 disagree on empty sets (v6: 0, v7: 1 where both are empty) and on hit@k without gold (0 and 1);
functions are named by generation where it matters. Arguments are array columns of strings, null counts
as empty.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.functions.text import ordered_distinct

KS = (1, 3, 5, 10)


def _array(x: Column) -> Column:
    return F.coalesce(x, F.array().cast("array<string>"))


def _div(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def harmonic(p: Column, r: Column) -> Column:
    return _div(2 * p * r, p + r)


def set_metrics_v6(predicted: Column, gold: Column) -> dict[str, Column]:
    p, g = ordered_distinct(_array(predicted)), ordered_distinct(_array(gold))
    both = F.size(F.array_intersect(p, g))
    precision, recall = _div(both, F.size(p)), _div(both, F.size(g))
    return {"precision": precision, "recall": recall, "f1": harmonic(precision, recall), "exact": (F.array_sort(p) == F.array_sort(g)).cast("double")}


def set_metrics_v7(predicted: Column, gold: Column) -> dict[str, Column]:
    p, g = F.array_distinct(_array(predicted)), F.array_distinct(_array(gold))
    both = F.size(F.array_intersect(p, g))
    precision = F.when(F.size(p) > 0, _div(both, F.size(p))).when(F.size(g) == 0, 1.0).otherwise(0.0)
    recall = F.when(F.size(g) > 0, _div(both, F.size(g))).when(F.size(p) == 0, 1.0).otherwise(0.0)
    return {"precision": precision, "recall": recall, "f1": harmonic(precision, recall), "exact": (F.array_sort(p) == F.array_sort(g)).cast("double"), "true_positive": both}


def hit_at_k(predicted: Column, gold: Column, k: int, empty: float = 0.0) -> Column:
    """``empty``: the value without gold, 0 in v6 and 1 in v7."""
    p, g = ordered_distinct(_array(predicted)), ordered_distinct(_array(gold))
    return F.when(F.size(g) == 0, F.lit(empty)).otherwise(F.arrays_overlap(F.slice(p, 1, k), g).cast("double"))


def recall_at_k(predicted: Column, gold: Column, k: int) -> Column:
    p, g = ordered_distinct(_array(predicted)), ordered_distinct(_array(gold))
    return F.when(F.size(g) == 0, 1.0).otherwise(_div(F.size(F.array_intersect(F.slice(p, 1, k), g)), F.size(g)))


def precision_at_k(predicted: Column, gold: Column, k: int) -> Column:
    """Over the results that are there, which may be fewer than k."""
    p, g = F.slice(ordered_distinct(_array(predicted)), 1, k), ordered_distinct(_array(gold))
    return _div(F.size(F.array_intersect(p, g)), F.size(p))


def _ranks(p: Column, g: Column) -> Column:
    """1-based ranks of the predictions that are gold."""
    return F.filter(F.transform(p, lambda x, i: F.when(F.array_contains(g, x), i + 1)), lambda i: i.isNotNull())


def reciprocal_rank(predicted: Column, gold: Column) -> Column:
    ranks = _ranks(ordered_distinct(_array(predicted)), ordered_distinct(_array(gold)))
    return F.when(F.size(ranks) > 0, 1.0 / ranks[0]).otherwise(0.0)


def average_precision(predicted: Column, gold: Column, repeats_take_ranks: bool = False) -> Column:
    """Over the number of gold items. v7 does not dedupe first: a repeat counts for nothing but takes a rank."""
    g = ordered_distinct(_array(gold))
    p = _array(predicted) if repeats_take_ranks else ordered_distinct(_array(predicted))
    firsts = F.transform(p, lambda x, i: F.when((F.array_position(p, x) == i + 1) & F.array_contains(g, x), i + 1))
    ranks = F.filter(firsts, lambda i: i.isNotNull())
    total = F.aggregate(F.transform(ranks, lambda r, i: (i + 1) / r), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(g) == 0, 1.0).otherwise(_div(total, F.size(g)))


def with_token_f1(rows: DataFrame, keys: list[str], predicted: Column, gold: Column, name: str) -> DataFrame:
    """``rows`` with the F1 of two token arrays as multisets. Both empty 1, one empty 0. ``keys`` tell rows apart.

    Tokens are counted as rows, in one shuffle by key: arrays would be compared token by token.
    """
    side = lambda x, k: F.transform(x, lambda t: F.struct(t.alias("t"), F.lit(k).alias("s")))
    tokens = rows.select(*keys, F.explode(F.concat(side(predicted, 0), side(gold, 1))).alias("x")).repartition(*keys)
    counts = tokens.groupBy(*keys, "x.t").agg(F.count_if(F.col("x.s") == 0).alias("a"), F.count_if(F.col("x.s") == 1).alias("b"))
    both = counts.groupBy(*keys).agg(F.sum(F.least("a", "b")).alias("_both"), F.sum("a").alias("_a"), F.sum("b").alias("_b"))
    value = F.when(F.col("_a").isNull(), 1.0).otherwise(_div(2 * F.col("_both"), F.col("_a") + F.col("_b")))
    return rows.join(both, keys, "left").withColumn(name, value).drop("_both", "_a", "_b")


def lcs(a: list, b: list) -> int:
    """Length of the longest common subsequence, by bit-parallel rows: one machine word for each 2^k tokens of the shorter side."""
    if len(a) < len(b):
        a, b = b, a
    where: dict = {}
    for i, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << i
    full = row = (1 << len(b)) - 1
    for x in a:
        hit = row & where.get(x, 0)
        row = (row + hit | row - hit) & full
    return len(b) - row.bit_count()


def rouge_l(predicted: Column, gold: Column) -> Column:
    """F1 of the longest common subsequence of two token arrays. Both empty 1, one empty 0."""
    return F.pandas_udf(_rouge_l, "double")(predicted, gold)


def _rouge_l(predicted: pd.Series, gold: pd.Series) -> pd.Series:
    out = []
    for p, g in zip(predicted, gold):
        p, g = list(p) if p is not None else [], list(g) if g is not None else []
        n = lcs(p, g) if p and g else 0
        out.append(2.0 * n / (len(p) + len(g)) if p or g else 1.0)
    return pd.Series(out, dtype="float64")


def pairs(nodes: Column, sep: str = ">>") -> Column:
    """Consecutive nodes as edges."""
    return F.transform(F.slice(nodes, 2, F.greatest(F.size(nodes) - 1, F.lit(0))), lambda x, i: F.concat(nodes[i], F.lit(sep), x))


def hop_accuracy(predicted: Column, gold: Column) -> Column:
    """Edges right in their place, over gold; without gold 1 if nothing is predicted."""
    right = F.size(F.filter(F.transform(gold, lambda x, i: F.coalesce(F.get(predicted, i) == x, F.lit(False))), lambda ok: ok))
    return F.when(F.size(gold) == 0, (F.size(predicted) == 0).cast("double")).otherwise(_div(right, F.size(gold)))


def path_metrics_v6(predicted: Column, gold: Column, predicted_events: Column, gold_events: Column) -> dict[str, Column]:
    """Nine metrics of a path (arrays of edges, and of the events on it); all null where gold has no edges."""
    p, g = _array(predicted), _array(gold)
    edge, event = set_metrics_v6(p, g), set_metrics_v6(predicted_events, gold_events)
    out = {"exact_path_accuracy": (p == g).cast("double"), "hop_accuracy": hop_accuracy(p, g)} | {f"path_edge_{k}": edge[k] for k in ("precision", "recall", "f1")}
    out |= {"path_length_accuracy": (F.size(p) == F.size(g)).cast("double")} | {f"path_event_{k}": event[k] for k in ("precision", "recall", "f1")}
    return {k: F.when(F.size(g) > 0, v) for k, v in out.items()}


def path_rule_metrics_v7(predicted: Column, gold: Column) -> dict[str, Column]:
    """Of the rules along a path: P/R/F1 and whether the sequences are equal."""
    seven = set_metrics_v7(predicted, gold)
    return {f"path_rule_{k}": seven[k] for k in ("precision", "recall", "f1")} | {"exact_rule_path": (_array(predicted) == _array(gold)).cast("double")}


def best_path(rows: DataFrame, key: str) -> DataFrame:
    """Of each ``key`` the predicted path that is best by (exact, edge F1, node F1, rule F1, final event, smaller rank).

    rows: rank, nodes, rules, gold_nodes, gold_rules, a row for each path. Floats are compared to nine digits.
    """
    m = path_metrics_v7(F.col("nodes"), F.col("gold_nodes")) | path_rule_metrics_v7(F.col("rules"), F.col("gold_rules"))
    parts = {"exact_path": m["exact_path"], "edge_f1": F.round(m["edge_f1"], 9), "node_f1": F.round(m["node_f1"], 9), "path_rule_f1": F.round(m["path_rule_f1"], 9), "final_event": m["final_event"], "_back": -F.col("rank")}
    best = rows.select(key, F.struct(*(c.alias(n) for n, c in parts.items())).alias("_b")).groupBy(key).agg(F.max("_b").alias("_b"))
    return best.select(key, (-F.col("_b._back")).cast("long").alias("rank"), *(F.col(f"_b.{n}").alias(n) for n in parts if n != "_back"))


def path_metrics_v7(predicted: Column, gold: Column) -> dict[str, Column]:
    """Of node arrays: node and edge P/R/F1, final event, exact match."""
    p, g = _array(predicted), _array(gold)
    node, edge = set_metrics_v7(p, g), set_metrics_v7(pairs(p), pairs(g))
    out = {f"node_{k}": node[k] for k in ("precision", "recall", "f1")} | {f"edge_{k}": edge[k] for k in ("precision", "recall", "f1")}
    last = F.when((F.size(g) > 0) & (F.size(p) > 0), (F.try_element_at(p, F.lit(-1)) == F.try_element_at(g, F.lit(-1))).cast("double")).otherwise(0.0)
    return out | {"final_event": last, "exact_path": (p == g).cast("double")}


# The codes of both generations, in order.
CODES_V6 = ["RULE_RETRIEVAL_MISS", "EVENT_RETRIEVAL_MISS", "PATH_MISMATCH", "VERIFICATION_ERROR", "LOW_ANSWER_F1", "CITATION_MISS"]
CODES_V7 = ["MISSED_GOLD_RULE", "TOP1_PATH_MISMATCH", "COUNTERFACTUAL_STATUS_MISMATCH", "REACHABILITY_MISMATCH", "ANSWER_LABEL_MISMATCH", "LOW_ANSWER_TOKEN_F1"]
MISSING_PREDICTION, PIPELINE_ERROR = "MISSING_PREDICTION", "PIPELINE_ERROR"


def _codes(names: list[str], wrong: list[Column]) -> Column:
    return F.array_compact(F.array(*(F.when(F.coalesce(w, F.lit(False)), F.lit(n)) for n, w in zip(names, wrong, strict=True))))


def errors_v6(row: dict[str, Column]) -> Column:
    """Codes, in order; a question without a prediction has one of its own. Recalls are those at the primary k."""
    wrong = [row["rule_recall"] < 1, row["event_recall"] < 1, row["exact_path"] < 1, row["verification_correct"] < 1, row["answer_f1"] < 0.5, row["citation_recall"] < 1]
    return F.when(row["missing"], F.array(F.lit(MISSING_PREDICTION))).otherwise(_codes(CODES_V6, wrong))


def primary_k(ks: tuple[int, ...] = KS) -> int:
    return 5 if 5 in ks else max(ks)


def errors_v7(row: dict[str, Column]) -> Column:
    """Codes, in order; a failed question has one of its own. Accuracies that are null (no gold) are no errors."""
    absent = lambda c: F.coalesce(c, F.lit(0.0))
    wrong = [absent(row["rule_recall"]) < 1, absent(row["top1_exact_path"]) < 1, row["cf_status_accuracy"] < 1, row["reachability_accuracy"] < 1, row["answer_label_accuracy"] < 1, absent(row["answer_f1"]) < 0.5]
    return F.when(~row["successful"], F.array(F.lit(PIPELINE_ERROR))).otherwise(_codes(CODES_V7, wrong))


def label_accuracy_v7(predicted: Column, gold: Column) -> Column:
    """Null where there is no gold."""
    return F.when(gold.isNotNull(), F.coalesce(predicted == gold, F.lit(False)).cast("double"))


def error_rows(rows: DataFrame, errors: str, key: str) -> DataFrame:
    """(error, key): whom each code befell, as rows."""
    return rows.select(F.explode(errors).alias("error"), key)


def error_report(rows: DataFrame, errors: str, key: str) -> DataFrame:
    """Of each code how often it occurs and its first and last key; ``error_rows`` has them all."""
    return error_rows(rows, errors, key).groupBy("error").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first_id"), F.max(key).alias("last_id"))


def unmatched(gold: DataFrame, predictions: DataFrame, key: str) -> DataFrame:
    """(key, side): ids that only one of the two tables has, 'missing' (gold only) or 'unexpected' (predictions only)."""
    g, p = gold.select(key).distinct(), predictions.select(key).distinct()
    return g.join(p, key, "left_anti").withColumn("side", F.lit("missing")).unionByName(p.join(g, key, "left_anti").withColumn("side", F.lit("unexpected")))


def percentage(x: Column) -> Column:
    """12.34%, or N/A for what is no finite number."""
    return F.when(finite(x).isNull(), "N/A").otherwise(F.format_string("%.2f%%", F.bround(x * 100, 2)))


def finite(x: Column, digits: int | None = None) -> Column:
    """A number of a report: rounded if ``digits`` are given; NaN and infinite ones are null."""
    y = F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)
    return y if digits is None else F.round(y, digits)


# The labels that a confusion matrix always has.
LABELS = ["SUPPORTED", "REJECT_DIRECT_CLAIM", "UNCERTAIN", "MISSING"]


def confusion(rows: DataFrame, gold: str, predicted: str) -> DataFrame:
    """A row for each pair of a gold and a predicted label; blanks are MISSING. The usual labels are always there, others that occur extend both sides."""
    label = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) == "", "MISSING").otherwise(F.col(c))
    counts = rows.select(label(gold).alias("gold"), label(predicted).alias("predicted")).groupBy("gold", "predicted").agg(F.count(F.lit(1)).alias("n"))
    both = F.array_union(F.flatten(F.collect_list(F.array("gold", "predicted"))), F.array(*(F.lit(x) for x in LABELS)))
    labels = counts.agg(both.alias("l"))  # of the counts: as many as there are pairs of labels
    grid = labels.select(F.explode("l").alias("gold"), "l").select("gold", F.explode("l").alias("predicted"), F.lit(0).cast("bigint").alias("n"))
    return counts.unionByName(grid).groupBy("gold", "predicted").agg(F.sum("n").alias("n"))


def binary(rows: DataFrame, gold: str, predicted: str, *by) -> DataFrame:
    """TP, FP, TN, FN and rates for REJECT_DIRECT_CLAIM as the positive class."""
    g, p = (F.coalesce(F.col(c) == "REJECT_DIRECT_CLAIM", F.lit(False)) for c in (gold, predicted))
    out = rows.groupBy(*by).agg(F.count_if(g & p).alias("tp"), F.count_if(~g & p).alias("fp"), F.count_if(~g & ~p).alias("tn"), F.count_if(g & ~p).alias("fn"))
    precision, recall = _div(F.col("tp"), F.col("tp") + F.col("fp")), _div(F.col("tp"), F.col("tp") + F.col("fn"))
    return out.withColumns({"precision": precision, "recall": recall, "f1": harmonic(precision, recall), "accuracy": _div(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn"))})


def micro(rows: DataFrame, tp: str, predicted: str, gold: str) -> DataFrame:
    out = rows.agg(F.sum(tp).alias("tp"), F.sum(predicted).alias("n_predicted"), F.sum(gold).alias("n_gold"))
    precision, recall = _div(F.col("tp"), F.col("n_predicted")), _div(F.col("tp"), F.col("n_gold"))
    return out.withColumns({"micro_precision": precision, "micro_recall": recall, "micro_f1": harmonic(precision, recall)})


def grouped_report(rows: DataFrame, metrics: list[str], *by: str) -> DataFrame:
    """Means over all rows and over each value of each of ``by``, in one pass of grouping sets."""
    sets = "(), " + ", ".join(f"({c})" for c in by)
    means = ", ".join(f"avg(nanvl({m}, NULL)) AS {m}" for m in metrics)
    level = "CASE " + " ".join(f"WHEN grouping({c}) = 0 THEN '{c}'" for c in by) + " ELSE 'all' END AS level"
    value = "coalesce(" + ", ".join(f"CASE WHEN grouping({c}) = 0 THEN coalesce(nullif(cast({c} AS string), ''), 'UNKNOWN') END" for c in by) + ", 'all') AS value"
    return rows.sparkSession.sql(f"SELECT {level}, {value}, count(*) AS n, {means} FROM {{rows}} GROUP BY GROUPING SETS ({sets})", rows=rows)


def macro_v7(rows: DataFrame, metrics: list[str], *by: str) -> DataFrame:
    """Means over the successful rows, nulls left out: of all rows and of each value of each of ``by``; with counts, and mean and exact median of runtime_seconds."""
    ok = rows.withColumns({c: F.when(F.col("successful"), F.col(c)) for c in [*metrics, "runtime_seconds"]})
    sets = "(), " + ", ".join(f"({c})" for c in by)
    means = "".join(f", avg({m}) AS {m}" for m in metrics)
    level = "CASE " + " ".join(f"WHEN grouping({c}) = 0 THEN '{c}'" for c in by) + " ELSE 'all' END AS level"
    value = "coalesce(" + ", ".join(f"CASE WHEN grouping({c}) = 0 THEN coalesce(nullif(cast({c} AS string), ''), 'UNKNOWN') END" for c in by) + ", 'all') AS value"
    counts = "count(*) AS n, count_if(successful) AS n_successful, count_if(NOT successful) AS n_failed, avg(CAST(successful AS double)) AS success_rate, avg(runtime_seconds) AS mean_runtime, median(runtime_seconds) AS median_runtime"
    return ok.sparkSession.sql(f"SELECT {level}, {value}, {counts}{means} FROM {{ok}} GROUP BY GROUPING SETS ({sets})", ok=ok)
