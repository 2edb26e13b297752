"""Exact vector search in blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MEMORY_BLOCK, QUERY_BLOCK = 4096, 1024


def top_k(queries: DataFrame, memory: DataFrame, k: int, floors: dict[str, float]) -> DataFrame:
    """(question_id, memory_id, memory_type, score, rank): for each question and type the k best inner products not below the type's floor.

    queries: question_id, vector; memory: memory_id, memory_type, vector. Both sides are cut into blocks;
    a task multiplies one block with another and keeps k rows for each question and type, so what is
    shuffled afterwards grows with the questions, not with the memory. Ties go to the smaller memory_id.
    """
    n_m, n_q = (max(1, -(-df.count() // size)) for df, size in ((memory, MEMORY_BLOCK), (queries, QUERY_BLOCK)))
    m = memory.withColumn("_m", F.pmod(F.xxhash64("memory_id"), F.lit(n_m)).cast("int")).withColumn("_q", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))))
    q = queries.withColumn("_q", F.pmod(F.xxhash64("question_id"), F.lit(n_q)).cast("int")).withColumn("_m", F.explode(F.sequence(F.lit(0), F.lit(n_m - 1))))

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = ["question_id", "memory_id", "memory_type", "score"]
        found = []
        if len(left) and len(right):
            right = right.sort_values("memory_id", kind="stable")
            scores = np.round(np.stack(left["qv"]).astype(np.float64) @ np.stack(right["mv"]).astype(np.float64).T, 9)
            kinds, ids, questions = right["memory_type"].to_numpy(), right["memory_id"].to_numpy(), left["question_id"].to_numpy()
            for kind, floor in floors.items():
                own = np.flatnonzero(kinds == kind)
                x = scores[:, own]
                if not len(own):
                    continue
                least = np.partition(x, max(0, len(own) - k), axis=1)[:, max(0, len(own) - k)]
                row, col = np.nonzero(x >= np.maximum(least, floor)[:, None])  # k of a row, and what equals the last
                order = np.lexsort((col, -x[row, col], row))
                row, col = row[order], col[order]
                keep = np.arange(len(row)) - np.searchsorted(row, row) < k
                row, col = row[keep], col[keep]
                found.append(pd.DataFrame({"question_id": questions[row], "memory_id": ids[own[col]], "memory_type": kind, "score": x[row, col]}, columns=names))
        return pd.concat(found) if found else pd.DataFrame(columns=names)

    # Aliased throughout: both sides may come from one table.
    left = q.select(F.col("_m").alias("qm"), F.col("_q").alias("qq"), F.col("question_id"), F.col("vector").alias("qv"))
    right = m.select(F.col("_m").alias("mm"), F.col("_q").alias("mq"), F.col("memory_id"), F.col("memory_type"), F.col("vector").alias("mv"))
    found = left.groupBy("qm", "qq").cogroup(right.groupBy("mm", "mq"))
    found = found.applyInPandas(best, "question_id bigint, memory_id bigint, memory_type string, score double")
    rank = F.row_number().over(Window.partitionBy("question_id", "memory_type").orderBy(F.desc("score"), "memory_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def cosine(a, b):
    """Cosine of two array columns; 0 for empty, unequal or zero vectors."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) > 0) & (F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm).otherwise(F.lit(0.0))
