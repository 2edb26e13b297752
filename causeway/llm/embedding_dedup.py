"""Near-duplicate embeddings through a pivot-permutation index.

A sample of vectors, thinned to such as lie apart, serves as pivots. Every vector is described by its PREFIX
nearest pivots, in order, and stands in the inverted lists of these. Within a list the inverted lists of its
members give the number of pivots that two of them share: those that share enough, or have the same nearest
pivot, are candidates, and only candidates are verified, by their cosine in double precision. A pair that
several lists hold is verified in the list of the smallest pivot it shares. Long lists are cut into chunks and worked off
as pairs of chunks, one task each; a task gives counts and a spanning forest for its vectors, never pairs.

A pivot that stands for others of the sample marks a dense place. Vectors nearest to it are at home in its
list: all their pairs are verified there, whatever else they share, and in no other list.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from causeway.llm.common import NULL_ID, handed_back, mapped, sortable_id, without_reserved, written
from causeway.llm.components import components

#: Pivots grow with the root of the number of vectors, so lists grow with the root, too. Their broadcast is bounded:
#: 64 MB are 131,072 pivots of 64 numbers, enough for 4 billion vectors.
LEAST_PIVOTS, PIVOT_BYTES = 32, 64 << 20
#: Nearest pivots that describe a vector, and how many of them candidates share at least. At cosine 0.9 of random
#: vectors this finds 0.98 of the pairs with 1,024 pivots, 0.998 with 200 (measured against brute force).
PREFIX, SHARED = 8, 2
#: Sampled vectors this close to a pivot become none: pivots within a dense group would be ordered by noise alone.
APART = 0.7
#: Vectors of a list that one side of a task holds at most.
CHUNK = 1024
THRESHOLD = 0.9


def units(x: np.ndarray) -> np.ndarray:
    """Rows of length 1. They are scaled by their largest magnitude first, so that no square runs over or under."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _forest(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix of links the first row of its component."""
    label = np.arange(len(linked))
    while True:
        near = np.where(linked, label[None, :], len(label)).min(1) if len(label) else label
        new = np.minimum(label, near)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _spread(x: np.ndarray, apart: float = APART) -> tuple[np.ndarray, np.ndarray]:
    """Rows of x that lie apart, chosen in order, and whether each stands for others."""
    chosen, dense = np.empty_like(x), np.zeros(len(x), bool)
    k = 0
    for v in x:
        near = chosen[:k] @ v
        if k and near.max() >= apart:
            dense[near.argmax()] = True
        else:
            chosen[k] = v
            k += 1
    return chosen[:k], dense[:k]


def _candidates(perm: np.ndarray, a: np.ndarray, b: np.ndarray, pivot: int, shared: int, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a and b that this list has to verify, by the counts of shared pivots out of the inverted lists of the block.

    Candidates share enough pivots, or have the same nearest one. A pair is left to the list of the smallest
    pivot that it shares; one that is at home together, to the home.
    """
    counts, elsewhere = np.zeros((len(a), len(b)), np.uint8), np.zeros((len(a), len(b)), bool)
    place_a, place_b = (np.full(len(perm), -1) for _ in range(2))
    place_a[a], place_b[b] = np.arange(len(a)), np.arange(len(b))
    row, held = np.repeat(np.arange(len(perm)), perm.shape[1]), perm.ravel()
    order = np.argsort(held, kind="stable")
    edges = np.flatnonzero(np.r_[True, np.diff(held[order]) != 0, True])
    for lo, hi in zip(edges[:-1], edges[1:]):
        own = row[order[lo:hi]]
        x, y = place_a[own], place_b[own]
        at = np.ix_(x[x >= 0], y[y >= 0])
        counts[at] += 1
        if held[order[lo]] < pivot:
            elsewhere[at] = True
    near, mine = perm[:, 0], home[a][:, None]
    together = (mine >= 0) & (mine == home[b][None, :])
    enough = (counts >= shared) | (near[a][:, None] == near[b][None, :])
    return np.nonzero(np.where(together, mine == pivot, enough & ~elsewhere))


def _block(part: pd.DataFrame, threshold: float, shared: int) -> pd.DataFrame:
    """Counts and forest of one pair of chunks of one list."""
    part = part.sort_values("_k", kind="stable").reset_index(drop=True)
    pivot, i, j = int(part["_p"][0]), int(part["_i"][0]), int(part["_j"][0])
    a = np.flatnonzero(part["_chunk"].to_numpy() == i)
    b = np.flatnonzero(part["_chunk"].to_numpy() == j)
    key, m = part["_k"].to_numpy(), part["_m"].to_numpy(np.int64)
    r, c = _candidates(np.stack(part["_perm"].to_numpy()), a, b, pivot, shared, part["_home"].to_numpy())
    r, c = a[r], b[c]
    on = r < c if i == j else r != c
    r, c = r[on], c[on]
    x = units(np.frombuffer(b"".join(part["_v"]), np.float64).reshape(len(part), -1))
    keep = np.zeros(len(r), bool)
    for at in range(0, len(r), 1 << 15):
        part_of = slice(at, at + (1 << 15))
        keep[part_of] = np.einsum("ij,ij->i", x[r[part_of]], x[c[part_of]]) >= threshold
    r, c = r[keep], c[keep]
    n = np.bincount(r, m[c], len(part)) + np.bincount(c, m[r], len(part))
    linked = np.zeros((len(part), len(part)), bool)
    linked[r, c] = linked[c, r] = True
    first = key[_forest(linked)]
    hit = n > 0
    handed_back()
    return pd.DataFrame({"_k": key[hit], "_n": n[hit].astype(np.int64), "_to": first[hit]})


def _pivots(classes: DataFrame) -> tuple[dict[int, tuple[int, np.ndarray]], np.ndarray]:
    """By vector length (the number of its first pivot, pivots); and of all pivots, whether each stands for others of the sample."""
    counts = {r.d: r["count"] for r in classes.groupBy(F.size("_x").alias("d")).count().collect()}
    if not counts:
        return {}, np.zeros(0, bool)
    most = {d: max(LEAST_PIVOTS, min(2 * math.isqrt(n), PIVOT_BYTES // (8 * d))) for d, n in counts.items()}
    parts = 1 << 20
    limit = F.create_map(*(F.lit(v) for d, n in counts.items() for v in (d, min(parts, -(-parts * (2 * most[d] + 64) // n)))))
    draw = F.xxhash64(F.lit("pivot"), "_k")
    drawn = classes.where(F.pmod(draw, F.lit(parts)) < limit[F.size("_x")]).select(draw.alias("_draw"), "_x").collect()
    sample: dict[int, list] = {}
    for r in sorted(drawn, key=lambda r: (r._draw, r._x)):
        if len(own := sample.setdefault(len(r._x), [])) < most[len(r._x)]:
            own.append(r._x)
    found, dense, first = {}, [], 0
    for d in sorted(sample):
        apart, own = _spread(units(np.array(sample[d], np.float64)))
        found[d] = first, apart
        first += len(apart)
        dense.append(own)
    return found, np.concatenate(dense)


def near_duplicate_vectors(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD, prefix: int = PREFIX, shared: int = SHARED) -> DataFrame:
    """The rows of ``df`` with n_links, component_id and kept.

    Equal vectors are one class that is indexed once and weighs as many as it holds. Vectors that are
    null, empty, zero or hold null or non-finite numbers link with nothing: n_links 0, a component of their
    own. Vectors of different lengths have no cosine and do not link; each length has pivots of its own.
    Rows that repeat an id, or have none, are vectors of their own: they are told apart by what they hold.
    A component is named by the smallest id of its vectors; one of null ids alone by null. Equal 64-bit
    hashes count as equal vectors in counts. Columns that clash with the results are replaced, those that
    begin with an underscore dropped. An empty table gives an empty result.
    """
    spark = df.sparkSession
    df = without_reserved(df)
    sound = F.coalesce(F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf"))) & F.exists(vector, lambda v: v != 0), F.lit(False))
    x = F.when(sound, F.col(vector).cast("array<double>"))
    values = df.select(sortable_id(vec_id).alias("_id"), x.alias("_x")).where("_x IS NOT NULL").withColumn("_k", F.xxhash64("_x"))
    classes = written(values.groupBy("_k", "_x").agg(F.min("_id").alias("_rep"), F.count(F.lit(1)).alias("_m")), "vector-classes")
    found, dense = _pivots(classes)
    pivots = spark.sparkContext.broadcast((found, dense))

    def describe(batches):
        by_length, dense = pivots.value
        for part in batches:
            size = part.column("_x").value_lengths().to_numpy(zero_copy_only=False)
            for d in np.unique(size):
                own = part.filter(pa.array(size == d))
                raw = own.column("_x").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(own.num_rows, int(d))
                first, apart = by_length[int(d)]
                perm = np.argsort(-(units(raw) @ apart.T), axis=1, kind="stable")[:, :prefix].astype(np.int32) + np.int32(first)
                home = np.where(dense[perm[:, 0]], perm[:, 0], -1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([own.column("_k"), own.column("_m"), pa.array(home), pa.array(list(perm), pa.list_(pa.int32())), pa.array([v.tobytes() for v in raw], pa.binary())], names=["_k", "_m", "_home", "_perm", "_v"])

    indexed = written(classes.transform(mapped, describe, "_k bigint, _m bigint, _home int, _perm array<int>, _v binary"), "vector-index")
    lists = indexed.select("*", F.explode("_perm").alias("_p"))
    # Chunks hold vectors of one home. A list has a row for each home in it; its chunks are numbered home by home.
    sizes = lists.groupBy("_p", "_home").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("_chunks"))
    sizes = sizes.withColumns({"_to": F.sum("_chunks").over(Window.partitionBy("_p").orderBy("_home")).cast("int"), "_all": F.sum("_chunks").over(Window.partitionBy("_p")).cast("int")})
    lists = lists.join(F.broadcast(sizes), ["_p", "_home"]).withColumn("_chunk", F.col("_to") - 1 - F.pmod(F.xxhash64("_k"), F.col("_chunks")).cast("int"))
    away = (F.col("_home") >= 0) & (F.col("_home") != F.col("_p"))
    others = F.sequence(F.lit(0), F.col("_all") - 1)
    others = F.when(away, F.filter(others, lambda k: (k < F.col("_to") - F.col("_chunks")) | (k >= F.col("_to")))).otherwise(others)
    tasks = lists.withColumn("_with", F.explode(others))
    tasks = tasks.select("_p", F.least("_chunk", "_with").alias("_i"), F.greatest("_chunk", "_with").alias("_j"), "_chunk", "_k", "_m", "_home", "_perm", "_v")
    links = written(tasks.groupBy("_p", "_i", "_j").applyInPandas(lambda part: _block(part, threshold, shared), "_k bigint, _n bigint, _to bigint"), "vector-links")
    labels = components(links.select(F.col("_k").alias("a"), F.col("_to").alias("b")))
    known = classes.join(links.groupBy("_k").agg(F.sum("_n").alias("_n")), "_k", "left").join(labels.select(F.col("node").alias("_k"), "component"), "_k", "left")
    known = written(known.select("_k", "_rep", (F.coalesce("_n", F.lit(0)) + F.col("_m") - 1).alias("_links"), F.coalesce("component", "_k").alias("_c")), "vector-known")
    named = known.join(known.groupBy("_c").agg(F.min("_rep").alias("_name")), "_c").select("_k", "_links", "_name")
    own = df.drop("n_links", "component_id", "kept").withColumns({"_id": sortable_id(vec_id), "_k": F.when(sound, F.xxhash64(x))})
    out = own.join(named, "_k", "left")
    out = out.withColumns({"n_links": F.coalesce("_links", F.lit(0)).cast("long"), "component_id": F.nullif(F.coalesce("_name", "_id"), F.lit(NULL_ID))})
    return out.withColumn("kept", F.col(vec_id).eqNullSafe(F.col("component_id"))).drop("_id", "_k", "_links", "_name")


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicate_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    return out.select("vec_id", "n_links", "component_id", "kept")
