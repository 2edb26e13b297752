"""Near-duplicate documents with BagMinHash signatures.

A document is the multiset of its runs of five words. The weight of a shingle (how often it occurs) is
discretised into unit levels, and levels are gathered in a hierarchy of regions [0, 1), [1, 2), [2, 4),
[4, 8) and so on. For every shingle and region a Poisson process gives points (x, slot, level) that depend
on the shingle alone; a document takes the points whose level lies under its weight, and its signature
holds the smallest x of each slot. Two signatures then agree in a slot with probability equal to the
weighted Jaccard similarity. Points come in order of x, so a shingle is left as soon as its next x is
beyond the largest value in the signature.

Signatures are cut into bands; documents that share a band are candidates, and the multiset overlap of
candidates is verified exactly. A bucket is not expanded into pairs: its members are compared with a
leader each, and components are built. Where a bucket still holds several components, the members outside
the main one are compared with all others of the bucket, as blocks of at most CHUNK by CHUNK texts: a
block is one task that multiplies presence matrices and gives a spanning forest of the links it finds.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm.common import documents, handed_back, mapped, slices, text_or_empty, without_reserved, written
from causeway.llm.components import components
from causeway.llm.textkit import mix, shingles, words

BANDS, ROWS, SLOTS = 21, 6, 128
THRESHOLD = 0.8
BYTES = 1 << 20
#: Texts on one side of a block, and columns of its matrices at a time.
CHUNK, COLUMNS = 256, 1 << 14
_G1, _G2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)


def bags(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle, its count, its text) for the distinct shingles of each text, in no order that matters."""
    hashes, begin = shingles(*words(texts))
    if len(texts) == 1:
        found, count = np.unique(hashes, return_counts=True)
        return found, count, np.zeros(len(found), np.int64)
    text = np.repeat(np.arange(len(texts)), np.diff(begin))
    order = np.argsort(hashes ^ mix(text.astype(np.uint64) + _G1))  # one key: much faster than sorting by two
    hashes, text = hashes[order], text[order]
    first = np.flatnonzero(np.r_[True, (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])]) if len(hashes) else np.zeros(0, np.int64)
    return hashes[first], np.diff(np.r_[first, len(hashes)]), text[first]


def signatures(shingle: np.ndarray, count: np.ndarray, text: np.ndarray, n_texts: int, slots: int = SLOTS) -> np.ndarray:
    """BagMinHash: n_texts x slots smallest x (infinite for a text without shingles)."""
    least = np.full(n_texts * slots, np.inf)
    # Region k is [2^(k-1), 2^k), region 0 is [0, 1); those that begin under the weight take part.
    deepest = np.ceil(np.log2(np.maximum(count, 1))).astype(np.int64)
    regions = np.repeat(np.arange(len(count)), deepest + 1)
    k = np.arange(len(regions)) - np.repeat(np.cumsum(deepest + 1) - (deepest + 1), deepest + 1)
    low = np.where(k > 0, 2.0 ** (k - 1), 0.0)
    size = np.where(k > 0, low, 1.0)
    seed = mix(shingle[regions] ^ (k.astype(np.uint64) * _G2))
    weight, doc = count[regions].astype(np.float64), text[regions].astype(np.int64)
    x = np.zeros(len(seed))
    step = np.zeros(1, np.uint64)
    while len(seed):
        step += _G1
        r = mix(seed + step)
        x = x - np.log(((r >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53) / (size * slots)
        s = mix(r ^ _G2)
        slot = (s & np.uint64(0xFFFF)).astype(np.int64) % slots
        level = low + size * ((s >> np.uint64(16)).astype(np.float64) * 2.0**-48)
        taken = level < weight
        np.minimum.at(least, (doc * slots + slot)[taken], x[taken])
        on = x < least.reshape(n_texts, slots).max(1)[doc]
        seed, x, size, low, weight, doc = seed[on], x[on], size[on], low[on], weight[on], doc[on]
    return least.reshape(n_texts, slots)


SIG_DDL = "_id bigint, _f1 bigint, _f2 bigint, _n bigint, _bands array<bigint>"


def _sign(batches):
    for part in slices(batches, "_text", BYTES):
        ids, texts = part.column("_id"), [t or "" for t in part.column("_text").to_pylist()]
        shingle, count, text = bags(texts)
        least = signatures(shingle, count, text, len(texts))
        bits = mix(least.view(np.uint64))
        bands = np.zeros((len(texts), BANDS), np.uint64)
        for j in range(ROWS):
            bands = bands * np.uint64(0x9DDFEA08EB382D69) + bits[:, j : BANDS * ROWS : ROWS]
        total = np.bincount(text, count, len(texts)).astype(np.int64)
        prints = []
        for salt in (_G1, _G2):
            f = np.zeros(len(texts), np.uint64)
            np.add.at(f, text, mix(shingle ^ salt) * count.astype(np.uint64))
            prints.append(f.view(np.int64))
        flat = pa.array(mix(bands).view(np.int64).ravel())
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(texts) + 1) * BANDS, BANDS, dtype=np.int32)), flat)
        yield pa.RecordBatch.from_arrays([ids, pa.array(prints[0]), pa.array(prints[1]), pa.array(total), lists], names=["_id", "_f1", "_f2", "_n", "_bands"])


def _squeeze(batches):
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=3)
    for part in slices(batches, "_text", BYTES):
        out = [squeeze.compress((t or "").encode("utf-8", "replace")) for t in part.column("_text").to_pylist()]
        yield pa.RecordBatch.from_arrays([part.column("_id"), pa.array(out, pa.binary())], names=["_id", "_z"])


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two bags (sorted shingles, counts)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    return both / max(1, int(a[1].sum()) + int(b[1].sum()) - both)


def _verify(batches):
    import zstandard

    expand = zstandard.ZstdDecompressor()
    bag = lambda z: bags([expand.decompress(z).decode("utf-8")])[:2]
    last, own = None, None
    for part in batches:
        out = []
        for a, b, za, zb in zip(*(part.column(n).to_pylist() for n in ("a", "b", "_za", "_zb"))):
            if last != (a, za):  # pairs come sorted by leader
                last, own = (a, za), bag(za)
            out.append((a, b, overlap(own, bag(zb))))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["a", "b", "similarity"])


def overlaps(bag_of: list[tuple[np.ndarray, np.ndarray]], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarities of the bags ``a`` with the bags ``b`` (indices), by products of presence matrices.

    The k-th occurrence of a shingle is an element of its own, which makes multiset overlap set overlap.
    """
    copies = [np.repeat(x, n) for x, n in bag_of]
    level = [np.arange(len(c)) - np.repeat(np.cumsum(n) - n, n) for c, (_, n) in zip(copies, bag_of)]
    element = mix(np.concatenate(copies) ^ (np.concatenate(level).astype(np.uint64) * _G1))
    sizes = np.array([len(c) for c in copies], np.int64)
    row = np.repeat(np.arange(len(copies)), sizes)
    _, column, often = np.unique(element, return_inverse=True, return_counts=True)
    shared = often > 1  # what one text alone has adds nothing
    place = np.cumsum(shared) - 1
    on = shared[column]
    row, column = row[on], place[column[on]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(a), len(b)), np.float64)
    for at in range(0, int(shared.sum()), COLUMNS):
        lo, hi = np.searchsorted(column, [at, at + COLUMNS])
        x = np.zeros((len(copies), COLUMNS), np.float32)
        x[row[lo:hi], column[lo:hi] - at] = 1
        both += x[a] @ x[b].T
    return both / np.maximum(1, sizes[a][:, None] + sizes[b][None, :] - both)


def _block(threshold: float):
    def block(part: pd.DataFrame) -> pd.DataFrame:
        import zstandard

        expand = zstandard.ZstdDecompressor()
        part = part.sort_values("_id", kind="stable").reset_index(drop=True)
        bag_of = [bags([expand.decompress(z).decode("utf-8")])[:2] for z in part["_z"]]
        side, group = part["_side"].to_numpy(), part["_c"].to_numpy()
        a, b = np.flatnonzero(side <= 1), np.flatnonzero(side >= 1)
        hit = (overlaps(bag_of, a, b) >= threshold) & (group[a][:, None] != group[b][None, :])
        linked = np.zeros((len(part), len(part)), bool)
        r, c = np.nonzero(hit)
        linked[a[r], b[c]] = linked[b[c], a[r]] = True
        # Members of one component count as linked: one link between two components is enough.
        ids, first = part["_id"].to_numpy(), forest(linked)
        on = first != np.arange(len(part))
        del bag_of, part
        handed_back()
        return pd.DataFrame({"a": ids[first[on]], "b": ids[on]})

    return block


def forest(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix of links the first row of its component."""
    label = np.arange(len(linked))
    while True:
        near = np.where(linked, label[None, :], len(label)).min(1) if len(label) else label
        new = np.minimum(label, near)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _led(buckets: DataFrame) -> DataFrame:
    """Pairs (leader, member). A bucket's leader is the smallest by a hash that differs between three kinds of bands."""
    ranked = buckets.select("_band", "_key", "_id", F.xxhash64("_id", F.pmod("_band", F.lit(3))).alias("_rank"))
    first = ranked.groupBy("_band", "_key").agg(F.min(F.struct("_rank", "_id")).alias("_lead")).select(F.col("_band").alias("_bb"), F.col("_key").alias("_kk"), F.col("_lead._id").alias("_l"))
    pairs = ranked.join(first, (F.col("_band") == F.col("_bb")) & (F.col("_key") == F.col("_kk"))).where("_id <> _l")
    return pairs.select(F.least("_id", "_l").alias("a"), F.greatest("_id", "_l").alias("b")).distinct()


def _verified(pairs: DataFrame, z: DataFrame, threshold: float) -> DataFrame:
    with_b = pairs.join(z.select(F.col("_id").alias("b"), F.col("_z").alias("_zb")), "b")
    with_both = with_b.join(z.select(F.col("_id").alias("a"), F.col("_z").alias("_za")), "a").sortWithinPartitions("a")
    return with_both.select("a", "b", "_za", "_zb").transform(mapped, _verify, "a bigint, b bigint, similarity double").where(F.col("similarity") >= threshold).select("a", "b")


def _blocks(labelled: DataFrame) -> DataFrame:
    """The members of buckets with several components, once for each block they are in; _side 0 meets 2, and 1 meets its own block.

    The main component is that of the smallest label. Blocks pair chunks of outsiders with chunks of the
    main component and with each other, so a bucket with few outsiders has few blocks.
    """
    key = ["_band", "_key"]
    main = labelled.groupBy(*key).agg(F.min("_c").alias("_main"), F.max("_c").alias("_other")).where("_main <> _other").drop("_other")
    split = written(labelled.join(main, key).withColumn("_out", F.col("_c") != F.col("_main")), "near-split")
    sizes = split.groupBy(*key).agg(*(F.ceil(F.count_if(x) / CHUNK).cast("int").alias(n) for x, n in ((F.col("_out"), "_no"), (~F.col("_out"), "_nm"))))
    rows = split.join(sizes, key).withColumn("_chunk", F.pmod(F.xxhash64("_id"), F.when(F.col("_out"), F.col("_no")).otherwise(F.col("_nm"))).cast("int"))
    with_main = F.transform(F.sequence(F.lit(0), F.col("_nm") - 1), lambda j: F.struct(F.lit(0).alias("kind"), F.col("_chunk").alias("i"), j.alias("j"), F.lit(0).alias("side")))
    one = lambda k: F.when(k == F.col("_chunk"), 1).when(k > F.col("_chunk"), 0).otherwise(2)
    with_out = F.transform(F.sequence(F.lit(0), F.col("_no") - 1), lambda k: F.struct(F.lit(1).alias("kind"), F.least("_chunk", k).alias("i"), F.greatest("_chunk", k).alias("j"), one(k).alias("side")))
    of_main = F.transform(F.sequence(F.lit(0), F.col("_no") - 1), lambda o: F.struct(F.lit(0).alias("kind"), o.alias("i"), F.col("_chunk").alias("j"), F.lit(2).alias("side")))
    found = rows.select(*key, "_id", "_c", F.explode(F.when(F.col("_out"), F.concat(with_main, with_out)).otherwise(of_main)).alias("_t"))
    return found.select(*key, "_id", "_c", F.col("_t.kind").alias("_kind"), F.col("_t.i").alias("_i"), F.col("_t.j").alias("_j"), F.col("_t.side").alias("_side"))


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, n_shingles): the smallest id of the documents a document is linked with, directly or over others.

    Documents are linked when the multisets of their runs of five words (one run, if a text is shorter)
    have a weighted Jaccard similarity of ``threshold`` or more and they share a band. Equal multisets are
    one class before anything is compared. Null and empty texts, and those without words, are linked with
    nothing. Rows that share an id count as one document and come back as often as they came; rows without
    an id are compared with nothing and have a null class. An empty table gives an empty result.
    """
    docs = without_reserved(docs).select(F.col(doc_id).cast("long").alias("_id"), text_or_empty(text).alias("_text"))
    signed = written(docs.transform(mapped, _sign, SIG_DDL), "near-signatures")
    known = signed.where("_n > 0 AND _id IS NOT NULL")
    same = written(known.groupBy("_f1", "_f2").agg(F.min("_id").alias("_rep")), "near-classes")
    member = written(known.select("_id", "_f1", "_f2").join(same, ["_f1", "_f2"]).select("_id", "_rep").distinct(), "near-members")
    reps = known.join(member.where("_id = _rep").select("_id").distinct(), "_id", "left_semi").dropDuplicates(["_id"])
    buckets = reps.select("_id", F.posexplode("_bands").alias("_band", "_key"))
    shared = buckets.groupBy("_band", "_key").agg(F.count(F.lit(1)).alias("_size")).where("_size > 1").drop("_size")
    buckets = written(buckets.join(shared, ["_band", "_key"], "left_semi"), "near-buckets")
    # The texts of all candidates are moved once. A merge join at every size: a broadcast would do for small tables only.
    needed = buckets.select("_id").distinct().hint("merge")
    z = written(docs.where("_id IS NOT NULL").transform(mapped, _squeeze, "_id bigint, _z binary").join(needed, "_id", "left_semi"), "near-texts")
    # A document that shares an id with another class links the classes.
    links = member.where("_id <> _rep").select(F.col("_rep").alias("a"), F.col("_id").alias("b"))
    near = written(_verified(_led(buckets), z, threshold), "near-links")
    labels = components(near)
    labelled = buckets.join(labels.withColumnRenamed("node", "_id"), "_id", "left").withColumn("_c", F.coalesce("component", "_id")).drop("component")
    blocks = _blocks(written(labelled, "near-labelled")).join(z, "_id")
    more = blocks.groupBy("_band", "_key", "_kind", "_i", "_j").applyInPandas(_block(threshold), "a bigint, b bigint")
    near = near.unionByName(written(more, "near-links"))
    labels = components(links.unionByName(near))
    out = signed.select("_id", "_n").join(labels.withColumnRenamed("node", "_id"), "_id", "left")
    return out.select(F.col("_id").alias("doc_id"), F.coalesce("component", "_id").alias("class_id"), F.col("_n").alias("n_shingles"))


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(documents(spark, sf_dir).select("doc_id", "text"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))
