"""Removal of repeated byte strings by ranking suffixes at growing lengths.

A suffix array over every byte would rank 1.7 billion positions for a GB of Parquet. Ranks are therefore
taken where they can matter: of every string of LENGTH bytes the leftmost smallest SEED-byte hash marks
its anchor, so equal strings have their anchors at the same place and one position in about thirty is an
anchor. The strings that share an anchor form a block. Round 1 ranks anchors by their SEED bytes, and an
anchor whose rank is unique is out. Round 2 ranks the survivors by pairs (rank of the seed, rank of the
whole block, up to LENGTH + 60 bytes): of equal blocks all but the first are repeats as they are. What is
left is groups with an equal seed but different blocks, the ends of repeated passages, with one position of
each block. Round 3 ranks them by HALF bytes that begin at the anchor or end with the seed: each string of
the block holds one of the two, and strings whose half is unique are out. Round 4 ranks the strings that
are left, at the threshold. Spark sorts in every round; ranks are
hashes, so no round needs the order of another, and equal pairs of 64-bit hashes count as equal strings.

Before a round's sort each task keeps one position of what is equal within its slice and marks the others,
so a passage that a third of all documents share reaches the sort once from each slice.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from causeway.llm.common import documents, mapped, slices, sortable_id, text_or_empty, without_reserved, written
from causeway.llm.textkit import RangeHash, mix, window_argmin

LENGTH, SEED, HALF = 100, 40, 70
#: Bytes of text looked at in one go (an array of 8 bytes for each is made several times over). A longer text is cut into
#: pieces that overlap by LENGTH - 1: a block that a cut divides has no equal and is left to rounds 3 and 4, which are exact.
BYTES = 1 << 20
#: Low bits of a place: a hash of the text, which tells rows apart that share an id. The byte offset is above.
TAG_BITS = 26
#: A block's number of starts; above it the distance from the first start to the anchor.
N_BITS, N_MASK = 8, 255
MID_DDL = "_g bigint, _b bigint, _id bigint, _at bigint, _n int"
_ODD = np.uint64(0xA0761D6478BD642F)


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])


def _mid(g, b, ids, at, n) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x).view(np.int64) if x.dtype == np.uint64 else x) for x in (g, b, ids, at)] + [pa.array(n.astype(np.int32))], names=["_g", "_b", "_id", "_at", "_n"])


def _local(g, b, ids, at, n):
    """One row of each (g, b), the earliest; the others as marked rows, with runs that touch merged and n negative."""
    order = np.lexsort((at, ids, b, g))
    g, b, ids, at, n = g[order], b[order], ids[order], at[order], n[order]
    new = np.r_[True, (g[1:] != g[:-1]) | (b[1:] != b[:-1])] if len(g) else np.zeros(0, bool)
    yield _mid(g[new], b[new], ids[new], at[new], n[new])
    head = np.maximum.accumulate(np.where(new, np.arange(len(g)), 0))
    later = ~new & ((ids != ids[head]) | (at != at[head]))  # a repeated row is the same place, not a later one
    ids, at, n = ids[later], at[later], n[later] & N_MASK
    tag, start = at & ((1 << TAG_BITS) - 1), at >> TAG_BITS
    order = np.lexsort((start, tag, ids))
    ids, tag, start, n = ids[order], tag[order], start[order], n[order].astype(np.int64)
    if len(ids):
        first = np.r_[True, (ids[1:] != ids[:-1]) | (tag[1:] != tag[:-1]) | (start[1:] > (start + n)[:-1])]
        heads = np.flatnonzero(first)
        length = np.maximum.reduceat(start + n, heads) - start[heads]
        ids, at = ids[heads], (start[heads] << TAG_BITS) | tag[heads]
        spread = mix(ids.astype(np.uint64) ^ (at.astype(np.uint64) * _ODD))
        yield _mid(spread, spread, ids, at, -length)


def _anchors(batches):
    for part in slices(batches, "_text", BYTES):
        pieces = [(k, at, t[at : at + BYTES + LENGTH - 1]) for k, t in enumerate(part.column("_text").cast(pa.binary()).to_pylist()) for at in range(0, max(len(t), 1), BYTES)]
        for at in range(0, len(pieces), 1 if len(pieces) > part.num_rows else len(pieces)):
            yield from _anchors_of(part, pieces[at : at + (1 if len(pieces) > part.num_rows else len(pieces))])


def _anchors_of(part, pieces):
    row, offset, texts = map(list, zip(*pieces))
    row, offset = np.array(row), np.array(offset)
    data, begin = _joined(texts)
    if len(data) < LENGTH:
        return
    ids, tags = part.column("_id").to_numpy(zero_copy_only=False), part.column("_tag").to_numpy(zero_copy_only=False)
    values = RangeHash(data).every(SEED)
    anchor = window_argmin(values, LENGTH - SEED + 1)
    doc = np.repeat(np.arange(len(texts)), np.diff(begin))[: len(anchor)]
    inside = np.arange(len(anchor)) + LENGTH <= begin[doc + 1]
    starts = np.flatnonzero(inside)
    if not len(starts):
        return
    a, d = anchor[starts], doc[starts]
    new = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (d[1:] != d[:-1])])
    s, n = starts[new], np.diff(np.r_[new, len(starts)])
    g, b = values[a[new]], RangeHash(data, True)(s, s + n - 1 + LENGTH)
    owner = d[new]
    yield from _local(g, b, ids[row[owner]], ((s - begin[owner] + offset[owner]) << TAG_BITS) | tags[row[owner]], n | (a[new] - s) << N_BITS)


HALF_DDL = "_g bigint, _b bigint, _id bigint, _at bigint, _n int, _s binary"


def _halves(batches):
    """Round 3: the asked blocks cut in two, each with the hashes of the half that its strings share and its bytes."""
    import zstandard

    expand = zstandard.ZstdDecompressor()
    for part in slices(batches, "_z", BYTES // 4):
        texts = [expand.decompress(z) for z in part.column("_z").to_pylist()]
        data, begin = _joined(texts)
        ids, tags = part.column("_id").to_numpy(zero_copy_only=False), part.column("_tag").to_numpy(zero_copy_only=False)
        runs = part.column("_runs")
        row = np.repeat(np.arange(part.num_rows), runs.value_lengths().to_numpy(zero_copy_only=False))
        a, packed = (runs.flatten().field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
        n, anchor = packed & N_MASK, a + (packed >> N_BITS)
        last_left = np.minimum(a + n - 1, anchor - (HALF - SEED))
        first, second = RangeHash(data), RangeHash(data, True)
        for side, lo, hi, at in ((0, a, last_left, anchor - (HALF - SEED)), (1, np.maximum(a, last_left + 1), a + n - 1, anchor)):
            on = np.flatnonzero(lo <= hi)
            at, lo, hi, own = begin[row[on]] + at[on], lo[on], hi[on], row[on]
            g = mix(first(at, at + HALF) + np.uint64(side))
            texts_of = [texts[r][x : y + LENGTH] for r, x, y in zip(own.tolist(), lo.tolist(), hi.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(second(at, at + HALF).view(np.int64)), pa.array(ids[own]), pa.array((lo << TAG_BITS) | tags[own]), pa.array((hi - lo + 1).astype(np.int32)), pa.array(texts_of, pa.binary())], names=["_g", "_b", "_id", "_at", "_n", "_s"])


def _strings(batches):
    """Round 4: the strings of LENGTH bytes of what is left, by two hashes."""
    for part in slices(batches, "_s", BYTES):
        data, begin = _joined(part.column("_s").to_pylist())
        n = part.column("_n").to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(len(n)), n)
        k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        at = begin[row] + k
        ids, places = (part.column(c).to_numpy(zero_copy_only=False) for c in ("_id", "_at"))
        yield from _local(RangeHash(data)(at, at + LENGTH), RangeHash(data, True)(at, at + LENGTH), ids[row], places[row] + (k << TAG_BITS), np.ones(len(at), np.int64))


def _squeeze(batches):
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=3)
    for part in slices(batches, "_text", BYTES):
        out = [squeeze.compress(t) for t in part.column("_text").cast(pa.binary()).to_pylist()]
        columns = [c for n, c in zip(part.schema.names, part.columns) if n != "_text"]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(out, pa.binary())], names=[*(n for n in part.schema.names if n != "_text"), "_z"])


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _cut(batches):
    import zstandard

    expand = zstandard.ZstdDecompressor()
    for batch in batches:
        out = ([], [], [], [], [])
        for z, runs in zip(batch.column("_z").to_pylist(), batch.column("_runs").to_pylist()):
            text = expand.decompress(z)
            spans, kept = [], text
            if runs:
                a = np.array([(r["a"], r["a"] + r["n"] - 1 + LENGTH) for r in runs], np.int64)
                a = a[np.argsort(a[:, 0], kind="stable")]
                reach = np.maximum.accumulate(a[:, 1])
                new = np.r_[True, a[1:, 0] > reach[:-1]]
                heads = np.flatnonzero(new)
                ends = np.r_[reach[heads[1:] - 1], reach[-1]]
                spans = list(zip(a[heads, 0].tolist(), ends.tolist()))
                at, pieces = 0, []
                for x, y in spans:
                    pieces.append(text[at:x])
                    at = y
                kept = b"".join([*pieces, text[at:]])
            out[0].append(len(text))
            out[1].append(len(text) - len(kept))
            out[2].append([{"start": x, "end": y} for x, y in spans])
            out[3].append(kept)
            out[4].append(hashlib.sha256(kept).hexdigest())
        columns = [c for n, c in zip(batch.schema.names, batch.columns) if n not in ("_z", "_runs")]
        made = [pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), SPANS, pa.binary(), pa.string()))]
        yield pa.RecordBatch.from_arrays([*columns, *made], names=[*(n for n in batch.schema.names if n not in ("_z", "_runs")), "n_bytes", "n_removed", "removed", "kept", "kept_sha256"])


def _first_of(rows: DataFrame, *extra) -> DataFrame:
    """Rows with whether they come later than the first of their (_g, _b); marked rows come as they are."""
    place = Window.partitionBy("_g", "_b").orderBy("_id", "_at")
    head = F.first(F.struct("_id", "_at")).over(place)
    return rows.withColumns({"_later": F.struct("_id", "_at") > head, "_again": F.lag("_id").over(place).isNotNull(), **dict(extra)})


def _by_document(places: DataFrame) -> DataFrame:
    mask = (1 << TAG_BITS) - 1
    run = F.struct(F.shiftright("_at", TAG_BITS).alias("a"), F.col("_n").cast("long").alias("n"))
    return places.groupBy(F.col("_id").alias("_id_r"), F.col("_at").bitwiseAND(mask).alias("_tag_r")).agg(F.collect_list(run).alias("_runs"))


def repeated_strings(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_bytes, n_removed, removed, kept, kept_sha256) per row: ``removed`` holds the maximal runs [start, end) of
    bytes that a string of LENGTH bytes covers which also starts earlier, ``kept`` the bytes that are left.

    Earlier is a smaller id, or a smaller start in the same document; strings are judged on the input and
    never cross documents. A null text counts as empty; texts under LENGTH bytes keep everything. A null id
    sorts last. Rows that repeat an id and its text are one place and share their result; of rows that share
    an id but not the text, the smaller start is the earlier one. An empty table gives an empty result.
    """
    raw = text_or_empty(text)
    keyed = without_reserved(docs).select(F.col(doc_id).alias("doc_id"), sortable_id(doc_id).alias("_id"), F.pmod(F.xxhash64(raw), F.lit(1 << TAG_BITS)).alias("_tag"), raw.alias("_text"))
    anchors = keyed.select("_id", "_tag", "_text").transform(mapped, _anchors, MID_DDL)
    seed = Window.partitionBy("_g")
    ranked = _first_of(anchors, ("_lo", F.min("_b").over(seed)), ("_hi", F.max("_b").over(seed)))
    ends = (F.col("_lo") != F.col("_hi")) & ~F.col("_again")
    ranked = ranked.where((F.col("_n") < 0) | F.col("_later") | ends).select("_id", "_at", "_n", ((F.col("_n") > 0) & ~F.col("_later")).alias("_ask"))
    ranked = written(ranked, "suffix-blocks")
    key = [F.col("_id") == F.col("_id_r"), F.col("_tag") == F.col("_tag_r")]
    ids = [(f.name, f.dataType.simpleString()) for f in keyed.schema.fields if f.name != "_text"]
    z_ddl = ", ".join(f"{n} {t}" for n, t in [*ids, ("_z", "binary")])
    squeezed = keyed.transform(mapped, _squeeze, z_ddl)
    asked = squeezed.join(_by_document(ranked.where("_ask")), key).dropDuplicates(["_id", "_tag"]).select("_id", "_tag", "_z", "_runs")
    here, same = F.struct("_id", "_at"), Window.partitionBy("_g", "_b")
    halves = asked.transform(mapped, _halves, HALF_DDL).withColumns({"_lo": F.min(here).over(same), "_hi": F.max(here).over(same)}).where("_lo <> _hi").select("_id", "_at", "_n", "_s")
    strings = _first_of(halves.transform(mapped, _strings, MID_DDL)).where("_n < 0 OR _later").select("_id", "_at", "_n")
    repeats = ranked.where("NOT _ask").select("_id", "_at", "_n").unionByName(strings).withColumn("_n", F.when(F.col("_n") < 0, -F.col("_n")).otherwise(F.col("_n").bitwiseAND(N_MASK)))
    out = squeezed.join(_by_document(repeats), key, "left").select("doc_id", "_z", "_runs")
    kind = keyed.schema["doc_id"].dataType.simpleString()
    return out.transform(mapped, _cut, f"doc_id {kind}, n_bytes bigint, n_removed bigint, removed array<struct<start: bigint, end: bigint>>, kept binary, kept_sha256 string")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeated_strings(documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), "kept_sha256")
