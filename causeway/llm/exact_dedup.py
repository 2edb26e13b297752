"""Exact deduplication by progressive refinement: length, then a prefix hash, then the full hash.

Two scans. The first reads lengths and prefixes and finds the (length, prefix hash) groups with more
than one row; these groups are marked in a bitmap of fixed size. The second scan hashes the whole text
of a row only where its group is marked, so a text that is alone by length and prefix is never hashed.
A group is one aggregated row before it meets the documents again, and that join has a unique side, so
a group that holds a third of all rows is split like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm.common import documents, text_or_empty, without_reserved, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: 2^23 bits are 256 bitmaps of 4 KB: 1 MB whatever the number of documents. A bit that two groups share only costs a hash.
BITS = 1 << 23


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. For ASCII texts lower() does the same and is faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def _marked(keys: DataFrame) -> DataFrame:
    """(bucket, bits): the groups of ``keys`` with more than one row as bitmaps, 256 rows at most."""
    groups = keys.groupBy("_len", "_prefix").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    at = F.pmod(F.xxhash64("_len", "_prefix"), F.lit(BITS))
    return groups.groupBy(F.bitmap_bucket_number(at).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("_bits"))


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", prefix_chars: int = 64, digest_all: bool = False) -> DataFrame:
    """The rows of ``docs`` with keep_id, group_size, kept and text_sha256 (null where the hash was not needed, unless ``digest_all``).

    Texts are equal when identical after lower-casing A-Z; a null text counts as empty, so nulls and
    empty texts form one group. The row with the largest id stays; ids that are null stay only if the
    whole group has none. Rows that repeat an id and its text share their fate, since nothing tells them
    apart. Columns of ``docs`` that clash with the results are replaced, those that begin with an underscore
    are dropped, others pass through. An empty table gives an empty result.
    """
    docs, raw = without_reserved(docs), text_or_empty(text)
    prefix = F.xxhash64(ascii_lower(F.substring(raw, 1, prefix_chars)))
    keyed = docs.withColumns({"_len": F.octet_length(raw).cast("long"), "_prefix": prefix})
    bits = F.broadcast(_marked(keyed.select("_len", "_prefix")))
    at = F.pmod(F.xxhash64("_len", "_prefix"), F.lit(BITS))
    place = F.bitmap_bit_position(at)
    byte = F.conv(F.hex(F.substring(F.col("_bits"), (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    shared = F.coalesce(F.expr("_byte >> cast(_place % 8 as int)").bitwiseAND(1) == 1, F.lit(False))
    keyed = keyed.withColumn("_at", F.bitmap_bucket_number(at)).join(bits, F.col("_at") == F.col("_bucket"), "left")
    keyed = keyed.withColumns({"_byte": byte, "_place": place}).withColumn("_shared", shared)
    # '' rather than null where no hash is needed: the join would otherwise hash once more to filter nulls out.
    sha = F.coalesce(F.sha2(ascii_lower(raw).cast("binary"), 256), F.lit(""))
    keyed = keyed.withColumn("text_sha256", sha if digest_all else F.when(F.col("_shared"), sha).otherwise(F.lit("")))
    keyed = keyed.drop("_at", "_bucket", "_bits", "_byte", "_place")
    keys = ["_len", "_prefix", "text_sha256"]
    groups = keyed.where("_shared").groupBy(*keys).agg(F.max(doc_id).alias("keep_id"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
    # Written, so that the join below has an exchange on either side and AQE can split a hot group.
    groups = written(groups, "exact-groups").select(*(F.col(k).alias(f"{k}_g") for k in keys), F.col("keep_id").alias("_keep"), F.col("group_size").alias("_size"))
    same = (F.col("_len") == F.col("_len_g")) & (F.col("_prefix") == F.col("_prefix_g")) & (F.col("text_sha256") == F.col("text_sha256_g"))
    out = keyed.join(groups, same, "left")
    size = F.coalesce("_size", F.lit(1)).cast("long")
    keep = F.when(F.col("_size").isNull(), F.col(doc_id)).otherwise(F.col("_keep"))
    out = out.withColumns({"keep_id": keep, "group_size": size, "text_sha256": F.nullif("text_sha256", F.lit(""))})
    out = out.withColumn("kept", F.col(doc_id).eqNullSafe(F.col("keep_id")))
    return out.drop(*(f"{k}_g" for k in keys), "_keep", "_size", "_len", "_prefix", "_shared")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = exact_dedup(docs, digest_all=True)
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP2_SQL = f"""
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS text_sha256 FROM documents
), g AS (
  SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256
)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, d.text_sha256
FROM d JOIN g USING (text_sha256)
"""
