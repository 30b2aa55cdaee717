"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch

BITS_A_GROUP = 16  # of the survivor filter: one row in 16 of those that are alone passes it by chance
MOST_BITS = 1 << 28  # of a filter that is broadcast: 32 MB


def _survivor_filter(prefixes: DataFrame, n_groups: int, scratch: Scratch) -> tuple[DataFrame, Column]:
    """A bitmap (bucket, bits) over the hashes of (length, prefix), and each row's place in it."""
    bits = 1 << max(15, (n_groups * BITS_A_GROUP - 1).bit_length())
    slot = F.pmod(F.xxhash64("length", "prefix"), F.lit(bits)) + 1
    places = prefixes.select(F.bitmap_bucket_number(slot).alias("bucket"), F.bitmap_bit_position(slot).alias("bit"))
    return scratch.write(places.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")), "survivors"), slot


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 128, all_hashes: bool = False, most_bits: int = MOST_BITS) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, full_hash) of each row; of equal texts the largest id stays.

    Texts are equal when identical; null counts as empty; texts of any length are hashed whole.  ``full_hash`` is the
    SHA-256 of the text; where length or prefix already showed that the text is alone it is null, unless ``all_hashes``
    asks for it.  Rows of one id and text are repeats: each counts in ``group_size`` and has the same verdict.  A null
    id ranks below all others; its row is kept where no row of the group has an id.  Other columns are ignored, whatever
    their names; an empty table gives no rows.

    The first scan yields (length, prefix hash).  Lengths and then (length, prefix) pairs that occur once drop out.  The
    second scan holds each row against what survived and hashes the whole content of rows in surviving groups, where
    they lie.  Survivors are a bitmap of BITS_A_GROUP bits for each group, broadcast while it has at most ``most_bits``;
    beyond that the second scan is semi-joined with the surviving pairs.  A chance hit in the bitmap costs one more hash
    and changes nothing, since groups are formed by length and full hash.
    """
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    keyed = docs.select("doc_id", F.octet_length("text").alias("length"), F.xxhash64(F.substring("text", 1, prefix_chars)).alias("prefix"), "text")

    keys = scratch.write(keyed.select("length", "prefix"), "keys")
    lengths = scratch.write(keys.groupBy("length").agg(F.count("*").alias("c")).where("c > 1").select("length"), "lengths")
    prefixes = keys.join(lengths, "length", "left_semi").groupBy("length", "prefix").agg(F.count("*").alias("c")).where("c > 1")
    prefixes = scratch.write(prefixes.select("length", "prefix"), "prefixes")
    scratch.drop(keys, lengths)

    n_groups = prefixes.count()
    if n_groups * BITS_A_GROUP <= most_bits:
        bitmap, slot = _survivor_filter(prefixes, n_groups, scratch)
        byte = F.conv(F.hex(F.expr("substring(bits, cast(bit div 8 as int) + 1, 1)")), 16, 10).cast("int")
        marked = keyed.withColumn("bucket", F.bitmap_bucket_number(slot)).withColumn("bit", F.bitmap_bit_position(slot)).join(F.broadcast(bitmap), "bucket", "left")
        marked = marked.withColumn("alive", F.coalesce(F.getbit(byte, F.col("bit") % 8) == 1, F.lit(False)))
    else:
        marked = keyed.join(prefixes.withColumn("found", F.lit(True)), ["length", "prefix"], "left").withColumn("alive", F.col("found").isNotNull())
    whole = F.sha2(F.col("text").cast("binary"), 256)
    hashed = marked.select("doc_id", "length", "alive", (whole if all_hashes else F.when(F.col("alive"), whole)).alias("full_hash"))
    hashed = scratch.write(hashed, "hashed")

    alive = hashed.where("alive")
    groups = scratch.write(alive.groupBy("length", "full_hash").agg(F.count("*").alias("group_size"), F.max("doc_id").alias("keep_id")).where("group_size > 1"), "groups")
    out = alive.join(groups, ["length", "full_hash"], "left")
    out = out.select("doc_id", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), "full_hash")
    alone = hashed.where("not alive").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "full_hash")
    return out.unionByName(alone).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "full_hash")
