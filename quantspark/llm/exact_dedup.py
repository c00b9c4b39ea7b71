"""Exact dedup through an extendible-hash index on shared files.

1. Scan: every text is normalised and hashed; narrow entries (id, key, sha256) are written to the
   shared folder.
2. Directory: keys are counted by their leading bits.  A bucket over its capacity doubles the
   directory below it, until each bucket fits or the bits run out (what is left chains).
3. Owners: whole buckets are given to owner tasks, in order; a row goes to its owner by its key's
   slot.  Rows of very frequent keys (at most ``HOT_KEYS``) are first added up where they are read.
4. Chains: an owner task holds the texts of its buckets by key, compares texts of one key byte by
   byte, and writes a class per text to the index.
5. Entries probe the index by (owner, key, sha256).

All of it is DataFrame code; no Python runs in tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import expand_copies, keep_rows, long_array, materialize, range_number, squeeze_space, text_or_empty, top_bits

#: So many keys at most count as very frequent: those with more than this share of all rows.
HOT_KEYS = 1000


def default_key(text: Column) -> Column:
    return F.xxhash64(text)


def build_directory(keys: DataFrame, capacity: int, max_bits: int) -> DataFrame:
    """Directory of an extendible hash: (slot, bucket, local_depth) for every used slot.

    ``keys`` has one row per distinct ``key``.  A slot is the first ``max_bits`` bits of a key; a
    bucket is named by its first slot.  Every node of the prefix tree is counted at once: the
    buckets are the shallowest nodes that fit, below parents that do not.
    """
    cells = keys.groupBy(top_bits(F.col("key"), max_bits).alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    nodes = (
        cells.select("n", "slot", F.explode(F.sequence(F.lit(0), F.lit(max_bits))).alias("depth"))
        .select("n", "depth", F.expr(f"shiftright(slot, {max_bits} - depth)").alias("prefix"))
        .groupBy("depth", "prefix")
        .agg(F.sum("n").alias("n"))
    )
    full = nodes.filter(F.col("n") > capacity).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("up"))
    fits = nodes.filter((F.col("n") <= capacity) | (F.col("depth") == max_bits)).withColumn("up", F.shiftright("prefix", 1))
    leaves = fits.filter("depth = 0").unionByName(fits.filter("depth > 0").join(full, ["depth", "up"], "left_semi").select(fits.columns))
    first = F.expr(f"shiftleft(prefix, {max_bits} - depth)")
    return leaves.select(
        F.col("depth").alias("local_depth"),
        first.alias("bucket"),
        F.explode(F.sequence(first, first + F.expr(f"shiftleft(1L, {max_bits} - depth)") - 1)).alias("slot"),
    )


def _owner_starts(entries: DataFrame, capacity: int, max_bits: int, owners_per_task: int = 4) -> list[int]:
    """Slots at which the owners' ranges start: first slots of buckets, about equal in keys.

    The driver sees one number per owner.
    """
    keys = entries.select("key").distinct()
    directory = build_directory(keys, capacity, max_bits).select("slot", "bucket")
    owners = owners_per_task * int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = keys.agg(F.percentile_approx(top_bits(F.col("key"), max_bits), [i / owners for i in range(1, owners)], 20 * owners).alias("slots"))
    found = cuts.select(F.explode(F.array_distinct("slots")).alias("slot")).join(directory, "slot").select("bucket").distinct().collect()
    return sorted({0, *(r["bucket"] for r in found)})


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_capacity: int = 1024, key=default_key) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when they agree after each run of separators becomes one space.  Null texts
    count as empty.  The smallest id of a class is its ``keep_id``; null ids lose to any other.
    Rows repeated with the same id and text stay once (the first copy has ``kept`` true).  An
    empty table gives an empty result; other columns of the input are ignored.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), squeeze_space(text_or_empty(text_col)).alias("norm"))
    source = source.withColumn("key", key(F.col("norm")))
    entries = materialize(source.select("doc_id", "key", F.unhex(F.sha2(F.col("norm"), 256)).alias("sha")), "dedup-entries")

    rows = entries.count()
    max_bits = max(1, math.ceil(math.log2(max(1, rows) / bucket_capacity)) + 3) if rows > bucket_capacity else 1
    slot = top_bits(F.col("key"), max_bits)
    starts = _owner_starts(entries, bucket_capacity, max_bits)
    hot = [r["key"] for r in entries.groupBy("key").count().filter(F.col("count") > max(bucket_capacity, rows // HOT_KEYS)).collect()]

    single = source.select("key", "norm", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    if hot:
        often = F.array_contains(long_array(hot), F.col("key"))
        summed = single.filter(often).groupBy("key", "norm").agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
        single = single.filter(~often).unionByName(summed)
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    owned = single.withColumn("owner", range_number(slot, starts)).repartition(tasks, "owner")
    classes = owned.groupBy("owner", "key", "norm").agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    index = materialize(classes.select("owner", "key", F.unhex(F.sha2(F.col("norm"), 256)).alias("sha"), "keep_id", "group_size"), "dedup-index")

    copies = entries.groupBy("doc_id", "key", "sha").agg(F.count(F.lit(1)).alias("copies")).withColumn("owner", range_number(slot, starts))
    found = copies.join(index, ["owner", "key", "sha"])
    return expand_copies(found, "copies", "copy").select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, columns unchanged, with one document of each group of equal texts: its least id.

    Rows are found again by id and text hash, and repeats of a row that stays are dropped where the
    join has brought them together, so texts are shuffled once.
    """
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    stay = exact_dedup(docs, **options).filter("kept").select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("mark"))
    return keep_rows(docs, id_col, F.sha2(squeeze_space(text_or_empty(text_col)), 256), stay)
