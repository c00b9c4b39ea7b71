"""Sharding by minimax contiguous partition.

Groups of equal texts are atomic and ordered by a hash of the text.  The smallest shard capacity
for which a greedy walk over the ordered groups needs no more than the given number of shards is
found by binary search, and the walk at that capacity gives the cuts.

The driver never holds the groups.  It holds sums over ranges of the hash order (at most
``2 * MAX_CELLS`` of them); only ranges in which a cut can still fall are split further, by one
aggregation a round, until every such range is a single group.  Then the capacity is exact.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cell_bits, counted_rows, expand_copies, materialize, text_or_empty, top_bits, with_exclusive_prefix

POSITION_BITS = 62
MAX_CELLS = 65536
ROWS_PER_SLOT_CELL = 4096
RECORD_OVERHEAD = 16


@dataclass
class Cells:
    """Ranges of the hash order: [low, low + 2**shift), with the sum and number of their groups."""

    low: np.ndarray
    shift: np.ndarray
    total: np.ndarray
    groups: np.ndarray

    def take(self, which) -> "Cells":
        return Cells(self.low[which], self.shift[which], self.total[which], self.groups[which])

    def plus(self, other: "Cells") -> "Cells":
        both = [np.concatenate(x) for x in zip(vars(self).values(), vars(other).values())]
        order = np.argsort(both[0], kind="stable")
        return Cells(*[x[order] for x in both])


def _cuts(ends: np.ndarray, atomic: np.ndarray, capacity: int, shards: int, fluid: bool):
    """Sums at which the greedy walk cuts, or None if it needs more than ``shards``.

    With ``fluid`` a cut may fall anywhere inside a range that is not atomic.
    """
    at, cuts = 0, []
    for _ in range(shards):
        reach = at + capacity
        if reach >= ends[-1]:
            return cuts
        i = int(np.searchsorted(ends, reach, side="right"))  # the first range that does not fit
        start = int(ends[i - 1]) if i else 0
        nxt = reach if fluid and not atomic[i] else start
        if nxt <= at:
            return None
        at = nxt
        cuts.append(at)
    return None


def _least_capacity(ends, atomic, shards: int, fluid: bool, low: int) -> int:
    lo, hi = low, int(ends[-1])
    while lo < hi:
        mid = (lo + hi) // 2
        if _cuts(ends, atomic, mid, shards, fluid) is None:
            lo = mid + 1
        else:
            hi = mid
    return lo


def _sums(groups: DataFrame, shift: int) -> Cells:
    rows = (
        groups.groupBy(F.shiftright("pos", shift).alias("cell"))
        .agg(F.sum("size").alias("total"), F.count(F.lit(1)).alias("groups"))
        .orderBy("cell")
        .collect()
    )
    cell = np.array([r[0] for r in rows], dtype=np.int64)
    return Cells(cell << shift, np.full(len(rows), shift), np.array([r[1] for r in rows], dtype=np.int64), np.array([r[2] for r in rows], dtype=np.int64))


def _split(groups: DataFrame, cells: Cells) -> Cells:
    """Sums over the parts of the given ranges; each is split as finely as MAX_CELLS allows."""
    bits = max(1, (MAX_CELLS // max(1, len(cells.low))).bit_length() - 1)
    out = None
    for shift in np.unique(cells.shift).tolist():
        ids = (cells.low[cells.shift == shift] >> shift).tolist()
        wanted = groups.sparkSession.createDataFrame([(i,) for i in ids], "cell long")  # at most MAX_CELLS rows
        inside = groups.join(F.broadcast(wanted), F.shiftright("pos", shift) == F.col("cell"), "left_semi")
        part = _sums(inside, max(0, shift - bits))
        out = part if out is None else out.plus(part)
    return out


def minimax_cuts(groups: DataFrame, shards: int) -> list[int]:
    """First positions of the second and later shards for ``groups`` (pos, size), both long.

    The largest shard is as small as contiguous shards can make it.
    """
    total, count = groups.agg(F.sum("size"), F.count(F.lit(1))).first()
    if not count or shards < 2:
        return []
    first_bits = min(POSITION_BITS, max(1, int(MAX_CELLS).bit_length() - 5))
    cells = _sums(groups, POSITION_BITS - first_bits if count > MAX_CELLS else 0)
    while True:
        ends, atomic = np.cumsum(cells.total), (cells.groups == 1) | (cells.shift == 0)
        low = _least_capacity(ends, atomic, shards, True, -(-int(total) // shards))
        high = _least_capacity(ends, atomic, shards, False, low)
        starts, open_ = ends - cells.total, np.zeros(len(ends), bool)
        ideal = [int(total) * k // shards for k in range(1, shards)]
        if low < high:
            # the k-th cut at any capacity between low and high lies between these sums
            at, early = 0, []
            for _ in ideal:
                i = int(np.searchsorted(ends, at + low, side="right"))
                at = max(at, int(ends[i - 1]) if i else 0)
                early.append(at)
            late = _cuts(ends, atomic, high, shards, True) or []
            late = late + [int(ends[-1])] * (shards - 1 - len(late))
            for a, b in zip(early, late):
                open_[np.searchsorted(ends, a, side="left") : np.searchsorted(starts, b, side="right")] = True
        else:  # the capacity is exact; only where even cuts would fall may still need splitting
            open_[np.searchsorted(ends, ideal, side="left")] = True
        open_ &= ~atomic
        if not open_.any():
            break
        if open_.sum() > MAX_CELLS:  # the earliest ranges first; the rest comes in later rounds
            open_ &= np.cumsum(open_) <= MAX_CELLS
        cells = cells.take(~open_).plus(_split(groups, cells.take(open_)))
    capacity = _least_capacity(ends, atomic, shards, False, low)
    places = np.concatenate([[0], ends])
    return [int(cells.low[np.searchsorted(ends, c, side="right")]) for c in _even_cuts(places, ends, atomic, capacity, ideal) if c < ends[-1]]


def _even_cuts(places: np.ndarray, ends: np.ndarray, atomic: np.ndarray, capacity: int, ideal: list[int]) -> list[int]:
    """Cuts near the even ones, such that no shard passes ``capacity``.

    The greedy walk from the front gives the last place for each cut, the walk from the back the first.
    """
    last = _cuts(ends, atomic, capacity, len(ideal) + 1, False)
    last = last + [int(ends[-1])] * (len(ideal) - len(last))
    first, at = [], int(ends[-1])
    for _ in ideal:
        at = int(places[np.searchsorted(places, max(0, at - capacity), side="left")])
        first.append(at)
    cuts, at = [], 0
    for want, lo, hi in zip(ideal, reversed(first), last):
        i = int(np.searchsorted(places, want))
        near = int(places[i]) if i == 0 or places[i] - want <= want - places[i - 1] else int(places[i - 1])
        reach = int(places[np.searchsorted(places, at + capacity, side="right") - 1])
        at = max(at, lo, min(near, hi, reach))
        cuts.append(at)
    return cuts


def shard_documents(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    Law ``bytes``: the largest shard is as small as possible and rows of equal text share a shard.
    A group larger than an equal share of what is left gets a shard of its own (there are fewer
    than ``shards`` such groups); the others are cut by :func:`minimax_cuts`.  A size is the UTF-8
    length plus 16; null texts have size 16, checksum 0 and go with empty ones.  Slots count from
    0 in each shard without gaps.  With fewer groups than shards, shards stay empty.  Slots follow a
    hash of id and text, so rows without an id spread like others; repeats of a row are added up
    and get slots block by block.  After the greedy walk has given the least capacity, cuts move
    to the places nearest even ones that keep within it.
    """
    text = text_or_empty(text_col)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + RECORD_OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64(text), 64 - POSITION_BITS).alias("pos"),
    )
    narrow = materialize(counted_rows(rows), "shard-rows")
    groups = materialize(narrow.groupBy("pos").agg(F.sum(F.col("size") * F.col("copies")).alias("size")), "shard-groups")
    total = groups.agg(F.sum("size")).first()[0] or 0
    alone, left = [], total
    for pos, size in groups.orderBy(F.desc("size"), "pos").limit(shards).collect():
        if len(alone) == shards - 1 or size * (shards - len(alone)) <= left:
            break
        alone.append(pos)
        left -= size
    cuts = minimax_cuts(groups.filter(~F.col("pos").isin(alone)) if alone else groups, shards - len(alone))

    passed = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col("pos"))) if cuts else F.lit(0)
    shard = F.lit(len(alone)) + passed
    for i, pos in enumerate(alone):
        shard = F.when(F.col("pos") == pos, F.lit(i)).otherwise(shard)
    bits = cell_bits(narrow.count(), ROWS_PER_SLOT_CELL * shards)
    placed = narrow.withColumn("shard", shard.cast("int")).withColumn("cell", top_bits(F.xxhash64("doc_id", "pos", "block"), bits))
    counted = with_exclusive_prefix(placed, ["shard"], "cell", ["doc_id", "pos", "size", "block"], "copies", "start")
    return expand_copies(counted, "copies", "nth").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("start") + F.col("nth") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
