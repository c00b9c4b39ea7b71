"""Packing by first-fit decreasing in randomised groups of documents.

Each document is tokenised where it is read and cut into full sequences and a remainder; only the
pieces' spans go on.  Documents are dealt by hash into groups of bounded size, and each group is
packed alone: longest first, each into the first open bin that has room, found in a tournament
tree that holds the largest free space of every subtree of bins.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carried_id, restored_id, text_or_empty
from .tokenizing import shared_encoder

PIECE = "doc_id long, nameless boolean, start long, length long, ids_crc32 long, doc_tokens long"


class BinTree:
    """Tournament tree over bins: each node holds the most free space below it."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.free = [capacity] * (2 * self.leaves)

    def place(self, length: int) -> tuple[int, int]:
        """Put ``length`` into the first bin with room; returns the bin and the free space it had."""
        free, node = self.free, 1
        while node < self.leaves:
            node *= 2
            if free[node] < length:
                node += 1
        bin_, had = node - self.leaves, free[node]
        free[node] = had - length
        node //= 2
        while node:
            most = max(free[2 * node], free[2 * node + 1])
            if free[node] == most:
                break
            free[node] = most
            node //= 2
        return bin_, had


def first_fit_decreasing(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each piece; ``lengths`` must descend and fit ``capacity``."""
    full = sum(1 for x in lengths if x == capacity)
    tree = BinTree(max(1, len(lengths) - full), capacity)
    bins, offsets = list(range(full)), [0] * full
    for x in lengths[full:]:
        b, had = tree.place(x)
        bins.append(full + b)
        offsets.append(capacity - had)
    return bins, offsets


def _cutter(tokenizer: str, end_id: int, capacity: int, groups: int, with_ids: bool):
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        encoder, end = shared_encoder(tokenizer, "<u2"), struct.pack("<H", end_id)
        task, seen = TaskContext.get().partitionId(), Counter()
        for pdf in batches:
            for lo in range(0, len(pdf), 2048):
                part, out = pdf.iloc[lo : lo + 2048], []
                for doc_id, null, raw in zip(part["doc_id"].tolist(), part["nameless"].tolist(), encoder.encode(part["text"].tolist())):
                    ids = np.frombuffer(raw + end, dtype="<u2").astype("<u4")
                    # repeats of a row are dealt apart; equal rows are alike, so a task run again deals the same
                    deal = zlib.crc32(struct.pack("<q?I", doc_id, null, zlib.crc32(raw)))
                    seen[deal] += 1
                    if seen[deal] > 1:
                        deal = zlib.crc32(struct.pack("<III", deal, task, seen[deal]))
                    for at in range(0, len(ids), capacity):
                        piece = ids[at : at + capacity]
                        row = (doc_id, null, at, len(piece), zlib.crc32(piece.tobytes()), len(ids), deal % groups)
                        out.append((*row, piece.astype(np.int32)) if with_ids else row)
                columns = ["doc_id", "nameless", "start", "length", "ids_crc32", "doc_tokens", "pack_group", "ids"][: 8 if with_ids else 7]
                yield pd.DataFrame(out, columns=columns)

    return cut


def _packer(capacity: int):
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = ["length", "nameless", "doc_id", "start", "ids_crc32"]
        pdf = pdf.sort_values(keys, ascending=[False, False, True, True, True], kind="stable")
        bins, offsets = first_fit_decreasing(pdf["length"].tolist(), capacity)
        pdf["sequence_id"] = (pdf["pack_group"].to_numpy(dtype=np.int64) << 32) + np.array(bins, dtype=np.int64)
        pdf["offset"] = np.array(offsets, dtype=np.int64)
        return pdf.drop(columns="pack_group")

    return pack


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = 2048,
    end_id: int = 1,
    docs_per_group: int = 4096,
    with_ids: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` (and ``ids``).

    Every token of every document, the end id included, lies in one piece.  Pieces in a sequence
    are gapless from offset 0 and fill at most ``capacity``.  Null texts are empty (one id); null
    ids and repeated rows are documents like any other.  An empty table gives no pieces.

    A group gets about ``docs_per_group`` documents, or fewer where they are longer than
    4 * ``capacity`` bytes on average, so that its pieces fit one task.
    """
    rows = docs.select(*carried_id(id_col), text_or_empty(text_col).alias("text"))
    count, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    groups = max(1, math.ceil(count / docs_per_group), math.ceil(size / (4 * capacity * docs_per_group)))
    ids = ", ids array<int>" if with_ids else ""
    pieces = rows.mapInPandas(_cutter(tokenizer, end_id, capacity, groups, with_ids), f"{PIECE}, pack_group long{ids}")
    return restored_id(pieces.groupBy("pack_group").applyInPandas(_packer(capacity), f"{PIECE}{ids}, sequence_id long, offset long"))


def packed_sequences(docs: DataFrame, tokenizer: str, capacity: int = 2048, pad_id: int = 0, **options) -> DataFrame:
    """The sequences themselves: ``sequence_id, n_tokens, input_ids`` (padded), ``doc_starts``.

    Nulls, repeats and empty tables are as in :func:`pack_documents`.
    """
    pieces = pack_documents(docs, tokenizer, capacity, with_ids=True, **options)
    found = pieces.groupBy("sequence_id").agg(  # at most ``capacity`` ids in a group
        F.sum("length").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts")
    )
    ids = F.flatten(F.col("parts.ids"))
    pad = F.array_repeat(F.lit(pad_id), F.lit(capacity) - F.size(ids))
    return found.select("sequence_id", "n_tokens", F.concat(ids, pad).alias("input_ids"), F.col("parts.offset").alias("doc_starts"))
