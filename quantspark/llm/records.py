"""Token ids as length-delimited binary records with an offset index.

A record file holds, per sequence: the payload's length (uint64), the masked checksum of that
length (uint32), the payload, and the masked checksum of the payload (uint32), all little-endian.
The checksum is CRC-32 (zlib), masked by a rotation and a constant so that a checksum stored
inside checked data does not check itself.  The payload is a null flag (1 byte), the id (int64)
and the token ids (uint16).  Beside each record file lies an index of (offset, length) pairs of
uint64, so that a reader can take records in any order.

Files hold ascending id ranges: Spark range-partitions the documents by id, each task writes one
file under a temporary name and renames it, so that a repeated task leaves the same file.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import carried_id, materialize, restored_id, shared_dir, text_or_empty
from .tokenizing import shared_encoder

# The rotation and constant of the masked checksum, as record formats use them.
MASK_ROTATE = 15
MASK_DELTA = 0xA282EAD8
HEAD, TAIL, KEY = "<QI", "<I", "<Bq"
HEAD_SIZE, TAIL_SIZE, KEY_SIZE = map(struct.calcsize, (HEAD, TAIL, KEY))
TEXTS_PER_BATCH = 3072
#: Texts of at most about so many bytes go to one file.
BYTES_PER_FILE = 256_000_000


def masked_checksum(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> MASK_ROTATE) | (c << (32 - MASK_ROTATE))) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return length + struct.pack(TAIL, masked_checksum(length)) + payload + struct.pack(TAIL, masked_checksum(payload))


def unframe(data: bytes) -> bytes:
    """The payload of one framed record; raises ValueError where a checksum or length is wrong."""
    length, check = struct.unpack_from(HEAD, data)
    if check != masked_checksum(data[:8]) or len(data) != HEAD_SIZE + length + TAIL_SIZE:
        raise ValueError("record length is damaged")
    payload = data[HEAD_SIZE : HEAD_SIZE + length]
    if struct.unpack_from(TAIL, data, HEAD_SIZE + length)[0] != masked_checksum(payload):
        raise ValueError("record payload is damaged")
    return payload


def _open_fs(uri: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri)


def _writer(out_dir: str, tokenizer: str, end_id: int):
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, root = _open_fs(out_dir)
        fs.create_dir(root, recursive=True)
        name, trial = f"part-{task.partitionId():06d}", f".{task.taskAttemptId()}"
        encoder, end = shared_encoder(tokenizer, "<u2"), struct.pack("<H", end_id)
        docs, tokens, at = 0, 0, np.uint64(0)
        out = index = None
        for pdf in batches:
            for lo in range(0, len(pdf), TEXTS_PER_BATCH):
                part = pdf.iloc[lo : lo + TEXTS_PER_BATCH]
                if out is None and len(part):
                    out, index = fs.open_output_stream(f"{root}/{name}.rec{trial}"), fs.open_output_stream(f"{root}/{name}.idx{trial}")
                records = []
                for null, doc_id, ids in zip(part["nameless"].tolist(), part["doc_id"].tolist(), encoder.encode(part["text"].tolist())):
                    records.append(frame(struct.pack(KEY, null, doc_id) + ids + end))
                    tokens += len(ids) // 2 + 1
                sizes = np.fromiter(map(len, records), dtype="<u8", count=len(records))
                ends = at + np.cumsum(sizes, dtype="<u8")
                out.write(b"".join(records))
                index.write(np.stack([ends - sizes, sizes], axis=1).astype("<u8").tobytes())
                docs, at = docs + len(records), ends[-1]
        if out is not None:
            out.close(), index.close()
            for kind in ("rec", "idx"):
                fs.move(f"{root}/{name}.{kind}{trial}", f"{root}/{name}.{kind}")
            yield pd.DataFrame({"part": [task.partitionId()], "name": [name], "docs": [docs], "tokens": [tokens]})

    return write


def write_token_records(
    docs: DataFrame, tokenizer: str, end_id: int = 2, out_dir: str | None = None, files: int | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Tokenise whole texts, append ``end_id`` and write record files in ascending id order.

    Returns the manifest, one row per file: ``part, name, docs, tokens, start, dir``; ``start`` is
    the number of ids in earlier files.  Null texts are empty (one id, the end); null ids come
    first; rows with equal ids are ordered by text hash, and may lie in several files.  An empty
    table has an empty manifest.  The folder must be one that pyarrow opens (file, hdfs, s3, gs).
    """
    spark = docs.sparkSession
    out_dir = out_dir or shared_dir(spark, "token-records")
    rows = docs.select(*carried_id(id_col), text_or_empty(text_col).alias("text"))
    if files is None:
        size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / BYTES_PER_FILE))
    order = [F.desc("nameless"), F.asc("doc_id"), F.xxhash64("text")]
    ordered = rows.repartitionByRange(files, *order).sortWithinPartitions(*order)
    written = materialize(ordered.mapInPandas(_writer(out_dir, tokenizer, end_id), "part long, name string, docs long, tokens long"), "token-manifest")
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row per file
    return written.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0))).withColumn("dir", F.lit(out_dir))


def _reader(with_ids: bool):
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for place, name, start in zip(pdf["dir"], pdf["name"], pdf["start"]):
                fs, root = _open_fs(place)
                with fs.open_input_stream(f"{root}/{name}.idx") as f:
                    spans = np.frombuffer(f.read(), dtype="<u8").reshape(-1, 2)
                with fs.open_input_stream(f"{root}/{name}.rec") as f:
                    for lo in range(0, len(spans), 1024):
                        found, sizes = [], spans[lo : lo + 1024, 1].tolist()
                        block, end = f.read(sum(sizes)), 0
                        for size in sizes:
                            payload = unframe(block[end : end + size])
                            end += size
                            null, doc_id = struct.unpack_from(KEY, payload)
                            ids = np.frombuffer(payload, dtype="<u2", offset=KEY_SIZE).astype("<u4")
                            row = (doc_id, bool(null), start, len(ids), zlib.crc32(ids.tobytes()))
                            found.append((*row, ids.astype(np.int32)) if with_ids else row)
                            start += len(ids)
                        yield pd.DataFrame(found, columns=["doc_id", "nameless", "start", "n_tokens", "ids_crc32", "ids"][: len(found[0])])

    return read


def read_token_records(manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """Read record files back, checking every length and checksum.

    One row per document: ``doc_id, start, n_tokens, ids_crc32`` and, if asked for, ``ids``.
    """
    spark = manifest.sparkSession
    schema = "doc_id long, nameless boolean, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return restored_id(manifest.select("dir", "name", "start").repartition(files, "name").mapInPandas(_reader(with_ids), schema))


def read_records_at(place: str, name: str, numbers: list[int]) -> Iterator[tuple[int | None, np.ndarray]]:
    """Random access to one file through its index: (id, token ids) of the given record numbers."""
    fs, root = _open_fs(place)
    with fs.open_input_stream(f"{root}/{name}.idx") as f:
        spans = np.frombuffer(f.read(), dtype="<u8").reshape(-1, 2)
    with fs.open_input_file(f"{root}/{name}.rec") as f:
        for n in numbers:
            at, size = spans[n].tolist()
            payload = unframe(f.read_at(size, at))
            null, doc_id = struct.unpack_from(KEY, payload)
            yield (None if null else doc_id), np.frombuffer(payload, dtype="<u2", offset=KEY_SIZE)
