"""Helpers shared by the training-data operators.

Intermediate tables go to the shared folder named by ``spark.checkpoint.dir``, so that a lost
executor costs only the tasks it ran.  Nothing here collects rows of documents.
"""

from __future__ import annotations

import atexit
import math
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The bytes that separate words everywhere in this package: space, tab, LF, VT, FF, CR.
WORD = r"[^\x20\x09-\x0D]+"
#: Runs that the normalisation must rewrite: two or more separators, or one that is not a space.
_LOOSE_SPACE = r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]"


_OWN_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path in this application's part of the shared folder (``spark.checkpoint.dir``).

    Where the setting is missing, a session on one machine (tests) uses a temporary folder; on a
    cluster that is an error, since executors would not see each other's files.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if context.applicationId not in _OWN_DIRS:
            _OWN_DIRS[context.applicationId] = tempfile.mkdtemp(prefix="quantspark-")
            atexit.register(shutil.rmtree, _OWN_DIRS[context.applicationId], ignore_errors=True)
        base = "file://" + _OWN_DIRS[context.applicationId]
    return f"{base.rstrip('/')}/quantspark/{context.applicationId}/{name}-{uuid.uuid4().hex}"


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def clear_tables(spark: SparkSession) -> None:
    """Delete every intermediate table of this application; results that still read them are lost."""
    _delete(spark, shared_dir(spark, "x").rsplit("/", 1)[0])


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the written table."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written.written_to = path
    return written


def discard(table: DataFrame) -> None:
    """Delete what :func:`materialize` wrote, once nothing reads it any more."""
    _delete(table.sparkSession, table.written_to)


def carried_id(id_col: str) -> list[Column]:
    """An id for a way through Python: pandas would turn longs beside nulls into doubles."""
    id_ = F.col(id_col).cast("long")
    return [F.coalesce(id_, F.lit(0).cast("long")).alias("doc_id"), id_.isNull().alias("nameless")]


def restored_id(df: DataFrame) -> DataFrame:
    """Undo :func:`carried_id`."""
    return df.withColumn("doc_id", F.when(~F.col("nameless"), F.col("doc_id"))).drop("nameless")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def squeeze_space(text: Column) -> Column:
    """Replace every run of separators by one space (only where something changes)."""
    return F.regexp_replace(text, _LOOSE_SPACE, " ")


def word_count(text: Column) -> Column:
    """Number of words; separators are ``[\\x20\\x09-\\x0D]``."""
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def id_crc32_mod(id_col: str, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus`` (null ids count as empty text)."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def cell_bits(rows: int, per_cell: int) -> int:
    """Bits of a uniform key that split ``rows`` rows into cells of about ``per_cell``."""
    return max(0, math.ceil(math.log2(max(1, rows) / per_cell)))


def top_bits(key: Column, bits: int) -> Column:
    """The leading ``bits`` of a 64-bit key as a non-negative long."""
    return F.lit(0).cast("long") if bits == 0 else F.shiftrightunsigned(key, 64 - bits)


def long_array(values: list[int]) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def range_number(value: Column, starts: list[int]) -> Column:
    """Number of the range that holds ``value``, of ranges with the given ascending starts (the first one open below).

    Two levels of starts, so that a row is compared with few of them.
    """
    leap = max(1, int(len(starts) ** 0.5))
    below = lambda some: F.size(F.filter(some, lambda s: s <= value))
    block = F.greatest(F.lit(0), below(long_array(starts[::leap])) - 1)
    return F.greatest(F.lit(0), block * leap + below(F.slice(long_array(starts), block * leap + 1, F.lit(leap))) - 1).cast("int")


def with_exclusive_prefix(df: DataFrame, group: list[str], cell: str, order: list[str], value: str, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows before this one, within ``group``.

    Rows are ordered by ``cell`` and then by ``order``.  Only per-cell sums are brought together
    for a group; each window over rows holds one cell, so a group of any size is spread over tasks.
    """
    from pyspark.sql import Window as W

    sums = df.groupBy(*group, cell).agg(F.sum(value).alias("__cell_sum"))
    before = W.partitionBy(*group).orderBy(cell).rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("__before", F.coalesce(F.sum("__cell_sum").over(before), F.lit(0))).drop("__cell_sum")
    inside = W.partitionBy(*group, cell).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return (
        df.join(sums, [*group, cell])
        .withColumn(out, F.col("__before") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .drop("__before")
    )


def keep_rows(docs: DataFrame, id_col: str, mark: Column, stay: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id (nulls included) and ``mark`` are in ``stay`` (id, mark), each once.

    The id is split into a value and a null flag, so that the join and the removal of repeats share
    one shuffle by the same three columns.
    """
    names = [free_name(docs, x) for x in ("row_mark", "row_id", "row_nameless")]

    def keyed(df: DataFrame, id_: Column, mark_: Column) -> DataFrame:
        return df.withColumns(dict(zip(names, (mark_, F.coalesce(id_.cast("long"), F.lit(0)), id_.isNull()))))

    wanted = keyed(stay, F.col("id"), F.col("mark")).select(names).distinct()
    return keyed(docs, docs[id_col], mark).join(wanted, names, "left_semi").dropDuplicates(names).select(docs.columns)


def counted_rows(rows: DataFrame, per_block: int = 4096) -> DataFrame:
    """The distinct rows of ``rows`` with ``copies``, at most ``per_block`` in a row, and a number ``block``.

    Repeats are added up before they are shuffled; a row repeated more often comes in several blocks,
    which a hash of row and block spreads over tasks.  ``expand_copies`` undoes it.
    """
    times, first = F.col("copies"), F.col("block") * F.lit(per_block)
    return (
        rows.groupBy(*rows.columns)
        .agg(F.count(F.lit(1)).alias("copies"))
        .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((times - 1) / per_block))))
        .withColumn("copies", F.least(times - first, F.lit(per_block).cast("long")))
    )


def expand_copies(df: DataFrame, copies: str, index: str) -> DataFrame:
    """One row per copy, numbered from 1 in ``index``; undoes a count of repeated rows."""
    return df.withColumn(index, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).drop(copies)
