"""Fill-in-the-middle: a text is cut at two places and its middle moved to the end.

Cuts fall between units (words and single other characters).  A matcher walks a text twice, match by
match: the first pass counts units, the second goes on to the two ranks and keeps only where they
end.  No array of units exists, so memory beyond the text is constant.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from itertools import count, islice

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

#: A unit, and the marks in front of prefix, suffix and middle.
UNIT = "[A-Za-z]+|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def count_units(pattern: re.Pattern, text: str) -> int:
    """Number of matches, none of which is kept."""
    counter = count()
    deque(zip(pattern.finditer(text), counter), maxlen=0)
    return next(counter)


def unit_ends(pattern: re.Pattern, text: str, low: int, high: int) -> tuple[int, int]:
    """Where the ``low``-th and the ``high``-th match (``low <= high``) end, in code points; 0 for rank 0."""
    matches, ends, at, before = pattern.finditer(text), [], 0, 0
    for rank in (low, high):
        if rank > before:
            at, before = next(islice(matches, rank - before - 1, None)).end(), rank
        ends.append(at)
    return ends[0], ends[1]


def cuts(unit: str = UNIT):
    """A column function of (text, first draw, second draw): ``n`` units, code points of the prefix and of the middle.

    Draws are taken modulo n + 1; matches of ``unit`` must cover a text without gaps.
    """

    @F.pandas_udf("n long, prefix_chars long, middle_chars long")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        pattern = re.compile(unit)
        for texts, first, second in batches:
            rows = []
            for text, a, b in zip(texts, first, second):
                n = count_units(pattern, text)
                start, end = unit_ends(pattern, text, *sorted((a % (n + 1), b % (n + 1))))
                rows.append((n, start, end - start))
            yield pd.DataFrame(rows, columns=["n", "prefix_chars", "middle_chars"])

    return cut


def draws(id_: Column, seed: int) -> list[Column]:
    """Four integers below 2**32 from the sha256 of ``<seed>:<id>`` (a null id counts as empty)."""
    code = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(code, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def restore_text(output: Column, form: Column) -> Column:
    """The text from which ``output`` was made, from the output and its form alone.

    No mark can begin inside another or across a cut, so the first of each kind is the real one.
    """
    at = lambda mark: F.instr(output, F.lit(mark))
    between = lambda a, b: F.substring(output, a + 3, b - a - 3)
    rest = F.char_length(output)
    p, s, m = at(PREFIX), at(SUFFIX), at(MIDDLE)
    middle = F.substring(output, m + 3, rest)
    return (
        F.when(form == "psm", F.concat(between(p, s), middle, between(s, m)))
        .when(form == "spm", F.concat(between(p, m), middle, between(s, p)))
        .otherwise(output)
    )


def fill_in_middle(docs: DataFrame, seed: int = 1, plain_percent: int = 10, spm_percent: int = 20, unit: str = UNIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n, form, prefix_chars, middle_chars, output``.

    Two draws from the id give the ranks of the cuts, two more the form: ``psm`` (prefix, suffix,
    middle), ``spm`` (suffix, prefix, middle) for ``spm_percent`` of the others, ``plain`` for
    ``plain_percent``, for empty texts and for texts that contain a mark; lengths of plain rows are
    null.  Null texts are empty; repeated rows come out alike; nothing is shuffled.
    """
    h1, h2, h3, h4 = draws(F.col(id_col), seed)
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"), h1.alias("h1"), h2.alias("h2"), h3.alias("h3"), h4.alias("h4"))
    text = F.col("text")
    marked = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    plain = (text == "") | marked | (F.col("h3") % 100 >= 100 - plain_percent)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < spm_percent, "spm").otherwise("psm")
    cut = rows.withColumn("cut", cuts(unit)("text", "h1", "h2")).select("doc_id", "text", form.alias("form"), "cut.n", "cut.prefix_chars", "cut.middle_chars")
    a, b = F.col("prefix_chars").cast("int"), F.col("middle_chars").cast("int")
    prefix, middle, suffix = F.substring(text, F.lit(1), a), F.substring(text, a + 1, b), F.substring(text, a + b + 1, F.char_length(text))
    parts = {"psm": (PREFIX, prefix, SUFFIX, suffix), "spm": (SUFFIX, suffix, PREFIX, prefix)}
    moved = {k: F.concat(F.lit(x), y, F.lit(z), w, F.lit(MIDDLE), middle) for k, (x, y, z, w) in parts.items()}
    output = F.when(F.col("form") == "plain", text).when(F.col("form") == "psm", moved["psm"]).otherwise(moved["spm"])
    shown = lambda c: F.when(F.col("form") != "plain", F.col(c)).alias(c)
    return cut.select("doc_id", "n", "form", shown("prefix_chars"), shown("middle_chars"), output.alias("output"))
