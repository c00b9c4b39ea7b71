"""Mixing sources to target weights.

Each row gets a hash-random key.  Within a source the rows are ordered by that key, id and size, rows
that agree in these are added up, and prefix sums of word counts come from per-range totals plus a
window inside each key range, so a source that holds a third of all rows, or an id that many rows
share (null, say), is spread like any other.  Each source is cut at its exact word budget, after as
many whole epochs as the budget asks for.  Rows before the cut are taken; where several rows agree
in key, id and size at the cut, they are ordered by their mark and counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cell_bits, counted_rows, expand_copies, free_name, materialize, text_or_empty, top_bits, with_exclusive_prefix, word_count

ROWS_PER_RANGE = 8192


def _random_key(id_col: str, seed: int) -> Column:
    """60 hash-random bits of the id, as a long below 2**60."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, max_repeat: float) -> DataFrame:
    """Word budget of each source: ``sizes`` (source, source_size) plus ``weight`` and ``target``.

    Sources take the weights in turn by code point, null last.  The budgets share ``share`` of all
    words by weight; none passes ``max_repeat`` times its source, and what is cut off goes to the
    others by weight.  That is a level L with target = min(cap, L * weight): sources are filled in
    the order of cap / weight, and L follows from the sums before the first that stays open (at
    later ones the same quotient is lower).  This window sees one row per source.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    place = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (place + 1).cast("int"))
    caps = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(max_repeat)))
    fill = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    upto, whole = fill.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    level = (F.lit(float(share)) * F.col("all_words") - F.col("cap_before")) / (F.col("weight_all") - F.col("weight_before"))
    return (
        caps.withColumn("all_words", F.sum("source_size").over(whole))
        .withColumn("weight_all", F.sum("weight").over(whole))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(upto), F.lit(0.0)))
        .withColumn("weight_before", F.coalesce(F.sum("weight").over(upto), F.lit(0.0)))
        .withColumn("full", F.col("cap") <= level * F.col("weight"))
        .withColumn("level", F.max(F.when(~F.col("full"), level)).over(whole))
        .withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(F.col("level") * F.col("weight")))
        .select("source", "source_size", "weight", "target")
    )


def mix_sources(
    docs: DataFrame,
    weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.5,
    max_repeat: float = 2.0,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    mark: Column | None = None,
) -> DataFrame:
    """One row per input row: ``doc_id, source, size, source_size, target, epochs, part, taken``.

    ``epochs`` whole passes plus the first ``part`` words in the pass that the budget cuts;
    ``taken = epochs * size + part``.  The words taken from a source equal its target rounded to a
    word.  Null texts have size 0, null sources are one source, ties in the random key go by id
    and size.  Reruns give the same rows.  ``mark`` is one more column of the input to return.
    """
    marked = [] if mark is None else ["mark"]
    narrow = materialize(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).cast("string").alias("source"),
            word_count(text_or_empty(text_col)).alias("size"),
            _random_key(id_col, seed).alias("key"),
            *([] if mark is None else [mark.alias("mark")]),
        ),
        "mix-sizes",
    )
    targets = source_targets(narrow.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, max_repeat)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    budgets = targets.withColumn("epochs", epochs.cast("long")).withColumn(
        "rest", F.floor(F.col("target") - F.col("epochs") * F.col("source_size") + 0.5).cast("long")
    )
    # the source's name as a key without nulls
    named = F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col("source")))
    bits = cell_bits(narrow.count(), ROWS_PER_RANGE)
    rows = narrow.withColumn("name", named)
    budgets = budgets.withColumn("name", named).select("name", "source_size", "target", "epochs", "rest")
    cuts = materialize(budgets.join(_cuts(rows, budgets, bits), "name", "left"), "mix-cuts")
    placed = rows.withColumn("place", _place()).join(cuts, "name")
    at_cut = F.coalesce(F.col("place") == F.col("cut"), F.lit(False))
    # without a cut the budget ends with the last row
    whole = F.col("cut").isNull() | (F.col("place") < F.col("cut"))
    outside = placed.filter(~at_cut).withColumn("part", F.when(whole, F.col("size")).otherwise(0))
    tied = counted_rows(placed.filter(at_cut).drop("place", "cut"))
    order = [*marked, "doc_id", "block"]
    turns = with_exclusive_prefix(tied.withColumn("cell", top_bits(F.xxhash64(*order), bits)), ["name"], "cell", order, "copies", "turn")
    inside = expand_copies(turns, "copies", "nth").withColumn("left", F.col("rest") - F.col("cut_before") - (F.col("turn") + F.col("nth") - 1) * F.col("size"))
    inside = inside.withColumn("part", F.greatest(F.lit(0).cast("long"), F.least("size", "left")))
    out = ["doc_id", "source", "size", "source_size", "target", "epochs", "part", *marked]
    both = outside.select(out).unionByName(inside.select(out))
    return both.select(*out[:7], (F.col("epochs") * F.col("size") + F.col("part")).alias("taken"), *marked)


def _place() -> Column:
    return F.struct("key", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), "size")


def _cuts(rows: DataFrame, budgets: DataFrame, bits: int) -> DataFrame:
    """``name, cut, cut_before``: the place (key, id, size) at which a source's ``rest`` ends, and the words before it."""
    summed = rows.groupBy("name", _place().alias("cut")).agg(F.sum("size").alias("words")).withColumn("range", F.shiftright("cut.key", 60 - bits) if bits else F.lit(0).cast("long"))
    before = with_exclusive_prefix(summed, ["name"], "range", ["cut"], "words", "before")
    ends = before.join(budgets.select("name", "rest"), "name").filter("before <= rest and rest < before + words")
    return ends.select("name", "cut", F.col("before").alias("cut_before"))


def take_mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed table with the columns of ``docs``: whole documents, repeated by epoch.

    The document in which a budget ends is taken whole in that pass, so no text is cut.  Documents
    the mix takes no words of are left out; rows come back once per pass that takes words of them.
    Rows are found again by id and a hash of all their columns; rows that agree in both are alike,
    so their passes are added up.  Null ids and sources are values like any other.
    """
    id_col = options.get("id_col", "doc_id")
    names = [free_name(docs, x) for x in ("mix_mark", "mix_id", "mix_nameless")]
    times, turn = (free_name(docs, x) for x in ("mix_passes", "mix_pass"))
    mark = F.xxhash64(*[docs[c] for c in docs.columns])

    def keyed(df: DataFrame, mark_: Column, id_: Column) -> DataFrame:
        return df.withColumns(dict(zip(names, (mark_, F.coalesce(id_.cast("string"), F.lit("")), id_.isNull()))))

    passes = F.col("epochs") + F.when(F.col("part") > 0, 1).otherwise(0)
    plan = mix_sources(docs, mark=mark, **options).filter("taken > 0").withColumn(times, passes)
    plan = keyed(plan, F.col("mark"), F.col("doc_id")).groupBy(*names).agg(F.sum(times).alias(times))
    found = keyed(docs, mark, docs[id_col]).dropDuplicates(names).join(plan, names)
    return found.withColumn(turn, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times)))).select(*docs.columns)
