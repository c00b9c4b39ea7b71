"""Spelling variants: words one edit apart, each pointing at its more frequent neighbour.

Every word emits itself and its distinct single deletions as keys (symmetric delete).  Two words one
edit apart share exactly one key, so an equi-join of the keys finds every pair once; a pair is then
verified exactly.  Neighbours are added up per word, and roots are found by joining the forms with
themselves until nothing moves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

#: Fixed value: the letters that words consist of.
LETTERS = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of at least this many code points are paired by hash and looked up afterwards, so that a
#: word of n letters costs n small rows and not n copies of itself.  It changes cost only.
LONG_WORD = 64


def lower_ascii(word: Column) -> Column:
    """``word`` with A to Z, and no other letter, in lower case."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def word_counts(
    docs: DataFrame, least_length: int = 5, least_count: int = 3, slip_every: int | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``word, n``: the lower-cased runs of letters of all texts, and how often each occurs.

    With ``slip_every`` a run whose crc32 of ``<id>:<run>`` it divides loses the code point at that
    number modulo the run's length.  Words shorter than ``least_length`` or rarer than ``least_count``
    go.  Null texts have no words, a null id counts as empty, repeated rows count each time.
    """
    runs = docs.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(LETTERS), F.lit(0))).alias("run")
    )
    words = runs.select("id", lower_ascii(F.col("run")).alias("word"))
    if slip_every:
        code = F.crc32(F.concat("id", F.lit(":"), "word").cast("binary"))
        at = F.pmod(code, F.char_length("word").cast("long")).cast("int")
        less = F.concat(F.substring("word", F.lit(1), at), F.substring(F.col("word"), at + 2, F.char_length("word")))
        words = words.select(F.when(code % slip_every == 0, less).otherwise(F.col("word")).alias("word"))
    kept = words.filter(F.char_length("word") >= least_length)
    return kept.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_count)


def deletion_keys(words: DataFrame, *carried: str) -> DataFrame:
    """``key`` and ``carried`` columns: a row for each word itself and for each of its distinct single deletions.

    Deleting any letter of a run of equal letters gives the same word, so only a run's first place counts.
    """
    places = words.select("word", *[c for c in carried if c != "word"], F.explode(F.sequence(F.lit(0), F.char_length("word"))).alias("at"))
    letter = lambda at: F.substring(F.col("word"), at, F.lit(1))
    at = F.col("at")
    distinct = places.filter((at <= 1) | (letter(at) != letter(at - 1)))
    key = F.xxhash64(F.concat(F.substring(F.col("word"), F.lit(1), at - 1), F.substring(F.col("word"), at + 1, F.char_length("word"))))
    return distinct.select(key.alias("key"), *carried)


def _by_shuffle(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """A join that never gathers a side in the driver.

    Both sides grow with the corpus, and what Spark expects of them is the size of compressed files
    before a word becomes its keys, far below the rows that a broadcast would bring together.
    """
    return left.join(right.hint("merge"), on, how)


def _meetings(rows: DataFrame, name: str) -> DataFrame:
    """Ordered pairs of rows that share a key: ``name, n, other, other_n``."""
    left = rows.select("key", name, "n")
    right = rows.select("key", F.col(name).alias("other"), F.col("n").alias("other_n"))
    return _by_shuffle(left, right, "key").filter(F.col(name) != F.col("other")).drop("key")


def near_words(words: DataFrame) -> DataFrame:
    """``word, n, other, other_n``: every ordered pair of ``words`` exactly one edit apart, once.

    A key is shared by at most as many words as one letter more or less can make.
    """
    length = F.char_length("word")
    short = _meetings(deletion_keys(words.filter(length <= LONG_WORD), "word", "n"), "word")
    long = words.filter(length >= LONG_WORD).withColumn("name", F.xxhash64("word"))
    names = long.select(F.col("name"), "word")
    met = _meetings(deletion_keys(long, "name", "n"), "name").distinct()
    met = _by_shuffle(_by_shuffle(met, names, "name"), names.select(F.col("name").alias("other"), F.col("word").alias("other_word")), "other")
    met = met.filter((length > LONG_WORD) | (F.char_length("other_word") > LONG_WORD)).select("word", "n", F.col("other_word").alias("other"), "other_n")
    return short.unionByName(met).filter(F.levenshtein("word", "other", 1) == 1)


def with_forms(words: DataFrame, ratio: float = 2.0) -> DataFrame:
    """``word, n, n_near, form, form_n``: the near word of largest count (ties: the first in code-point order), if it is ``ratio`` times the word's."""
    near = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form"))).alias("best"))
    joined = _by_shuffle(words, near, "word", "left")
    much = -F.col("best.less") >= F.col("n") * ratio
    return joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(much, F.col("best.form")).alias("form"), F.when(much, -F.col("best.less")).alias("form_n")
    )


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of every row of ``forms`` (word, form, no nulls): where following the forms ends.

    Counts grow along the way, so there is no circle.  Each round doubles the reach: a chain of k
    steps takes log2(k) rounds.  Rows whose root has no form of its own take no part in later rounds.
    """
    forms = forms.select("word", F.col("form").alias("root"))
    inner = forms.select(F.col("word").alias("root"), F.lit(True).alias("goes_on"))
    state = materialize(_by_shuffle(forms, inner, "root", "left").select("word", "root", F.coalesce("goes_on", F.lit(False)).alias("goes_on")), "spelling-roots")
    while not state.filter("goes_on").isEmpty():
        onward = state.select(F.col("word").alias("root"), F.col("root").alias("next"), F.col("goes_on").alias("next_goes_on"))
        moved = _by_shuffle(state.filter("goes_on"), onward, "root").select("word", F.col("next").alias("root"), F.col("next_goes_on").alias("goes_on"))
        before, state = state, materialize(state.filter("not goes_on").unionByName(moved), "spelling-roots")
        discard(before)
    return state.select("word", "root")


def spelling_variants(docs: DataFrame, least_length: int = 5, least_count: int = 3, ratio: float = 2.0, slip_every: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per word: ``word, form, root, n, n_near, form_n``.

    ``form`` is the near word it is a variant of, or null; ``root`` is where forms lead, the word
    itself without one; ``n_near`` counts near words.  Without any word the result is empty.
    """
    words = materialize(word_counts(docs, least_length, least_count, slip_every, id_col, text_col), "spelling-words")
    formed = materialize(with_forms(words, ratio), "spelling-forms")
    ends = roots(formed.filter("form is not null"))
    found = _by_shuffle(formed, ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
    return found.select("word", "form", "root", "n", "n_near", "form_n")
