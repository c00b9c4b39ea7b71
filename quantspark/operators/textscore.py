"""Scores of texts by a lexicon of words and rules about their neighbours.

Every text's words are laid out with the three before them, joined with the lexicon, and only the
words it has go on; rules for negation, boosters, capitals and "but" change their worth, and the sum
of a text, with its exclamation and question marks, is brought into (-1, 1).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The published scalars of rule-based scoring.
BOOST, CAPITALS, NEGATE, BEFORE_BUT, AFTER_BUT = 0.293, 0.733, -0.74, 0.5, 1.5
BY_DISTANCE = (1.0, 0.95, 0.9)
EXCLAIM, MOST_EXCLAIM, QUESTION, MOST_QUESTION = 0.292, 4, 0.18, 0.96
NORMAL = 15.0
# Words that raise, lower or turn the worth of what follows.
BOOSTERS = {
    **dict.fromkeys("absolutely amazingly completely considerably deeply enormously entirely especially exceptionally extremely greatly highly hugely incredibly intensely more most particularly purely quite really remarkably so substantially thoroughly totally tremendously unusually utterly very".split(), BOOST),
    **dict.fromkeys("almost barely hardly less little marginally occasionally partly scarcely slightly somewhat".split(), -BOOST),
}
NEGATIONS = tuple("aint arent cannot cant couldnt didnt doesnt dont hadnt hasnt havent isnt neither never no none nope nor not nothing nowhere shouldnt wasnt werent without wont wouldnt rarely seldom despite ain't aren't can't couldn't didn't doesn't don't hadn't hasn't haven't isn't shouldn't wasn't weren't won't wouldn't".split())
#: Worth of words in financial news and posts, by stem; LEXICON adds their inflections.
STEMS = {
    "achieve": 1.6, "advance": 1.3, "approve": 1.5, "beat": 1.5, "benefit": 1.7, "boost": 1.7, "climb": 1.2, "exceed": 1.6, "expand": 1.2, "gain": 2.0, "grow": 1.6, "improve": 1.9,
    "jump": 1.4, "outperform": 2.2, "profit": 1.9, "rally": 1.7, "rebound": 1.4, "recover": 1.4, "reward": 2.0, "rise": 1.1, "soar": 2.1, "succeed": 2.2, "surge": 1.8, "surpass": 1.6,
    "thrive": 2.2, "upgrade": 2.2, "win": 2.6, "abandon": -1.9, "accuse": -1.8, "cancel": -1.2, "collapse": -2.5, "crash": -2.4, "cut": -1.1, "damage": -2.0, "decline": -1.7, "default": -2.3,
    "delay": -1.2, "disappoint": -2.0, "downgrade": -2.2, "drop": -1.3, "fail": -2.3, "fall": -1.2, "lose": -1.9, "miss": -1.5, "plunge": -2.2, "recall": -1.3, "sink": -1.6, "slump": -1.9,
    "struggle": -1.6, "sue": -1.7, "suffer": -2.1, "suspend": -1.5, "threaten": -2.0, "tumble": -1.8, "violate": -2.2, "warn": -1.4, "worry": -1.7,
}
#: Words without inflections.
WORDS = {
    "bullish": 2.5, "strong": 2.0, "growth": 1.8, "record": 1.2, "good": 1.9, "great": 3.1, "excellent": 2.7, "positive": 2.3, "best": 3.2, "success": 2.7, "winner": 2.8, "confident": 2.2,
    "optimistic": 1.9, "robust": 1.8, "bearish": -2.5, "loss": -2.0, "losses": -2.0, "weak": -1.8, "bad": -2.5, "terrible": -2.9, "worst": -3.1, "negative": -2.2, "lawsuit": -2.0, "fraud": -3.0,
    "bankruptcy": -3.0, "scandal": -2.4, "crisis": -2.6, "risk": -1.1, "debt": -1.2, "worthless": -2.4, "stupid": -2.1, "poor": -1.9, "fear": -2.2, "disgusting": -2.4, "clown": -1.4, "idiot": -2.3,
}


def inflections(stem: str) -> list[str]:
    """A verb's stem and its regular forms: gain, gains, gained, gaining."""
    if stem.endswith("e"):
        return [stem, stem + "s", stem + "d", stem[:-1] + "ing"]
    if stem.endswith("y") and stem[-2] not in "aeiou":
        return [stem, stem[:-1] + "ies", stem[:-1] + "ied", stem + "ing"]
    return [stem, stem + ("es" if stem.endswith(("s", "sh", "ch", "x")) else "s"), stem + "ed", stem + "ing"]


LEXICON = {form: worth for stem, worth in STEMS.items() for form in inflections(stem)} | WORDS

#: Separators of words, what is cut off a word's ends, and a word in capitals.
SPACE, EDGES, CAPS = r"[\x20\x09-\x0D]+", r"^[^A-Za-z0-9À-ÿ']+|[^A-Za-z0-9À-ÿ']+$", r"^[^a-zß-ÿ]*[A-ZÀ-Þ][^a-zß-ÿ]*$"


def _looked_up(word: Column, table: dict[str, float], otherwise: float) -> Column:
    """A short table as one expression."""
    out = F.lit(otherwise)
    for worth in sorted(set(table.values())):
        out = F.when(word.isin([w for w, x in table.items() if x == worth]), worth).otherwise(out)
    return out


def word_worths(texts: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``key, worth`` of the lexicon's words in ``texts`` (key, text) after all rules about neighbours."""
    words = F.filter(F.transform(F.split("text", SPACE), lambda w: F.regexp_replace(w, EDGES, "")), lambda w: w != "")
    rows = texts.select("key", words.alias("w")).filter(F.size("w") > 0)
    lower = F.transform("w", F.lower)
    rows = rows.select("key", "w", F.array_position(lower, "but").alias("but"), F.exists("w", lambda w: ~w.rlike(CAPS)).alias("mixed"))
    near = lambda i, k: F.when(i >= k, F.get("w", i - k)).alias(f"p{k}")
    each = F.transform("w", lambda w, i: F.struct(w.alias("word"), (i + 1).alias("at"), *[near(i, k) for k in (1, 2, 3)]))
    found = rows.select("key", "but", "mixed", F.explode(each).alias("x")).select("key", "but", "mixed", "x.*").withColumn("lower", F.lower("word"))
    found = found.join(lexicon.select(F.col("word").alias("lower"), "valence"), "lower")
    sign, caps = F.signum("valence"), F.col("mixed")
    worth = F.col("valence") + F.when(caps & F.col("word").rlike(CAPS), sign * CAPITALS).otherwise(0.0)
    for k, share in zip((1, 2, 3), BY_DISTANCE):
        before = F.coalesce(F.col(f"p{k}"), F.lit(""))
        boost = _looked_up(F.lower(before), BOOSTERS, 0.0)
        boost = F.when(boost == 0.0, 0.0).otherwise(boost * sign + F.when(caps & before.rlike(CAPS), sign * CAPITALS).otherwise(0.0))
        worth = (worth + boost * share) * F.when(F.lower(before).isin(*NEGATIONS), NEGATE).otherwise(1.0)
    side = F.when((F.col("but") > 0) & (F.col("at") < F.col("but")), BEFORE_BUT).when((F.col("but") > 0) & (F.col("at") > F.col("but")), AFTER_BUT).otherwise(1.0)
    return found.select("key", (worth * side).alias("worth"))


def emphasis(text: Column) -> Column:
    """What exclamation and question marks add to the strength of a text."""
    marks = F.least(F.lit(MOST_EXCLAIM), F.regexp_count(text, F.lit("!"))) * EXCLAIM
    asked = F.regexp_count(text, F.lit(r"\?"))
    return marks + F.when(asked > 3, MOST_QUESTION).when(asked > 1, asked * QUESTION).otherwise(0.0)


def score_texts(df: DataFrame, text: Column, name: str = "compound", lexicon: DataFrame | None = None) -> DataFrame:
    """``df`` with the score of ``text``, from -1 to 1; 0 for null texts and those without a word of the lexicon.

    Each distinct text is scored once and found again by its md5.  ``lexicon`` (word, valence) defaults
    to LEXICON; its words are lower case, the first valence of a repeated word counts.
    """
    words = df.sparkSession.createDataFrame(list(LEXICON.items()), "word string, valence double") if lexicon is None else lexicon.dropDuplicates(["word"])
    keyed = df.withColumns({"__text": F.coalesce(text, F.lit("")), "__key": F.md5(F.coalesce(text, F.lit("")).cast("binary"))})
    texts = keyed.select(F.col("__key").alias("key"), F.col("__text").alias("text")).dropDuplicates(["key"])
    sums = word_worths(texts, words).groupBy("key").agg(F.sum("worth").alias("__sum"))
    joined = keyed.join(sums.withColumnRenamed("key", "__key"), "__key", "left")
    s = F.col("__sum") + F.signum("__sum") * emphasis(F.col("__text"))
    score = F.coalesce(s / F.sqrt(s * s + NORMAL), F.lit(0.0))
    return joined.select(*[F.col(c) for c in df.columns], score.alias(name))
