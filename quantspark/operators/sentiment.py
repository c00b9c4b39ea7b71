"""The 22 sentiment features: conditional aggregates of dated events in look-back windows.

Windows end at the as-of date (no later event is seen) and empty ones give 0.  ``spine`` is
(stock_id, as_of).  Days are cut into bins as long as the window; an event goes to its bin and the
next one and is joined by stock and bin, so it meets as-of dates at most two windows away.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Thresholds of post and article scores.
BULLISH, NEGATIVE_NEWS = 0.05, -0.5
ACTIVIST_FORMS = ("SC 13D", "SC 13D/A", "SC 13G", "SC 13G/A")
# Words that mark an adverse 8-K filing.
NEGATIVE_8K = (
    "restatement", "restate", "material weakness", "investigation", "sec inquiry", "subpoena", "grand jury",
    "resignation", "terminated", "departure", "going concern", "bankruptcy", "default", "liquidity",
)


def in_window(spine: DataFrame, events: DataFrame, days: int, undated: bool = False) -> DataFrame:
    """Events with the as-of dates they are at most ``days`` days before, as ``age`` in days."""
    bin_of = lambda c: F.floor(F.datediff(F.col(c), F.lit("1970-01-01").cast("date")) / (days + 1))
    dated = events.filter(F.col("day").isNotNull()).withColumn("__bin", F.explode(F.array(bin_of("day"), bin_of("day") + 1)))
    met = spine.withColumn("__bin", bin_of("as_of")).join(dated, ["stock_id", "__bin"]).drop("__bin")
    found = met.withColumn("age", F.datediff("as_of", "day")).filter((F.col("age") >= 0) & (F.col("age") <= days))
    if undated:
        found = found.unionByName(spine.join(events.filter(F.col("day").isNull()), "stock_id").withColumn("age", F.lit(None).cast("int")))
    return found


def _sum_if(condition: Column, value=1) -> Column:
    return F.coalesce(F.sum(F.when(condition, value)), F.lit(0))


def _mean(x: Column) -> Column:
    return F.coalesce(F.avg(x), F.lit(0.0))


def _complete(spine: DataFrame, found: DataFrame, features: list[str]) -> DataFrame:
    """Every spine row; features of rows without events are 0."""
    return spine.join(found, ["stock_id", "as_of"], "left").select("stock_id", "as_of", *[F.coalesce(f, F.lit(0)).alias(f) for f in features])


def posts(spine: DataFrame, events: DataFrame) -> DataFrame:
    """Events: stock_id, day, score, comments, compound, board."""
    week = F.col("age") <= 7
    x = lambda c: F.when(week, F.col(c))
    found = in_window(spine, events, 14).groupBy("stock_id", "as_of").agg(
        _sum_if(week).alias("reddit_mention_count_7d"),
        (_sum_if(week) - _sum_if(~week)).alias("reddit_mention_change"),
        _mean(x("compound")).alias("reddit_sentiment_avg_7d"),
        F.coalesce(F.stddev_samp(x("compound")), F.lit(0.0)).alias("reddit_sentiment_std_7d"),
        _mean((x("compound") > BULLISH).cast("double")).alias("reddit_bullish_ratio"),
        _mean(x("score")).alias("reddit_post_score_avg"),
        _mean(x("comments")).alias("reddit_comment_ratio"),
        F.coalesce(F.max((week & (F.col("board") == "wallstreetbets")).cast("int")), F.lit(0)).alias("wsb_mention_flag"),
    )
    return _complete(spine, found, [c for c in found.columns if c not in ("stock_id", "as_of")])


def news(spine: DataFrame, events: DataFrame) -> DataFrame:
    """Events: stock_id, day (null: undated, counted as recent), sentiment."""
    week = F.col("day").isNull() | (F.col("age") <= 7)
    mean7, mean30 = F.avg(F.when(week, F.col("sentiment"))), F.avg("sentiment")
    n7, n30 = _sum_if(week), F.count(F.lit(1))
    found = in_window(spine, events, 30, undated=True).groupBy("stock_id", "as_of").agg(
        n7.alias("news_volume_7d"),
        (n7 - F.greatest(F.lit(0), n30 - n7)).alias("news_volume_change"),
        F.round(F.coalesce(mean7, F.lit(0.0)), 4).alias("news_sentiment_avg_7d"),
        F.round(F.coalesce(mean30, F.lit(0.0)), 4).alias("news_sentiment_30d"),
        F.round(F.coalesce(mean7, F.lit(0.0)) - F.coalesce(mean30, F.lit(0.0)), 4).alias("news_sentiment_momentum"),
        F.coalesce(F.max((week & (F.col("sentiment") < NEGATIVE_NEWS)).cast("int")), F.lit(0)).alias("negative_news_flag"),
    )
    return _complete(spine, found, [c for c in found.columns if c not in ("stock_id", "as_of")])


def insiders(spine: DataFrame, events: DataFrame, days: int = 30) -> DataFrame:
    """Events: stock_id, day, code (P or S), amount."""
    buys, sells = _sum_if(F.col("code") == "P"), _sum_if(F.col("code") == "S")
    found = in_window(spine, events, days).groupBy("stock_id", "as_of").agg(
        buys.alias("insider_buy_count_30d"),
        sells.alias("insider_sell_count_30d"),
        F.coalesce(F.round(F.try_divide(buys - sells, buys + sells), 4), F.lit(0.0)).alias("insider_net_sentiment"),
        F.coalesce(F.sum(F.when(F.col("code") == "P", F.col("amount"))), F.lit(0.0)).alias("insider_dollar_volume"),
    )
    return _complete(spine, found, [c for c in found.columns if c not in ("stock_id", "as_of")])


def filings(spine: DataFrame, events: DataFrame) -> DataFrame:
    """Events: stock_id, day, form, negative (0 or 1)."""
    activist, stake = F.col("form").isin(*ACTIVIST_FORMS[:2]), F.col("form").isin(*ACTIVIST_FORMS)
    recent_8k = (F.col("form") == "8-K") & (F.col("age") <= 30)
    found = in_window(spine, events, 90).groupBy("stock_id", "as_of").agg(
        F.coalesce(F.max(activist.cast("int")), F.lit(0)).alias("activist_filing_flag"),
        _sum_if(stake).alias("activist_stake_change"),
        _sum_if(recent_8k).alias("material_event_count_30d"),
        F.coalesce(F.max((recent_8k & (F.col("negative") == 1)).cast("int")), F.lit(0)).alias("negative_8k_flag"),
    )
    return _complete(spine, found, [c for c in found.columns if c not in ("stock_id", "as_of")])


def sentiment_features(spine: DataFrame, post_events: DataFrame, news_events: DataFrame, insider_events: DataFrame, filing_events: DataFrame) -> DataFrame:
    """stock_id, as_of and the 22 features."""
    out = posts(spine, post_events)
    for part in (news(spine, news_events), insiders(spine, insider_events), filings(spine, filing_events)):
        out = out.join(part, ["stock_id", "as_of"])
    return out


def is_negative_filing(text: Column) -> Column:
    """1 where a filing's text has one of the adverse words, else 0."""
    return F.coalesce(F.lower(text).rlike("|".join(NEGATIVE_8K)).cast("int"), F.lit(0))


#: A small lexicon for the compound score; the published form s / sqrt(s^2 + 15) keeps it in (-1, 1).
LEXICON = {
    "gain": 2.0, "gains": 2.0, "beat": 1.5, "strong": 2.0, "growth": 1.8, "upgrade": 2.2, "profit": 1.9, "record": 1.2, "bullish": 2.5,
    "loss": -2.0, "losses": -2.0, "miss": -1.5, "weak": -1.8, "decline": -1.7, "downgrade": -2.2, "lawsuit": -2.0, "bearish": -2.5, "fraud": -3.0,
    "bankruptcy": -3.0, "worthless": -2.4, "stupid": -2.1, "good": 1.9, "great": 3.1, "bad": -2.5, "terrible": -2.9,
}


def compound_score(text: Column) -> Column:
    """Compound score of a text by LEXICON, in built-in expressions."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z]+")
    table = F.create_map(*[F.lit(x) for kv in LEXICON.items() for x in kv])
    s = F.aggregate(words, F.lit(0.0), lambda acc, w: acc + F.coalesce(F.try_element_at(table, w), F.lit(0.0)))
    return s / F.sqrt(s * s + 15)
