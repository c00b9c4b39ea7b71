"""Readers that turn source files into the stored tables: universe, bars, filings, Form 4, news and posts.

Every reader takes files a collector left behind; nothing here opens a connection.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def universe(spark: SparkSession, path: str) -> DataFrame:
    """Stocks from a JSON document with a list ``stocks``; active unless it says otherwise."""
    schema = "stocks array<struct<ticker:string,cik:string,company:string,sector:string,sector_etf:string,industry:string,is_active:int>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("stocks").alias("s")).select("s.*")
    return rows.select("ticker", pad_cik(F.col("cik")).alias("cik"), F.col("company").alias("company_name"), "sector", "sector_etf", "industry", F.coalesce("is_active", F.lit(1)).alias("is_active"))


def pad_cik(cik: Column) -> Column:
    """Ten digits with leading zeros."""
    return F.lpad(F.regexp_replace(F.trim(cik), "^0+", ""), 10, "0")


def price_rows(raw: DataFrame) -> DataFrame:
    """Vendor bars (stock_id, date, open, high, low, close, adj_close, volume) as stored.

    Missing prices count as 0, prices have four decimals, a missing adjusted close is the close.
    """
    price = lambda c: F.round(F.coalesce(F.col(c), F.lit(0.0)), 4).alias(c)
    adjusted = F.round(F.coalesce("adj_close", "close", F.lit(0.0)), 4).alias("adj_close")
    return raw.select("stock_id", F.to_date("date").alias("date"), *map(price, ("open", "high", "low", "close")), adjusted, F.coalesce("volume", F.lit(0)).cast("long").alias("volume"))


def read_prices(spark: SparkSession, path: str, kind: str = "csv") -> tuple[DataFrame, DataFrame]:
    """Vendor bars from CSV (with a header) or JSON lines: rows as stored, and the quarantine.

    The quarantine (line, reason) has the lines that cannot be read, have no stock or day, a price
    below 0, a low above the high or a close outside both; stored rows are the first of each stock and day.
    """
    fields = "stock_id long, date string, open double, high double, low double, close double, adj_close double, volume double, __line string"
    reader = spark.read.schema(fields).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "__line")
    raw = reader.csv(path, header=True) if kind == "csv" else reader.json(path)
    least = F.least(*[F.col(c) for c in ("open", "high", "low", "close", "adj_close", "volume")])
    low, high, close = (F.col(c) for c in ("low", "high", "close"))
    reason = (
        F.when(F.col("__line").isNotNull(), "unreadable")
        .when(F.col("stock_id").isNull(), "no stock")
        .when(F.try_to_date("date").isNull(), "no day")
        .when(least < 0, "below 0")
        .when(low > high, "low above high")
        .when((close > high) | (close < low), "close outside low and high")
    )
    told = raw.withColumn("__reason", reason)
    line = F.coalesce("__line", F.to_json(F.struct(*[c for c in raw.columns if c != "__line"])))
    good = told.filter("__reason is null").dropDuplicates(["stock_id", "date"])
    return price_rows(good), told.filter("__reason is not null").select(line.alias("line"), F.col("__reason").alias("reason"))


def fact_rows(documents: DataFrame, taxonomy: str = "us-gaap", forms: Sequence[str] = ("10-K", "10-Q", "10-K/A", "10-Q/A")) -> DataFrame:
    """Facts from the vendor's nested maps: stock_id, tag, unit, period_start, period_end, filed, accession_number, form, value.

    ``documents`` has stock_id and ``json`` (facts by taxonomy, tag and unit).  Facts without an end, a filing
    day or a value, and those of other forms, are left out; broken documents give none.
    """
    fact = "array<struct<start:string,end:string,val:double,accn:string,form:string,filed:string>>"
    parsed = documents.select("stock_id", F.from_json("json", f"facts map<string,map<string,struct<units:map<string,{fact}>>>>").alias("d"))
    tags = parsed.select("stock_id", F.explode(F.try_element_at(F.col("d.facts"), F.lit(taxonomy))).alias("tag", "t"))
    units = tags.select("stock_id", "tag", F.explode("t.units").alias("unit", "facts"))
    f = units.select("stock_id", "tag", "unit", F.explode("facts").alias("f"))
    rows = f.select(
        "stock_id", "tag", "unit", F.try_to_date("f.start").alias("period_start"), F.try_to_date("f.end").alias("period_end"), F.try_to_date("f.filed").alias("filed"),
        F.col("f.accn").alias("accession_number"), F.col("f.form").alias("form"), F.col("f.val").alias("value"),
    )
    return rows.filter(F.col("period_end").isNotNull() & F.col("filed").isNotNull() & F.col("value").isNotNull() & F.col("form").isin(list(forms)))


def facts_known(spine: DataFrame, facts: DataFrame, tags: Sequence[str]) -> DataFrame:
    """stock_id, as_of, tag, period_end, filed, value: for each day of ``spine`` (stock_id, as_of) the newest period filed by then, as stated in its newest filing by then.

    A restatement counts from the day it was filed, and a late filing of an older period never hides a
    newer one.  Days without any fact have nulls.  Of several values filed on one day for a period the largest counts.
    """
    from ..functions.windows import asof_join

    wanted = facts.filter(F.col("tag").isin(list(tags)))
    daily = wanted.groupBy("stock_id", "tag", "filed").agg(F.max(F.struct("period_end", "filed", "value")).alias("newest"))
    so_far = F.max("newest").over(W.partitionBy("stock_id", "tag").orderBy("filed").rowsBetween(W.unboundedPreceding, 0))
    best = daily.select("stock_id", "tag", F.col("filed").alias("date"), so_far.alias("best"))
    asked = spine.select("stock_id", F.col("as_of").alias("date"), F.explode(F.array(*map(F.lit, tags))).alias("tag")).distinct()
    found = asof_join(asked, best, ["stock_id", "tag"], values=["best"])
    return found.select("stock_id", F.col("date").alias("as_of"), "tag", "best.period_end", "best.filed", "best.value")


def missing_ranges(stocks: DataFrame, prices: DataFrame, as_of, years: int = 5) -> DataFrame:
    """stock_id, fetch_from: the first day to fetch per stock; stocks at most a day behind are left out."""
    last = prices.groupBy("stock_id").agg(F.max("date").alias("last"))
    day = F.lit(as_of).cast("date")
    start = F.when(F.col("last").isNull(), F.add_months(day, -12 * years)).otherwise(F.date_add("last", 1))
    return stocks.join(last, "stock_id", "left").filter(F.col("last").isNull() | (F.datediff(day, "last") > 1)).select("stock_id", start.alias("fetch_from"))


def filing_rows(documents: DataFrame, forms: Sequence[str], as_of, days_back: int) -> DataFrame:
    """Filings from the vendor's parallel arrays: ``documents`` has stock_id and ``json``.

    Positions beyond the shortest list have no accession number and are left out.
    """
    lists = ("accessionNumber", "filingDate", "form", "primaryDocument", "reportDate")
    schema = "filings struct<recent:struct<" + ",".join(f"{x}:array<string>" for x in lists) + ">>"
    recent = documents.select("stock_id", F.from_json("json", schema).getField("filings").getField("recent").alias("r"))
    rows = recent.select("stock_id", F.explode(F.arrays_zip(*[F.col(f"r.{x}").alias(x) for x in lists])).alias("f"))
    filed = F.to_date("f.filingDate")
    complete = F.col("f.accessionNumber").isNotNull() & F.col("f.form").isNotNull() & filed.isNotNull()
    kept = rows.filter(complete & F.col("f.form").isin(list(forms)) & (filed >= F.date_sub(F.lit(as_of).cast("date"), days_back)))
    return kept.select(
        "stock_id",
        F.col("f.accessionNumber").alias("accession_number"),
        F.col("f.form").alias("form_type"),
        filed.alias("filed_date"),
        F.try_to_date("f.reportDate").alias("period_of_report"),
        F.to_json("f").alias("raw_json"),
    )


_MONEY = "struct<value:string,_VALUE:string>"
_FORM4 = f"""reportingOwner struct<reportingOwnerId:struct<rptOwnerName:string>,
reportingOwnerRelationship:struct<isDirector:string,isOfficer:string,isTenPercentOwner:string,officerTitle:string>>,
nonDerivativeTable struct<nonDerivativeTransaction:array<struct<transactionDate:{_MONEY},transactionCoding:struct<transactionCode:string>,
transactionAmounts:struct<transactionShares:{_MONEY},transactionPricePerShare:{_MONEY}>,postTransactionAmounts:struct<sharesOwnedFollowingTransaction:{_MONEY}>>>>"""


def form4_rows(documents: DataFrame) -> DataFrame:
    """Insider purchases (P) and sales (S): ``documents`` has stock_id, accession_number and ``xml``.

    Amounts may stand in an element or in its child ``value``; what is not a number is 0.
    A document that does not parse gives no rows.
    """
    text = lambda c: F.coalesce(F.col(f"{c}.value"), F.col(f"{c}._VALUE"))
    number = lambda c: F.coalesce(text(c).try_cast("double"), F.lit(0.0))
    parsed = documents.withColumn("p", F.from_xml("xml", _FORM4.replace("\n", "")))
    role = F.col("p.reportingOwner.reportingOwnerRelationship")
    is_set = lambda f: F.lower(role.getField(f)).isin("1", "true")
    title = F.array_join(
        F.array_compact(
            F.array(
                F.when(is_set("isDirector"), F.lit("Director")),
                F.when(is_set("isOfficer"), F.coalesce(role.getField("officerTitle"), F.lit("Officer"))),
                F.when(is_set("isTenPercentOwner"), F.lit("10% Owner")),
            )
        ),
        ", ",
    )
    rows = parsed.select(
        "stock_id", "accession_number", F.col("p.reportingOwner.reportingOwnerId.rptOwnerName").alias("insider_name"), title.alias("insider_title"), F.explode("p.nonDerivativeTable.nonDerivativeTransaction").alias("t")
    )
    out = rows.select(
        "stock_id",
        "accession_number",
        F.try_to_date(text("t.transactionDate")).alias("transaction_date"),
        "insider_name",
        "insider_title",
        F.col("t.transactionCoding.transactionCode").alias("transaction_type"),
        number("t.transactionAmounts.transactionShares").alias("shares"),
        number("t.transactionAmounts.transactionPricePerShare").alias("price_per_share"),
        number("t.postTransactionAmounts.sharesOwnedFollowingTransaction").alias("shares_owned_after"),
    )
    return out.filter(F.col("transaction_type").isin("P", "S")).withColumn("total_value", F.col("shares") * F.col("price_per_share"))


def feed_time(*fields: str) -> Column:
    """The first field that parses: RFC-822 dates without their weekday, else ISO.  Zones are dropped."""

    def one(f: str) -> Column:
        rest = F.regexp_replace(F.col(f), r"^\s*[A-Za-z]{3},\s*", "")
        local = F.regexp_replace(rest, r"\s+([A-Z]{2,4}|[+-]\d{4})\s*$", "")
        return F.coalesce(F.try_to_timestamp(local, F.lit("d MMM yyyy HH:mm:ss")), F.try_to_timestamp(F.regexp_replace(F.col(f), r"(Z|[+-]\d\d:?\d\d)$", "")))

    return F.coalesce(*map(one, fields))


def news_rows(entries: DataFrame, as_of, days_back: int = 30, per_feed: int = 30) -> DataFrame:
    """Articles: the first ``per_feed`` entries of each feed, not older than the cutoff; undated ones stay.

    ``entries`` has stock_id, feed, position, title, summary, published, updated, created.
    """
    from ..operators.textscore import score_texts

    first = W.partitionBy("stock_id", "feed").orderBy("position")
    at = feed_time("published", "updated", "created")
    rows = entries.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= per_feed).withColumn("day", F.to_date(at))
    rows = rows.filter(F.col("day").isNull() | (F.col("day") >= F.date_sub(F.lit(as_of).cast("date"), days_back)))
    scored = score_texts(rows, F.concat_ws(" ", "title", "summary"), "sentiment")
    return scored.select("stock_id", "day", "title", F.col("feed").alias("source"), "sentiment")


def post_rows(posts: DataFrame, per_board: int = 200, as_of=None, days_back: int = 30) -> DataFrame:
    """Posts: stock_id, day, score, comments, compound, board; at most ``per_board`` of each search, and with ``as_of`` none older than ``days_back`` days."""
    from ..operators.textscore import score_texts

    newest = W.partitionBy("stock_id", "subreddit").orderBy(F.desc("created_utc"), "title")
    if as_of is not None:
        posts = posts.filter(F.to_date(F.timestamp_seconds("created_utc")) >= F.date_sub(F.lit(as_of).cast("date"), days_back))
    rows = posts.withColumn("n", F.row_number().over(newest)).filter(F.col("n") <= per_board)
    return score_texts(rows, F.concat_ws(" ", "title", "selftext")).select(
        "stock_id", F.to_date(F.timestamp_seconds("created_utc")).alias("day"), F.col("score").cast("double").alias("score"), F.col("num_comments").cast("double").alias("comments"), "compound", F.col("subreddit").alias("board")
    )
