"""Forward-return labels and walk-forward folds."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.safe import div
from ..functions.windows import by

HORIZON = 63
#: Upper edges of the first three return classes; the fourth is open.
EDGES = (-0.05, 0.05, 0.15)


def bucket(r: Column) -> Column:
    """Class 0 to 3 of a return, intervals closed on the right; null stays null."""
    out = F.when(r.isNull(), None)
    for i, edge in enumerate(EDGES):
        out = out.when(r <= edge, F.lit(i))
    return out.otherwise(F.lit(len(EDGES))).cast("int")


def forward_returns(bars: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """stock_id, date, forward_return (null in the last ``horizon`` rows), label.  By rows, not days."""
    ahead = F.lead("close", horizon).over(by("stock_id"))
    out = bars.select("stock_id", "date", (div(ahead, "close") - 1).alias("forward_return"))
    return out.withColumn("label", bucket(F.col("forward_return")))


def labels_between(bars: DataFrame, start: date, end: date, horizon: int = HORIZON, look_ahead_days: int = 150) -> DataFrame:
    """Labels of dates in [start, end], from prices up to ``look_ahead_days`` later."""
    needed = bars.filter(F.col("date").between(F.lit(start), F.date_add(F.lit(end), look_ahead_days)))
    return forward_returns(needed, horizon).filter(F.col("date").between(F.lit(start), F.lit(end)) & F.col("label").isNotNull())


def trading_days_later(day: Column | str, n: int) -> Column:
    """About ``n`` trading days after ``day`` (before it where n is negative): one and a half calendar days each, cut to whole days."""
    days = int(abs(n) * 1.5)
    return F.date_add(day, days if n >= 0 else -days)


def class_distribution(labels: DataFrame, keys: list[str]) -> DataFrame:
    return labels.filter(F.col("label").isNotNull()).groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("n"))


def walk_forward(dates: DataFrame, train: int = 36, gap: int = 1, validate: int = 3, step: int = 3) -> DataFrame:
    """Folds over the span of ``dates`` (date): fold, train_start, train_end, val_start, val_end.

    Months are added to the step before, clipped to month ends, until a fold would end past the
    last date.  The span is one row; the folds are as many as steps in it.
    """
    lo, hi = dates.agg(F.min("date"), F.max("date")).first()
    spark = dates.sparkSession
    schema = "fold int, train_start date, train_end date, val_start date, val_end date"
    if lo is None:
        return spark.createDataFrame([], schema)
    folds, start = [], lo
    while True:
        train_end = _plus_months(start, train)
        val_start = _plus_months(train_end, gap)
        val_end = _plus_months(val_start, validate)
        if val_end > hi:
            break
        folds.append((len(folds), start, train_end, val_start, val_end))
        start = _plus_months(start, step)
    return spark.createDataFrame(folds, schema)


def _plus_months(d: date, months: int) -> date:
    import calendar

    total = d.year * 12 + d.month - 1 + months
    year, month = divmod(total, 12)
    return date(year, month + 1, min(d.day, calendar.monthrange(year, month + 1)[1]))


def assign_folds(df: DataFrame, folds: DataFrame) -> DataFrame:
    """Rows with the fold and part ("train" or "validate") that their date falls in; rows may be in several folds."""
    part = F.when(F.col("date") < F.col("train_end"), "train").when(F.col("date") >= F.col("val_start"), "validate")
    inside = (F.col("date") >= F.col("train_start")) & (F.col("date") < F.col("val_end"))
    joined = df.join(F.broadcast(folds), inside)  # one row per fold
    return joined.withColumn("part", part).filter("part is not null").drop("train_start", "train_end", "val_start", "val_end")


def purged_training(df: DataFrame, folds: DataFrame, label_end: str = "label_end") -> DataFrame:
    """Training rows of every fold, with its number: those whose label is known before the fold's validation begins.

    ``label_end`` is the date of the price that a row's label was made from; without it a row has no label
    and trains no fold.
    """
    inside = (F.col("date") >= F.col("train_start")) & (F.col("date") < F.col("train_end")) & (F.col(label_end) < F.col("val_start"))
    return df.join(F.broadcast(folds), inside).drop("train_start", "train_end", "val_start", "val_end")  # one row per fold
