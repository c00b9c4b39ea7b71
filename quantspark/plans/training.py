"""The training run: labelled features, a split by date, fitted scaler and models, saved by version.

Below the store's ``models`` folder a version has ``<version>`` (boosted trees), ``<version>_scaler``,
``<version>_sequences`` (recurrent network) and ``<version>_steps`` (the scaler of sequence columns).
"""

from __future__ import annotations

import datetime as dt
import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.windows import by, fill_both_ways
from ..operators import dataset as D
from ..operators import labels as L
from ..operators import models
from ..operators import preprocess as P
from ..sources.scratch import written

log = logging.getLogger("quantspark")
VALIDATION_MONTHS = 4


def months_before(day: dt.date, months: int) -> dt.date:
    """The same day some months earlier, clipped to the month's end."""
    return L._plus_months(day, -months)


def split(rows: DataFrame, start: dt.date, end: dt.date, validation_start: dt.date) -> DataFrame:
    """Rows with a date in [start, end], ``held_out`` from ``validation_start`` on."""
    inside = rows.filter(F.col("date").between(F.lit(start), F.lit(end)))
    return inside.withColumn("held_out", F.col("date") >= F.lit(validation_start))


def model_columns(df: DataFrame) -> list[str]:
    """Model features among the columns, in model order."""
    return [c for c in (*D.TECHNICAL, *D.SENTIMENT, *D.MACRO, *D.FUNDAMENTAL) if c in df.columns]


def fit_trees(data: DataFrame, rounds: int, depth: int = 6, patience: int = 50):
    """Scaler fitted on the training part, boosted trees, and the scored held-out part of ``split`` rows.

    The rows are read several times: pass a written table.
    """
    names = model_columns(data)
    scaler = P.FeatureScaler.fit(data.filter(~F.col("held_out")), names)
    scaled = scaler.transform(data)
    model = models.fit_boosted(scaled, names, validation="held_out", rounds=rounds, depth=depth, patience=patience)
    held = models.probabilities(model, scaled.filter("held_out"), "xgb")
    return scaler, model, held.withColumn("predicted_class", models.most_likely("xgb"))


def filled_steps(frame: DataFrame) -> DataFrame:
    """Sequence columns with gaps filled from the last value, else the next one, else 0."""
    return frame.withColumns({c: fill_both_ways(c, by("stock_id")) for c in D.SEQUENCE if c in frame.columns})


def fit_steps(frame: DataFrame, labelled: DataFrame, start: dt.date, end: dt.date, validation_start: dt.date, params: models.RecurrentParams = models.RecurrentParams(), steps: int = D.STEPS):
    """Scaler of the steps, recurrent network on scaled sequences, and the scored held-out sequences.

    ``labelled`` has stock_id, date, label; sequences reach back before ``start``, the scaler does not.
    The filled frame is written once, since scaler and sequences read it several times.
    """
    names = [c for c in D.SEQUENCE if c in frame.columns]
    frame = written(filled_steps(frame), "filled-steps")[0]
    scaler = P.FeatureScaler.fit(frame.filter((F.col("date") >= F.lit(start)) & (F.col("date") < F.lit(validation_start))), names)
    rows = D.sequences(scaler.transform(frame), names, steps).join(labelled.filter("label is not null"), ["stock_id", "date"])
    data = split(rows, start, end, validation_start)
    net = models.fit_recurrent(data, ["stock_id", "date"], held_out="held_out", params=params)
    held = models.probabilities(net, data.filter("held_out"), "lstm")
    return scaler, net, held.withColumn("predicted_class", models.most_likely("lstm"))


def train(
    spark: SparkSession, tables: str, store: str, cutoff: dt.date, version: str, train_months: int = 36, skip_sequences: bool = False, tickers: list[str] | None = None, dry_run: bool = False, rounds: int = 500,
    recurrent: models.RecurrentParams = models.RecurrentParams(),
) -> DataFrame:
    """Fit and save the models of one version; returns the run's record, which is also appended to ``model_runs``.

    The last VALIDATION_MONTHS of the window are held out for early stopping and accuracy.  A dry run
    counts rows only.  The data set is written once below the store, so each fit reads files.
    """
    from ..sources import market as M
    from ..sources.schemas import TABLES
    from ..sources.store import TableStore
    from .modelling import all_features, all_steps

    start, validation_start = months_before(cutoff, train_months), months_before(cutoff, VALIDATION_MONTHS)
    bars, stocks = M.bars(spark, tables), M.stocks(spark, tables)
    if tickers:
        stocks = stocks.filter(F.col("ticker").isin(tickers))
        bars = bars.join(stocks.select("stock_id"), "stock_id", "left_semi")
    labelled = L.labels_between(bars, start, cutoff).select("stock_id", "date", "label")
    home = f"{store.rstrip('/')}/models/{version}"
    data = split(D.training_set(labelled, all_features(spark, tables)), start, cutoff, validation_start)
    data.write.mode("overwrite").parquet(f"{home}_data")
    data = spark.read.parquet(f"{home}_data")
    sizes = {r["held_out"]: r["count"] for r in data.groupBy("held_out").count().collect()}  # two rows
    log.info("train rows %s, held out %s", sizes.get(False, 0), sizes.get(True, 0))
    folds = L.walk_forward(data.select("date"), train_months).count()
    kept, accuracy, loss, sequence_accuracy, top = [], None, None, None, []
    if not dry_run:
        if not sizes.get(True) or not sizes.get(False):
            raise ValueError(f"no labelled rows before or after {validation_start}")
        low = [r["feature"] for r in P.coverage(data, model_columns(data)).filter("non_null_pct < 50").select("feature").collect()]  # features
        if low:
            log.warning("mostly null: %s", " ".join(low))
        scaler, model, held = fit_trees(data, rounds)
        kept, accuracy, loss = [model.best_round], models.accuracy(held), models.log_loss(held, "xgb")
        top = [name for name, _ in models.importances(model, 10)]
        model.save(spark, home)
        scaler.save(f"{home}_scaler")
        if not skip_sequences:
            frame = all_steps(spark, tables)
            if tickers:
                frame = frame.join(stocks.select("stock_id"), "stock_id", "left_semi")
            frame.write.mode("overwrite").parquet(f"{home}_frame")
            step_scaler, net, held = fit_steps(spark.read.parquet(f"{home}_frame"), labelled, start, cutoff, validation_start, recurrent)
            sequence_accuracy = models.accuracy(held)
            net.save(spark, f"{home}_sequences")
            step_scaler.save(f"{home}_steps")
    record = (version, cutoff, start, validation_start, dt.datetime.now(), sizes.get(False, 0), sizes.get(True, 0), kept, accuracy, loss, sequence_accuracy, folds, top)
    run = spark.createDataFrame([record], TABLES["model_runs"])
    if not dry_run:
        TableStore(spark, store).append("model_runs", run)
    return run
