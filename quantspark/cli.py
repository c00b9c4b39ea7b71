"""Command line: set up a store, compute and store features, train, predict, migrate, report.

    python -m quantspark.cli setup TABLES --out STORE
    python -m quantspark.cli features TABLES --out STORE [--date D] [--skip-macro] [--tickers A,B]
    python -m quantspark.cli train TABLES --out STORE [--cutoff-date D] [--version V] [--train-months N] [--skip-lstm] [--tickers A,B] [--rounds N] [--dry-run]
    python -m quantspark.cli predict STORE [--tables TABLES] [--date D] [--version V] [--top-n N] [--dry-run]
    python -m quantspark.cli migrate STORE --version N --table T --column NAME:TYPE [--description TEXT]
    python -m quantspark.cli status STORE
"""

from __future__ import annotations

import argparse
import datetime as dt
import logging
import sys
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger("quantspark")


def _session() -> SparkSession:
    return SparkSession.builder.appName("quantspark").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def setup(spark: SparkSession, tables: str, out: str) -> DataFrame:
    """Create the stocks table where it is missing; returns the universe."""
    from .sources import market
    from .sources.store import TableStore

    db = TableStore(spark, out)
    universe = market.stocks(spark, tables).select(F.col("stock_id").alias("id"), "ticker", "sector", F.lit(1).alias("is_active"))
    db.append_new("stocks", universe)
    return db.read("stocks").orderBy("sector", "ticker")


def features(spark: SparkSession, tables: str, out: str, as_of: str | None = None, skip_macro: bool = False, tickers: list[str] | None = None) -> DataFrame:
    """Compute the features of one date for all stocks and overwrite them by key; returns the run's record.

    A source that fails is recorded and does not stop the others.
    """
    from .functions.windows import latest_per_key
    from .operators import fundamental, quality, sentiment, technical
    from .plans import market_context as C
    from .sources import market
    from .sources.store import TableStore

    db, started = TableStore(spark, out), dt.datetime.now()
    stocks = market.stocks(spark, tables)
    bars = market.bars(spark, tables)
    if tickers:
        stocks = stocks.filter(F.col("ticker").isin(tickers))
        bars = bars.join(F.broadcast(stocks.select("stock_id")), "stock_id", "left_semi")
    day = F.lit(as_of).cast("date") if as_of else F.lit(bars.agg(F.max("date")).first()[0])
    bars = bars.filter(F.col("date") <= day)
    dates = spark.range(1).select(day.alias("as_of"))
    benchmark = market.benchmark(spark, tables).filter(F.col("date") <= day)
    counts, errors, findings = {}, [], []

    def stage(name: str, build) -> None:
        try:
            rows = build()
            db.overwrite_by_key(f"{name}_features", rows)
            counts[name] = rows.count()
        except Exception as e:  # each source stands alone; the record says what failed
            log.exception("%s features failed", name)
            errors.append(f"{name}: {type(e).__name__}")
            counts[name] = 0

    def technical_rows() -> DataFrame:
        rows = technical.technical_features(bars, benchmark, market.sector_funds(spark, tables).filter(F.col("date") <= day))
        return latest_per_key(rows, ["stock_id"])

    def fundamental_rows() -> DataFrame:
        rows = fundamental.fundamental_features(market.statements(spark, tables), market.company_info(spark, tables), bars, stocks, dates, market.METRICS)
        return rows.withColumnRenamed("as_of", "date")

    def macro_rows() -> DataFrame:
        return C.macro_all(spark, tables).filter(F.col("date") <= day).orderBy(F.desc("date")).limit(1)

    def sentiment_rows() -> DataFrame:
        spine = stocks.select("stock_id").crossJoin(F.broadcast(dates))  # one date
        events = [build(spark, tables) for build in (C.post_events, C.news_events, C.insider_events, C.filing_events)]
        return sentiment.sentiment_features(spine, *events).withColumnRenamed("as_of", "date")

    stage("technical", technical_rows)
    stage("fundamental", fundamental_rows)
    stage("sentiment", sentiment_rows)
    if not skip_macro:
        stage("macro", macro_rows)
    if counts.get("technical"):
        checks = quality.warnings(db.read("technical_features"), technical.FEATURES)
        findings = [f"{r['check']}: {r['n']}" for r in checks.groupBy("check").agg(F.count(F.lit(1)).alias("n")).collect()]  # one row per kind of check
    old = [r.ticker for r in quality.stale(stocks, bars, as_of or str(dt.date.today())).select("ticker").limit(1000).collect()]
    status = "failed" if errors and not any(counts.values()) else "partial" if errors else "ok"
    record = (uuid.uuid4().hex, started, dt.datetime.now(), status, counts.get("technical", 0), counts.get("fundamental", 0), counts.get("sentiment", 0), old, findings, errors)
    run = spark.createDataFrame([record], "run_id string, started timestamp, finished timestamp, status string, technical long, fundamental long, sentiment long, stale_tickers array<string>, qa_warnings array<string>, error_log array<string>")
    db.append("pipeline_runs", run)
    return run


def predict(spark: SparkSession, store: str, as_of: str | None, version: str, top_n: int, dry_run: bool, tables: str | None = None) -> DataFrame:
    """Score the newest stored features with the saved model ``version`` and store the predictions; returns the top signals.

    "latest" is the version trained last.  With ``tables``, a version that has a sequence model
    blends its probabilities in; stocks too young for a sequence keep those of the trees.
    """
    from .functions.windows import asof_join, latest_per_key
    from .operators import dataset, models, signals
    from .operators.preprocess import FeatureScaler
    from .plans import modelling, training
    from .sources.store import TableStore

    db = TableStore(spark, store)
    if version == "latest":
        newest = db.read("model_runs").orderBy(F.desc("trained_at")).select("version").first()
        version = newest["version"] if newest else version
    home = f"{store}/models/{version}"
    until = lambda df: df.filter(F.col("date") <= as_of) if as_of else df
    rows = latest_per_key(until(db.read("technical_features")), ["stock_id"])
    rows = asof_join(rows, db.read("fundamental_features"), ["stock_id"], values=list(dataset.FUNDAMENTAL))
    rows = rows.join(db.read("sentiment_features").select("stock_id", "date", *dataset.SENTIMENT), ["stock_id", "date"], "left")
    rows = rows.join(db.read("macro_features").select("date", *dataset.MACRO), "date", "left")
    if _exists(spark, f"{home}_scaler"):
        rows = FeatureScaler.load(spark, f"{home}_scaler").transform(rows)
    scored, second = models.probabilities(models.load_flat(spark, home), rows, "xgb"), None
    if tables and _exists(spark, f"{home}_sequences"):
        scaler, second = FeatureScaler.load(spark, f"{home}_steps"), "lstm"
        frame = scaler.transform(training.filled_steps(until(modelling.all_steps(spark, tables))))
        last = latest_per_key(dataset.sequences(frame, scaler.features), ["stock_id"])
        found = models.probabilities(models.RecurrentModel.load(spark, f"{home}_sequences"), last, "lstm")
        scored = scored.join(found.select("stock_id", *[f"lstm_prob_{k}" for k in range(4)]), "stock_id", "left")
    out = signals.score_and_action(signals.signal_columns(signals.blend(scored, second=second)))
    if not dry_run:
        db.overwrite_by_key("predictions", prediction_rows(out, version))
    ticker = db.read("stocks").select(F.col("id").alias("stock_id"), "ticker")
    return signals.top_signals(out.join(F.broadcast(ticker), "stock_id"), top_n).select("ticker", "date", "expected_return", "conviction", "action")


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def prediction_rows(signals: DataFrame, version: str) -> DataFrame:
    """Signals as stored: returns in percent, bull probability, component probabilities."""
    bull = (F.col("prob_class_2") + F.col("prob_class_3")).alias("bull_probability")
    parts = [c for c in signals.columns if c.startswith(("prob_class_", "xgb_prob_", "lstm_prob_"))]
    return signals.select(
        "stock_id", F.col("date").alias("prediction_date"), F.lit(version).alias("model_version"), *parts, "predicted_class", F.col("conviction").alias("confidence"), (F.col("expected_return") * 100).alias("expected_return_pct"), bull, "score", "action"
    )


def main(argv: list[str] | None = None) -> int:
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(levelname)s %(message)s")
    parser = argparse.ArgumentParser(prog="quantspark", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    todo = parser.add_subparsers(dest="todo", required=True)
    for name in ("setup", "features", "train"):
        p = todo.add_parser(name)
        p.add_argument("tables")
        p.add_argument("--out", required=True)
        if name != "setup":
            p.add_argument("--tickers", type=lambda s: s.split(","))
        if name == "features":
            p.add_argument("--date")
            p.add_argument("--skip-macro", action="store_true")
        if name == "train":
            p.add_argument("--cutoff-date", type=dt.date.fromisoformat, default=dt.date.today())
            p.add_argument("--version")
            p.add_argument("--train-months", type=int, default=36)
            p.add_argument("--skip-lstm", action="store_true")
            p.add_argument("--rounds", type=int, default=500)
            p.add_argument("--dry-run", action="store_true")
    p = todo.add_parser("predict")
    p.add_argument("store")
    p.add_argument("--tables")
    p.add_argument("--date")
    p.add_argument("--version", default="latest")
    p.add_argument("--top-n", type=int, default=10)
    p.add_argument("--dry-run", action="store_true")
    p = todo.add_parser("migrate")
    p.add_argument("store")
    p.add_argument("--version", type=int, required=True)
    p.add_argument("--table", required=True)
    p.add_argument("--column", action="append", default=[], type=lambda s: tuple(s.split(":")))
    p.add_argument("--description", default="")
    todo.add_parser("status").add_argument("store")
    a = parser.parse_args(argv)
    spark = _session()
    if a.todo == "setup":
        setup(spark, a.tables, a.out).show(100, False)
    elif a.todo == "features":
        status = features(spark, a.tables, a.out, a.date, a.skip_macro, a.tickers).first()["status"]
        return {"ok": 0, "partial": 1}.get(status, 2)
    elif a.todo == "predict":
        predict(spark, a.store, a.date, a.version, a.top_n, a.dry_run, a.tables).show(a.top_n, False)
    elif a.todo == "train":
        from .plans.training import train

        version = a.version or a.cutoff_date.strftime("%Y%m%d")
        train(spark, a.tables, a.out, a.cutoff_date, version, a.train_months, a.skip_lstm, a.tickers, a.dry_run, a.rounds).show(1, False, True)
    else:
        from .sources.store import TableStore

        db = TableStore(spark, a.store)
        if a.todo == "migrate":
            db.migrate(a.version, a.description, a.table, a.column)
        db.history().show(1000, False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
