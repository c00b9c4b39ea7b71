"""Feeds, the table store and the streaming job on small files."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from quantspark.sources import feeds, store
from quantspark.sources.schemas import KEYS, TABLES
from quantspark.streaming import daily


def test_universe(spark, tmp_path):
    path = tmp_path / "u.json"
    path.write_text(json.dumps({"stocks": [{"ticker": "A", "cik": "320193", "company": "Co", "sector": "Tech", "sector_etf": "X"}, {"ticker": "X", "is_active": 0}]}))
    got = {r.ticker: r for r in feeds.universe(spark, str(path)).collect()}
    assert got["A"].cik == "0000320193" and got["A"].is_active == 1 and got["X"].is_active == 0


def test_price_rows_and_gaps(spark):
    raw = spark.createDataFrame([(1, "2024-01-02", 1.23456, None, 1.0, 2.0, None, None)], "stock_id long, date string, open double, high double, low double, close double, adj_close double, volume double")
    r = feeds.price_rows(raw).first()
    assert (r.open, r.high, r.adj_close, r.volume) == (1.2346, 0.0, 2.0, 0)
    stocks = spark.createDataFrame([(1,), (2,), (3,)], "stock_id long")
    prices = spark.createDataFrame([(1, dt.date(2024, 1, 2)), (2, dt.date(2024, 1, 9))], "stock_id long, date date")
    got = {r.stock_id: r.fetch_from for r in feeds.missing_ranges(stocks, prices, "2024-01-10").collect()}
    assert got == {1: dt.date(2024, 1, 3), 3: dt.date(2019, 1, 10)}


def test_filings_and_form4(spark):
    doc = {"filings": {"recent": {"accessionNumber": ["a", "b"], "filingDate": ["2024-01-02", "2020-01-01", "2024-01-03"], "form": ["8-K", "8-K", "4"], "primaryDocument": [], "reportDate": ["2023-12-31"]}}}
    docs = spark.createDataFrame([(1, json.dumps(doc))], "stock_id long, json string")
    got = feeds.filing_rows(docs, ["8-K", "4"], "2024-01-10", 90).collect()
    assert [(r.accession_number, r.filed_date, r.period_of_report) for r in got] == [("a", dt.date(2024, 1, 2), dt.date(2023, 12, 31))]
    xml = """<ownershipDocument><reportingOwner><reportingOwnerId><rptOwnerName>Ann</rptOwnerName></reportingOwnerId>
    <reportingOwnerRelationship><isDirector>1</isDirector><isOfficer>true</isOfficer><officerTitle>CFO</officerTitle></reportingOwnerRelationship></reportingOwner>
    <nonDerivativeTable><nonDerivativeTransaction><transactionDate><value>2024-01-02</value></transactionDate><transactionCoding><transactionCode>P</transactionCode></transactionCoding>
    <transactionAmounts><transactionShares><value>10</value></transactionShares><transactionPricePerShare><value>2.5</value></transactionPricePerShare></transactionAmounts></nonDerivativeTransaction>
    <nonDerivativeTransaction><transactionCoding><transactionCode>G</transactionCode></transactionCoding></nonDerivativeTransaction></nonDerivativeTable></ownershipDocument>"""
    rows = feeds.form4_rows(spark.createDataFrame([(1, "a", xml), (1, "b", "<broken")], "stock_id long, accession_number string, xml string")).collect()
    assert [(r.insider_name, r.insider_title, r.transaction_type, r.total_value, r.transaction_date) for r in rows] == [("Ann", "Director, CFO", "P", 25.0, dt.date(2024, 1, 2))]


def test_news_and_posts(spark):
    entries = [(1, "f", i, "t", "strong profit", "Tue, 09 Jan 2024 10:00:00 GMT" if i else None, None, None) for i in range(35)]
    df = spark.createDataFrame(entries, "stock_id long, feed string, position int, title string, summary string, published string, updated string, created string")
    got = feeds.news_rows(df, "2024-01-10").collect()
    assert len(got) == 30 and sum(r.day is None for r in got) == 1 and all(0 < r.sentiment < 1 for r in got)
    posts = spark.createDataFrame([(1, "wsb", 1704844800.0, 5, 2, "bad loss", None)], "stock_id long, subreddit string, created_utc double, score long, num_comments long, title string, selftext string")
    r = feeds.post_rows(posts).first()
    assert r.day == dt.date(2024, 1, 10) and r.compound < 0


def test_broken_price_lines_go_to_the_quarantine(spark, tmp_path):
    head = "stock_id,date,open,high,low,close,adj_close,volume\n"
    good = ["1,2024-01-02,1,2,1,1.5,1.5,10", "1,2024-01-03,1,,1,1.5,,", "1,2024-01-02,1,2,1,1.5,1.5,10"]
    bad = {"1,2024-01-04,one,2,1,1.5,1.5,10": "unreadable", ",2024-01-04,1,2,1,1.5,1.5,10": "no stock", "1,someday,1,2,1,1.5,1.5,10": "no day", "1,2024-01-05,-1,2,1,1.5,1.5,10": "below 0",
           "1,2024-01-06,1,1,2,1.5,1.5,10": "low above high", "1,2024-01-07,1,2,1,9,9,10": "close outside low and high"}
    path = tmp_path / "bars.csv"
    path.write_text(head + "\n".join([*good, *bad]) + "\n")
    rows, quarantine = feeds.read_prices(spark, str(path))
    assert sorted((r.date.day, r.high, r.adj_close, r.volume) for r in rows.collect()) == [(2, 2.0, 1.5, 10), (3, 0.0, 1.5, 0)]
    assert sorted(r.reason for r in quarantine.collect()) == sorted(bad.values())
    assert quarantine.filter("reason = 'unreadable'").first().line == next(iter(bad))
    lines = tmp_path / "bars.json"
    lines.write_text('{"stock_id": 1, "date": "2024-01-02", "close": 3}\n{"stock_id": 1,\n')
    rows, quarantine = feeds.read_prices(spark, str(lines), "json")
    assert [r.close for r in rows.collect()] == [3.0] and [r.reason for r in quarantine.collect()] == ["unreadable"]


def test_facts_are_known_from_their_filing_day(spark):
    fact = lambda end, val, filed, form="10-Q": {"start": "2020-01-01", "end": end, "val": val, "accn": f"a{filed}", "form": form, "filed": filed}
    units = {"USD": [fact("2020-03-31", 10, "2020-05-01"), fact("2020-06-30", 20, "2020-08-01"), fact("2020-03-31", 11, "2020-09-01", "10-Q/A"), fact("2020-06-30", 22, "2020-10-01", "10-Q/A"),
                     fact("2020-09-30", 99, "2020-08-02", "S-1"), fact(None, 1, "2020-08-02"), fact("2020-09-30", None, "2020-08-02"), fact("2020-09-30", 1, "soon")]}
    doc = json.dumps({"facts": {"us-gaap": {"Revenues": {"units": units}, "Assets": {"units": {}}}, "dei": {"Shares": {"units": {"shares": [fact("2020-03-31", 5, "2020-05-01")]}}}}})
    docs = spark.createDataFrame([(1, doc), (2, "{broken"), (3, None), (4, "{}")], "stock_id long, json string")
    rows = feeds.fact_rows(docs)
    assert sorted((str(r.filed), r.value) for r in rows.collect()) == [("2020-05-01", 10.0), ("2020-08-01", 20.0), ("2020-09-01", 11.0), ("2020-10-01", 22.0)]
    asked = {"2020-04-30": None, "2020-05-01": 10.0, "2020-08-15": 20.0, "2020-09-15": 20.0, "2020-12-31": 22.0}
    spine = spark.createDataFrame([(i, dt.date.fromisoformat(d)) for d in asked for i in (1, 2)], "stock_id long, as_of date")
    got = feeds.facts_known(spine, rows, ["Revenues", "Assets"]).collect()
    assert len(got) == 20 and {str(r.as_of): r.value for r in got if r.stock_id == 1 and r.tag == "Revenues"} == asked
    assert all(r.value is None for r in got if r.stock_id == 2 or r.tag == "Assets")
    assert feeds.fact_rows(docs, "dei").first().unit == "shares"


def test_old_posts_are_cut_off(spark):
    rows = [(1, "wsb", 1704844800.0 - 86400 * d, 5, 2, "gains", None) for d in (0, 29, 31)]
    posts = spark.createDataFrame(rows, "stock_id long, subreddit string, created_utc double, score long, num_comments long, title string, selftext string")
    assert feeds.post_rows(posts).count() == 3 and feeds.post_rows(posts, as_of="2024-01-10").count() == 2


def test_store_append_overwrite_migrate(spark, tmp_path):
    db = store.TableStore(spark, str(tmp_path))
    day = dt.date(2024, 1, 2)
    row = lambda close: spark.createDataFrame([(1, day, close)], "stock_id long, date date, close double")
    db.append_new("daily_prices", row(1.0))
    db.append_new("daily_prices", row(2.0))
    assert [r.close for r in db.read("daily_prices").collect()] == [1.0]
    db.overwrite_by_key("daily_prices", row(3.0))
    assert [r.close for r in db.read("daily_prices").collect()] == [3.0]
    assert db.version() == 0
    db.migrate(1, "more", "daily_prices", [("note", "string")])
    assert db.version() == 1
    with pytest.raises(ValueError):
        db.migrate(1, "again", "daily_prices", [])
    assert len(TABLES["technical_features"]) == 63 and len(TABLES["fundamental_features"]) == 71 and len(TABLES["macro_features"]) == 37 and len(TABLES["sentiment_features"]) == 24
    assert all(set(k) <= set(TABLES[t].names) for t, k in KEYS.items())


def test_stream_counts_and_upserts(spark, tmp_path):
    ts = dt.datetime(2024, 1, 2, 12)
    rows = [(i % 2, i, ts + dt.timedelta(hours=i), float(i)) for i in range(10)] + [(0, 0, ts, 0.0)]
    source = str(tmp_path / "in")
    spark.createDataFrame(rows, "stock_id long, event_id long, ts timestamp, value double").write.parquet(source)
    events = daily.watermarked(daily.read_events(spark, source, "stock_id long, event_id long, ts timestamp, value double"))
    once, counted = [], []
    daily.upsert_stream(daily.without_repeats(events, "event_id"), lambda df: once.extend(df.collect()), str(tmp_path / "a"), "append").awaitTermination(60)
    daily.upsert_stream(daily.windowed_counts(events), lambda df: counted.extend(df.collect()), str(tmp_path / "b")).awaitTermination(60)
    assert sorted(r.event_id for r in once) == list(range(10))
    assert sum(r.n for r in counted if r.as_of == dt.datetime(2024, 1, 5)) == 11


def test_command_line_features_and_predictions(spark, tmp_path, smallest):
    from quantspark import cli
    from quantspark.operators import models

    out = str(tmp_path / "store")
    assert cli.setup(spark, smallest, out).count() == 25
    run = cli.features(spark, smallest, out, "2001-06-30").first()
    assert run.status == "ok" and run.technical > 0 and run.fundamental == 25
    db = store.TableStore(spark, out)
    before = db.read("technical_features").count()
    cli.features(spark, smallest, out, "2001-06-30", skip_macro=True)
    assert db.read("technical_features").count() == before and db.read("macro_features").count() == 1 and db.read("pipeline_runs").count() == 2
    rows = db.read("technical_features").withColumn("label", F.pmod("stock_id", F.lit(4)).cast("int"))
    models.fit_forest(rows, ["rsi_14", "momentum_30d"], trees=5).write().overwrite().save(f"{out}/models/latest")
    top = cli.predict(spark, out, None, "latest", 5, False)
    assert top.columns == ["ticker", "date", "expected_return", "conviction", "action"]
    assert db.read("predictions").count() == before
    assert cli.main(["status", out]) == 0


def test_command_line_training_and_prediction(spark, tmp_path, smallest):
    from quantspark import cli
    from quantspark.operators.recurrent import RecurrentParams
    from quantspark.plans import training
    from quantspark.plans.market_context import macro_all

    out, cutoff = str(tmp_path / "store"), dt.date(2000, 6, 30)
    cli.setup(spark, smallest, out)
    run = cli.features(spark, smallest, out, "2000-06-30").first()
    db = store.TableStore(spark, out)
    assert run.status == "ok" and run.sentiment == 25
    stored = db.read("macro_features").first()
    tilts = {r.date: r.growth_vs_value for r in macro_all(spark, smallest).select("date", "growth_vs_value").collect()}
    assert stored.growth_vs_value == tilts[stored.date] and any(x is not None for x in tilts.values())
    dry = training.train(spark, smallest, out, cutoff, "v0", dry_run=True).first()
    assert dry.train_rows > 0 and dry.validation_rows > 0 and db.read("model_runs").count() == 0
    run = training.train(spark, smallest, out, cutoff, "v1", rounds=3, recurrent=RecurrentParams(hidden=8, layers=1, epochs=2)).first()
    assert run.train_rows == dry.train_rows and run.rounds == [3]
    assert run.train_start == dt.date(1997, 6, 30) and run.validation_start == dt.date(2000, 2, 29)
    assert 0 <= run.accuracy <= 1 and run.log_loss > 0 and 0 <= run.sequence_accuracy <= 1 and len(run.top_features) == 10
    top = cli.predict(spark, out, "2000-06-30", "latest", 5, False, smallest)
    assert top.count() <= 5  # after three small rounds no signal need be strong
    saved = db.read("predictions").filter("model_version = 'v1'")
    total = sum(F.col(f"prob_class_{k}") for k in range(4))
    assert saved.count() > 0 and saved.filter(F.abs(total - 1) > 1e-9).count() == 0
    assert saved.filter("lstm_prob_0 is not null").count() > 0


def test_parts_are_rewritten_after_some_appends(spark, tmp_path, monkeypatch):
    db = store.TableStore(spark, str(tmp_path))
    rows = lambda *ids: spark.createDataFrame([(i, f"t{i}") for i in ids], "id int, ticker string")
    monkeypatch.setattr(store, "MOST_PARTS", 3)
    parts = []
    for ids in ((1, 2), (2, 3), (4,), (4, 5), (5,)):
        db.append_new("stocks", rows(*ids))
        parts.append(len(db._latest()[1]["stocks"]))
    assert parts == [1, 2, 3, 1, 1] and sorted(r.id for r in db.read("stocks").collect()) == [1, 2, 3, 4, 5]
    assert db.views("db_") == ["db_stocks"] and spark.sql("SELECT count(*) FROM db_stocks").first()[0] == 5


def _bars(spark, *rows):
    return spark.createDataFrame([(i, dt.date(2024, 1, d), float(c)) for i, d, c in rows], "stock_id long, date date, close double")


def _closes(db):
    return sorted((r.stock_id, r.date.day, r.close) for r in db.read("daily_prices").collect())


def test_an_upsert_of_a_day_writes_a_day(spark, tmp_path):
    db = store.TableStore(spark, str(tmp_path))
    db.append_new("daily_prices", _bars(spark, *[(i, d, d) for i in (1, 2) for d in range(1, 11)]))
    first = db._latest()[1]["daily_prices"][0]
    db.overwrite_by_key("daily_prices", _bars(spark, (1, 3, 99), (3, 3, 5), (1, 20, 7)))
    want = {(i, d): float(d) for i in (1, 2) for d in range(1, 11)} | {(1, 3): 99.0, (3, 3): 5.0, (1, 20): 7.0}
    assert _closes(db) == sorted((*k, v) for k, v in want.items())
    parts = db._latest()[1]["daily_prices"]
    assert parts[0].path == first.path and parts[0].without == ("2024-01-03",)
    written = spark.read.parquet(*[f"{tmp_path}/daily_prices/{p.path}" for p in parts[1:]])
    assert sorted((r.stock_id, r.date.day) for r in written.collect()) == [(1, 3), (1, 20), (2, 3), (3, 3)]
    db.overwrite_by_key("daily_prices", _bars(spark, (2, 3, 4)))
    want[2, 3] = 4.0
    assert _closes(db) == sorted((*k, v) for k, v in want.items())
    assert len(db.read("daily_prices", 1).collect()) == 20  # an earlier commit
    assert db.vacuum(keep=1) >= 1 and db.commits() == [3] and _closes(db) == sorted((*k, v) for k, v in want.items())


def test_writers_at_the_same_time_lose_nothing(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    db = store.TableStore(spark, str(tmp_path))
    db.append("daily_prices", _bars(spark, (0, 1, 0), (0, 2, 0)))

    def write(i):
        mine = store.TableStore(spark, str(tmp_path))
        mine.append("backtest_results", spark.createDataFrame([(f"r{i}", 1.0)], "run_id string, equity double"))
        mine.overwrite_by_key("daily_prices", _bars(spark, (i, 1, i), (0, 2 + i, i)))  # one day shared by all, one of its own
        mine.append_new("stocks", spark.createDataFrame([(1, "same"), (i, f"t{i}")], "id int, ticker string"))

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(write, range(1, 6)))
    assert sorted(r.run_id for r in db.read("backtest_results").collect()) == [f"r{i}" for i in range(1, 6)]
    assert _closes(db) == sorted([(0, 1, 0.0), (0, 2, 0.0), *[(i, 1, float(i)) for i in range(1, 6)], *[(0, 2 + i, float(i)) for i in range(1, 6)]])
    assert sorted(r.ticker for r in db.read("stocks").collect()) == ["same", *[f"t{i}" for i in range(1, 6)]]
    assert db.commits() == list(range(1, 17))


def test_a_transaction_publishes_all_tables_or_none(spark, tmp_path, monkeypatch):
    db = store.TableStore(spark, str(tmp_path))
    stock = spark.createDataFrame([(1, "a")], "id int, ticker string")
    with pytest.raises(ZeroDivisionError), db.transaction() as tx:
        tx.append("stocks", stock)
        1 / 0
    with pytest.raises(Exception), db.transaction() as tx:  # the second table's rows fail while they are written
        tx.append("stocks", stock)
        tx.append("daily_prices", _bars(spark, (1, 1, 1)).withColumn("close", F.raise_error(F.lit("broken")).cast("double")))
    assert db.commits() == [] and db.read("stocks").count() == 0 and not list(tmp_path.glob("stocks/*"))
    with db.transaction() as tx:
        tx.append("stocks", stock)
        tx.overwrite_by_key("daily_prices", _bars(spark, (1, 1, 1)))
        tx.overwrite_by_key("daily_prices", _bars(spark, (1, 1, 2), (1, 2, 3)))
    assert db.commits() == [1] and _closes(db) == [(1, 1, 2.0), (1, 2, 3.0)]
    monkeypatch.setattr(store.TableStore, "_create_once", lambda *a: False)
    with pytest.raises(store.Conflict):
        db.append("stocks", stock)
    assert len(list(tmp_path.glob("stocks/*"))) == 1


def test_files_are_created_once(spark, tmp_path):
    db = store.TableStore(spark, str(tmp_path))
    assert db._create_once(f"{tmp_path}/x/1.json", "one") and not db._create_once(f"{tmp_path}/x/1.json", "two")
    assert (tmp_path / "x/1.json").read_text() == "one" and [p.name for p in (tmp_path / "x").iterdir() if p.suffix == ".json"] == ["1.json"]
