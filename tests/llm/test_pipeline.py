import os
import shutil
import subprocess
import sys
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline as C
from quantspark.llm import exact_dedup, mixing, near_dedup, quality

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_every_stage_keeps_the_columns_and_takes_effect(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    table = docs
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, table, small)
        rows = out.collect()
        assert out.columns == docs.columns, name
        before = {tuple(r) for r in table.collect()}
        assert all(tuple(r) in before for r in rows), name
        table = spark.createDataFrame(rows, docs.schema)
    pieces = C.STAGES[-1][1](spark, table, small)
    assert Counter(r.doc_id for r in pieces.filter("start = 0").collect()) == Counter(r.doc_id for r in table.collect())


def test_stages_equal_their_operators(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    ids = lambda df: Counter(r.doc_id for r in df.select("doc_id").collect())
    assert ids(C.keep_good(spark, docs, small)) == ids(quality.classify_quality(docs, labels).filter("predicted = 1"))
    assert ids(C.drop_copies(spark, docs, small)) == ids(exact_dedup.exact_dedup(docs).filter("kept"))
    assert ids(C.drop_near_copies(spark, docs, small)) == ids(near_dedup.near_duplicates(docs).filter("is_first"))
    plan = mixing.mix_sources(docs).filter("taken > 0")
    passes = plan.select("doc_id", (F.col("epochs") + (F.col("part") > 0).cast("long")).alias("n"))
    assert ids(C.mix(spark, docs, small)) == Counter({r.doc_id: r.n for r in passes.collect()})


def test_awkward_rows_pass_every_stage(spark, small, awkward, nothing):
    for docs in (awkward, nothing):
        for name, stage in C.STAGES:
            stage(spark, docs, small).count()


def test_run(spark, small):
    assert C.run(spark, small).count() > 0


def test_entry_works_without_the_training_data_package(tmp_path):
    for name in ("quantspark", "__spark_entry__.py"):
        source = os.path.join(ROOT, name)
        (shutil.copytree if os.path.isdir(source) else shutil.copy)(source, tmp_path / name)
    shutil.rmtree(tmp_path / "quantspark/llm")
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert len(q) > 80 and set(s) <= set(q) and not any(x.startswith('op') or x == 'pipeline' for x in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
