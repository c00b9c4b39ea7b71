import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from quantspark.llm import mixing as M
from quantspark.llm import sharding as S
from quantspark.llm.common import counted_rows


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def fair_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), share * sum(sizes.values())
    while open_:
        total = sum(w[s] for s in open_)
        over = [s for s in open_ if left * w[s] / total > most * sizes[s]]
        if not over:
            target |= {s: left * w[s] / total for s in open_}
            break
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
            open_.discard(s)
    return target


def test_mix_meets_every_target(awkward):
    got = M.mix_sources(awkward).collect()
    assert len(got) == awkward.count()
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r.size
    want = fair_targets(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
    assert all(abs(taken[s] - want[s]) <= 0.5 + 1e-6 for s in want)
    assert sorted(map(str, got)) == sorted(map(str, M.mix_sources(awkward).collect()))


def test_targets_of_many_sources_are_positive_and_shared_in_full(spark, small):
    from quantspark.llm.queries import QUERIES

    rng = random.Random(3)
    for count in (1, 3, 20, 57):
        sizes = {f"s{i}": rng.randint(0, 30_000) for i in range(count)} | {None: 500}
        got = M.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"), (5, 2, 1), 1.5, 2.0).collect()
        assert {r.source: r.target for r in got} == pytest.approx(fair_targets(sizes))
        assert sum(r.target for r in got) == pytest.approx(1.5 * sum(sizes.values())) or all(r.target == 2 * r.source_size for r in got)
    rows = QUERIES["op1_mixing"](spark, small).collect()
    assert all(0 <= r.taken <= 2 * r.size for r in rows) and sum(r.taken for r in rows) == pytest.approx(1.5 * sum(r.size for r in rows), abs=20)


def test_mix_cuts_in_ranges_as_in_one(awkward, monkeypatch):
    whole = sorted(map(str, M.mix_sources(awkward).collect()))
    monkeypatch.setattr(M, "ROWS_PER_RANGE", 4)
    assert sorted(map(str, M.mix_sources(awkward).collect())) == whole


def plain_mix(rows, ids, seed=17):
    """(doc_id, source, size, taken) by sorting each source and walking to its budget."""
    sizes, by_source = defaultdict(int), defaultdict(list)
    for doc, text, source in rows:
        sizes[source] += words(text)
        by_source[source].append((int(ids(f"{seed}:{'' if doc is None else doc}")[:15], 16), "" if doc is None else str(doc), words(text), doc))
    out, want = [], fair_targets(sizes)
    for source, docs in by_source.items():
        epochs = int(want[source] // sizes[source]) if sizes[source] else 0
        left = int(want[source] - epochs * sizes[source] + 0.5)
        for _, _, size, doc in sorted(docs, key=lambda d: d[:3]):
            out.append((doc, source, size, epochs * size + min(size, left)))
            left -= min(size, left)
    return out


def test_mix_of_many_rows_without_ids_equals_a_walk_and_spreads(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(None, f"a{i} " * rng.randint(1, 9), "s0") for i in range(6000)] + [(None, "one two", "s1")] * 3000
    rows += [(i % 700, "w " * rng.randint(0, 40), f"s{i % 4}") for i in range(3000)] + [(5, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    monkeypatch.setattr(M, "ROWS_PER_RANGE", 256)
    got = M.mix_sources(docs).collect()
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    assert sorted(map(str, [(r.doc_id, r.source, r.size, r.taken) for r in got])) == sorted(map(str, plain_mix(rows, md5)))
    marked = docs.select("*", docs.text.alias("m"))
    one, two = (sorted(map(str, M.mix_sources(marked.repartition(n), mark=marked.m).collect())) for n in (1, 7))
    assert one == two


def test_repeats_of_a_row_are_counted_in_blocks(spark):
    rows = spark.createDataFrame([(None, "x")] * 1000 + [(1, "y")] * 3, "doc_id long, v string")
    counted = counted_rows(rows, 64).collect()
    assert sorted((r.v, r.block, r.copies) for r in counted) == [("x", b, 64 if b < 15 else 40) for b in range(16)] + [("y", 0, 3)]


def test_take_mix_repeats_whole_documents(awkward, nothing):
    out = M.take_mix(awkward)
    assert out.columns == awkward.columns
    known = {r.text for r in awkward.collect()}
    assert all(r.text in known for r in out.collect())
    assert M.take_mix(nothing).count() == 0 and M.mix_sources(nothing).count() == 0


def test_take_mix_of_repeated_ids_takes_what_the_plan_says(spark):
    rows = [(i % 400 if i % 7 else None, f"w{i % 5} " * (1 + i % 13), f"s{i % 3}") for i in range(600)] + [(1, "same row", "s0")] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = M.mix_sources(docs).selectExpr("sum(epochs + if(part > 0, 1, 0)) as n").first().n
    assert M.take_mix(docs).count() == plan
    times = M.take_mix(docs).groupBy("doc_id", "text", "source").count().collect()
    assert sum(r["count"] for r in times) == plan and max(r["count"] for r in times if r.text == "same row") >= 40


def test_mix_of_texts_without_words(spark):
    df = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert [(r.size, r.taken, r.target) for r in M.mix_sources(df).collect()] == [(0, 0, 0.0)] * 2


def least_capacity(sizes, n):
    lo, hi = max(sizes), sum(sizes)
    while lo < hi:
        mid, need, at = (lo + hi) // 2, 1, 0
        for x in sizes:
            if at + x > mid:
                need, at = need + 1, 0
            at += x
        lo, hi = (lo, mid) if need <= n else (mid + 1, hi)
    return lo


@pytest.mark.parametrize("seed,count,shards", [(1, 5, 2), (2, 40, 40), (3, 400, 7), (4, 3000, 40)])
def test_minimax_capacity_is_exact_with_few_cells(spark, monkeypatch, seed, count, shards):
    monkeypatch.setattr(S, "MAX_CELLS", 64)
    rng = random.Random(seed)
    pos = sorted(rng.sample(range(2**62), count))
    sizes = [rng.choice([16, rng.randint(16, 5000), rng.randint(16, 90000)]) for _ in pos]
    cuts = S.minimax_cuts(spark.createDataFrame(list(zip(pos, sizes)), "pos long, size long"), shards)
    loads = np.bincount(np.searchsorted(cuts, pos, side="right"), weights=sizes, minlength=shards)
    assert len(loads) == shards and loads.max() == least_capacity(sizes, shards)


def test_shards_of_awkward_rows(awkward):
    rows = awkward.select("doc_id", "text").collect()
    got = S.shard_documents(awkward, shards=6).collect()
    assert len(got) == len(rows)
    want = sorted((str(r.doc_id), len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in rows)
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == want
    homes, slots, loads = defaultdict(set), defaultdict(list), defaultdict(int)
    for r in got:
        homes[r.text_crc32].add(r.shard)
        slots[r.shard].append(r.slot)
        loads[r.shard] += r.size
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 6
    assert all(len(h) == 1 for h in homes.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    big = max(len((r.text or "").encode()) + 16 for r in rows)
    assert max(loads.values()) <= max(big, 2 * sum(loads.values()) / 6)


def test_a_giant_group_leaves_the_other_shards_even(spark):
    rng = random.Random(2)
    rows = [(i, "same text over and over") for i in range(2000)] + [(i, f"{i} " + "w" * rng.randint(5, 40)) for i in range(2000, 5000)]
    got = S.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), shards=10).collect()
    loads = defaultdict(int)
    for r in got:
        loads[r.shard] += r.size
    giant = {r.shard for r in got if r.doc_id < 2000}
    assert len(giant) == 1
    rest = [v for s, v in loads.items() if s not in giant]
    assert len(rest) == 9 and max(rest) - min(rest) < 200


def test_shards_equal_a_plain_walk_and_spread_rows_without_ids(spark):
    rng = random.Random(5)
    texts = [f"{i} " + "w" * rng.randint(1, 3000) for i in range(900)] + [f"n{i}" for i in range(12_000)] + ["again"] * 12_000
    df = spark.createDataFrame([(i if i < 900 else None, t) for i, t in enumerate(texts)], "doc_id long, text string")
    shards = 7
    got = S.shard_documents(df, shards=shards).collect()
    pos = {r.t: r.p for r in df.selectExpr("text t", "shiftrightunsigned(xxhash64(text), 2) p").distinct().collect()}
    of_crc = {zlib.crc32(t.encode()): t for t in pos}
    assert len(of_crc) == len(pos) and len(got) == len(texts)
    loads, slots, home = defaultdict(int), defaultdict(list), {}
    for r in got:
        loads[r.shard] += r.size
        slots[r.shard].append(r.slot)
        assert home.setdefault(of_crc[r.text_crc32], r.shard) == r.shard
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    total, size = sum(loads.values()), defaultdict(int)
    for t in texts:
        size[t] += len(t) + 16
    alone = ["again"] if size["again"] * shards > total else []  # larger than an equal share: a shard of its own
    assert all([t for t in home if home[t] == home[x]] == [x] for x in alone)
    order = sorted((t for t in home if t not in alone), key=pos.get)
    homes = [home[t] for t in order]
    assert homes == sorted(homes)  # contiguous in the order of the hash
    assert max(v for s, v in loads.items() if s not in {home[x] for x in alone}) == least_capacity([size[t] for t in order], shards - len(alone))


def test_sharding_nothing(nothing):
    assert S.shard_documents(nothing).count() == 0
