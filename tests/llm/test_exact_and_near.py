import hashlib
import inspect
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantspark.llm import exact_dedup as E
from quantspark.llm import near_dedup as N


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[normal(t)].append(i)
    out = []
    for n, ids in groups.items():
        named = [i for i in ids if i is not None]
        keep = min(named) if named else None
        done = False
        for i in ids:
            kept = i == keep and not done
            done |= kept
            out.append((i, keep, len(ids), kept, hashlib.sha256(n.encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("key", [E.default_key, lambda t: F.pmod(F.xxhash64(t), F.lit(5)), lambda t: F.lit(1).cast("long")])
def test_exact_dedup_is_brute_force_even_when_keys_collide(awkward, key):
    got = E.exact_dedup(awkward, bucket_capacity=4, key=key)
    assert Counter(map(tuple, got.collect())) == brute_exact(rows_of(awkward))


def test_exact_dedup_of_nothing(nothing):
    assert E.exact_dedup(nothing).count() == 0 and E.keep_first(nothing).columns == nothing.columns


def test_directory_splits_full_buckets_only(spark):
    low = [(i << 53,) for i in range(64)]  # one key in every other of the first 128 of 4096 slots
    keys = spark.createDataFrame(low + [(-1,)], "key long")
    d = {r.slot: (r.bucket, r.local_depth) for r in E.build_directory(keys, 8, 12).collect()}
    assert {d[2 * i][1] for i in range(64)} == {8} and len({d[2 * i][0] for i in range(64)}) == 8
    bucket, depth = d[4095]
    assert depth == 1 and bucket == 4096 - 2 ** (12 - depth)
    assert all(d[slot][0] <= slot < d[slot][0] + 2 ** (12 - d[slot][1]) for slot in d)


def test_exact_keep_first_keeps_columns_and_one_row_each(awkward):
    kept = E.keep_first(awkward)
    assert kept.columns == awkward.columns
    texts = [normal(r.text) for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({normal(t) for _, t in rows_of(awkward)})


def shingles(text, k=5):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def brute_classes(rows, least=0.8):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both / len(sets[i] | sets[j]) >= least:
                up[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    out = []
    for ids in groups.values():
        named = [i for i in ids if i is not None]
        out += [(i, min(named) if named else None, len(ids)) for i in ids]
    return Counter(out)


def brute_class_count(rows):
    """Classes of the brute-force result: ids repeat, so classes are counted by their sizes."""
    return round(sum(n / size for (_, _, size), n in brute_classes(rows).items()))


def classes(df, **options):
    return Counter((r.doc_id, r.class_id, r.class_size) for r in N.near_duplicates(df, **options).collect())


def test_near_classes_of_awkward_rows(awkward):
    got = N.near_duplicates(awkward)
    assert Counter((r.doc_id, r.class_id, r.class_size) for r in got.collect()) == brute_classes(rows_of(awkward))
    assert got.filter("is_first").count() == brute_class_count(rows_of(awkward))


@pytest.fixture(scope="module")
def edited(spark):
    """A text with many edited copies, chains of edits, and texts that share a passage only."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(200)]
    rows = [(0, " ".join(base))]
    for _ in range(150):  # copies at all distances around the threshold
        w = base[:]
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(len(w))] = word()
        rows.append((len(rows), " ".join(w)))
    chain = [word() for _ in range(120)]
    for step in range(12):  # each near the last, the first far from the last
        rows.append((len(rows), " ".join(chain)))
        chain[step * 9] = word()
        chain[(step * 9 + 50) % 120] = word()
    passage = [word() for _ in range(60)]
    for _ in range(40):
        rows.append((len(rows), " ".join([word() for _ in range(60)] + passage + [word() for _ in range(60)])))
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("tile", [512, 16])
def test_near_classes_lose_no_link(edited, tile, monkeypatch):
    monkeypatch.setattr(N, "TILE", tile)
    assert classes(edited) == brute_classes(rows_of(edited))


def test_near_classes_of_the_small_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    assert classes(docs) == brute_classes(rows_of(docs))


def test_short_texts_of_the_same_words_in_another_order_are_different(spark):
    texts = ["not all is well", "all is not well", "Not  all is WELL", "well", "well well", "b a", "a b", "a b c", "c b a", "a b c d e", "e d c b a", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert classes(docs) == brute_classes(rows_of(docs))


def test_near_dedup_of_nothing(nothing):
    assert N.near_duplicates(nothing).count() == 0


def test_near_keep_first(awkward):
    kept = N.keep_first(awkward)
    assert kept.columns == awkward.columns and kept.count() == brute_class_count(rows_of(awkward))


def test_sketch_components_agree_as_probability_jaccard():
    rng = np.random.default_rng(1)
    codes = N._mix(np.arange(1, 301, dtype=np.uint64) * N._G)
    x, y = np.arange(0, 200), np.arange(100, 300)
    wx, wy = rng.integers(1, 5, 200).astype(float), rng.integers(1, 5, 200).astype(float)
    size = 4096
    sk = N.prob_minhash(np.concatenate([codes[x], codes[y]]), np.concatenate([wx, wy]), np.repeat([0, 1], 200), 2, size)
    a, b = np.zeros(300), np.zeros(300)
    a[x], b[y] = wx, wy
    want = sum(1 / np.maximum(a / a[d], b / b[d]).sum() for d in range(100, 200))
    assert abs((sk[0] == sk[1]).mean() - want) < 4 * np.sqrt(want * (1 - want) / size)


def test_near_classes_of_texts_that_repeat_a_passage_differently(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows = []
    for edits in [0, 3] * 40:  # set Jaccard 0.98 and 0.84
        body, passage = [word() for _ in range(160)], [word() for _ in range(40)]
        rows.append((len(rows), " ".join(body + passage * 200)))
        for i in range(edits):
            body[20 + 40 * i] = word()
        rows.append((len(rows), " ".join(body + passage)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_classes(rows)
    assert {size for _, _, size in want} == {2}
    assert classes(docs) == want


def test_weights_bound_the_probability_jaccard():
    rng = np.random.default_rng(2)
    for _ in range(50):
        a, b = np.zeros(300), np.zeros(300)
        a[:220], b[80:] = N.shingle_weights(rng.integers(1, 5000, 220)), N.shingle_weights(rng.choice([1, 9999], 220))
        both = [d for d in range(300) if a[d] and b[d]]
        assert sum(1 / np.maximum(a / a[d], b / b[d]).sum() for d in both) >= len(both) / 300 / N.HEAVIEST
    bands = inspect.signature(N.near_duplicates).parameters
    assert (1 - (0.8 / N.HEAVIEST) ** bands["rows"].default) ** bands["bands"].default < 2e-6


def test_common_counts():
    sets = [np.array(s, dtype=np.uint32) for s in ([1, 2, 3], [2, 3, 9], [7], [3, 7])]
    np.testing.assert_array_equal(N.common_counts(sets)[:2, :], [[2, 2, 0, 1], [2, 2, 0, 1]])


def test_components_of_a_path_and_a_star(spark):
    path = [(f"p{i:03}", f"p{i + 1:03}") for i in range(40)] + [("s", f"t{i}") for i in range(30)]
    links = spark.createDataFrame([(a.encode(), b.encode()) for a, b in path], "a binary, b binary")
    got = {bytes(r.node).decode(): bytes(r.root).decode() for r in N.connect(links).collect()}
    assert {v for k, v in got.items() if k[0] == "p"} == {"p000"} and {v for k, v in got.items() if k[0] == "t"} == {"s"} and len(got) == 70
