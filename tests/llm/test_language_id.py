import itertools
import random
from collections import Counter

import numpy as np
import pytest

from quantspark.llm import language_id as L


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


@pytest.fixture(scope="module")
def model(documents):
    return L.train_languages(documents)


def test_held_out_documents_get_their_language(documents):
    rows = L.identify_language(documents).join(documents.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(rows) > 150 and sum(r.lang == r.lang_pred for r in rows) >= 0.98 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_labels_of_held_out_rows_and_ids_are_no_input(spark, documents):
    rows = [(r.doc_id, r.text, r.lang) for r in documents.limit(150).collect()]
    held = [r for r in L.identify_language(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()]
    ids = {r.doc_id for r in held if r.held_out}
    changed = [(i, t, "xx" if i in ids else x) for i, t, x in rows]
    again = L.identify_language(spark.createDataFrame(changed, "doc_id long, text string, lang string").repartition(5)).collect()
    assert sorted(held) == sorted(again)


def test_mixed_texts_are_cut_where_the_language_changes(spark, documents, model):
    texts = {x: next(r.text for r in documents.filter(f"lang = '{x}' and length(text) > 900").orderBy("doc_id").limit(1).collect()) for x in ("en", "fr", "de")}
    parts = [(x, texts[x][200:600] + ". ") for x in ("en", "fr", "de", "en")]
    text = "".join(t for _, t in parts)
    row = L.identify_language(spark.createDataFrame([(1, text, None)], "doc_id long, text string, lang string"), model, spans=True).first()
    assert [s.lang for s in row.spans] == ["en", "fr", "de", "en"] and row.lang_pred == "en" and row.score < 0.8
    border = np.cumsum([len(t) for _, t in parts])
    assert all(abs(s.end - b) < 40 for s, b in zip(row.spans, border))
    assert row.spans[0].start == next(i for i, c in enumerate(text) if c.isalpha())


def test_scripts_narrow_the_candidates(spark):
    rows = [(i, t, x) for i, (t, x) in enumerate([("привет мир как дела", "ru"), ("hello world how are you", "en"), ("καλημέρα κόσμε", "el"), ("नमस्ते दुनिया", "hi"), ("สวัสดีชาวโลก", "th")] * 6)]
    model = L.train_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    asked = [(1, "совершенно новое"), (2, "σπίτι"), (3, "विद्यालय"), (4, "โรงเรียน"), (5, "unseen stuff"), (6, "ქართული"), (7, "12 !? 34"), (8, "́́"), (9, "привет"), (10, "worldпривет")]
    found = {r.doc_id: r for r in L.identify_language(spark.createDataFrame(asked, "doc_id long, text string"), model, spans=True).collect()}
    assert [found[i].lang_pred for i in (1, 2, 3, 4, 5, 7, 8, 9)] == ["ru", "el", "hi", "th", "en", "und", "und", "ru"]
    assert found[7].score == 0 and found[6].lang_pred in model.languages
    assert [(s.start, s.end, s.lang) for s in found[10].spans] == [(0, 5, "en"), (5, 11, "ru")]


def test_viterbi_equals_all_paths():
    rng = np.random.default_rng(2)
    lengths = np.array([3, 0, 5, 1, 5])
    scores = rng.integers(-6, 7, (lengths.sum(), 3)).astype(np.float32)
    first, start, switch = np.concatenate([[0], np.cumsum(lengths)[:-1]]), np.array([0.0, -1.5, 0.25]), 2.5
    labels = L.viterbi(scores, first, lengths, start, switch)
    worth = lambda path, s: start[path[0]] + sum(s[t][k] for t, k in enumerate(path)) - switch * sum(a != b for a, b in zip(path, path[1:]))
    for a, n in zip(first, lengths):
        if n:
            s, mine = scores[a : a + n], labels[a : a + n]
            assert worth(mine, s) == pytest.approx(max(worth(p, s) for p in itertools.product(range(3), repeat=n)))


def test_counts_and_scores_equal_a_plain_loop(spark):
    texts = [("en", "The cat, the CAT"), ("en", "a cat"), ("fr", "é été")]
    bits = 17
    got = {(r.lang, r.slot): r.n for r in L.count_ngrams(spark.createDataFrame(texts, "lang string, text string"), bits).collect()}

    def grams(word):
        chars = [ord(c) + 2 for c in word]
        back = lambda i, k: [chars[j] if j >= 0 else 0 for j in range(i, i - k, -1)]
        inner = [(k, *back(i, k)) for i in range(len(chars)) for k in (1, 2, 3, 4)]
        return inner, [(4 + k, 1, *back(len(chars) - 1, k)) for k in (1, 2, 3)]

    slot = lambda g: int(L._slots(g[0], *[np.array([c], np.uint64) for c in g[1:]], bits=bits)[0])
    want = Counter()
    words = [("en", w) for w in "the cat the cat a cat".split()] + [("fr", w) for w in "é été".split()]
    for lang, w in words:
        for g in sum(grams(w), []):
            want[lang, slot(g)] += 1
        want[lang, (1 << bits) + L.LETTERS] += len(w)
        want[lang, (1 << bits) + L.WORDS] += 1
        want[lang, (1 << bits) + L.BY_SCRIPT] += len(w)
    assert got == dict(want)
    model = L.train_languages(spark.createDataFrame(texts, "lang string, text string"), bits)
    scores = model.scores(L.find_words(["the cat", "été"]))
    for row, w in zip(scores, ["the", "cat", "été"]):
        inner, ends = grams(w)
        assert row == pytest.approx(sum(model.weights[slot(g)] for g in inner) / 4 + sum(model.weights[slot(g)] for g in ends) / 3, rel=1e-4)


def test_pieces_and_groups_change_nothing(documents, model, monkeypatch):
    texts = [r.text for r in documents.limit(60).collect()]
    whole = L._label(texts, model, 8.0, True)
    monkeypatch.setattr(L, "CHUNK", 1 << 8)
    scores = model.scores(L.find_words(texts[:7]))
    assert np.allclose(scores, model.scores(L.find_words(texts[:7])))
    one_by_one = [L._label([t], model, 8.0, True).iloc[0] for t in texts]
    assert [list(whole.iloc[i][["lang_pred", "spans"]]) for i in range(60)] == [list(r[["lang_pred", "spans"]]) for r in one_by_one]
    assert [b for _, b in L._groups(["a" * 10] * 5, 22)] == [2, 4, 5]


def test_awkward_rows(spark, awkward, nothing):
    rows = L.identify_language(awkward, spans=True).collect()
    assert len(rows) == awkward.count()
    texts = {r.doc_id: r.text for r in awkward.collect() if r.doc_id in (100, 101, 102)}
    assert all((r.lang_pred, r.score, r.spans) == ("und", 0.0, []) for r in rows if r.doc_id in texts)
    assert {r.lang_pred for r in rows} <= {"en", "fr", "und"}
    assert len({(r.lang_pred, r.score) for r in rows if r.doc_id == 110}) == 1
    assert L.identify_language(nothing).collect() == []
    unlabelled = spark.createDataFrame([(random.randint(1, 9), "some text", None)], "doc_id long, text string, lang string")
    assert tuple(L.identify_language(unlabelled).first())[2:] == ("und", 0.0)
