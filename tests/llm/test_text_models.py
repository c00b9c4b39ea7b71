import hashlib
import math
import random
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from quantspark.llm import fingerprints as X
from quantspark.llm import language_model as L
from quantspark.llm import quality as Q
from quantspark.llm.html_text import extract_html, render


def test_quality_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = Q.classify_quality(docs, labels).join(labels, "doc_id").filter("held_out").toPandas()
    assert (got.predicted == got.quality).mean() > 0.93 and got[got.quality == 1].predicted.mean() > 0.98
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.7)).all()
    assert all((zlib.crc32(str(i).encode()) % 4 == 2) for i in got.doc_id)


def test_quality_of_awkward_rows_and_without_labels(spark, awkward, nothing):
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, None), (None, 1), (999, 0)], "doc_id long, quality int")
    got = Q.classify_quality(awkward, labels)
    assert got.count() == awkward.count() and got.filter("score is null or held_out is null").count() == 0
    assert {r.score for r in Q.classify_quality(awkward, labels.limit(0)).collect()} == {0.5}
    assert Q.classify_quality(nothing, labels).count() == 0
    kept = Q.keep_quality(awkward, labels)
    assert kept.columns == awkward.columns


def test_quality_ignores_held_out_labels(spark, awkward):
    held = [i for i in range(40) if zlib.crc32(str(i).encode()) % 4 == 2]
    rest = [(i, i % 2) for i in range(40) if i not in held]
    a = Q.train_quality(awkward, spark.createDataFrame(rest + [(i, 0) for i in held], "doc_id long, quality int"))
    b = Q.train_quality(awkward, spark.createDataFrame(rest + [(i, 1) for i in held], "doc_id long, quality int"))
    np.testing.assert_array_equal(a, b)


def base_scores(rows):
    words = [(t or "").encode().lower().split() for _, t in rows]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1 for i, _ in rows]
    c, ends = Counter(), 0
    for w, h in zip(words, held):
        if not h:
            c.update(w)
            ends += 1
    n, v = sum(c.values()) + ends, len(c) + (ends > 0)
    total = math.log10(n + 0.5 * (v + 1))
    return [(i, h, len(w) + 1, sum(c[x] > 0 for x in w) + (ends > 0), n, sum(math.log10(c[x] + 0.5) - total for x in w) + math.log10(ends + 0.5) - total) for (i, _), w, h in zip(rows, words, held)]


@pytest.mark.parametrize("known", [200_000, 3])
def test_base_scores_are_exact(awkward, known):
    rows = [(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()]
    got = L.score_language(awkward, known_words=known, classes=8, dims=4, batch=64).collect()
    key = lambda r: (str(r[0]), r[2], round(r[5], 5))
    a = sorted([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got], key=key)
    b = sorted(base_scores(rows), key=key)
    assert [x[:5] for x in a] == [x[:5] for x in b]
    np.testing.assert_allclose([x[5] for x in a], [x[5] for x in b], rtol=1e-9)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_language_scores_of_nothing(nothing):
    assert L.score_language(nothing, classes=8, dims=4).count() == 0


def test_model_probabilities_sum_to_one_and_learn_order(spark):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(["a b c d"] * 30 + [str(rng.choice(list("xyz")))] * 3)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = L.score_language(docs, classes=12, dims=8, batch=256, rate=0.3).filter("held_out").toPandas()
    assert got.score.sum() > got.base_score.sum() / 2  # order is worth far more than counts
    m = L.LogBilinear.start(np.full(12, 1 / 12), 8)
    norm = m.normalisers()
    for far, near in ((0, 0), (3, 7)):
        s = m.predicted(np.array([far]), np.array([near])) @ m.target.T + m.bias
        assert np.exp(s - norm[far, near]).sum() == pytest.approx(1, rel=1e-4)


@pytest.mark.parametrize("classes", [4, 9, 40])
def test_words_of_a_class_and_one_unknown_share_it(classes):
    counts = {"ab": 9, "b": 7, "xab": 4, "yab": 3, "zz": 2, "é": 2, "q": 1}
    words = [(w.encode(), n) for w, n in counts.items()]
    endings = {}
    for w, n in words:
        tokens, kinds = endings.get(w[-2:], (0, 0))
        endings[w[-2:]] = (tokens + n, kinds + 1)
    v = L.Vocabulary(words[:4], endings, classes)  # the last three words are not listed
    texts = [w for w, _ in words] + [b"unseen"]
    classed = v.classed(texts, v.numbers(texts))
    assert classed[-1] == 0 and classed.max() < classes and v.tokens.sum() == sum(counts.values())
    shared = {int(c) for c in classed[:-1]} - set(range(2, 2 + v.alone))
    for c in shared:
        mass = [10 ** (math.log10(n + 0.5) - v.share[c]) for (_, n), k in zip(words, classed) if k == c] + [10 ** (math.log10(0.5) - v.share[c])]
        assert sum(mass) == pytest.approx(1)


def test_language_model_beats_counts_alike_in_any_layout(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    gains = []
    for parts in (1, 40):
        got = L.score_language(docs.repartition(parts, "doc_id")).filter("held_out").agg({"score": "sum", "base_score": "sum"}).first()
        gains.append(1 - got["sum(score)"] / got["sum(base_score)"])
    assert min(gains) > 0.09 and abs(gains[0] - gains[1]) < 0.01


def test_scores_equal_a_plain_loop(spark, monkeypatch):
    seen = {}

    def fixed(training, tokens, vocabulary, prior, dims, *rest):
        model = L.LogBilinear.start(prior, dims, seed=3)
        model.context *= 10
        model.mix[0] = 0.5
        seen.update(v=vocabulary.value, model=model, tokens=tokens)
        return model

    monkeypatch.setattr(L, "train_model", fixed)
    rows = [(i, " ".join(f"w{(i * 7 + k * k) % 23}{'ab'[k % 2]}" for k in range(i % 9)) + (" Odd" if i % 6 == 0 else "")) for i in range(120)]
    got = L.score_language(spark.createDataFrame(rows, "doc_id long, text string"), known_words=9, classes=9, dims=3).collect()
    v, m = seen["v"], seen["model"]
    counts = Counter(w for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1 for w in t.encode().lower().split())
    alone = {w for w, k in v.number.items() if k < v.alone}
    class_of = lambda w: int(v.class_of[v.number[w]]) if w in v.number else v.ending.get(w[-2:], 1)
    kinds = Counter(class_of(w) for w in counts if w not in alone)
    inside = Counter()
    for w, n in counts.items():
        inside[class_of(w)] += n
    assert seen["tokens"] == sum(counts.values()) + sum(zlib.crc32(str(i).encode()) % 5 != 1 for i, _ in rows)
    texts = dict(rows)
    for r in got:
        words = texts[r.doc_id].encode().lower().split()
        classes, total = [class_of(w) for w in words] + [0], 0.0
        for t, c in enumerate(classes):
            far, near = (classes[t - 2] if t > 1 else 0), (classes[t - 1] if t else 0)
            logits = (m.context[far] * m.mix[0] + m.context[near] * m.mix[1]) @ m.target.T + m.bias
            total += (logits[c] - np.log(np.exp(logits.astype(float)).sum())) / np.log(10)
            if t < len(words) and words[t] not in alone:
                total += np.log10((counts[words[t]] + 0.5) / (inside[c] + 0.5 * (kinds[c] + 1)))
        assert r.score == pytest.approx(total, rel=1e-4)


def test_pair_counts_and_their_fit(spark):
    rng = np.random.default_rng(1)
    seqs = [rng.integers(0, 6, rng.integers(1, 30)).astype("<u2") for _ in range(50)]
    seqs += [np.array([2, 3] * 40, "<u2")] * 20
    pairs = L.pair_counts(spark.createDataFrame([(bytearray(q.tobytes()),) for q in seqs], "classes binary"), 6)
    want = Counter((a, b) for q in seqs for a, b in zip([0, *q.tolist()], q.tolist()))
    assert {k: int(n) for k, n in np.ndenumerate(pairs) if n} == dict(want)
    prior = pairs.sum(axis=0) / pairs.sum()
    model = L.LogBilinear.start(prior, 5)
    L.fit_pairs(model, pairs, prior, turns=600, decay=0.01)
    scores = model.context @ model.target.T + model.bias
    log_p = scores - np.log(np.exp(scores).sum(axis=1, keepdims=True))
    best = (pairs * np.log(np.maximum(pairs, 1e-9) / pairs.sum(axis=1, keepdims=True))).sum()
    assert (pairs * log_p).sum() > best - 0.02 * abs(best)
    assert abs(np.exp(scores).sum(axis=1) - 1).max() < 0.3  # estimation against noise normalises by itself


def test_edited_texts_in_id_order(awkward):
    order = lambda t: struct.unpack("<q", struct.pack("<Q", xxhash.xxh64_intdigest(t.encode(), 42)))[0]
    rows = sorted(((r.doc_id if r.doc_id is not None else -(2**63), r.text or "") for r in awkward.select("doc_id", "text").collect()), key=lambda x: (x[0], order(x[1])))
    want = []
    for k, (i, t) in enumerate(rows):
        following, cut = rows[(k + 1) % len(rows)][1], len(t) // 4
        edited = t[: len(t) - cut] + following[:cut]
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest()))
    got = X.fingerprints_under_edit(awkward).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -(2**63), r.n_chars, r.edited_sha256) for r in got) == sorted(want)
    by_text = {}
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert by_text.setdefault((r.doc_id, r.n_chars), r.fingerprint) is not None


def test_fingerprints_tell_copies_from_others(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = X.fingerprints_under_edit(docs).filter("n_chars > 1500").toPandas()
    assert got.near_edited.median() > 0.4 and got.near_next.median() < 0.05
    alone = docs.limit(1)
    assert X.fingerprints_under_edit(alone).count() == 1
    assert X.fingerprints_under_edit(docs.limit(0)).count() == 0
    plain = {r.doc_id: r.fingerprint for r in X.fingerprint_documents(docs).collect()}
    assert all(plain[r.doc_id] == r.fingerprint for r in got.itertuples())
    a, b = X.decode_fingerprint(plain[0]), X.decode_fingerprint(plain[1])
    assert X.pruned_jaccard(a, a) == 1.0 and X.pruned_jaccard(a, b, 0.99) == 0.0


@pytest.mark.parametrize("seed", range(3))
def test_every_row_has_a_next_one(spark, seed):
    rng = random.Random(seed)
    ids = [rng.choice([None, 5, 2**53 + rng.randint(0, 9), rng.randint(-(2**63), 2**63 - 1), 2**63 - 1, -(2**63)]) for _ in range(rng.choice([1, 2, 7, 120]))]
    rows = [(i, " ".join(rng.choice("the river of stones and a bridge".split()) for _ in range(rng.randint(0, 9)))) for i in ids]
    got = X.fingerprints_under_edit(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert Counter((r.doc_id, r.n_chars) for r in got) == Counter((i, len(t)) for i, t in rows)


def plain_signatures(text, chain=2, gap=8):
    """Signatures as tuples of words, by loops."""
    edge = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())
    words = [w for w in (x.lower().strip(edge) for x in text.split()) if w]
    content = [w for w in words if w not in X.ANCHORS]
    found, seen, run = set(), 0, []

    def long_run():
        if len(run) > gap:
            for j in run:
                if j + chain < len(content):
                    found.add((content[j], *content[j + 1 : j + 1 + chain]))
        run.clear()

    for w in words:
        if w in X.ANCHORS:
            long_run()
            if seen + chain <= len(content):
                found.add((w, *content[seen : seen + chain]))
        else:
            run.append(seen)
            seen += 1
    long_run()
    return found or {tuple(words)}


def plain_jaccard(a, b):
    return len(a & b) / len(a | b)


def test_signatures_and_likenesses_against_plain_loops(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(120)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    order = sorted(texts)
    got = {r.doc_id: r for r in X.fingerprints_under_edit(docs).collect()}
    for k, i in enumerate(order):
        text, following = texts[i], texts[order[(k + 1) % len(order)]]
        cut = len(text) // 4
        mine, edited, theirs = map(plain_signatures, (text, text[: len(text) - cut] + following[:cut], following))
        assert len(X.decode_fingerprint(got[i].fingerprint)) == len(mine)
        for have, want in ((got[i].near_edited, plain_jaccard(mine, edited)), (got[i].near_next, plain_jaccard(mine, theirs))):
            assert have == pytest.approx(want if want >= 0.1 else have if have < 0.1 else want)
    edited = [r.near_edited for r in got.values() if r.n_chars > 200]
    assert min(edited) > 0.1 and np.median(edited) > 0.5


def test_similar_fingerprints_are_all_linked(spark, awkward, nothing):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)] + ["the", "of", "and"] * 8
    base = [[rng.choice(words) for _ in range(rng.randint(20, 90))] for _ in range(12)]
    rows = []
    for i in range(150):
        text = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 5, 20])):
            text[rng.randrange(len(text))] = rng.choice(words)
        rows.append((2**53 + i, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    prints = X.fingerprint_documents(docs).cache()
    sets = {r.doc_id: set(X.decode_fingerprint(r.fingerprint).tolist()) for r in prints.collect()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and plain_jaccard(sets[i], sets[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = {r.doc_id: r.class_id for r in X.similar_fingerprints(prints, 0.8).collect()}
    assert got == {i: find(i) for i in sets} and len(set(got.values())) < 100
    assert X.similar_fingerprints(X.fingerprint_documents(awkward)).count() == awkward.count()
    assert X.similar_fingerprints(X.fingerprint_documents(nothing)).count() == 0


PAGES = [
    ("<table><tr><td rowspan=2>AA<td>b1<td>c1<tr><td>b2<td>c2</table>", "AA  b1  c1\n    b2  c2"),
    ("<div>" * 300 + "<ul><li>one<li>two</ul><table><tr><td>x<td>y</table><pre>z\n  w</pre>", "- one\n- two\n\nx  y\n\nz\n  w"),
    ("<div style='visibility:hidden'>no <b style='visibility: visible'>yes</b> no<p style='display:none'>no</div>", "yes"),
    ("<ul><li>a<li>b<ol start=3><li>x<li>y</ol><li>c</ul>", "- a\n- b\n\n  3. x\n  4. y\n- c"),
    ("<p>one<p>two <span hidden>no</span><b style='display: none'>no</b>three", "one\n\ntwo three"),
    ("<table><tr><td>a<td>bbb<tr><th>cc<td>d<br>e</table>tail", "a   bbb\ncc  d\n    e\n\ntail"),
    ("<table><tr><td colspan=2>wide one<tr><td>a<td>b</table>", "wide one\na  b"),
    ("x<script>if (a<b) document.write('<p>no')</script><!-- <p>no --><style>p{}</style>y", "xy"),
    ("<pre> a\n   b</pre>&lt;tag&gt; &amp; &#233;", " a\n   b\n\n<tag> & é"),
    ("<div>a</div><div>b</div><noscript>no</noscript><select><option>no</select>", "a\nb"),
    ("<blockquote><p>q</blockquote>z", "  q\n\nz"),
    ("<p>open <b>bold<p>next</p></div>", "open bold\n\nnext"),
    ("<img alt='a cat'><input type=hidden value=no><input type=submit value=Go>", "a catGo"),
    ("just text", "just text"),
    ("a <b unclosed", "a <b unclosed"),
]


@pytest.mark.parametrize("source,want", PAGES)
def test_rendering(source, want):
    assert render(source)[1] == want


def test_deep_and_empty_pages(spark):
    deep = "<div>" * 50_000 + "x" + "</div>" * 50_000
    assert render(deep)[1] == "x" and render(None) == ("", "") and render("") == ("", "")
    df = spark.createDataFrame([(1, None, "u"), (None, "<title>T</title>t", "u"), (None, "<title>T</title>t", "u"), (2, "", "u")], "page_id long, html string, text string")
    got = sorted((str(r.page_id), r.title, r.text, r.n_chars) for r in extract_html(df).collect())
    assert got == [("1", "", "", 0), ("2", "", "", 0), ("None", "T", "t", 1), ("None", "T", "t", 1)]
    assert extract_html(df.limit(0)).count() == 0


def test_all_visible_words_of_the_small_pages_stay(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    for r in pages.limit(20).collect():
        text = render(r.html)[1]
        for inner in __import__("re").findall(r"<p>([^<&]+)</p>", r.html):
            assert " ".join(inner.split()) in text
        assert "track(" not in text and "margin:0" not in text
