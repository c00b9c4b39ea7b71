import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from quantspark.llm import fill_middle as M
from quantspark.llm import queries as Q
from quantspark.llm import spelling as S

# --- spelling ------------------------------------------------------------------------------


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_counts(rows, least_length=5, least_count=3, slip=None):
    lower = str.maketrans(S.UPPER, S.LOWER)
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall(S.LETTERS, text or ""):
            run = run.translate(lower)
            if slip:
                h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
                if h % slip == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= least_length and n >= least_count}


def plain_variants(counts, ratio=2):
    near, form = defaultdict(list), {}
    for a in counts:
        near[a] = [b for b in counts if a != b and abs(len(a) - len(b)) < 2 and one_edit(a, b)]
        best = min(near[a], key=lambda b: (-counts[b], b), default=None)
        form[a] = best if best and counts[best] >= ratio * counts[a] else None
    rows = set()
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        rows.add((w, form[w], root, counts[w], len(near[w]), counts.get(form[w])))
    return rows


def got(df):
    rows = [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def ids_and_texts(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def test_variants_equal_all_pairs(spark):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        words = []
        for _ in range(30):
            w = rng.choice(["bridge", "stones", "straße", "aaaaab", "Éclair", "niñosa", "walking"])
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                k = rng.randrange(len(w) + 1)
                w = rng.choice([w[:k] + rng.choice("aeé×S") + w[k:], w[:k] + w[k + 1 :], w[:k] + rng.choice("asÿ") + w[k + 1 :]])
            words.append(w)
        rows.append((i if i % 9 else None, rng.choice([" ", "1", "\n", "-"]).join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for slip in (None, 97, 5):
        want = plain_variants(plain_counts(rows, slip=slip))
        assert len(want) > 300 and got(S.spelling_variants(docs, slip_every=slip)) == want
    assert any(root not in (w, form) for w, form, root, *_ in want)


def test_long_chains_of_forms_reach_their_root(spark):
    words = ["abcdefghij"[: 10 - i] + "z" * i for i in range(9)]  # each one edit from the next
    rows = [(i, " ".join([w] * (3 * 2**i))) for i, w in enumerate(words)]
    found = {r.word: r for r in S.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {r.root for r in found.values()} == {words[-1]} and found[words[0]].form == words[1]


def test_very_long_words_and_the_border_between_both_ways(spark):
    rng = random.Random(1)
    base = "".join(rng.choice("abcdeé") for _ in range(S.LONG_WORD))
    longer, huge = base[:30] + "x" + base[30:], "".join(rng.choice("abcdef") for _ in range(3000))
    words = [base, base[:-1], base[:-1] + "x", longer, longer[:-1] + "y", huge, huge[:77] + huge[78:], "x" + huge, "q" * 5000, "q" * 5001]
    rows = [(i, " ".join([w] * (3 + i * i))) for i, w in enumerate(words)]
    want = plain_variants(plain_counts(rows))
    assert got(S.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string"))) == want and sum(r[4] for r in want) >= 12


def test_each_word_emits_itself_and_its_distinct_deletions(spark):
    words = spark.createDataFrame([("aabbb", 1), ("xyz", 1), ("", 1)], "word string, n long")
    per = {r.word: r.k for r in S.deletion_keys(words, "word").groupBy("word").agg(F.count_distinct("key").alias("k"), F.count("key").alias("n")).filter("k = n").collect()}
    assert per == {"aabbb": 3, "xyz": 4, "": 1}


def test_spelling_of_awkward_rows_and_of_a_word_in_a_third_of_all_places(spark, awkward, nothing):
    assert got(S.spelling_variants(awkward, slip_every=97)) == plain_variants(plain_counts(ids_and_texts(awkward), slip=97))
    assert S.spelling_variants(nothing).collect() == []
    rows = [(i, ("common " * 5 + f"comon word{'abcdefghij'[i % 10]} ") * 3) for i in range(300)]
    assert got(S.spelling_variants(spark.createDataFrame(rows, "doc_id int, text string"))) == plain_variants(plain_counts(rows))


def test_no_side_of_a_spelling_join_is_gathered_in_the_driver(spark, monkeypatch):
    words = ["abcdefghij"[: 10 - i] + "z" * i for i in range(9)] + ["q" * 80, "q" * 81]
    docs = spark.createDataFrame([(i, " ".join([w] * (3 * 2**i))) for i, w in enumerate(words)], "doc_id long, text string")
    plans, write = [], S.materialize

    def run(df):
        rows = df.collect()
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return rows

    monkeypatch.setattr(S, "materialize", lambda df, name: (run(df), write(df, name))[1])
    assert len(run(S.spelling_variants(docs))) == len(words)
    assert len(plans) > 5 and sum("SortMergeJoin" in p for p in plans) >= 5 and not any("Broadcast" in p for p in plans)


# --- fill in the middle --------------------------------------------------------------------


def plain_middle(doc_id, text):
    text = text or ""
    units = re.findall(M.UNIT, text)
    code = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(code[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, len(units), "plain", None, None, text
    if h[3] % 100 < 20:
        return doc_id, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def sort(rows):
    return sorted(rows, key=repr)


def test_middles_equal_a_plain_version(spark, awkward, nothing):
    rng = random.Random(5)
    pieces = ["word", "Niño", "<", "<S", ">", "P>", "𝔘𝔫𝔦", "\n", " ", "  ", "é", "ab1", "\r\n", "<M"]
    rows = [(i, "".join(rng.choice(pieces) for _ in range(rng.randint(0, 60)))) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for docs in (docs, awkward):
        made = M.fill_in_middle(docs)
        out = made.withColumn("back", M.restore_text(F.col("output"), F.col("form"))).collect()
        assert sort(tuple(r)[:6] for r in out) == sort(plain_middle(r.doc_id, r.text) for r in docs.collect())
        assert sort(r.back for r in out) == sort(r.text or "" for r in docs.collect())
    assert {r.form for r in M.fill_in_middle(docs).collect()} == {"plain", "psm", "spm"}
    assert M.fill_in_middle(nothing).collect() == []


def test_matcher_keeps_no_units():
    import tracemalloc

    text, pattern = "ab " * 400_000, re.compile(M.UNIT)
    tracemalloc.start()
    assert M.count_units(pattern, text) == 800_000 and M.unit_ends(pattern, text, 3, 799_999) == (5, len(text) - 1)
    assert tracemalloc.get_traced_memory()[1] < 100_000
    tracemalloc.stop()


def test_shares_and_units_are_parameters(awkward):
    assert {r.form for r in M.fill_in_middle(awkward, plain_percent=100).collect()} == {"plain"}
    forms = {r.form for r in M.fill_in_middle(awkward, plain_percent=0, spm_percent=100).collect() if r.n}
    assert forms == {"spm"}
    lines = M.fill_in_middle(awkward, unit="[^\n]*\n|[^\n]+").filter("doc_id = 107").collect()
    assert min(r.n for r in lines) >= 1 and max(r.n for r in lines) == 80


def test_queries_equal_their_sql(spark, small):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{small}/documents.parquet')")
    for name in ("op11_spelling", "op12_fill_middle"):
        df = Q.QUERIES[name](spark, small)
        want = con.execute(Q.ORACLE_SQL[name])
        columns = [d[0] for d in want.description]
        assert sorted(columns) == sorted(df.columns)
        assert sort(tuple(r) for r in df.select(columns).collect()) == sort(want.fetchall())
