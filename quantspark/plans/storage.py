"""Registered queries: writes by key, high-watermarks, key checks, text scores, with the SQL that states each result."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.windows import by, change
from ..operators import quality as Q
from ..operators import sentiment as S
from ..operators import signals as G
from ..operators import textscore as X
from ..sources import feeds, store
from ..sources import market as M
from .modelling import SIGNALS, _signals
from .technical import BARS, changed, r6

QUERIES, SQL = {}, {}


def register(name: str, sql: str | None = None):
    def keep(query):
        QUERIES[name] = query
        if sql:
            SQL[name] = sql
        return query

    return keep


@register(
    "upsert_by_key",
    """WITH new AS (SELECT c_custkey, c_acctbal * 2 AS c_acctbal FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey + 1000000, 1.5 FROM customer WHERE c_custkey % 5 = 0)
SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM new) UNION ALL SELECT c_custkey, NULL, c_acctbal FROM new""",
)
def upsert_by_key(spark, sf_dir):
    stored = M.table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    changed_ = stored.filter("c_custkey % 3 = 0").select("c_custkey", (F.col("c_acctbal") * 2).alias("c_acctbal"))
    added = stored.filter("c_custkey % 5 = 0").select((F.col("c_custkey") + 1000000).alias("c_custkey"), F.lit(1.5).alias("c_acctbal"))
    return store.replaced(stored, changed_.unionByName(added), ["c_custkey"])


@register(
    "insert_or_ignore",
    """SELECT DISTINCT o_custkey AS c_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 20)""",
)
def insert_or_ignore(spark, sf_dir):
    stored = M.table(spark, sf_dir, "customer").filter("c_nationkey < 20").select("c_custkey")
    return store.only_new(M.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), stored, ["c_custkey"])


@register("orphans", "SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 2)")
def orphans(spark, sf_dir):
    parents = M.table(spark, sf_dir, "nation").filter("n_regionkey <> 2")
    return store.orphans(M.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), parents, "c_nationkey", "n_nationkey").select("c_custkey", "c_nationkey")


AT = "2001-11-06"


@register(
    "high_watermark",
    f"""WITH {BARS}, l AS (SELECT n_nationkey::BIGINT AS stock_id, max(date) AS last FROM nation LEFT JOIN bars ON stock_id = n_nationkey GROUP BY 1)
SELECT stock_id, CASE WHEN last IS NULL THEN DATE '{AT}' - INTERVAL 60 MONTH ELSE last + 1 END::DATE AS fetch_from FROM l WHERE last IS NULL OR DATE '{AT}' - last > 1""",
)
def high_watermark(spark, sf_dir):
    return feeds.missing_ranges(M.stocks(spark, sf_dir).select("stock_id"), M.bars(spark, sf_dir), AT)


@register(
    "percentile_of_score",
    f"""WITH {BARS}, r AS (SELECT stock_id, date, {changed('close', 1)} AS r FROM bars), s AS (SELECT stock_id, arg_max(r, date) AS s FROM r GROUP BY 1)
SELECT stock_id, {r6('(avg((r < s)::INT) + avg((r <= s)::INT)) / 2 * 100')} AS percentile FROM r JOIN s USING (stock_id) GROUP BY stock_id""",
)
def percentile_of_score(spark, sf_dir):
    rows = M.bars(spark, sf_dir).select("stock_id", "date", change("close", by("stock_id"), 1).alias("r"))
    last = rows.groupBy("stock_id").agg(F.max_by("r", "date").alias("s"))
    return Q.percentile_of_score(rows.join(last, "stock_id"), "stock_id", "r", "s").select("stock_id", F.round("percentile", 6).alias("percentile"))


@register(
    "score_action",
    f"""{SIGNALS}, a AS (SELECT *, (p2 + p3) * 50 + er * 100 / 25 * 30 + top * 20 AS sc FROM s)
SELECT ticker, date, {r6('sc')} AS score, CASE WHEN sc >= 75 AND top >= 0.6::DOUBLE THEN 'strong_buy' WHEN sc >= 60 AND top >= 0.5 THEN 'buy' WHEN sc <= 25 AND top >= 0.6::DOUBLE THEN 'sell'
WHEN sc >= 45 THEN 'watch' ELSE 'hold' END AS action FROM a""",
)
def score_action(spark, sf_dir):
    return G.score_and_action(_signals(spark, sf_dir)).select("ticker", "date", F.round("score", 6).alias("score"), "action")


_MAP = "MAP {" + ", ".join(f"'{w}': {v}::DOUBLE" for w, v in S.LEXICON.items()) + "}"


@register(
    "compound_score",
    f"""WITH w AS (SELECT conv_id, turn, list_sum(list_transform(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: coalesce(({_MAP})[x], 0))) AS s FROM conversations)
SELECT conv_id, turn, {r6('s / sqrt(s * s + 15)')} AS compound FROM w""",
)
def compound_score(spark, sf_dir):
    return M.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.round(S.compound_score(F.col("text")), 6).alias("compound"))


def _values(pairs) -> str:
    return ", ".join(f"('{w.replace(chr(39), chr(39) * 2)}', {v}::DOUBLE)" for w, v in pairs)


def _rule(k: int, before: str) -> str:
    """The worth after the rules about the k-th word before, in terms of the worth ``before`` them."""
    caps = f"CASE WHEN mixed AND regexp_matches(p{k}, '{X.CAPS}') THEN sign(valence) * {X.CAPITALS}::DOUBLE ELSE 0 END"
    boost = f"CASE WHEN b{k}.worth IS NULL THEN 0 ELSE b{k}.worth * sign(valence) + {caps} END"
    return f"({before} + {boost} * {X.BY_DISTANCE[k - 1]}::DOUBLE) * CASE WHEN n{k}.word IS NOT NULL THEN {X.NEGATE}::DOUBLE ELSE 1 END"


_WORTH = f"valence + CASE WHEN mixed AND regexp_matches(y.word, '{X.CAPS}') THEN sign(valence) * {X.CAPITALS}::DOUBLE ELSE 0 END"
for _k in (1, 2, 3):
    _WORTH = _rule(_k, f"({_WORTH})")


@register(
    "text_scores",
    f"""WITH lex(lower, valence) AS (VALUES {_values(X.LEXICON.items())}), boosters(word, worth) AS (VALUES {_values(X.BOOSTERS.items())}),
negations(word) AS (VALUES {', '.join("('" + w.replace("'", "''") + "')" for w in X.NEGATIONS)}),
t AS (SELECT row_number() OVER () AS id, conv_id, turn, coalesce(text, '') AS text FROM conversations),
w0 AS (SELECT id, list_filter(list_transform(regexp_split_to_array(text, '{X.SPACE}'), lambda x: regexp_replace(x, '{X.EDGES.replace("'", "''")}', '', 'g')), lambda x: x <> '') AS w FROM t),
w1 AS (SELECT id, w, coalesce(list_position(list_transform(w, lambda x: lower(x)), 'but'), 0) AS but, len(list_filter(w, lambda x: NOT regexp_matches(x, '{X.CAPS}'))) > 0 AS mixed FROM w0),
x AS (SELECT id, but, mixed, w, unnest(w) AS word, generate_subscripts(w, 1) AS place FROM w1),
y AS (SELECT x.*, valence, coalesce(w[nullif(place - 1, 0)], '') AS p1, CASE WHEN place > 2 THEN w[place - 2] ELSE '' END AS p2, CASE WHEN place > 3 THEN w[place - 3] ELSE '' END AS p3 FROM x JOIN lex ON lex.lower = lower(word)),
z AS (SELECT id, ({_WORTH}) * CASE WHEN but > 0 AND place < but THEN {X.BEFORE_BUT}::DOUBLE WHEN but > 0 AND place > but THEN {X.AFTER_BUT}::DOUBLE ELSE 1 END AS worth FROM y
  {' '.join(f"LEFT JOIN boosters b{k} ON b{k}.word = lower(p{k}) LEFT JOIN negations n{k} ON n{k}.word = lower(p{k})" for k in (1, 2, 3))}),
s0 AS (SELECT id, sum(worth) AS s FROM z GROUP BY id),
m AS (SELECT *, len(text) - len(replace(text, '!', '')) AS e, len(text) - len(replace(text, '?', '')) AS q FROM t),
s AS (SELECT conv_id, turn, s + sign(s) * (least({X.MOST_EXCLAIM}, e) * {X.EXCLAIM}::DOUBLE + CASE WHEN q > 3 THEN {X.MOST_QUESTION}::DOUBLE WHEN q > 1 THEN q * {X.QUESTION}::DOUBLE ELSE 0 END) AS s FROM m LEFT JOIN s0 USING (id))
SELECT conv_id, turn, {r6(f'coalesce(s / sqrt(s * s + {X.NORMAL}::DOUBLE), 0)')} AS compound FROM s""",
)
def text_scores(spark, sf_dir):
    rows = M.table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return X.score_texts(rows, F.col("text")).select("conv_id", "turn", F.round("compound", 6).alias("compound"))


# --- facts by period and filing day: a first filing after 45 days, restated after 120 ---------


def _facts(spark, sf_dir):
    orders = M.table(spark, sf_dir, "orders").join(M.table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    end = F.date_sub(F.add_months(F.date_trunc("quarter", "o_orderdate"), 3).cast("date"), 1)
    price = F.col("o_totalprice").cast("decimal(18,2)")
    sums = orders.groupBy(F.col("c_nationkey").cast("long").alias("stock_id"), end.alias("period_end")).agg(F.sum(F.when(F.col("o_orderstatus") == "F", price)).cast("double").alias("first"), F.sum(price).cast("double").alias("restated"))
    filings = F.array(F.struct(F.date_add("period_end", 45).alias("filed"), F.col("first").alias("value")), F.struct(F.date_add("period_end", 120).alias("filed"), F.col("restated").alias("value")))
    return sums.select("stock_id", "period_end", F.explode(filings).alias("f")).select("stock_id", F.lit("Revenues").alias("tag"), "period_end", "f.filed", "f.value").filter("value is not null")


@register(
    "facts_known",
    """WITH q AS (SELECT c_nationkey::BIGINT AS stock_id, (date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY)::DATE AS period_end,
  (sum(o_totalprice::DECIMAL(18,2)) FILTER (WHERE o_orderstatus = 'F'))::DOUBLE AS first, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS restated FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
facts AS (SELECT stock_id, period_end, period_end + 45 AS filed, first AS value FROM q WHERE first IS NOT NULL UNION ALL SELECT stock_id, period_end, period_end + 120, restated FROM q),
spine AS (SELECT DISTINCT c_nationkey::BIGINT AS stock_id, (date_trunc('month', o_orderdate))::DATE AS as_of FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT s.stock_id, s.as_of, 'Revenues' AS tag, period_end, filed, value FROM spine s LEFT JOIN facts f ON f.stock_id = s.stock_id AND f.filed <= s.as_of
QUALIFY row_number() OVER (PARTITION BY s.stock_id, s.as_of ORDER BY period_end DESC NULLS LAST, filed DESC) = 1""",
)
def facts_known(spark, sf_dir):
    orders = M.table(spark, sf_dir, "orders").join(M.table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    spine = orders.select(F.col("c_nationkey").cast("long").alias("stock_id"), F.trunc("o_orderdate", "month").alias("as_of")).distinct()
    return feeds.facts_known(spine, _facts(spark, sf_dir), ["Revenues"])
