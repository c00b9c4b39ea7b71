"""The registered queries of this package: each operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table
from .exact_dedup import exact_dedup
from .fill_middle import fill_in_middle, restore_text
from .fingerprints import fingerprints_under_edit
from .html_text import extract_html
from .language_id import identify_language
from .language_model import score_language
from .mixing import mix_sources
from .near_dedup import near_duplicates
from .packing import pack_documents
from .quality import classify_quality
from .records import read_token_records, write_token_records
from .sharding import shard_documents
from .spelling import LOWER, UPPER, spelling_variants
from .tokenizing import vocabulary

BYTE_VOCABULARY = "byte_bpe_50k.json"
WORD_VOCABULARY = "word_bpe_49k.json"


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read_table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op4_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_token_records(read_table(spark, sf_dir, "documents"), vocabulary(BYTE_VOCABULARY), end_id=2)
    return read_token_records(manifest, with_ids=False)


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints_under_edit(read_table(spark, sf_dir, "documents"))


def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_language(read_table(spark, sf_dir, "documents"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), similarity=0.8, shingle_words=5)


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_html(read_table(spark, sf_dir, "pages"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"), vocabulary(WORD_VOCABULARY), capacity=2048, end_id=1)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(read_table(spark, sf_dir, "documents"), shards=40)


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(read_table(spark, sf_dir, "documents"), least_length=5, least_count=3, ratio=2.0, slip_every=97)


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(read_table(spark, sf_dir, "documents"), seed=1, plain_percent=10, spm_percent=20)
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    restored = restore_text(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored).alias("restored_sha256"))


def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_language(read_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_quality": op3_quality,
    "op4_token_records": op4_token_records,
    "op5_fingerprints": op5_fingerprints,
    "op6_language_model": op6_language_model,
    "op7_near_dedup": op7_near_dedup,
    "op8_html_text": op8_html_text,
    "op9_packing": op9_packing,
    "op10_sharding": op10_sharding,
    "op11_spelling": op11_spelling,
    "op12_fill_middle": op12_fill_middle,
    "op13_language": op13_language,
}

def _crc_table() -> str:
    """The 256 remainders of CRC-32 as a SQL list."""
    table = []
    for code in range(256):
        for _ in range(8):
            code = (code >> 1) ^ (0xEDB88320 if code & 1 else 0)
        table.append(code)
    return f"{table}::BIGINT[]"


_UTF8 = "flatten(list_transform(string_split({}, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [192 + unicode(c) // 64, 128 + unicode(c) % 64] END))"
_CRC32 = f"xor(list_reduce(list_concat([4294967295::BIGINT], {_UTF8}), lambda c, b: xor(c >> 8, ({_crc_table()})[xor(c & 255, b) + 1])), 4294967295::BIGINT)"
_DRAW = "('0x' || substr(sha256('1:' || doc_id), {}, 8))::BIGINT"

ORACLE_SQL = {
    "op1_mixing": """
WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         substr(md5('17:' || coalesce(doc_id::VARCHAR, '')), 1, 15) AS k
  FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source),
named AS (
  SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT + 1]::DOUBLE AS weight,
         source_size * 2.0::DOUBLE AS cap FROM sizes),
sums AS (
  SELECT *, sum(source_size) OVER () AS all_words, sum(weight) OVER () AS weight_all,
         coalesce(sum(cap) OVER w, 0) AS cap_before, coalesce(sum(weight) OVER w, 0) AS weight_before
  FROM named WINDOW w AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levels AS (SELECT *, (1.5 * all_words - cap_before) / (weight_all - weight_before) AS lev FROM sums),
filled AS (SELECT *, cap <= lev * weight AS is_full FROM levels),
targets AS (
  SELECT source, source_size, CASE WHEN is_full THEN cap ELSE weight * max(CASE WHEN NOT is_full THEN lev END) OVER () END AS target
  FROM filled),
budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM targets),
placed AS (
  SELECT d.doc_id, d.size, b.source_size, b.target, b.epochs,
         floor(b.target - b.epochs * b.source_size + 0.5)::BIGINT AS rest,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM docs d JOIN budgets b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, rest - before)))::BIGINT AS taken FROM placed
""",
    "op2_exact_dedup": """
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS norm FROM documents),
c AS (SELECT norm, min(doc_id) AS keep_id, count(*)::BIGINT AS group_size FROM t GROUP BY norm)
SELECT t.doc_id, c.keep_id, c.group_size,
       t.doc_id IS NOT DISTINCT FROM c.keep_id
         AND row_number() OVER (PARTITION BY t.norm, t.doc_id ORDER BY t.doc_id) = 1 AS kept,
       sha256(t.norm) AS text_sha256
FROM t JOIN c USING (norm)
""",
    "op11_spelling": f"""
WITH RECURSIVE runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[a-zÀ-ÿ]+')) AS run FROM documents),
each_run AS (SELECT doc_id, run, count(*) AS times FROM runs GROUP BY ALL),
coded AS (SELECT run, times, {_CRC32.format("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM each_run),
slipped AS (
  SELECT CASE WHEN h % 97 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, times FROM coded),
words AS MATERIALIZED (SELECT word, sum(times)::BIGINT AS n FROM slipped WHERE length(word) >= 5 GROUP BY word HAVING sum(times) >= 3),
keys AS MATERIALIZED (
  SELECT word, n, unnest(list_distinct(list_concat([word], list_transform(range(1, length(word) + 1), lambda i: word[:i - 1] || word[i + 1:])))) AS key FROM words),
pairs AS (SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM keys a JOIN keys b ON a.key = b.key AND a.word <> b.word 
  WHERE length(a.word) <> length(b.word) OR len(list_filter(range(1, length(a.word) + 1), lambda i: a.word[i] <> b.word[i])) = 1),
near AS (SELECT word, n, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS form, max(other_n) AS form_n FROM pairs GROUP BY ALL),
forms AS MATERIALIZED (
  SELECT word, words.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN form_n >= 2 * words.n THEN form END AS form, CASE WHEN form_n >= 2 * words.n THEN form_n END AS form_n
  FROM words LEFT JOIN near USING (word)),
way AS (
  SELECT word, word AS reached, form AS next FROM forms
  UNION ALL SELECT way.word, forms.word, forms.form FROM way JOIN forms ON forms.word = way.next)
SELECT word, form, reached AS root, n, n_near, form_n FROM forms JOIN (FROM way WHERE next IS NULL) USING (word)
""",
    "op12_fill_middle": f"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
         {_DRAW.format(1)} AS h1, {_DRAW.format(9)} AS h2, {_DRAW.format(17)} AS h3, {_DRAW.format(25)} AS h4 FROM documents),
cut AS (SELECT *, len(u)::BIGINT AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b FROM units),
parts AS (
  SELECT doc_id, text, n, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256 FROM parts
""",
}
