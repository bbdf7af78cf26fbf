"""The queries of the training-data operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontamination, html, language, licenses, linededup, neardup, negatives, packing, quality, topk, toxicity, variants


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_predictions(_table(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_table(spark, sf_dir, "pages"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_verdicts(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(_table(spark, sf_dir, "documents"))


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_grades(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_report(_table(spark, sf_dir, "documents"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_report(_table(spark, sf_dir, "documents"), linededup.EVERY_LINE)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(_table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(_table(spark, sf_dir, "embeddings"))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_best_fit_packing, op3_html_extraction, op4_quality_rules, op5_bpe_round_trip, op6_exact_top_k, op7_toxicity, op8_license_scan, op9_near_duplicates, op10_line_dedup, op11_spelling_variants, op12_hard_negatives, op13_decontamination)}


_OP6 = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
 WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.v, b.v)::BIGINT AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20"""

_OP9 = """WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(0, len(w) - 4), lambda i: array_to_string(w[i + 1 : i + 5], ' '))) END AS sh FROM w),
n AS (SELECT doc_id, len(sh) AS n FROM s), e AS (SELECT doc_id, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS c FROM n UNION SELECT r.doc_id, u.b FROM r JOIN u ON u.a = r.c)
SELECT n.doc_id, n.n AS n_shingles, min(c) AS component_id, n.doc_id = min(c) AS kept FROM n JOIN r USING (doc_id) GROUP BY n.doc_id, n.n"""


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# crc32 bit by bit over the bytes of the key; near words are those that share what is left when one letter is deleted
_OP11 = f"""WITH RECURSIVE t(n, c) AS (SELECT i, list_reduce(list_prepend(i::UBIGINT, range(8)::UBIGINT[]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384::UBIGINT, c >> 1) ELSE c >> 1 END) FROM range(256) r(i)),
tab AS (SELECT list(c ORDER BY n) AS tab FROM t),
r AS (SELECT doc_id, w, count(*) AS k FROM (SELECT doc_id, unnest(regexp_extract_all({_LOW}, '[a-z\u00C0-\u00FF]+')) AS w FROM documents) GROUP BY doc_id, w HAVING length(w) >= 5),
h AS (SELECT w, k, xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(0, length(b) // 2), lambda i: ('0x' || substring(b, 2 * i + 1, 2))::UBIGINT)), lambda c, x: xor(tab[((xor(c, x) & 255) + 1)::BIGINT], c >> 8))) AS h
 FROM (SELECT *, hex(coalesce(doc_id::VARCHAR, '') || ':' || w) AS b FROM r), tab),
v AS (SELECT w AS word, sum(k)::BIGINT AS n FROM (SELECT CASE WHEN h % 97 = 0 THEN left(w, (h % length(w))::BIGINT) || substring(w, (h % length(w))::BIGINT + 2) ELSE w END AS w, k FROM h) GROUP BY w HAVING length(w) >= 5 AND sum(k) >= 3),
d AS (SELECT word, n, i, left(word, i) || substring(word, i + 2) AS rest FROM v, unnest(range(0, length(word))) u(i)),
p AS (SELECT a.word AS a, b.word AS b, b.n AS n FROM d a JOIN d b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
 UNION SELECT d.word, v.word, v.n FROM d JOIN v ON d.rest = v.word UNION SELECT v.word, d.word, d.n FROM d JOIN v ON d.rest = v.word),
f AS (SELECT a, count(*) AS n_near, min({{'m': -n, 'b': b}}) AS best FROM p GROUP BY a),
g AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.m >= 2 * n THEN best.b END AS form, CASE WHEN -best.m >= 2 * n THEN -best.m END AS form_n FROM v LEFT JOIN f ON a = word),
s AS (SELECT word, word AS root, form FROM g UNION ALL SELECT s.word, g.word, g.form FROM s JOIN g ON g.word = s.form)
SELECT g.word, g.n, g.n_near, g.form, g.form_n, s.root FROM g JOIN s ON s.word = g.word AND s.form IS NULL"""

_OP12 = """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
 WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5),
n AS (SELECT p.a, p.b AS p, p.score AS ps, s.b AS n, s.score AS ns, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS rank FROM p JOIN s ON s.a = p.a AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT a AS anchor_id, p AS positive_id, rank::INTEGER AS rank, n AS negative_id, ps AS positive_score, ns AS negative_score FROM n WHERE rank <= 10"""

_WORDS = f"list_filter(string_split_regex({_LOW}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
_OP13 = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
i AS (SELECT item_id, l, array_to_string(w[k + 1 : k + l], ' ') AS t FROM (SELECT item_id, w, least(10, len(w)) AS l, unnest(range(0, len(w) - least(10, len(w)) + 1)) AS k FROM b WHERE len(w) > 0)),
x AS (SELECT r, l, k, array_to_string(w[k + 1 : k + l], ' ') AS t FROM (SELECT r, w, l, unnest(range(0, len(w) - l + 1)) AS k FROM d, (SELECT DISTINCT l FROM i))),
h AS (SELECT x.r, x.k, x.l, i.item_id FROM x JOIN i ON i.l = x.l AND i.t = x.t),
c AS (SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT r, unnest(range(k, k + l)) AS pos FROM h) GROUP BY r),
m AS (SELECT r, count(*) AS n_items, sha256(string_agg(id, ',' ORDER BY id)) AS items FROM (SELECT DISTINCT r, item_id::VARCHAR AS id FROM h WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN c USING (r) LEFT JOIN m USING (r)"""


def oracle_sql() -> dict[str, str]:
    """SQL for the results that SQL can say; the others are tested against brute force."""
    return {"op6_exact_top_k": _OP6, "op9_near_duplicates": _OP9, "op11_spelling_variants": _OP11, "op12_hard_negatives": _OP12, "op13_decontamination": _OP13}
