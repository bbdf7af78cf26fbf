"""Named queries over the given tables, each with the SQL of its result where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import signals as S
from ..functions import text as X
from ..operators import answering, asking, dense, diagnostics, fusion, graph, learning, lexical, metrics, packed, resident, routing
from ..streaming.router import route_counts
from .views import SQL, corpus, edges, questions, table, user_turns

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def q(pattern: str) -> str:
    """A pattern or text as an SQL literal."""
    return "'" + pattern.replace("'", "''") + "'"


def _any(column: str, terms: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({column}, {q(t)})" for t in terms) + ")"


def _starts(column: str, terms: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"starts_with({column}, {q(t)})" for t in terms) + ")"


def _match(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, {q(pattern)})"


# -- SQL building blocks ----------------------------------------------------------------

_LOW = "lower(question)"
_FEATURES = f"""feat AS (SELECT *, lexical0 AS lexical, (semantic0 OR NOT (lexical0 OR deductive0 OR relational0)) AS semantic, deductive0 AS deductive, relational0 AS relational FROM (
 SELECT *, {_match(_LOW, S.marker_pattern(S.LEXICAL))} OR {_match(_LOW, S.IDENTIFIER)} AS lexical0, {_match(_LOW, S.marker_pattern(S.SEMANTIC))} AS semantic0,
 {_match(_LOW, S.marker_pattern(S.DEDUCTIVE))} OR {_match(_LOW, S.MEMBERSHIP)} AS deductive0, {_match(_LOW, S.marker_pattern(S.RELATIONAL))} AS relational0 FROM asked))"""
_ALL = "asked AS (SELECT qid, question FROM questions UNION ALL SELECT qid + 1000000000, question FROM user_turns)"
_BENCH = "asked AS (SELECT * FROM questions)"
_PENALTY = """scored AS (SELECT *, round(1.0 - CASE WHEN lexical THEN 0.6 ELSE 0 END, 6)::DOUBLE AS score_bm25,
 round(1.0 + CASE WHEN lexical THEN 0.2 ELSE 0 END - CASE WHEN semantic THEN 0.5 ELSE 0 END, 6)::DOUBLE AS score_dense,
 round(1.0 - CASE WHEN deductive THEN 0.6 ELSE 0 END - CASE WHEN relational THEN 0.2 ELSE 0 END, 6)::DOUBLE AS score_kg,
 round(1.0 - CASE WHEN relational THEN 0.7 ELSE 0 END, 6)::DOUBLE AS score_hybrid FROM feat),
routed AS (SELECT *, CASE least(score_bm25, score_dense, score_kg, score_hybrid) WHEN score_bm25 THEN 'bm25' WHEN score_dense THEN 'dense' WHEN score_kg THEN 'kg' ELSE 'hybrid' END AS route,
 round(list_sort([score_bm25, score_dense, score_kg, score_hybrid])[2] - list_sort([score_bm25, score_dense, score_kg, score_hybrid])[1], 6) AS margin FROM scored)"""
_KEYWORD = f"""kw0 AS (SELECT *, ({_match(_LOW, S.IDENTIFIER)} OR {_any(_LOW, S.KEYWORD_LEXICAL)}) AS on_b, {_any(_LOW, S.KEYWORD_RELATIONAL)} AS on_h, {_any(_LOW, S.KEYWORD_DEDUCTIVE)} AS on_k, {_any(_LOW, S.KEYWORD_SEMANTIC)} AS on_d FROM routed),
kw1 AS (SELECT *, CASE WHEN on_b THEN 3.0 ELSE 0.0 END AS rb, CASE WHEN NOT (on_b OR on_h OR on_k OR on_d) THEN 1.0 ELSE greatest(0.0, CASE WHEN on_d THEN 2.4 ELSE 0.0 END - CASE WHEN on_b AND NOT on_h THEN 0.8 ELSE 0.0 END) END AS rd,
 greatest(0.0, CASE WHEN on_k THEN 2.6 ELSE 0.0 END - CASE WHEN on_h THEN 0.8 ELSE 0.0 END) AS rk, CASE WHEN on_h THEN 3.0 ELSE 0.0 END AS rh FROM kw0),
kw AS (SELECT *, CASE greatest(rb, rd, rk, rh) WHEN rb THEN 'bm25' WHEN rd THEN 'dense' WHEN rk THEN 'kg' ELSE 'hybrid' END AS keyword_route,
 round(rb::DOUBLE / (rb + rd + rk + rh)::DOUBLE, 6) AS keyword_bm25, round(rd::DOUBLE / (rb + rd + rk + rh)::DOUBLE, 6) AS keyword_dense, round(rk::DOUBLE / (rb + rd + rk + rh)::DOUBLE, 6) AS keyword_kg, round(rh::DOUBLE / (rb + rd + rk + rh)::DOUBLE, 6) AS keyword_hybrid FROM kw1)"""
_STRONG = f"({_any(_LOW, S.V2_STRONG)} OR {_match(_LOW, S.STRONG_PATTERN)})"
_V2 = f"""v2 AS (SELECT *, CASE WHEN rule_v2 = 'relational' THEN 'hybrid' WHEN rule_v2 = 'deductive' THEN 'kg' WHEN rule_v2 IN ('ambiguous_identifier', 'low_margin') THEN 'dense' WHEN rule_v2 IN ('strong_identifier', 'source_prior') THEN 'bm25' ELSE route END AS route_v2 FROM (
 SELECT *, CASE WHEN {_any(_LOW, S.V2_RELATIONAL)} THEN 'relational' WHEN {_any(_LOW, S.V2_DEDUCTIVE)} AND NOT {_STRONG} THEN 'deductive' WHEN {_match(_LOW, S.IDENTIFIER)} AND {_any(_LOW, S.V2_AMBIGUOUS)} AND NOT {_STRONG} THEN 'ambiguous_identifier'
 WHEN {_match(_LOW, S.IDENTIFIER)} AND {_STRONG} THEN 'strong_identifier' WHEN margin < 0.15 AND semantic AND NOT lexical THEN 'low_margin' ELSE 'none' END AS rule_v2 FROM kw))"""
_CALIBRATED = f"""sig AS (SELECT *, {_match(_LOW, S.IDENTIFIER)} AS identifier_heavy, {_any(_LOW, S.CAL_SEMANTIC)} AS semantic_cue, {_any(_LOW, S.CAL_MISLEADING)} AS misleading_exact_cue, {_any(_LOW, S.CAL_RELATIONAL)} AS relational_cue,
 ({_any(_LOW, S.CAL_DEDUCTIVE)} OR {_starts(_LOW, S.CAL_DEDUCTIVE_STARTS)}) AS deductive_cue, {_any(_LOW, S.CAL_NO_GRAPH)} AS explicit_kg_negation FROM routed),
cal AS (SELECT *, CASE WHEN relational_cue AND route <> 'hybrid' THEN 'hybrid' WHEN deductive_cue AND NOT explicit_kg_negation AND route <> 'kg' THEN 'kg' WHEN route = 'bm25' AND semantic_cue AND misleading_exact_cue AND NOT (identifier_heavy AND NOT semantic_cue AND NOT relational_cue AND NOT deductive_cue) THEN 'dense'
 WHEN route = 'kg' AND explicit_kg_negation AND identifier_heavy THEN 'bm25' ELSE route END AS calibrated_route,
 CASE WHEN (relational_cue AND route <> 'hybrid') OR (deductive_cue AND NOT explicit_kg_negation AND route <> 'kg') THEN 'structural' WHEN route = 'bm25' AND semantic_cue AND misleading_exact_cue AND NOT (identifier_heavy AND NOT semantic_cue AND NOT relational_cue AND NOT deductive_cue) THEN 'semantic_bait'
 WHEN route = 'kg' AND explicit_kg_negation AND identifier_heavy THEN 'kg_suppression' ELSE 'none' END AS override FROM sig)"""


def _with(*names: str) -> str:
    return "WITH " + ", ".join(names) + " "


_ROUTED = _with(SQL["questions"], _BENCH, _FEATURES, _PENALTY)[:-1]
_SIMPLE = "regexp_extract_all(lower({}), '[a-z0-9]+')"
_LEX = (
    "flatten(list_transform(list_zip(raw, list_concat(raw[2:], [NULL])), lambda z: list_filter([z[1],"
    " CASE WHEN contains(z[1], '-') THEN replace(z[1], '-', '') END,"
    " CASE WHEN contains(z[1], '.') AND regexp_matches(replace(z[1], '.', ''), '[^0-9]') THEN replace(z[1], '.', '_') END,"
    " CASE WHEN z[1] = 'rfc' AND regexp_matches(z[2], '^[0-9]+$') THEN 'rfc-' || z[2] END,"
    " CASE WHEN z[1] = 'section' THEN z[2] END], lambda t: t IS NOT NULL)))"
)
_RAW = "regexp_extract_all(replace(lower({}), '§ ', '§'), " + q(X.TOKEN) + ")"
_LEX_DOCS = f"dtok AS (SELECT doc_id, {_LEX} AS tokens FROM (SELECT doc_id, {_RAW.format(chr(34) + 'full' + chr(34))} AS raw FROM (SELECT doc_id, concat_ws(' ', title, text) AS \"full\" FROM corpus)))"
_LEX_QS = f"qtok AS (SELECT qid, {_LEX} AS tokens FROM (SELECT qid, {_RAW.format('question')} AS raw FROM questions))"
_SIMPLE_DOCS = f"dtok AS (SELECT doc_id, {_SIMPLE.format('text')} AS tokens FROM corpus)"
_SIMPLE_QS = f"qtok AS (SELECT qid, {_SIMPLE.format('question')} AS tokens FROM questions)"
_TF = """dtf AS (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest(tokens) AS token FROM dtok) GROUP BY ALL),
qtf AS (SELECT qid, token, count(*) AS qtf FROM (SELECT qid, unnest(tokens) AS token FROM qtok) GROUP BY ALL)"""
_BM25 = f"""stats AS (SELECT count(*) AS n, avg(len(tokens)) AS avgdl FROM dtok), dl AS (SELECT doc_id, len(tokens) AS dl FROM dtok), df AS (SELECT token, count(*) AS df FROM dtf GROUP BY token),
bm AS (SELECT qid, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * {lexical.K1 + 1} / (tf + {lexical.K1} * (1 - {lexical.B} + {lexical.B} * dl / avgdl)) * qtf), 4) AS score
 FROM qtf JOIN dtf USING (token) JOIN df USING (token) JOIN dl USING (doc_id), stats GROUP BY qid, doc_id)"""
_SHARED = f"""shared AS (SELECT qid, doc_id, sum(least(tf, qtf)) AS common, count(*) AS shared, sum(CASE WHEN regexp_matches(token, {q(X.IDENTIFIER_TOKEN)}) THEN 1 ELSE 0 END) AS ids FROM qtf JOIN dtf USING (token) GROUP BY qid, doc_id)"""


def _top(source: str, k: int, item: str = "doc_id", order: str = "DESC") -> str:
    return f"SELECT qid, {item}, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, {item} {order}) AS rank FROM {source}) WHERE rank <= {k}"


# -- text -------------------------------------------------------------------------------


@query(f"SELECT doc_id, len(t) AS n_tokens, array_to_string(t, ' ') AS tokens FROM (SELECT doc_id, {_SIMPLE.format('text')} AS t FROM documents)")
def tokenize_simple(spark, d):
    return corpus(spark, d).select("doc_id", X.simple_tokens(F.col("text")).alias("t")).select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.array_join("t", " ").alias("tokens"))


@query(_with(SQL["corpus"], _LEX_DOCS) + "SELECT doc_id, len(tokens) AS n_tokens, array_to_string(tokens, ' ') AS tokens FROM dtok")
def tokenize_identifiers(spark, d):
    t = lexical.tokenized(corpus(spark, d), X.lexical_tokens(F.concat_ws(" ", "title", "text")))
    return t.select("doc_id", F.col("dl").alias("n_tokens"), F.array_join("tokens", " ").alias("tokens"))


@query(_with(SQL["corpus"], _LEX_DOCS) + f"SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(tokens, lambda t: regexp_matches(t, {q(X.IDENTIFIER_TOKEN)})))), ' ') AS identifiers FROM dtok")
def identifier_tokens(spark, d):
    t = lexical.tokenized(corpus(spark, d), X.lexical_tokens(F.concat_ws(" ", "title", "text")))
    return t.select("doc_id", F.array_join(X.identifier_tokens(F.col("tokens")), " ").alias("identifiers"))


@query("""WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w FROM documents),
n AS (SELECT doc_id, w, unnest(range(0, greatest(1, ceil((len(w) - 20) / 60.0)::BIGINT))) AS ordinal FROM w)
SELECT doc_id || '::chunk_' || ordinal AS chunk_id, doc_id, ordinal::INTEGER AS ordinal, array_to_string(w[ordinal * 60 + 1 : ordinal * 60 + 80], ' ') AS chunk FROM n""")
def chunk_words(spark, d):
    return dense.chunks(corpus(spark, d))


@query("SELECT doc_id, len(s) AS n_sentences, list_max(list_transform(s, lambda x: length(x))) AS longest FROM (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.;])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS s FROM documents)")
def sentence_split(spark, d):
    s = corpus(spark, d).select("doc_id", X.sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.array_max(F.transform("s", F.length)).cast("long").alias("longest"))


_DECODE = "text0"
for _name, _char in X.ENTITIES:
    _DECODE = f"replace({_DECODE}, {q(_name)}, {q(_char)})"
_PLAIN = "trim(regexp_replace(" + _DECODE.replace("text0", "regexp_replace(regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g')") + ", '\\s+', ' ', 'g'))"


@query(f"SELECT page_id, text, length(text) AS n_chars FROM (SELECT page_id, {_PLAIN} AS text FROM pages)")
def html_normalize(spark, d):
    t = table(spark, d, "pages").select("page_id", X.plain_text(F.col("html")).alias("text"))
    return t.select("page_id", "text", F.length("text").cast("long").alias("n_chars"))


@query("SELECT page_id, array_to_string(h, '|') AS sections, len(h) AS n FROM (SELECT page_id, list_transform((list_filter(list_transform(string_split(html, chr(10)), lambda x: trim(x)), lambda x: starts_with(x, '#') OR regexp_matches(x, '^[A-Z][A-Za-z0-9 /:-]{3,80}$')))[1:20], lambda x: trim(regexp_replace(x, '^#+', ''))) AS h FROM pages)")
def page_sections(spark, d):
    h = table(spark, d, "pages").select("page_id", X.headings(F.col("html")).alias("h"))
    return h.select("page_id", F.array_join("h", "|").alias("sections"), F.size("h").cast("long").alias("n"))


@query("SELECT doc_id, array_to_string(h, '|') AS sections FROM (SELECT doc_id, (list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: starts_with(x, '#') OR regexp_matches(x, '^[A-Z][A-Za-z0-9 /:-]{3,80}$')))[1:20] AS h0, list_transform(h0, lambda x: trim(regexp_replace(x, '^#+', ''))) AS h FROM documents)")
def document_sections(spark, d):
    return corpus(spark, d).select("doc_id", F.array_join(X.headings(F.col("text")), "|").alias("sections"))


@query("SELECT page_id, list_reduce(list_prepend('', list_transform(string_split(t, ' '), lambda w: upper(w[1]) || lower(w[2:]))), lambda a, b: CASE WHEN a = '' THEN b ELSE a || ' ' || b END) AS title FROM (SELECT page_id, trim(translate(string_split(regexp_replace(url, '[?#].*$|/+$', '', 'g'), '/')[-1], '-_', '  ')) AS t FROM pages)")
def url_title(spark, d):
    return table(spark, d, "pages").select("page_id", X.url_title(F.col("url")).alias("title"))


_IDS = "flatten([" + ", ".join(f"regexp_extract_all(text, {q(f)})" for f in X.IDENTIFIER_FORMS) + "])"
_FORMED = "regexp_replace(trim(x), '\\s+', ' ', 'g')"
for _written, _form in X.NORMAL_FORMS:
    _FORMED = f"regexp_replace({_FORMED}, {q(_written)}, {q(_form.replace('$1', chr(92) + '1'))}, 'g')"
_CANON = f"list_sort(list_distinct(list_transform({_IDS}, lambda x: {_FORMED})))"


@query(f"SELECT doc_id, array_to_string(ids, '|') AS ids FROM (SELECT doc_id, {_CANON} AS ids FROM documents)")
def identifiers(spark, d):
    return corpus(spark, d).select("doc_id", F.array_join(X.identifiers(F.col("text")), "|").alias("ids"))


@query(f"SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(flatten(list_transform(ids, lambda x: [x, lower(x), replace(x, '-', ' '), replace(x, ' ', '-'), string_split(x, ' ')[-1]])), lambda x: x <> ''))), '|') AS aliases FROM (SELECT doc_id, {_CANON} AS ids FROM documents)")
def alias_expansion(spark, d):
    return corpus(spark, d).select("doc_id", F.array_join(X.alias_forms(X.identifiers(F.col("text"))), "|").alias("aliases"))


@query("SELECT doc_id, trim(array_to_string((string_split(regexp_replace(trim(text), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)))[1:3], ' ')[1:420]) AS lead FROM documents")
def lead_summaries(spark, d):
    return corpus(spark, d).select("doc_id", X.lead_summary(F.col("text")).alias("lead"))


@query("SELECT doc_id, CASE WHEN length(text) <= 240 THEN text ELSE text[1:237] || '...' END AS snippet FROM documents")
def answer_snippets(spark, d):
    return corpus(spark, d).select("doc_id", X.snippet(F.col("text")).alias("snippet"))


@query("SELECT doc_id, substr(text, greatest(1, CASE WHEN hit > 0 THEN hit - 90 ELSE 1 END), 320) AS snippet FROM (SELECT *, instr(lower(text), ' the ') AS hit FROM documents)")
def snippets_around(spark, d):
    return corpus(spark, d).select("doc_id", X.snippet_around(F.col("text"), F.lit(" the ")).alias("snippet"))


@query("SELECT page_id, 'oc_' || right(regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 40) || '_' || left(sha1(url || chr(10) || html[1:500]), 12) AS stable_id FROM pages")
def stable_ids(spark, d):
    return table(spark, d, "pages").select("page_id", X.stable_id(F.col("url"), F.col("html")).alias("stable_id"))


@query("SELECT page_id, coalesce(nullif(split_part(url, ':', 1), ''), 'unknown') AS scheme, coalesce(nullif(split_part(url, ':', 3), ''), 'unknown') AS port FROM pages")
def source_parts(spark, d):
    return table(spark, d, "pages").select("page_id", X.source_part(F.col("url"), 0).alias("scheme"), X.source_part(F.col("url"), 2).alias("port"))


@query("SELECT qid, trim(regexp_replace(regexp_replace(lower(question), '[^a-z0-9§._:/ -]+', ' ', 'g'), '\\s+', ' ', 'g')) AS form FROM (" + _with(SQL["user_turns"]) + "SELECT * FROM user_turns)")
def match_forms(spark, d):
    return user_turns(spark, d).select("qid", X.match_form(F.col("question")).alias("form"))


@query(_with(SQL["corpus"]) + "SELECT doc_id, list_aggregate(list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9._§:/-]+'), lambda w: length(w) > 2 AND w NOT IN (" + ", ".join(q(s) for s in X.STOPWORDS) + ")))), 'string_agg', ' ') AS words FROM corpus")
def content_word_sets(spark, d):
    s = corpus(spark, d).select("doc_id", F.array_sort(X.content_words(F.col("text"))).alias("w"))
    return s.select("doc_id", F.when(F.size("w") > 0, F.array_join("w", " ")).alias("words"))


@query("SELECT doc_id, 'Title: ' || source || chr(10) || 'Language: ' || lang || chr(10) || 'Body:' || chr(10) || text AS enriched FROM documents")
def enriched_text(spark, d):
    return corpus(spark, d).select("doc_id", F.concat_ws("\n", F.concat(F.lit("Title: "), "title"), F.concat(F.lit("Language: "), "lang"), F.lit("Body:"), "text").alias("enriched"))


# -- routing ----------------------------------------------------------------------------


def _all_questions(spark, d):
    turns = user_turns(spark, d).withColumn("qid", F.col("qid") + 1000000000)
    return questions(spark, d).select("qid", "question").unionByName(turns)


@query(_with(SQL["questions"], SQL["user_turns"], _ALL, _FEATURES) + "SELECT qid, lexical, semantic, deductive, relational FROM feat")
def query_features(spark, d):
    return routing.with_features(_all_questions(spark, d)).select("qid", "lexical", "semantic", "deductive", "relational")


_P = "SELECT qid, score_bm25, score_dense, score_kg, score_hybrid, route, margin FROM routed"


@query(_with(SQL["questions"], SQL["user_turns"], _ALL, _FEATURES, _PENALTY) + _P)
def route_penalty(spark, d):
    return routing.penalty_routes(_all_questions(spark, d)).select("qid", *(f"score_{b}" for b in routing.BACKENDS), "route", "margin")


@query(_with(SQL["questions"], SQL["user_turns"], _ALL, _FEATURES, _PENALTY, _KEYWORD) + "SELECT qid, keyword_bm25, keyword_dense, keyword_kg, keyword_hybrid, keyword_route FROM kw")
def route_keyword(spark, d):
    return routing.keyword_routes(_all_questions(spark, d)).select("qid", *(f"keyword_{b}" for b in routing.BACKENDS), "keyword_route")


@query(_with(SQL["questions"], SQL["user_turns"], _ALL, _FEATURES, _PENALTY, _KEYWORD, _V2) + "SELECT qid, rule_v2, route_v2 FROM v2")
def route_v2(spark, d):
    return routing.rule_routes_v2(routing.penalty_routes(_all_questions(spark, d))).select("qid", "rule_v2", "route_v2")


_CONF = """conf0 AS (SELECT *, (keyword_route = route)::INTEGER AS agreement, round(margin + 0.15 * (keyword_route = route)::INTEGER, 6) AS confidence_score,
 CASE least(CASE WHEN route = 'bm25' THEN 1e9 ELSE score_bm25 END, CASE WHEN route = 'dense' THEN 1e9 ELSE score_dense END, CASE WHEN route = 'kg' THEN 1e9 ELSE score_kg END, CASE WHEN route = 'hybrid' THEN 1e9 ELSE score_hybrid END)
  WHEN CASE WHEN route = 'bm25' THEN 1e9 ELSE score_bm25 END THEN 'bm25' WHEN CASE WHEN route = 'dense' THEN 1e9 ELSE score_dense END THEN 'dense' WHEN CASE WHEN route = 'kg' THEN 1e9 ELSE score_kg END THEN 'kg' ELSE 'hybrid' END AS runner_up FROM kw),
conf AS (SELECT *, CASE WHEN confidence_score >= 0.65 AND margin >= 0.35 THEN 'high' WHEN confidence_score >= 0.35 OR agreement > 0 THEN 'medium' ELSE 'low' END AS confidence FROM conf0)"""


def _confident(spark, d, source=questions):
    return routing.route_confidence(routing.keyword_routes(routing.penalty_routes(source(spark, d))))


@query(_with(SQL["questions"], SQL["user_turns"], _ALL, _FEATURES, _PENALTY, _KEYWORD, _CONF) + "SELECT qid, runner_up, agreement, confidence_score, confidence FROM conf")
def route_confidence(spark, d):
    return _confident(spark, d, _all_questions).select("qid", "runner_up", "agreement", "confidence_score", "confidence")


@query(_with(SQL["questions"], SQL["user_turns"], _ALL, _FEATURES, _PENALTY, _CALIBRATED) + "SELECT qid, identifier_heavy, semantic_cue, misleading_exact_cue, relational_cue, deductive_cue, explicit_kg_negation, calibrated_route, override FROM cal")
def route_calibrated(spark, d):
    c = routing.calibrated_routes(routing.penalty_routes(_all_questions(spark, d)))
    return c.select("qid", "identifier_heavy", "semantic_cue", "misleading_exact_cue", "relational_cue", "deductive_cue", "explicit_kg_negation", "calibrated_route", "override")


@query(_with(SQL["questions"], _BENCH, _FEATURES, _PENALTY, _KEYWORD, _V2) + "SELECT qid, len(list_distinct([route, keyword_route, route_v2]))::INTEGER AS n_routes, (margin < 0.25 OR len(list_distinct([route, keyword_route, route_v2])) > 1) AS ambiguous FROM v2")
def router_agreement(spark, d):
    r = routing.rule_routes_v2(routing.keyword_routes(routing.penalty_routes(questions(spark, d))))
    return routing.route_votes(r, ("route", "keyword_route", "route_v2")).select("qid", "n_routes", "ambiguous")


@query(_with(SQL["questions"], SQL["user_turns"], _ALL, _FEATURES, _PENALTY.replace("scored AS", "scored_ AS").replace("FROM scored)", "FROM scored_)").replace("routed AS", "before AS")) + """,
active AS (SELECT qid, route AS route_before, margin AS margin_before, unnest(list_filter([CASE WHEN lexical THEN 'lexical' END, CASE WHEN semantic THEN 'semantic' END, CASE WHEN deductive THEN 'deductive' END, CASE WHEN relational THEN 'relational' END], lambda x: x IS NOT NULL)) AS feature, lexical, semantic, deductive, relational FROM before),
cut AS (SELECT qid, route_before, margin_before, feature, lexical AND feature <> 'lexical' AS lexical, semantic AND feature <> 'semantic' AS semantic, deductive AND feature <> 'deductive' AS deductive, relational AND feature <> 'relational' AS relational FROM active), """.lstrip() + _PENALTY.replace("FROM feat", "FROM cut") + " SELECT qid, feature, route_before, route AS route_after, margin_before, margin AS margin_after, route_before <> route AS changed FROM routed")
def route_feature_ablation(spark, d):
    return routing.feature_ablation(_all_questions(spark, d), "qid")


@query(_with(SQL["user_turns"]) + ", ".join([]) + f"""SELECT qid, array_to_string(list_sort(list_distinct(flatten(list_transform(flatten([{', '.join(f"regexp_extract_all(lower(question), {q(m + chr(92) + 's+([^,?.;:]+)')}, 1)" for m in S.NEGATIONS)}]), lambda s: (list_sort(list_distinct(list_filter(regexp_extract_all(s, '[a-z0-9._§:/-]+'), lambda w: length(w) > 2 AND w NOT IN ({', '.join(q(s) for s in X.STOPWORDS)})))))[1:6])))), ' ') AS negated FROM user_turns""")
def negated_terms(spark, d):
    return user_turns(spark, d).select("qid", F.array_join(S.negated_words(F.col("question")), " ").alias("negated"))


_LIN_NAMES = ("lexical", "semantic", "deductive", "relational", "bias")
# A fixed model in place of a fitted one: the penalties' deltas with their sign turned.
_LIN_WEIGHTS = (("bm25", "lexical", 0.6), ("bm25", "bias", -1.0), ("dense", "lexical", -0.2), ("dense", "semantic", 0.5), ("dense", "bias", -1.0), ("kg", "deductive", 0.6), ("kg", "relational", 0.2), ("kg", "bias", -1.0), ("hybrid", "relational", 0.7), ("hybrid", "bias", -1.0))
_LIN_SQL = "weights(label, feature, weight) AS (VALUES " + ", ".join(f"({q(a)}, {q(b)}, {c}::DOUBLE)" for a, b, c in _LIN_WEIGHTS) + "), long AS (SELECT qid, unnest(['lexical', 'semantic', 'deductive', 'relational', 'bias']) AS feature, unnest([lexical::DOUBLE, semantic::DOUBLE, deductive::DOUBLE, relational::DOUBLE, 1.0]) AS value FROM feat), lin AS (SELECT qid, label, round(sum(weight * value), 6) AS score FROM long JOIN weights USING (feature) GROUP BY qid, label)"


def _linear(spark, d):
    f = routing.with_features(questions(spark, d)).withColumn("bias", F.lit(True))
    weights = spark.createDataFrame(list(_LIN_WEIGHTS), "label string, feature string, weight double")
    return routing.long_features(f.withColumns({n: F.col(n).cast("int") for n in _LIN_NAMES}), "qid", _LIN_NAMES), weights


@query(_with(SQL["questions"], _BENCH, _FEATURES, _LIN_SQL) + "SELECT * FROM lin")
def linear_scores(spark, d):
    return routing.linear_scores(*_linear(spark, d), "qid")


@query(_with(SQL["questions"], _BENCH, _FEATURES, _LIN_SQL) + "SELECT qid, label, feature, round(weight * value, 6) AS contribution FROM long JOIN weights USING (feature) WHERE round(weight * value, 6) <> 0")
def linear_contributions(spark, d):
    return routing.linear_contributions(*_linear(spark, d), "qid")


@query(_with(SQL["questions"], _BENCH, _FEATURES, _LIN_SQL) + "SELECT qid, label AS route, round(score - nxt, 6) AS margin FROM (SELECT *, row_number() OVER w AS rn, lead(score) OVER w AS nxt FROM lin WINDOW w AS (PARTITION BY qid ORDER BY score DESC, CASE label WHEN 'bm25' THEN 1 WHEN 'dense' THEN 2 WHEN 'kg' THEN 3 ELSE 4 END)) WHERE rn = 1")
def linear_route(spark, d):
    return routing.best_label(routing.linear_scores(*_linear(spark, d), "qid"), "qid")


# -- retrieval --------------------------------------------------------------------------


@query(_with(SQL["questions"], SQL["corpus"], _LEX_DOCS, _LEX_QS, _TF, _BM25) + _top("bm", 3))
def bm25_topk(spark, d):
    return resident.bm25_top_k(corpus(spark, d), questions(spark, d), 3)


@query(_with(SQL["questions"], SQL["corpus"], _LEX_DOCS, _LEX_QS, _TF, _BM25, _SHARED) + _top("(SELECT qid, doc_id, round(score + 5.0 * ids + 0.05 * shared, 4) AS score FROM bm JOIN shared USING (qid, doc_id))", 3))
def bm25_identifier_boost(spark, d):
    return resident.bm25_top_k(corpus(spark, d), questions(spark, d), 3, 5.0, 0.05)


@query(_with(SQL["questions"], SQL["corpus"], _SIMPLE_DOCS, _SIMPLE_QS, _TF, _SHARED) + _top("(SELECT qid, doc_id, round(common / len(tokens), 6) AS score FROM shared JOIN qtok USING (qid))", 3))
def overlap_topk(spark, d):
    return resident.set_top_k(corpus(spark, d), questions(spark, d), 3, "overlap")


@query(_with(SQL["questions"], SQL["corpus"], _SIMPLE_DOCS, _SIMPLE_QS, _TF, _SHARED) + _top("(SELECT qid, doc_id, round(shared / (len(list_distinct(q.tokens)) + len(list_distinct(d.tokens)) - shared), 6) AS score FROM shared JOIN qtok q USING (qid) JOIN dtok d USING (doc_id))", 3))
def jaccard_topk(spark, d):
    return resident.set_top_k(corpus(spark, d), questions(spark, d), 3, "jaccard")


def _vectors(spark, d):
    e = table(spark, d, "embeddings")
    return e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), "embedding"), e.select(F.col("vec_id").alias("item_id"), "embedding")


@query(_top("(SELECT a.vec_id AS qid, b.vec_id AS item_id, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0)", 5, "item_id", "ASC"))
def dense_inner_product_topk(spark, d):
    return dense.vector_top_k(*_vectors(spark, d), 5)


_HASH = """hv AS (SELECT key, bucket, sum(s) AS value FROM (SELECT key, ('0x' || left(md5(token), 8))::BIGINT % 384 AS bucket, CASE WHEN ('0x' || substr(md5(token), 9, 2))::BIGINT % 2 = 0 THEN 1.0 ELSE -1.0 END::DOUBLE AS s FROM (
 SELECT 'd' || doc_id AS key, unnest(tokens) AS token FROM dtok UNION ALL SELECT 'q' || qid, unnest(tokens) FROM qtok)) GROUP BY ALL),
hn AS (SELECT key, greatest(sqrt(sum(value * value)), 1e-12) AS norm FROM hv GROUP BY key), he AS (SELECT key, bucket, value / norm AS value FROM hv JOIN hn USING (key)),
hs AS (SELECT substr(a.key, 2)::BIGINT AS qid, substr(b.key, 2)::BIGINT AS doc_id, round(sum(a.value * b.value), 5) AS score FROM he a JOIN he b USING (bucket) WHERE a.key[1] = 'q' AND b.key[1] = 'd' GROUP BY ALL)"""


@query(_with(SQL["questions"], SQL["corpus"], _SIMPLE_DOCS, _SIMPLE_QS, _HASH) + _top("hs", 3))
def hash_embed_topk(spark, d):
    return packed.hashed_top_k(corpus(spark, d), questions(spark, d), 3)


_CONCEPTS = ("concept", "bridge", "class", "code")


@query(_with(SQL["questions"], SQL["corpus"], _SIMPLE_DOCS, _SIMPLE_QS, _HASH) + f", qc AS (SELECT qid, unnest(list_distinct(list_filter(tokens, lambda t: t IN ({', '.join(map(q, _CONCEPTS))}) OR length(t) > 9))) AS concept FROM qtok), dc AS (SELECT doc_id, unnest(list_distinct(list_filter(tokens, lambda t: t IN ({', '.join(map(q, _CONCEPTS))}) OR length(t) > 9))) AS concept FROM dtok), cb AS (SELECT qid, doc_id, count(*) AS n FROM qc JOIN dc USING (concept) GROUP BY ALL) ".lstrip() + _top("(SELECT qid, doc_id, round(score + 0.35 * coalesce(n, 0), 5) AS score FROM hs LEFT JOIN cb USING (qid, doc_id))", 3))
def concept_boost_topk(spark, d):
    concepts = lambda text: F.filter(F.array_distinct(X.simple_tokens(text)), lambda t: t.isin(*_CONCEPTS) | (F.length(t) > 9))
    return packed.concept_top_k(corpus(spark, d), questions(spark, d), concepts, 3)


# -- graph ------------------------------------------------------------------------------


@query(_with(SQL["edges"]) + "SELECT * FROM edges")
def graph_edges(spark, d):
    return edges(spark, d)


@query(_with(SQL["edges"]) + "SELECT 1 AS pid, * FROM edges WHERE subject = 'c1' UNION ALL SELECT 2, * FROM edges WHERE predicate = 'is_a' AND object = 'n3' UNION ALL SELECT 3, * FROM edges WHERE subject = 'n2' AND predicate = 'is_a' AND object = 'r1' UNION ALL SELECT 4, * FROM edges WHERE predicate = 'in_segment' UNION ALL SELECT 5, * FROM edges WHERE object = 'r0' UNION ALL SELECT 6, * FROM edges")
def triple_match(spark, d):
    rows = [(1, "c1", None, None), (2, None, "is_a", "n3"), (3, "n2", "is_a", "r1"), (4, None, "in_segment", None), (5, None, None, "r0"), (6, None, None, None)]
    return graph.triple_match(edges(spark, d), spark.createDataFrame(rows, "pid int, s string, p string, o string"))


_ASKED = "asked AS (SELECT c_custkey AS qid, 'c' || c_custkey AS subject, 'n' || (c_custkey % 25) AS object FROM customer)"


def _asked(spark, d):
    c = table(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("qid"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("subject"), F.concat(F.lit("n"), (F.col("c_custkey") % 25).cast("string")).alias("object"))


@query(_with(SQL["edges"], _ASKED) + "SELECT qid, triple_id AS item_id, concat_ws(' ', subject, predicate, object) AS content, 5.0::DOUBLE AS score FROM asked JOIN edges USING (subject, object) WHERE predicate = 'is_a'")
def membership(spark, d):
    return graph.membership(edges(spark, d), _asked(spark, d))


@query(_with(SQL["edges"]) + "SELECT 'path:' || e.triple_id || '->' || f.triple_id AS item_id, e.subject || ' ' || e.predicate || ' ' || e.object || ' ; ' || f.subject || ' ' || f.predicate || ' ' || f.object AS content, e.subject AS a, e.object AS b, f.object AS c, 6.0::DOUBLE AS score FROM edges e JOIN edges f ON e.object = f.subject")
def two_hop_paths(spark, d):
    return graph.two_hop_paths(edges(spark, d))


@query(_with(SQL["edges"]) + "SELECT c_custkey AS qid, 'path:' || e.triple_id || '->' || f.triple_id AS item_id, f.object AS c FROM customer JOIN edges e ON e.subject = 'c' || c_custkey JOIN edges f ON e.object = f.subject AND f.object = 'r' || (c_custkey % 5)")
def two_hop_between(spark, d):
    asked = _asked(spark, d).withColumn("object", F.concat(F.lit("r"), (F.col("qid") % 5).cast("string")))
    return graph.two_hop_paths(edges(spark, d), asked).select("qid", "item_id", "c")


_CLASS = "asked AS (SELECT n_nationkey AS qid, 'n' || n_nationkey AS class, 'in_segment' AS predicate, 'BUILDING' AS object FROM nation)"
_NEG = "neg AS (SELECT * FROM edges UNION ALL SELECT 'neg_' || c_custkey, 'c' || c_custkey, 'not_in_segment', 'BUILDING', 'derived' FROM customer WHERE c_mktsegment <> 'BUILDING' AND c_custkey % 3 = 0)"


def _class_asked(spark, d):
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("qid"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("class"), F.lit("in_segment").alias("predicate"), F.lit("BUILDING").alias("object"))


def _with_negations(spark, d):
    c = table(spark, d, "customer").filter("c_mktsegment <> 'BUILDING' and c_custkey % 3 = 0")
    key = F.col("c_custkey").cast("string")
    neg = c.select(F.concat(F.lit("neg_"), key).alias("triple_id"), F.concat(F.lit("c"), key).alias("subject"), F.lit("not_in_segment").alias("predicate"), F.lit("BUILDING").alias("object"), F.lit("derived").alias("source"))
    return edges(spark, d).unionByName(neg)


@query(_with(SQL["edges"], _CLASS) + "SELECT qid, triple_id AS item_id, concat_ws(' ', e.subject, e.predicate, e.object) AS content, 5.0::DOUBLE AS score FROM asked JOIN edges e ON class = e.subject AND asked.predicate = e.predicate AND asked.object = e.object UNION ALL SELECT qid, 'path:' || m.triple_id || '->' || s.triple_id, m.subject || ' is_a ' || class || ' ; ' || concat_ws(' ', s.subject, s.predicate, s.object), 6.0 FROM asked JOIN edges m ON m.object = class AND m.predicate = 'is_a' JOIN edges s ON s.subject = m.subject AND s.predicate = asked.predicate AND s.object = asked.object")
def existential_paths(spark, d):
    return graph.existential(edges(spark, d), _class_asked(spark, d))


@query(_with(SQL["edges"], _CLASS, _NEG) + "SELECT qid, 'path:' || m.triple_id || '->' || s.triple_id AS item_id, m.subject || ' is_a ' || class || ' ; ' || concat_ws(' ', s.subject, s.predicate, s.object) AS content, CASE WHEN s.predicate = asked.predicate THEN 'support' ELSE 'counterexample' END AS kind, CASE WHEN s.predicate = asked.predicate THEN 4.0 ELSE 7.0 END::DOUBLE AS score FROM asked JOIN neg m ON m.object = class AND m.predicate = 'is_a' JOIN neg s ON s.subject = m.subject AND s.object = asked.object AND s.predicate IN (asked.predicate, 'not_' || asked.predicate)")
def universal_counterexamples(spark, d):
    return graph.universal(_with_negations(spark, d), _class_asked(spark, d))


@query(_with(SQL["edges"], _CLASS) + "SELECT qid, class, m.subject AS member FROM asked JOIN edges m ON m.object = class AND m.predicate = 'is_a' WHERE NOT EXISTS (SELECT 1 FROM edges s WHERE s.subject = m.subject AND s.predicate = asked.predicate AND s.object = asked.object)")
def closed_world_gaps(spark, d):
    return graph.without_property(edges(spark, d), _class_asked(spark, d))


@query(_with(SQL["edges"]) + ", l AS (SELECT * FROM edges WHERE source IN ('customer', 'nation')), r AS (SELECT 'x_' || triple_id AS triple_id, subject, predicate, object, 'second' AS source FROM edges WHERE source IN ('nation', 'supplier')) ".lstrip() + "SELECT coalesce(l.triple_id, r.triple_id) AS triple_id, subject, predicate, object, CASE WHEN l.source IS NOT NULL AND r.source IS NOT NULL THEN l.source || '|extracted:' || r.source ELSE coalesce(l.source, r.source) END AS source, CASE WHEN l.triple_id IS NULL THEN 'right' WHEN r.triple_id IS NULL THEN 'left' ELSE 'both' END AS origin FROM l FULL JOIN r USING (subject, predicate, object)")
def merge_graphs(spark, d):
    e = edges(spark, d)
    right = e.filter(F.col("source").isin("nation", "supplier")).withColumns({"triple_id": F.concat(F.lit("x_"), "triple_id"), "source": F.lit("second")})
    return graph.merge_graphs(e.filter(F.col("source").isin("customer", "nation")), right, "extracted")


# Sentence patterns with two groups, their predicate and confidence.
_PATTERNS = [
    ("is_a", r"(?:^|[^a-z])([a-z]+) is an? ([a-z]+)", "is_a", 0.82),
    ("eats", r"(?:^|[^a-z])([a-z]+) eats ([a-z]+)", "eats", 0.90),
    ("has", r"(?:^|[^a-z])([a-z]+) has (?:property )?([a-z]+)", "has_property", 0.84),
    ("are", r"(?:^|[^a-z])([a-z]+) are ([a-z]+)", "is_a", 0.72),
    ("can", r"(?:^|[^a-z])([a-z]+) can ([a-z]+)", "capable_of", 0.64),
]
_SENT = "sent AS (SELECT doc_id, unnest(s) AS sentence, unnest(range(0, len(s))) AS sentence_no FROM (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.;])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS s FROM documents))"
_FOUND = "found AS (" + " UNION ALL ".join(f"SELECT doc_id, sentence_no, {i} AS pattern_no, unnest(range(0, len(m))) AS match_no, lower(unnest(m)) AS subject, {q(p)} AS predicate, lower(unnest(regexp_extract_all(sentence, {q(r)}, 2))) AS object, {c}::DOUBLE AS confidence, {q(n)} AS pattern FROM (SELECT *, regexp_extract_all(sentence, {q(r)}, 1) AS m FROM sent)" for i, (n, r, p, c) in enumerate(_PATTERNS)) + ")"


def _extracted(spark, d):
    s = corpus(spark, d).select("doc_id", F.posexplode(X.sentences(F.col("text"))).alias("sentence_no", "sentence"))
    return graph.extract_triples(s, _PATTERNS)


@query(_with(_SENT, _FOUND) + "SELECT doc_id, sentence_no::INTEGER AS sentence_no, pattern_no::INTEGER AS pattern_no, match_no::INTEGER AS match_no, subject, predicate, object, confidence, pattern FROM found")
def extract_triples(spark, d):
    return _extracted(spark, d)


@query(_with(_SENT, _FOUND) + "SELECT subject, predicate, object, doc_id, confidence, pattern FROM (SELECT *, row_number() OVER (PARTITION BY subject, predicate, object ORDER BY confidence DESC, doc_id, sentence_no, pattern_no, match_no) AS rn FROM found) WHERE rn = 1")
def dedupe_best_confidence(spark, d):
    return graph.best_per_triple(_extracted(spark, d), ["doc_id", "sentence_no", "pattern_no", "match_no"]).select("subject", "predicate", "object", "doc_id", "confidence", "pattern")


@query(_with(_SENT, _FOUND) + "SELECT pattern, count(*) AS n, round(avg(confidence), 6) AS mean_confidence, count(DISTINCT doc_id) AS docs FROM found GROUP BY pattern")
def extraction_summary(spark, d):
    return _extracted(spark, d).groupBy("pattern").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence"), F.count_distinct("doc_id").alias("docs"))


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1")
def last_write_wins(spark, d):
    return graph.last_per_key(table(spark, d, "events").select("user_id", "event_id", "event_type", "value"), "user_id", "event_id")


@query(_with(SQL["edges"]) + "SELECT 'ex:' || translate(subject, ' -', '__') || ' ex:' || translate(predicate, ' -', '__') || ' ex:' || translate(object, ' -', '__') || ' .' AS line FROM edges")
def turtle_lines(spark, d):
    return edges(spark, d).select(graph.turtle_line().alias("line"))


# -- fusion, answers --------------------------------------------------------------------

_RANKS = (
    "b AS (" + _top("bm", 10) + "), h AS (" + _top("hs", 10) + "),"
    " ranks AS (SELECT qid, 'bm25' AS backend, doc_id AS item_id, rank FROM b UNION ALL SELECT qid, 'dense', doc_id, rank FROM h)"
)
_RANKED = _with(SQL["questions"], SQL["corpus"], _LEX_DOCS, _LEX_QS, _TF, _BM25)[:-1]
_HASH2 = _HASH.replace("dtok", "dtok2").replace("qtok", "qtok2")
_RANKED += ", " + _SIMPLE_DOCS.replace("dtok", "dtok2") + ", " + _SIMPLE_QS.replace("qtok", "qtok2") + ", " + _HASH2 + ", " + _RANKS
_W = "CASE backend WHEN 'dense' THEN 1.0 WHEN 'kg' THEN 1.2 ELSE 0.9 END"


def _ranked(spark, d):
    c, qs = corpus(spark, d), questions(spark, d)
    b = resident.bm25_top_k(c, qs, 10).select("qid", F.lit("bm25").alias("backend"), F.col("doc_id").alias("item_id"), "rank")
    h = packed.hashed_top_k(c, qs, 10).select("qid", F.lit("dense").alias("backend"), F.col("doc_id").alias("item_id"), "rank")
    return b.unionByName(h)


@query(_RANKED + f" SELECT qid, item_id, round(sum({_W} / (60 + rank)), 8)::DOUBLE AS score, array_to_string(list_sort(list_distinct(list(backend))), ',') AS backends FROM ranks GROUP BY qid, item_id")
def rrf_fuse(spark, d):
    return fusion.rrf_fuse(_ranked(spark, d))


@query(_RANKED + f" SELECT variant, qid, item_id, round(sum({_W} / (60 + rank)), 8)::DOUBLE AS score FROM ranks, (VALUES ('none'), ('kg'), ('bm25'), ('dense')) v(variant) WHERE variant <> backend GROUP BY ALL")
def rrf_ablations(spark, d):
    return fusion.ablations(_ranked(spark, d))


_EV = "ev AS (SELECT b.qid, question, doc_id AS item_id, rank, text AS content, source AS title, score FROM (" + _top("bm", 3) + ") b JOIN questions USING (qid) JOIN documents USING (doc_id))"
_EVIDENCE = _with(SQL["questions"], SQL["corpus"], _LEX_DOCS, _LEX_QS, _TF, _BM25, _EV)[:-1]


def _evidence(spark, d):
    c, qs = corpus(spark, d), questions(spark, d)
    top = resident.bm25_top_k(c, qs, 3)
    return top.join(c.select("doc_id", "title", "text"), "doc_id").join(qs.select("qid", "question"), "qid").select("qid", "question", F.col("doc_id").alias("item_id"), "rank", F.col("text").alias("content"), "title", "score")


_G = "g AS (SELECT qid, item_id, 'the' AS subject, split_part(question, ' ', 6) AS object, 1 AS rank FROM (SELECT qid, question, 'kg_' || qid AS item_id FROM questions))"


@query(_EVIDENCE + ", " + _G + " SELECT g.qid, g.item_id AS graph_id, ev.item_id AS text_id, round(1.2 / (60 + g.rank) + 0.9 / (60 + ev.rank) + 0.05, 8)::DOUBLE AS score FROM g JOIN ev USING (qid) WHERE ev.rank <= 6 AND (contains(lower(content), lower(subject)) OR contains(lower(content), lower(object)))")
def relational_bundles(spark, d):
    qs = questions(spark, d)
    g = qs.select("qid", F.concat(F.lit("kg_"), F.col("qid").cast("string")).alias("item_id"), F.lit("the").alias("subject"), F.split_part("question", F.lit(" "), F.lit(6)).alias("object"), F.lit(1).alias("rank"))
    return fusion.relational_bundles(g, _evidence(spark, d))


_WORDS_OF = "list_distinct(list_filter(regexp_extract_all(lower({}), '[a-z0-9._§:/-]+'), lambda w: length(w) > 2 AND w NOT IN (" + ", ".join(q(s) for s in X.STOPWORDS) + ")))"
_NEGATED_OF = "list_sort(list_distinct(flatten(list_transform(flatten([" + ", ".join(f"regexp_extract_all(lower({{0}}), {q(m + chr(92) + 's+([^,?.;:]+)').replace('{', '{{').replace('}', '}}')}, 1)" for m in S.NEGATIONS) + "]), lambda s: list_sort(" + _WORDS_OF.format("s") + ")[1:6]))))"
_RESCUE = f""", r0 AS (SELECT *, first_value(question || ' not ' || string_split_regex(content, '\\s+')[3]) OVER (PARTITION BY qid ORDER BY rank) AS q2, lower(item_id || ' ' || content) AS low FROM ev),
 r1 AS (SELECT *, {_WORDS_OF.format("q2")} AS words, {_NEGATED_OF.format("q2")} AS negated, {_WORDS_OF.format("low")} AS there, {_CANON.replace("(text,", "(q2,")} AS named FROM r0),
 r2 AS (SELECT *, len(list_intersect(words, there)) / greatest(1, len(words)) AS overlap, len(list_filter(negated, lambda w: contains(low, w))) AS negated_hits, len(list_filter(named, lambda w: contains(low, lower(w)))) AS identifier_hits FROM r1),
 r3 AS (SELECT *, round(overlap + 0.18::DOUBLE * identifier_hits - 0.28::DOUBLE * negated_hits - 0.015::DOUBLE * (rank - 1), 6) AS rescue_score FROM r2),
 r4 AS (SELECT *, row_number() OVER best AS new_rank, first_value(rescue_score) OVER best AS best_score, first_value(negated_hits) OVER best AS best_hits, first_value(rescue_score) OVER f AS first_score, first_value(negated_hits) OVER f AS first_hits, count(*) OVER (PARTITION BY qid) AS items FROM r3 WINDOW best AS (PARTITION BY qid ORDER BY rescue_score DESC, rank), f AS (PARTITION BY qid ORDER BY rank)),
 r5 AS (SELECT *, items >= 2 AND len(negated) > 0 AND best_score >= first_score + 0.12::DOUBLE AND best_hits < first_hits AS applied FROM r4)
 SELECT qid, item_id, rank, CASE WHEN applied THEN new_rank ELSE rank END AS final_rank, rescue_score, round(overlap, 6) AS overlap, identifier_hits, negated_hits, applied FROM r5"""


@query(_EVIDENCE + _RESCUE)
def topk_rescue(spark, d):
    e = _evidence(spark, d)
    negated = F.concat("question", F.lit(" not "), F.element_at(F.split("content", r"\s+"), 3))
    return fusion.rescue(e.withColumn("question", F.first(negated).over(_by_rank())))


def _by_rank():
    from pyspark.sql import Window

    return Window.partitionBy("qid").orderBy("rank")


_ANS = f"""items AS (SELECT qid, list(item_id::VARCHAR ORDER BY rank) AS ids, list(title ORDER BY rank) AS titles, list(content ORDER BY rank) AS contents, max(score) AS best FROM ev GROUP BY qid),
ans AS (SELECT r.qid, route, CASE WHEN ids IS NULL THEN 'insufficient evidence' WHEN route = 'bm25' THEN titles[1] || ': ' || contents[1] || ' [evidence: ' || ids[1] || ']' WHEN route = 'dense' THEN titles[1] || '. ' || contents[1] || ' [evidence: ' || ids[1] || ']'
 WHEN route = 'kg' THEN contents[1] || '. [evidence: ' || ids[1] || ']' ELSE 'Hybrid connection: ' || contents[1] || '. This combines structured evidence plus text relation evidence. [fused evidence: ' || array_to_string(ids, ',') || ']' END AS answer,
 CASE WHEN ids IS NULL THEN 'insufficient' WHEN route = 'bm25' THEN 'lexical_exact_match' WHEN route = 'dense' THEN 'semantic_summary' WHEN route = 'kg' THEN 'deductive' ELSE 'relational' END AS answer_type, coalesce(array_to_string(ids, ','), '') AS evidence_ids,
 coalesce(array_to_string(list_transform(contents, lambda x: CASE WHEN length(x) <= 240 THEN x ELSE x[1:237] || '...' END), ' | '), '') AS snippets, round(CASE WHEN best IS NULL OR best <= 0 THEN 0.0 ELSE least(1.0, best / (1.0 + best)) END, 6) AS support, lexical, semantic, deductive, relational, score_bm25, score_dense, score_kg, score_hybrid, family, gold FROM routed r LEFT JOIN items USING (qid))"""
_ANSWERED = _EVIDENCE + ", " + ", ".join((_BENCH, _FEATURES, _PENALTY, _ANS))


@query(_ANSWERED + " SELECT qid, route, answer, answer_type, evidence_ids, snippets, support FROM ans")
def answers_templated(spark, d):
    return answering.answers(routing.penalty_routes(questions(spark, d)), _evidence(spark, d))


_FAM = "CASE route WHEN 'bm25' THEN 'lexical/exact-match' WHEN 'dense' THEN 'semantic/paraphrase' WHEN 'kg' THEN 'deductive/structured' ELSE 'relational/fused-evidence' END"
_BEST = "CASE route WHEN 'bm25' THEN score_bm25 WHEN 'dense' THEN score_dense WHEN 'kg' THEN score_kg ELSE score_hybrid END"


@query(_ANSWERED + f""" SELECT qid, unnest([1, 2, 3, 4, 5]) AS step_no, unnest(['parse_query_features', 'score_ras', 'select_backend', 'retrieve_evidence', 'synthesize_answer']) AS step,
 unnest([array_to_string(list_filter([CASE WHEN lexical THEN 'lexical' END, CASE WHEN semantic THEN 'semantic' END, CASE WHEN deductive THEN 'deductive' END, CASE WHEN relational THEN 'relational' END], lambda x: x IS NOT NULL), ','),
 'bm25=' || printf('%.3f', score_bm25) || ',dense=' || printf('%.3f', score_dense) || ',kg=' || printf('%.3f', score_kg) || ',hybrid=' || printf('%.3f', score_hybrid),
 'Selected ' || route || ' for ' || {_FAM} || ' signals with minimum penalty=' || printf('%.3f', {_BEST}) || '.', evidence_ids, evidence_ids]) AS detail FROM ans""")
def reasoning_traces(spark, d):
    return answering.traces(routing.penalty_routes(questions(spark, d)), _evidence(spark, d))


@query(_ANSWERED + " SELECT qid, unnest(list_filter([CASE WHEN evidence_ids = '' THEN 'no_evidence' END, CASE WHEN answer = 'insufficient evidence' THEN 'no_answer' END, CASE WHEN support <= 0 THEN 'no_support' END], lambda x: x IS NOT NULL)) AS issue FROM ans")
def trace_issues(spark, d):
    return answering.trace_issues(answers_templated(spark, d))


_GOLDTOK = "list_filter(string_split(g, ' '), lambda t: t <> '' AND t NOT IN (" + ", ".join(q(s) for s in X.GOLD_STOPWORDS) + "))"
_NORM = "trim(regexp_replace(regexp_replace(lower({}), '[^a-z0-9§._:/ -]+', ' ', 'g'), '\\s+', ' ', 'g'))"
_MATCHED = f"matched AS (SELECT qid, route, family, gold, (g <> '' AND (contains(a, g) OR (len({_GOLDTOK}) > 0 AND len(list_filter({_GOLDTOK}, lambda t: contains(a, t))) >= 0.5 * len({_GOLDTOK})))) AS matched FROM (SELECT ans.*, {_NORM.format('answer')} AS a, {_NORM.format('text')} AS g FROM ans JOIN benchmark ON item_id = qid))"


def _matched(spark, d):
    gold = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("gold_text"))
    a = answers_templated(spark, d).join(gold, "qid").join(questions(spark, d).select("qid", "family", "gold"), "qid")
    return a.withColumn("matched", metrics.answer_matches(F.col("answer"), F.col("gold_text")))


@query(_ANSWERED + ", " + _MATCHED + " SELECT qid, matched FROM matched")
def answer_match(spark, d):
    return _matched(spark, d).select("qid", "matched")


@query(_ANSWERED + ", " + _MATCHED + " SELECT family, count(*) AS n, round(avg((route = gold)::INTEGER), 6) AS route_accuracy, round(avg(matched::INTEGER), 6) AS answer_accuracy FROM matched GROUP BY ROLLUP (family)")
def evaluate_system(spark, d):
    m = _matched(spark, d)
    return m.rollup("family").agg(F.count("*").alias("n"), metrics.rate(F.col("route") == F.col("gold")).alias("route_accuracy"), metrics.rate(F.col("matched")).alias("answer_accuracy"))


_SYSTEMS = "sys AS (SELECT qid, family, gold, 'computed' AS system, route AS predicted FROM v2 UNION ALL SELECT qid, family, gold, 'keyword', keyword_route FROM v2 UNION ALL SELECT qid, family, gold, 'rules_v2', route_v2 FROM v2 UNION ALL SELECT qid, family, gold, 'always_bm25', 'bm25' FROM v2 UNION ALL SELECT qid, family, gold, 'always_dense', 'dense' FROM v2 UNION ALL SELECT qid, family, gold, 'always_kg', 'kg' FROM v2 UNION ALL SELECT qid, family, gold, 'always_hybrid', 'hybrid' FROM v2 UNION ALL SELECT qid, family, gold, 'oracle', gold FROM v2)"
_SYS = _with(SQL["questions"], _BENCH, _FEATURES, _PENALTY, _KEYWORD, _V2, _SYSTEMS)


def _systems(spark, d):
    """All systems' routes for all questions in one pass: a row per question and system."""
    r = routing.rule_routes_v2(routing.keyword_routes(routing.penalty_routes(questions(spark, d))))
    choices = {"computed": F.col("route"), "keyword": F.col("keyword_route"), "rules_v2": F.col("route_v2"), **{f"always_{b}": F.lit(b) for b in routing.BACKENDS}, "oracle": F.col("gold")}
    s = F.explode(F.array(*(F.struct(F.lit(k).alias("system"), v.alias("predicted")) for k, v in choices.items())))
    return r.select("qid", "family", "gold", s.alias("s")).select("qid", "family", "gold", "s.system", "s.predicted")


@query(_SYS + "SELECT system, count(*) AS n, count_if(gold = predicted) AS correct, round(avg((gold = predicted)::INTEGER), 6) AS accuracy FROM sys GROUP BY ROLLUP (system)")
def route_accuracy(spark, d):
    return metrics.accuracy(_systems(spark, d), "gold", "predicted", "system")


@query(_SYS + "SELECT system, family, count(*) AS n, round(avg((gold = predicted)::INTEGER), 6) AS accuracy FROM sys GROUP BY CUBE (system, family)")
def accuracy_cube(spark, d):
    return metrics.accuracy_cube(_systems(spark, d), "gold", "predicted", "system", "family")


@query(_SYS + "SELECT gold, predicted, count(*) AS n FROM sys WHERE system = 'computed' GROUP BY ALL")
def route_confusion(spark, d):
    return metrics.confusion(_systems(spark, d).filter("system = 'computed'"), "gold", "predicted")


@query(_SYS + ", acc AS (SELECT system, family, avg((gold = predicted)::INTEGER) AS a FROM sys WHERE system IN ('computed', 'keyword') GROUP BY ALL) ".lstrip() + "SELECT family, coalesce(max(a) FILTER (system = 'computed'), 0) AS base, coalesce(max(a) FILTER (system = 'keyword'), 0) AS other, round(coalesce(max(a) FILTER (system = 'keyword'), 0) - coalesce(max(a) FILTER (system = 'computed'), 0), 6) AS delta FROM acc GROUP BY family")
def family_deltas(spark, d):
    a = _systems(spark, d).filter(F.col("system").isin("computed", "keyword")).groupBy("system", "family").agg(F.avg((F.col("gold") == F.col("predicted")).cast("double")).alias("a"))
    return metrics.deltas(a, "family", "system", "a", "computed", "keyword")


@query(_SYS + "SELECT arg_max(system, (a, system)) AS strongest, max(a) AS accuracy FROM (SELECT system, round(avg((gold = predicted)::INTEGER), 6) AS a FROM sys WHERE starts_with(system, 'always_') GROUP BY system)")
def strongest_fixed(spark, d):
    a = _systems(spark, d).filter(F.col("system").startswith("always_")).groupBy("system").agg(metrics.rate(F.col("gold") == F.col("predicted")).alias("a"))
    return a.agg(F.max_by("system", F.struct("a", "system")).alias("strongest"), F.max("a").alias("accuracy"))


@query(_ROUTED + " SELECT count(*) AS n, round(min(margin), 6) AS min_margin, round(max(margin), 6) AS max_margin, round(avg(margin), 6) AS mean_margin, count_if(margin < 0.25) AS low_margins FROM routed")
def route_margins(spark, d):
    return metrics.margins(routing.penalty_routes(questions(spark, d)), "margin")


@query(_with(SQL["questions"], _BENCH, _FEATURES, _PENALTY, _KEYWORD, _CONF) + "SELECT confidence, count(*) AS n, round(avg((route <> gold)::INTEGER), 6) AS miss_rate FROM conf GROUP BY confidence")
def confidence_buckets(spark, d):
    return _confident(spark, d).groupBy("confidence").agg(F.count("*").alias("n"), metrics.rate(F.col("route") != F.col("gold")).alias("miss_rate"))


@query(_with(SQL["questions"], _BENCH, _FEATURES, _PENALTY, _KEYWORD, _CONF) + "SELECT qid, confidence_score FROM conf ORDER BY confidence_score, qid LIMIT 10")
def lowest_confidence(spark, d):
    return _confident(spark, d).select("qid", "confidence_score").orderBy("confidence_score", "qid").limit(10)


_HITS = _RANKED + ", fh AS (SELECT q.qid, family, min(rank) AS first_hit FROM questions q LEFT JOIN (SELECT * FROM b JOIN documents USING (doc_id) WHERE lang = 'en') x ON q.qid = x.qid GROUP BY ALL)"


@query(_HITS + " SELECT family, count(*) AS n, round(avg((first_hit IS NOT NULL)::INTEGER), 6) AS hit_at_k, round(avg(coalesce(first_hit = 1, false)::INTEGER), 6) AS top1, round(avg((first_hit IS NOT NULL)::INTEGER) - avg(coalesce(first_hit = 1, false)::INTEGER), 6) AS gap FROM fh GROUP BY family")
def hit_rates(spark, d):
    c, qs = corpus(spark, d), questions(spark, d)
    top = resident.bm25_top_k(c, qs, 10).join(c.filter("lang = 'en'").select("doc_id"), "doc_id", "left_semi")
    first = qs.select("qid", "family").join(top.groupBy("qid").agg(F.min("rank").alias("first_hit")), "qid", "left")
    return metrics.hit_rates(first, "family")


@query(_HITS + ", res AS (SELECT qid, family, route = gold AS route_ok, first_hit IS NOT NULL AS hit, coalesce(first_hit = 1, false) AS top1 FROM fh JOIN (SELECT qid AS q2, route, gold FROM routed) ON qid = q2) ".replace("res AS", "asked AS (SELECT * FROM questions), " + _FEATURES.replace("'", "'") + ", " + _PENALTY + ", res AS") + "SELECT qid, unnest(list_sort(list_filter([CASE WHEN NOT route_ok THEN 'route_error' END, CASE WHEN NOT hit THEN 'retrieval_miss' END, CASE WHEN hit AND NOT top1 THEN 'ranking_error' END, CASE WHEN family = 'deductive' AND NOT hit THEN 'kg_incompleteness' END, CASE WHEN family = 'semantic' THEN 'semantic_drift' END, CASE WHEN family = 'relational' AND NOT hit THEN 'hybrid_fusion_miss' END], lambda x: x IS NOT NULL))) AS bucket FROM res")
def failure_buckets(spark, d):
    c, qs = corpus(spark, d), questions(spark, d)
    top = resident.bm25_top_k(c, qs, 10).join(c.filter("lang = 'en'").select("doc_id"), "doc_id", "left_semi")
    first = qs.select("qid").join(top.groupBy("qid").agg(F.min("rank").alias("first_hit")), "qid", "left")
    r = routing.penalty_routes(qs).join(first, "qid")
    hit, top1 = F.col("first_hit").isNotNull(), F.coalesce(F.col("first_hit") == 1, F.lit(False))
    return answering.failure_buckets(r.select("qid", "family", (F.col("route") == F.col("gold")).alias("route_ok"), hit.alias("hit"), top1.alias("top1"), F.lit(True).alias("matched")))


# -- annotations and votes --------------------------------------------------------------


@query("SELECT count(*) AS n, round(avg((quality = toxic)::INTEGER), 6) AS agreement FROM labels")
def percent_agreement(spark, d):
    return metrics.percent_agreement(table(spark, d, "labels"), "quality", "toxic")


_KAPPA = "p AS (SELECT quality AS a, toxic AS b FROM labels), t AS (SELECT count(*) AS n, avg((a = b)::INTEGER) AS po FROM p), e AS (SELECT sum(x.n * y.n) AS c FROM (SELECT a, count(*) AS n FROM p GROUP BY a) x JOIN (SELECT b, count(*) AS n FROM p GROUP BY b) y ON a = b)"


@query(_with(_KAPPA) + "SELECT n, round(po, 6) AS observed, round(coalesce(c, 0) / (n * n), 6) AS expected, round(CASE WHEN coalesce(c, 0) / (n * n) = 1 THEN 1.0 ELSE (po - coalesce(c, 0) / (n * n)) / (1 - coalesce(c, 0) / (n * n)) END, 6) AS kappa FROM t, e")
def cohen_kappa(spark, d):
    return metrics.cohen_kappa(table(spark, d, "labels"), "quality", "toxic")


_RATE = "r AS (SELECT event_id, user_id % 3 + 1 AS a, event_id % 3 + 1 AS b FROM events)"


def _ratings(spark, d):
    return table(spark, d, "events").select("event_id", (F.col("user_id") % 3 + 1).alias("a"), (F.col("event_id") % 3 + 1).alias("b"))


@query(_with(_RATE) + ", o AS (SELECT count(*) AS n, sum((a - b) * (a - b) / 4.0) AS o FROM r), m AS (SELECT sum(x.n * y.n * (a - b) * (a - b) / 4.0) AS e FROM (SELECT a, count(*) AS n FROM r GROUP BY a) x, (SELECT b, count(*) AS n FROM r GROUP BY b) y) ".lstrip() + "SELECT n, round(CASE WHEN e = 0 THEN 1.0 ELSE 1 - (o / n) / (e / (n * n)) END, 6)::DOUBLE AS weighted_kappa FROM o, m")
def weighted_kappa(spark, d):
    return metrics.weighted_kappa(_ratings(spark, d), "a", "b", 1, 3)


_VOTES = "v AS (SELECT event_id, user_id AS item, CASE event_type WHEN 'click' THEN 'A' WHEN 'view' THEN 'B' ELSE 'Tie' END AS choice, value AS confidence FROM events)"


def _votes(spark, d):
    kind = F.when(F.col("event_type") == "click", "A").when(F.col("event_type") == "view", "B").otherwise("Tie")
    return table(spark, d, "events").select("event_id", F.col("user_id").alias("item"), kind.alias("choice"), F.col("value").alias("confidence"))


@query(_with(_VOTES) + ", c AS (SELECT item, choice, count(*) AS n FROM v GROUP BY ALL), t AS (SELECT item, max(n) AS most, sum(n)::BIGINT AS votes FROM c GROUP BY item) ".lstrip() + "SELECT item, CASE WHEN count(*) > 1 THEN 'Tie' ELSE min(choice) END AS winner, most AS n, votes FROM c JOIN t USING (item) WHERE n = most GROUP BY item, most, votes")
def majority_vote(spark, d):
    return metrics.majority_vote(_votes(spark, d), "item", "choice")


@query(_with(_VOTES) + ", c AS (SELECT item, choice, count(*) AS n, min(event_id) AS seen FROM v GROUP BY ALL) ".lstrip() + "SELECT item, choice AS winner, n FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY n DESC, seen) AS rn FROM c) WHERE rn = 1")
def first_seen_majority(spark, d):
    return metrics.first_seen_majority(_votes(spark, d), "item", "choice", "event_id")


@query(_with(_VOTES) + "SELECT item, count(*) AS n, round(count_if(choice = 'A') / count(*), 6) AS rate_a, round(count_if(choice = 'B') / count(*), 6) AS rate_b, round(count_if(choice = 'Tie') / count(*), 6) AS rate_tie FROM v GROUP BY item")
def preference_rates(spark, d):
    return metrics.preference_rates(_votes(spark, d), "item", "choice", ("A", "B", "Tie"))


@query(_with(_VOTES) + "SELECT item, count(DISTINCT choice) AS choices, round(min(confidence), 6) AS least_confidence FROM v GROUP BY item HAVING count(DISTINCT choice) > 1 OR round(min(confidence), 6) <= 1.0")
def adjudication_queue(spark, d):
    return metrics.adjudication_queue(_votes(spark, d), "item", "choice", "confidence", 1.0)


_LONG = "l AS (SELECT event_id % 100 AS item, unnest(['a', 'b']) AS dim, unnest([user_id % 3 + 1, event_id % 7]) AS score FROM events)"


def _long_ratings(spark, d):
    e = table(spark, d, "events").select((F.col("event_id") % 100).alias("item"), (F.col("user_id") % 3 + 1).alias("a"), (F.col("event_id") % 7).alias("b"))
    return e.unpivot("item", ["a", "b"], "dim", "score")


@query(_with(_LONG) + "SELECT item, max(spread) AS spread FROM (SELECT item, dim, max(score) - min(score) AS spread FROM l GROUP BY ALL) GROUP BY item ORDER BY spread DESC, item LIMIT 20")
def disagreement_cases(spark, d):
    return metrics.disagreement(_long_ratings(spark, d), "item", "dim", "score")


@query(_with(_LONG) + "SELECT dim, count(*) FILTER (score > 0) AS n, round(avg(score) FILTER (score > 0), 6) AS mean, round(median(score) FILTER (score > 0), 6) AS median FROM l GROUP BY dim")
def group_means(spark, d):
    return metrics.group_means(_long_ratings(spark, d), "dim", "score")


_TAGS = "tg AS (SELECT doc_id, quality, toxic, unnest(list_filter([CASE WHEN quality = 1 THEN 'good' END, CASE WHEN toxic = 1 THEN 'toxic' END, CASE WHEN n_chars > 2000 THEN 'long' END, lang], lambda x: x IS NOT NULL)) AS tag FROM labels JOIN documents USING (doc_id))"


@query(_with(_TAGS) + "SELECT tag, count(*) AS n, round(avg((quality = toxic)::INTEGER), 6) AS accuracy FROM tg GROUP BY tag")
def tag_breakdown(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    tags = F.array_compact(F.array(F.when(F.col("quality") == 1, "good"), F.when(F.col("toxic") == 1, "toxic"), F.when(F.col("n_chars") > 2000, "long"), F.col("lang")))
    return metrics.tag_breakdown(rows.withColumn("tags", tags), "tags", "quality", "toxic")


@query("SELECT lang, doc_id, rn FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM documents) WHERE rn <= 5")
def balanced_sample(spark, d):
    return metrics.first_per_family(corpus(spark, d), "lang", "doc_id", 5, False).select("lang", "doc_id", "rn")


@query("SELECT lang, doc_id, row_number() OVER (ORDER BY rn, lang) AS place FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM documents) WHERE rn <= 5")
def round_robin_sample(spark, d):
    return metrics.first_per_family(corpus(spark, d), "lang", "doc_id", 5, True).select("lang", "doc_id", "place")


@query("SELECT lang, source, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY GROUPING SETS ((lang), (source), ())")
def corpus_summary(spark, d):
    c = table(spark, d, "documents")
    return c.groupingSets([[F.col("lang")], [F.col("source")], []], "lang", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("SELECT doc_id, 'unknown_document' AS issue FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT doc_id, 'quality_out_of_range' FROM labels WHERE quality NOT IN (0, 1) UNION ALL SELECT doc_id, 'unlabelled' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def annotation_issues(spark, d):
    labels, docs = table(spark, d, "labels"), table(spark, d, "documents").select("doc_id")
    unknown = labels.join(docs, "doc_id", "left_anti").select("doc_id", F.lit("unknown_document").alias("issue"))
    out = labels.filter(~F.col("quality").isin(0, 1)).select("doc_id", F.lit("quality_out_of_range").alias("issue"))
    none = docs.join(labels, "doc_id", "left_anti").select("doc_id", F.lit("unlabelled").alias("issue"))
    return unknown.unionByName(out).unionByName(none)


@query(_with(SQL["questions"], SQL["user_turns"]) + "SELECT qid, CASE WHEN best IS NULL OR best <= 0 THEN 0.0 ELSE round(least(1.0, best / (1.0 + best)), 6) END AS support FROM (SELECT user_id AS qid, max(value) AS best FROM events GROUP BY user_id)")
def support_scores(spark, d):
    e = table(spark, d, "events").groupBy(F.col("user_id").alias("qid")).agg(F.max("value").alias("best"))
    return e.select("qid", metrics.support_score(F.col("best")).alias("support"))


# -- learned routers, diagnostics, graph questions ----------------------------------------


@query(None)
def fit_text_router(spark, d):
    qs = questions(spark, d)
    return learning.predict_routes(learning.fit_text_router(qs), qs).select("qid", "gold", "predicted")


@query(None)
def router_out_of_fold(spark, d):
    return learning.out_of_fold(questions(spark, d))


@query(None)
def fit_linear_router(spark, d):
    f = diagnostics.route_features(routing.keyword_routes(routing.penalty_routes(questions(spark, d))))
    names = tuple(c for c in f.columns if c not in ("qid", "bias"))
    return learning.top_weights(learning.fit_linear(f.join(questions(spark, d).select("qid", "gold"), "qid"), "gold", names, 0.85), 10)


def _f(c: str) -> str:
    return f"({c})::INTEGER::DOUBLE"


@query(_with(SQL["questions"], _BENCH, _FEATURES, _PENALTY, _KEYWORD) + "SELECT qid, 1.0::DOUBLE AS bias, round(ln(1 + length(question)) / 6.0, 6) AS query_length_log, round(ln(1 + len(regexp_extract_all(lower(question), '[a-z0-9._:/§-]+'))) / 3.0, 6) AS token_count_log, "
    + f"{_f(_match(_LOW, S.IDENTIFIER))} AS identifier_heavy, {_f('lexical OR ' + _any(_LOW, diagnostics.EXACT))} AS lexical_exactness, {_f('semantic OR ' + _any(_LOW, diagnostics.ABSTRACT))} AS semantic_abstraction, {_f('deductive OR ' + _any(_LOW, diagnostics.DEDUCTIVE))} AS deductive_cue, {_f('relational OR ' + _any(_LOW, diagnostics.RELATIONAL))} AS relational_bridge, "
    + f"{_f(_any(_LOW, diagnostics.MULTI_HOP))} AS multi_hop_cue, {_f(_any(_LOW, diagnostics.CONTRAST))} AS negation_or_contrast, round(greatest(0.0, (lexical::INTEGER + semantic::INTEGER + deductive::INTEGER + relational::INTEGER - 1) / 3.0), 6)::DOUBLE AS route_ambiguity, {_f('margin < 0.25')} AS low_margin, {_f(_any(_LOW, diagnostics.NOISE))} AS public_document_noise, "
    + ", ".join(f"(route = '{b}')::INTEGER::DOUBLE AS computed_route_{b}" for b in routing.BACKENDS) + ", " + ", ".join(f"(keyword_route = '{b}')::INTEGER::DOUBLE AS keyword_route_{b}" for b in routing.BACKENDS) + " FROM kw")
def route_features(spark, d):
    return diagnostics.route_features(routing.keyword_routes(routing.penalty_routes(questions(spark, d))))


_DW = "list_distinct(list_filter(regexp_extract_all(lower({}), '[a-z0-9._§:/-]+'), lambda w: length(w) > 1 AND w NOT IN (" + ", ".join(q(x) for x in diagnostics.STOP) + ")))"


@query(_EVIDENCE + ", dg AS (SELECT qid, " + _DW.format("question") + " AS q, " + _DW.format("content") + " AS w, rank, CASE WHEN score <= 0 THEN 0.0 ELSE score / (1.0 + score) END AS s, item_id FROM ev), pr AS (SELECT a.qid, avg(CASE WHEN len(list_distinct(list_concat(a.w, b.w))) = 0 THEN 0.0 ELSE len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) END) AS red FROM dg a JOIN dg b ON a.qid = b.qid AND a.rank < b.rank GROUP BY a.qid)"
    + " SELECT qid, round(max(s) FILTER (rank = 1), 6) AS top1_score, round(avg(s), 6) AS topk_score_mean, round(ln(1 + count(*)) / 2.0, 6) AS evidence_count_log, round(max(CASE WHEN len(q) = 0 THEN 0 ELSE len(list_intersect(q, w)) / len(q) END) FILTER (rank = 1), 6)::DOUBLE AS query_overlap_top1, round(coalesce(max(red), 0), 6) AS redundancy FROM dg LEFT JOIN pr USING (qid) GROUP BY qid")
def evidence_diagnostics(spark, d):
    return diagnostics.evidence_diagnostics(_evidence(spark, d)).select("qid", "top1_score", "topk_score_mean", "evidence_count_log", "query_overlap_top1", "redundancy")


def _candidate_evidence(spark, d):
    """What lexical retrieval found, and for the hybrid candidate its first two rows as paths."""
    e = _evidence(spark, d).withColumn("item_id", F.col("item_id").cast("string")).withColumn("parent", F.col("item_id"))
    one = e.withColumns({"backend": F.lit("bm25"), "kind": F.lit("document"), "backends": F.lit("bm25")})
    two = e.filter("rank <= 2").withColumns({"backend": F.lit("hybrid"), "kind": F.lit("path"), "backends": F.lit("bm25,kg"), "item_id": F.concat(F.lit("path:"), "item_id")})
    return one.unionByName(two)


def _cues(text: str, markers: tuple[str, ...]) -> str:
    return "least(1.0, (" + " + ".join(f"contains({text}, {q(m)})::INTEGER" for m in markers) + ") / 3.0)"


def _candidate_sql() -> str:
    share = "CASE WHEN len(q) = 0 THEN 0.0 ELSE len(list_intersect(q, {})) / len(q) END"
    values = {
        **{f"candidate_{b}": f"(backend = '{b}')::INTEGER" for b in routing.BACKENDS},
        "candidate_matches_computed_ras": "(route = backend)::INTEGER",
        "candidate_matches_keyword": "(keyword_route = backend)::INTEGER",
        "top1_score": "ss[1]",
        "topk_score_mean": "list_avg(ss)",
        "top1_top2_gap": "CASE WHEN n > 1 THEN greatest(0, ss[1] - ss[2]) ELSE ss[1] END",
        "evidence_count_log": "ln(1 + n) / 2.0",
        "query_overlap_top1": f"CASE WHEN n > 0 THEN {share.format('ws[1]')} END",
        "query_overlap_topk": share.format("list_distinct(flatten(ws))"),
        "identifier_exact_match": "CASE WHEN len(ids) > 0 THEN len(list_filter(ids, lambda x: contains(replace(whole, ' ', ''), replace(x, ' ', '')))) / len(ids) END",
        "title_or_id_match": f"list_max(list_transform(ts, lambda t: {share.format('t')}))",
        "source_diversity": "CASE WHEN n > 0 THEN len(list_distinct(ps)) / n END",
        "redundancy": "red",
        "kg_fact_or_path_present": "(len(list_filter(ks, lambda k: k IN ('kg', 'triple', 'path'))) > 0)::INTEGER",
        "kg_path_completeness": "CASE WHEN list_contains(ks, 'path') THEN 1.0 ELSE 0.0 END",
        "hybrid_component_agreement": "CASE backend WHEN 'bm25' THEN 1 / 3.0 WHEN 'hybrid' THEN 2 / 3.0 ELSE 0 END",
        "semantic_snippet_consistency": f"list_avg(list_transform(ws[1:5], lambda t: {share.format('t')}))",
        "negation_or_distractor_contamination": _cues("lower(question) || ' ' || whole", diagnostics.CONTAMINATION),
        "public_noise_indicator": f"({_any('whole', diagnostics.PUBLIC_NOISE)})::INTEGER",
        "answerability_marker": _cues("whole", diagnostics.ANSWERABLE),
    }
    return (
        f"""evb AS (SELECT qid, 'bm25' AS backend, rank, item_id::VARCHAR AS item_id, item_id::VARCHAR AS parent, content, title, score, 'document' AS kind FROM ev UNION ALL SELECT qid, 'hybrid', rank, 'path:' || item_id, item_id::VARCHAR, content, title, score, 'path' FROM ev WHERE rank <= 2),
 evw AS (SELECT *, {_DW.format("content")} AS w, {_DW.format("concat_ws(' ', title, parent, item_id)")} AS t, CASE WHEN score <= 0 THEN 0.0 ELSE score / (1.0 + score) END AS s FROM evb),
 pr AS (SELECT a.qid, a.backend, avg(CASE WHEN len(list_distinct(list_concat(a.w, b.w))) = 0 THEN 0.0 ELSE len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) END) AS red FROM evw a JOIN evw b ON a.qid = b.qid AND a.backend = b.backend AND a.rank < b.rank GROUP BY ALL),
 eva AS (SELECT qid, backend, count(*) AS k, list(w ORDER BY rank) AS ws, list(t ORDER BY rank) AS ts, list(s ORDER BY rank) AS ss, list(parent ORDER BY rank) AS ps, list(kind ORDER BY rank) AS ks, string_agg(lower(content), ' ' ORDER BY rank) AS whole0 FROM evw GROUP BY ALL),
 cnd AS (SELECT c.*, coalesce(k, 0) AS n, coalesce(ws, []) AS ws, ts, ss, ps, coalesce(ks, []) AS ks, coalesce(whole0, '') AS whole, red, {_DW.format("question")} AS q, regexp_extract_all(lower(question), {q(diagnostics.IDENTIFIERS)}) AS ids FROM (SELECT qid, question, route, keyword_route, unnest(['bm25', 'dense', 'kg', 'hybrid']) AS backend FROM kw) c LEFT JOIN eva USING (qid, backend) LEFT JOIN pr USING (qid, backend)),
 cf AS (SELECT qid, backend, """
        + ", ".join(f"round(coalesce({v}, 0)::DOUBLE, 6) AS {k}" for k, v in values.items())
        + " FROM cnd)"
    )


_CANDIDATES = _with(SQL["questions"], SQL["corpus"], _LEX_DOCS, _LEX_QS, _TF, _BM25, _EV, _BENCH, _FEATURES, _PENALTY, _KEYWORD, _candidate_sql())


@query(_CANDIDATES + "SELECT * FROM cf")
def candidate_features(spark, d):
    return diagnostics.candidate_features(routing.keyword_routes(routing.penalty_routes(questions(spark, d))), _candidate_evidence(spark, d))


_V4 = {"route__lexical_exactness": 0.5, "route__relational_bridge": -0.25, "evidence__top1_score": 2.0, "evidence__candidate_matches_computed_ras": 1.0, "evidence__redundancy": -1.0, "evidence__kg_path_completeness": 0.25}


def _v4_part(prefix: str, column: str) -> str:
    return " + ".join(f"{w} * {column.format(c.removeprefix(prefix))}" for c, w in sorted(_V4.items()) if c.startswith(prefix))


@query(
    _CANDIDATES + f"""SELECT qid, backend, combined, route_part, evidence_part, round(CASE WHEN place = 1 THEN combined - max(combined) FILTER (place = 2) OVER (PARTITION BY qid) ELSE max(combined) OVER (PARTITION BY qid) - combined END, 6) AS behind, place = 1 AS selected FROM (
 SELECT *, row_number() OVER (PARTITION BY qid ORDER BY combined DESC, list_position(['bm25', 'dense', 'kg', 'hybrid'], backend)) AS place FROM (SELECT *, round(0.1 + route_part + evidence_part, 6)::DOUBLE AS combined FROM (
 SELECT qid, backend, round({_v4_part("evidence__", "cf.{}")}, 6)::DOUBLE AS evidence_part, round(0.5 * (lexical OR {_any(_LOW, diagnostics.EXACT)})::INTEGER - 0.25 * (relational OR {_any(_LOW, diagnostics.RELATIONAL)})::INTEGER, 6)::DOUBLE AS route_part FROM cf JOIN kw USING (qid))))"""
)
def evidence_router(spark, d):
    routed = routing.keyword_routes(routing.penalty_routes(questions(spark, d)))
    candidates = diagnostics.candidate_features(routed, _candidate_evidence(spark, d))
    return diagnostics.evidence_routes(diagnostics.joint_features(diagnostics.route_features(routed), candidates), _V4, 0.1)


_GQ = "gq AS (SELECT n_nationkey AS qid, CASE n_nationkey % 4 WHEN 0 THEN 'Is c' || n_nationkey || ' a n3?' WHEN 1 THEN 'What path connects c' || n_nationkey || ' and r1?' WHEN 2 THEN 'What property has p' || n_nationkey || '?' ELSE 'Tell about n' || n_nationkey END AS question FROM nation)"


def _graph_questions(spark, d):
    n = F.col("n_nationkey")
    k = n.cast("string")
    text = F.when(n % 4 == 0, F.concat(F.lit("Is c"), k, F.lit(" a n3?"))).when(n % 4 == 1, F.concat(F.lit("What path connects c"), k, F.lit(" and r1?"))).when(n % 4 == 2, F.concat(F.lit("What property has p"), k, F.lit("?"))).otherwise(F.concat(F.lit("Tell about n"), k))
    return table(spark, d, "nation").select(n.alias("qid"), text.alias("question"))


@query(_with(SQL["edges"], _GQ) + ", nm AS (SELECT DISTINCT name FROM (SELECT subject AS name FROM edges UNION ALL SELECT object FROM edges)), tk AS (SELECT qid, unnest(t) AS token, unnest(range(0, len(t))) AS place FROM (SELECT qid, regexp_extract_all(lower(question), '[a-z0-9]+') AS t FROM gq)) ".lstrip() + "SELECT qid, name AS entity, min(place)::INTEGER AS place FROM tk JOIN nm ON lower(name) = token GROUP BY ALL")
def entity_mentions(spark, d):
    e = edges(spark, d)
    return asking.mentions(_graph_questions(spark, d), e.select(F.col("subject").alias("name")).union(e.select("object")).distinct())


@query(_with(SQL["edges"], _GQ) + ", qt AS (SELECT qid, unnest(t) AS token, len(t) AS n FROM (SELECT qid, list_distinct(regexp_extract_all(lower(question), '[a-z0-9]+')) AS t FROM gq)), ft AS (SELECT triple_id AS item_id, unnest(list_distinct(regexp_extract_all(lower(concat_ws(' ', subject, predicate, object)), '[a-z0-9]+'))) AS token FROM edges) ".lstrip() + "SELECT qid, item_id, round(count(*) / n, 6) AS score FROM qt JOIN ft USING (token) GROUP BY qid, item_id, n")
def lexical_facts(spark, d):
    return asking.lexical_facts(_graph_questions(spark, d), edges(spark, d))


#: Questions of every branch, and what their words mean to the graph of the given tables.
_ASKS = {
    0: ("Is c{} a n3?", "Is c{} a r1?"),
    1: ("What path connects c{} and r1?",),
    2: ("What property has p{}?",),
    3: ("Do all customers of n{} have segment building?",),
    4: ("Can some member of n{} be in the segment machinery?",),
    5: ("What belongs to n{}?",),
    6: ("Tell about the segment of c{}",),
    7: ("Tell about n{}", "What chain links c{} to n3?"),
}
_WORDS = asking.GraphWords(
    classes=tuple(f"n{i}" for i in range(25)),
    predicates={"segment": "in_segment", "property": "has_property"},
    objects={"building": "BUILDING", "machinery": "MACHINERY"},
    other_objects={"has_property": ("brand", "Brand#11")},
    able="in_segment",
    inverse=("what belongs", "is_a"),
    universal_object="BUILDING",
)


def _branch_questions(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("qid"))
    text = None
    for m, forms in _ASKS.items():
        for i, form in enumerate(forms):
            before, after = form.split("{}")
            one = F.concat(F.lit(before), F.col("qid").cast("string"), F.lit(after))
            hit = (F.col("qid") % 8 == m) & (F.floor(F.col("qid") / 8) % len(forms) == i)
            text = F.when(hit, one) if text is None else text.when(hit, one)
    return n.select("qid", text.alias("question"))


def _branch_sql(asked: str | None = None, k: int = 3) -> str:
    """The dispatch and its look-ups as SQL, for the questions of the branches or for ``asked``."""
    cases = []
    for m, forms in _ASKS.items():
        for i, form in enumerate(forms):
            before, after = form.split("{}")
            cases.append(f"WHEN n_nationkey % 8 = {m} AND (n_nationkey // 8) % {len(forms)} = {i} THEN {q(before)} || n_nationkey || {q(after)}")
    klass = " ".join(f"WHEN regexp_matches(low, {q(X.BEFORE + c + 's?' + X.AFTER)}) THEN {q(c)}" for c in _WORDS.classes)
    predicate = " ".join(f"WHEN regexp_matches(low, {q(X.BEFORE + w + X.AFTER)}) THEN {q(p)}" for w, p in _WORDS.predicates.items())
    target = " ".join(f"WHEN contains(low, {q(w)}) THEN {q(o)}" for w, o in _WORDS.objects.items())
    other = " ".join(f"WHEN {{}} = {q(p)} AND contains(low, {q(w)}) THEN {q(o)}" for p, (w, o) in _WORDS.other_objects.items())
    late = f"CASE WHEN (starts_with(low, 'can ') OR contains(low, ' able to ')) AND about IS NOT NULL AND able_target IS NOT NULL THEN 'existential' WHEN starts_with(low, {q(_WORDS.inverse[0])}) AND n >= 1 THEN 'inverse' WHEN predicate IS NOT NULL AND n >= 1 THEN 'relation' ELSE 'lexical' END"
    return (
        f"""gq AS ({asked or f'SELECT n_nationkey AS qid, CASE {" ".join(cases)} END AS question FROM nation'}),
 nm AS (SELECT DISTINCT name FROM (SELECT subject AS name FROM edges UNION ALL SELECT object FROM edges)),
 tk AS (SELECT qid, unnest(t) AS token, unnest(range(0, len(t))) AS place FROM (SELECT qid, regexp_extract_all(lower(question), '[a-z0-9]+') AS t FROM gq)),
 mt AS (SELECT qid, list(name ORDER BY place, name) AS es FROM (SELECT qid, name, min(place) AS place FROM tk JOIN nm ON lower(name) = token GROUP BY ALL) GROUP BY qid),
 u0 AS (SELECT qid, question, lower(question) AS low, coalesce(es, []) AS es, len(coalesce(es, [])) AS n FROM gq LEFT JOIN mt USING (qid)),
 u1 AS (SELECT *, CASE {klass} END AS klass, CASE {predicate} END AS predicate, es[1] AS e1, es[2] AS e2, es[n] AS el FROM u0),
 u2 AS (SELECT *, CASE {target} {other.format("predicate")} END AS target, CASE {target} {other.format(f"coalesce(predicate, {q(_WORDS.able)})")} END AS able_target, coalesce(klass, e1) AS about FROM u1),
 u3 AS (SELECT *, {late} AS later FROM u2),
 u AS (SELECT *, CASE WHEN {_any("low", S.UNIVERSAL)} AND predicate IS NOT NULL AND about IS NOT NULL THEN 'universal' WHEN {_any("low", asking.PROPERTY_WORDS)} AND n >= 1 THEN 'properties'
 WHEN {_any("low", asking.PATH_WORDS)} AND n >= 2 THEN 'path' WHEN {_starts("low", ("is ", "are "))} AND n >= 2 THEN 'membership' ELSE later END AS branch FROM u3),
 hop AS (SELECT e.subject AS a, f.object AS c, 'path:' || e.triple_id || '->' || f.triple_id AS item_id, concat_ws(' ', e.subject, e.predicate, e.object) || ' ; ' || concat_ws(' ', f.subject, f.predicate, f.object) AS content FROM edges e JOIN edges f ON e.object = f.subject),
 fact AS (SELECT *, concat_ws(' ', subject, predicate, object) AS content FROM edges),
 pt AS (SELECT qid, 'two_hop' AS mode, item_id, content, 6.0 AS score FROM u JOIN hop ON a = e1 AND c = el WHERE branch = 'path'),
 dr AS (SELECT qid, 'direct_relation', triple_id, content, 5.5 FROM u JOIN fact f ON f.subject = e1 AND f.object = el WHERE branch = 'path' AND qid NOT IN (SELECT qid FROM pt)),
 me AS (SELECT qid, 'membership' AS mode, triple_id AS item_id, content, 5.0 AS score FROM u JOIN fact f ON f.subject = e1 AND f.object = e2 AND f.predicate = 'is_a' WHERE branch = 'membership'),
 mi AS (SELECT qid, 'two_hop' AS mode, item_id, content, 6.0 AS score FROM u JOIN hop ON a = e1 AND c = e2 WHERE branch = 'membership' AND qid NOT IN (SELECT qid FROM me)),
 k AS (SELECT *, CASE WHEN branch = 'membership' THEN later ELSE branch END AS kind FROM u WHERE qid NOT IN (SELECT qid FROM me UNION ALL SELECT qid FROM mi)),
 mem AS (SELECT triple_id AS mid, subject AS member, object AS class FROM edges WHERE predicate = 'is_a'),
 un AS (SELECT qid, CASE WHEN f.predicate = k.predicate THEN 'universal_support' ELSE 'universal_counterexample' END, 'path:' || mid || '->' || f.triple_id, member || ' is_a ' || class || ' ; ' || f.content, CASE WHEN f.predicate = k.predicate THEN 4.0 ELSE 7.0 END FROM k JOIN mem ON class = about JOIN fact f ON f.subject = member AND f.object = coalesce(target, 'BUILDING') AND f.predicate IN (k.predicate, 'not_' || k.predicate) WHERE kind = 'universal'),
 ex AS (SELECT qid, 'property', triple_id, content, 5.0 FROM k JOIN fact f ON f.subject = about AND f.predicate = '{_WORDS.able}' AND f.object = able_target WHERE kind = 'existential' UNION ALL SELECT qid, 'existential', 'path:' || mid || '->' || f.triple_id, member || ' is_a ' || class || ' ; ' || f.content, 6.0 FROM k JOIN mem ON class = about JOIN fact f ON f.subject = member AND f.predicate = '{_WORDS.able}' AND f.object = able_target WHERE kind = 'existential'),
 pr AS (SELECT qid, 'property', triple_id, content, 5.0 FROM k JOIN fact f ON f.subject = e1 AND (f.predicate = 'has_property' OR contains(low, 'BUILDING') AND f.predicate = '{_WORDS.able}' AND f.object = 'BUILDING') WHERE kind = 'properties'),
 iv AS (SELECT qid, 'inverse_relation', triple_id, content, 5.0 FROM k JOIN fact f ON f.object = el AND f.predicate = 'is_a' WHERE kind = 'inverse'),
 rl AS (SELECT qid, 'relation', triple_id, content, 5.0 FROM k JOIN fact f ON f.subject = e1 AND f.predicate = k.predicate AND (target IS NULL OR target = f.object) WHERE kind = 'relation'),
 hit AS (SELECT * FROM pt UNION SELECT * FROM dr UNION SELECT * FROM me UNION SELECT * FROM mi UNION SELECT * FROM un UNION SELECT * FROM ex UNION SELECT * FROM pr UNION SELECT * FROM iv UNION SELECT * FROM rl),
 qt AS (SELECT qid, unnest(t) AS token, len(t) AS n FROM (SELECT qid, list_distinct(regexp_extract_all(low, '[a-z0-9]+')) AS t FROM u WHERE qid NOT IN (SELECT qid FROM hit))),
 ft AS (SELECT triple_id, content, unnest(list_distinct(regexp_extract_all(lower(content), '[a-z0-9]+'))) AS token FROM fact),
 allhit AS (SELECT * FROM hit UNION ALL SELECT qid, 'fallback', triple_id, content, round(count(*) / n, 6) FROM qt JOIN ft USING (token) GROUP BY qid, triple_id, content, n),
 got AS (SELECT qid, branch, mode, item_id, content, score::DOUBLE AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, item_id DESC) AS rank FROM allhit) JOIN u USING (qid) WHERE rank <= {k})"""
    )


_GOT = _with(SQL["edges"], _branch_sql())


@query(_GOT + "SELECT * FROM got")
def graph_retrieve(spark, d):
    return asking.graph_retrieve(_branch_questions(spark, d), edges(spark, d), 3, _WORDS)


@query(
    _GOT + """SELECT qid, CASE WHEN items IS NULL THEN 'insufficient evidence' WHEN modes[1] = 'universal_counterexample' THEN 'No. Counterexample evidence: ' || against || '. [evidence: ' || against_ids || ']'
 WHEN modes[1] = 'existential' THEN 'Yes. Existential support in the demo KG: ' || contents[1] || cite WHEN is_ AND starts_with(items[1], 'path:') THEN 'Yes, indirectly: ' || contents[1] || cite WHEN is_ THEN 'Yes. ' || contents[1] || cite
 WHEN contains(contents[1], 'not_capable_of') THEN 'No. ' || contents[1] || cite ELSE contents[1] || cite END AS answer
 FROM (SELECT gq.qid, starts_with(lower(question), 'is ') OR contains(lower(question), 'is a ') AS is_, items, contents, modes, against, against_ids, '. [evidence: ' || items[1] || ']' AS cite FROM gq LEFT JOIN (SELECT qid, list(item_id ORDER BY rank) AS items, list(content ORDER BY rank) AS contents, list(mode ORDER BY rank) AS modes,
 string_agg(CASE WHEN mode = 'universal_counterexample' THEN content END, '; ' ORDER BY rank) AS against, string_agg(CASE WHEN mode = 'universal_counterexample' THEN item_id END, ', ' ORDER BY rank) AS against_ids FROM got GROUP BY qid) USING (qid))"""
)
def graph_answers(spark, d):
    asked = _branch_questions(spark, d)
    return asking.graph_answers(asked, asking.graph_retrieve(asked, edges(spark, d), 3, _WORDS))


@query("WITH g AS (SELECT item_id AS qid, [item_id, item_id + 100000] AS gold FROM benchmark), x AS (SELECT qid, unnest(gold) AS id, len(gold) AS n FROM g) SELECT qid, count(doc_id) = max(n) AS covered, count(doc_id) AS found FROM x LEFT JOIN documents ON id = doc_id GROUP BY qid")
def gold_coverage(spark, d):
    g = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.explode(F.array("item_id", F.col("item_id") + 100000)).alias("doc_id"))
    ids = table(spark, d, "documents").select("doc_id", F.lit(1).alias("there"))
    return g.join(ids, "doc_id", "left").groupBy("qid").agg((F.count("there") == F.count("*")).alias("covered"), F.count("there").alias("found"))


@query(_SYS + ", m AS (SELECT system, avg((gold = predicted)::INTEGER) AS a FROM sys GROUP BY system), x AS (SELECT (SELECT a FROM m WHERE system = 'rules_v2') AS candidate, (SELECT a FROM m WHERE system = 'computed') AS base, (SELECT max(a) FROM m WHERE starts_with(system, 'always_')) AS fixed) ".lstrip() + "SELECT round(candidate - base, 6) AS delta, candidate >= fixed AS beats_fixed, CASE WHEN candidate - base >= 0.03 AND candidate >= fixed THEN 'promote' ELSE 'keep' END AS decision FROM x")
def promotion_gate(spark, d):
    m = _systems(spark, d).groupBy("system").agg(F.avg((F.col("gold") == F.col("predicted")).cast("double")).alias("a"))
    x = m.agg(F.max(F.when(F.col("system") == "rules_v2", F.col("a"))).alias("candidate"), F.max(F.when(F.col("system") == "computed", F.col("a"))).alias("base"), F.max(F.when(F.col("system").startswith("always_"), F.col("a"))).alias("fixed"))
    delta, fixed = F.col("candidate") - F.col("base"), F.col("candidate") >= F.col("fixed")
    return x.select(F.round(delta, 6).alias("delta"), fixed.alias("beats_fixed"), F.when((delta >= 0.03) & fixed, "promote").otherwise("keep").alias("decision"))


@query(_SYS + "SELECT c.family, c.qid, k.predicted AS rescued_by FROM sys c JOIN sys k ON c.qid = k.qid AND c.system = 'computed' AND k.system = 'keyword' WHERE c.predicted <> c.gold AND k.predicted = k.gold")
def failure_rescues(spark, d):
    s = _systems(spark, d)
    c = s.filter("system = 'computed' and predicted <> gold").select("qid", "family")
    return c.join(s.filter("system = 'keyword' and predicted = gold").select("qid", F.col("predicted").alias("rescued_by")), "qid").select("family", "qid", "rescued_by")


@query(_SYS + ", a AS (SELECT system, family, avg((gold = predicted)::INTEGER) AS a FROM sys GROUP BY ALL), b AS (SELECT family, max(a) FILTER (system = 'computed') AS base FROM a GROUP BY family) ".lstrip() + "SELECT system, family, round(a - base, 6) AS gain FROM a JOIN b USING (family) WHERE a > base")
def baseline_wins(spark, d):
    from pyspark.sql import Window

    a = _systems(spark, d).groupBy("system", "family").agg(F.avg((F.col("gold") == F.col("predicted")).cast("double")).alias("a"))
    base = F.max(F.when(F.col("system") == "computed", F.col("a"))).over(Window.partitionBy("family"))
    return a.withColumn("base", base).filter("a > base").select("system", "family", F.round(F.col("a") - F.col("base"), 6).alias("gain"))


@query(f"SELECT page_id, trim(regexp_replace(regexp_replace(text, 'https?://\\S+', ' ', 'g'), '\\s+', ' ', 'g'))[1:5000] AS text FROM (SELECT page_id, {_PLAIN} AS text FROM pages)")
def public_text(spark, d):
    return table(spark, d, "pages").select("page_id", X.public_text(F.col("html")).alias("text"))


_ALIASES = {"region": "area", "nations": "nation", "building": "construction"}


@query("SELECT c_custkey, c_mktsegment, CASE WHEN lower(c_mktsegment) = 'building' THEN 'construction' ELSE replace(lower(c_mktsegment), ' ', '_') END AS form FROM customer")
def entity_forms(spark, d):
    return table(spark, d, "customer").select("c_custkey", "c_mktsegment", X.entity_form(F.col("c_mktsegment"), _ALIASES).alias("form"))


@query("SELECT source, CASE WHEN starts_with(triple_id, 'xkg_') THEN 'extracted' ELSE 'curated' END AS provenance, count(*) AS n FROM (" + _with(SQL["edges"]) + "SELECT CASE WHEN source = 'part' THEN 'xkg_' || triple_id ELSE triple_id END AS triple_id, source FROM edges) GROUP BY ALL")
def graph_provenance(spark, d):
    e = edges(spark, d).withColumn("triple_id", F.when(F.col("source") == "part", F.concat(F.lit("xkg_"), "triple_id")).otherwise(F.col("triple_id")))
    return e.groupBy("source", X.provenance(F.col("triple_id")).alias("provenance")).agg(F.count("*").alias("n"))


@query(_with(SQL["questions"], SQL["user_turns"], _ALL, _FEATURES) + ", e(feature, backend, delta) AS (VALUES ('lexical', 'bm25', -0.6::DOUBLE), ('lexical', 'dense', 0.2), ('semantic', 'dense', -0.5), ('deductive', 'kg', -0.6), ('relational', 'hybrid', -0.7), ('relational', 'kg', -0.2)) ".lstrip() + "SELECT qid, feature, backend, delta FROM feat, e WHERE CASE feature WHEN 'lexical' THEN lexical WHEN 'semantic' THEN semantic WHEN 'deductive' THEN deductive ELSE relational END")
def route_feature_effects(spark, d):
    return routing.feature_effects(_all_questions(spark, d), "qid")


@query(_SYS + "SELECT system AS config, round(avg((gold = predicted)::INTEGER), 6) AS accuracy, count_if(predicted <> base) AS overrides FROM (SELECT s.*, c.predicted AS base FROM sys s JOIN sys c USING (qid) WHERE c.system = 'computed' AND s.system IN ('computed', 'keyword', 'rules_v2')) GROUP BY system ORDER BY accuracy DESC, overrides, config LIMIT 1")
def tuned_config(spark, d):
    s = _systems(spark, d).filter(F.col("system").isin("computed", "keyword", "rules_v2"))
    base = s.filter("system = 'computed'").select("qid", F.col("predicted").alias("base"))
    rows = s.join(base, "qid").withColumn("changed", F.col("predicted") != F.col("base")).withColumnRenamed("system", "config")
    return routing.tune(rows, "config", "predicted", "gold", "changed")


@query(_SYS + ", m AS (SELECT system, avg((gold = predicted)::INTEGER) AS value FROM sys GROUP BY system) ".lstrip() + "SELECT claim, CASE WHEN ties THEN p.value >= b.value ELSE p.value > b.value END AS supported FROM (VALUES ('routing beats bm25', 'computed', 'always_bm25', false), ('routing beats graph', 'computed', 'always_kg', false), ('rules do not hurt', 'rules_v2', 'computed', true)) c(claim, prim, baseline, ties) JOIN m p ON p.system = prim JOIN m b ON b.system = baseline")
def claim_validation(spark, d):
    m = _systems(spark, d).groupBy("system").agg(F.avg((F.col("gold") == F.col("predicted")).cast("double")).alias("value"))
    stated = spark.createDataFrame([("routing beats bm25", "computed", "always_bm25", False), ("routing beats graph", "computed", "always_kg", False), ("rules do not hurt", "rules_v2", "computed", True)], "claim string, primary string, baseline string, ties boolean")
    return metrics.claims(m, stated)


@query(_with(_SENT, _FOUND) + "SELECT 'qlg_' || lpad((row_number() OVER (ORDER BY doc_id, pattern_no, sentence_no, match_no, subject, object) - 1)::VARCHAR, 4, '0') || '_' || doc_id AS triple_id, subject, predicate, object, doc_id FROM (SELECT subject, predicate, object, x.doc_id AS doc_id, x.pattern_no AS pattern_no, x.sentence_no AS sentence_no, x.match_no AS match_no FROM (SELECT subject, predicate, object, min({'doc_id': doc_id, 'pattern_no': pattern_no, 'sentence_no': sentence_no, 'match_no': match_no}) AS x FROM found WHERE subject <> object GROUP BY ALL)) ORDER BY doc_id, pattern_no, sentence_no, match_no, subject, object LIMIT 80")
def query_local_graph(spark, d):
    return graph.local_graph(_extracted(spark, d))


@query(_EVIDENCE + " SELECT qid, 'Question: ' || question || chr(10) || 'Evidence:' || chr(10) || string_agg('- ' || content, chr(10) ORDER BY rank) AS prompt FROM ev GROUP BY qid, question")
def prompts(spark, d):
    e = _evidence(spark, d).groupBy("qid", "question").agg(F.array_sort(F.collect_list(F.struct("rank", "content"))).alias("e"))
    return e.select("qid", answering.prompt(F.col("question"), F.transform("e", lambda x: x["content"])).alias("prompt"))


@query("SELECT event_id, CASE WHEN event_type = 'click' THEN 'A' WHEN event_type = 'view' THEN 'B' END AS choice, CASE WHEN event_id % 5 BETWEEN 1 AND 3 THEN (event_id % 5)::INTEGER ELSE 0 END AS score FROM events")
def coerced_annotations(spark, d):
    e = table(spark, d, "events")
    raw = F.when(F.col("event_type") == "click", " a").when(F.col("event_type") == "view", "B ").otherwise("?")
    return e.select("event_id", S.choice(raw).alias("choice"), S.rating((F.col("event_id") % 5).cast("string")).alias("score"))


@query(None)
def stream_route_counts(spark, d):
    return route_counts(table(spark, d, "events"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Every benchmark question routed, its evidence retrieved and its answer written."""
    return answers_templated(spark, d)


# registers its queries here
from . import evaluations, evidence  # noqa: E402, F401
