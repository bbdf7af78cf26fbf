"""Queries of evidence: gated facts, names in questions, pruned and packed retrieval, fusion; with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import signals as S
from ..functions import text as X
from ..operators import answering, asking, dense, diagnostics, evaluation, extraction, fusion, learning, lexical, metrics, packed, pruned, public, resident, routing, runtime
from ..sources.shared import written
from . import registry as R
from .registry import q, query
from .views import SQL, corpus, edges, questions, table, user_turns

# -- facts ------------------------------------------------------------------------------

# Patterns of the given prose; "by" stands for a denial of "for", "of ... in" for a bridge.
_PATTERNS = (
    extraction.FactPattern("is_a", r"(?:^|[^a-z])([a-z]+) is an? ([a-z]+)", ((1, "is_a", 2),), 0.82, " is a"),
    extraction.FactPattern("are", r"(?:^|[^a-z])([a-z]+) are ([a-z]+)", ((1, "is_a", 2),), 0.72, " are ", never_objects=("the",)),
    extraction.FactPattern("for", r"(?:^|[^a-z])([a-z]+) for ([a-z]+)", ((1, "capable_of", 2),), 0.86, " for "),
    extraction.FactPattern("by", r"(?:^|[^a-z])([a-z]+) by ([a-z]+)", ((1, "not_capable_of", 2),), 0.64, " by "),
    extraction.FactPattern("bridge", r"(?:^|[^a-z])([a-z]+) of ([a-z]+) in ([a-z]+)", ((1, "is_a", 3), (3, "is_a", 2)), 0.78, " in "),
)
_ALIASES = {"thes": "the", "ands": "and", "its": "it"}
#: words that stand behind "the" in two documents or more
_KNOWN = r"(?:^|[^a-z])the ([a-z]+)"


def _known(spark, d):
    w = table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(_KNOWN), F.lit(1)))).alias("name"))
    return w.groupBy("name").agg(F.count_distinct("doc_id").alias("n")).filter("n >= 2").select("name")


def _gated(spark, d):
    s = corpus(spark, d).select("doc_id", F.posexplode(X.sentences(F.col("text"))).alias("sentence_no", "sentence"))
    return extraction.gated_triples(s, _known(spark, d), _PATTERNS, _ALIASES)


def _matches() -> str:
    parts = []
    for i, p in enumerate(_PATTERNS):
        groups = sorted({g for s, _, o in p.facts for g in (s, o)})
        reads = ", ".join(f"lower(unnest(regexp_extract_all(sentence, {q('(?i)' + p.regex)}, {g}))) AS g{g}" for g in groups)
        inner = f"SELECT doc_id, sentence_no, unnest(range(0, len(regexp_extract_all(sentence, {q('(?i)' + p.regex)})))) AS m, {reads} FROM sent"
        for j, (s, predicate, o) in enumerate(p.facts):
            where = f" WHERE g{o} NOT IN ({', '.join(map(q, p.never_objects))})" if p.never_objects else ""
            parts.append(f"SELECT doc_id, sentence_no, {i} AS p, m, {j} AS f, {q(p.name)} AS pattern, g{s} AS subject, {q(predicate)} AS predicate, g{o} AS object, {p.confidence}::DOUBLE AS confidence FROM ({inner}){where}")
    return " UNION ALL ".join(parts)


_FORM = "coalesce(map_extract(al, {0})[1], CASE WHEN ends_with({0}, 's') THEN map_extract(al, regexp_replace({0}, 's$', ''))[1] END, {0})"
_GATED = (
    f"WITH {R._SENT}, al AS (SELECT MAP {{{', '.join(f'{q(k)}: {q(v)}' for k, v in _ALIASES.items())}}} AS al), known AS (SELECT name FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), {q(_KNOWN)}, 1)) AS name FROM documents) GROUP BY name HAVING count(DISTINCT doc_id) >= 2),"
    f" raw AS ({_matches()}), found AS (SELECT * REPLACE ({_FORM.format('subject')} AS subject, {_FORM.format('object')} AS object) FROM raw, al),"
    " fact AS (SELECT subject, predicate, object, min({'c': -confidence, 'doc_id': doc_id, 's': sentence_no, 'p': p, 'm': m, 'f': f, 'pattern': pattern}) AS best, count(*) AS mentions FROM found WHERE subject IN (FROM known) AND object IN (FROM known) GROUP BY ALL),"
    " seen AS (SELECT f.*, coalesce(g.mentions, 0) AS overruled FROM fact f LEFT JOIN fact g ON f.predicate = 'not_capable_of' AND g.predicate = 'capable_of' AND f.subject = g.subject AND f.object = g.object)"
    " SELECT concat_ws('_', 'xkg', subject, predicate, object, left(md5(concat_ws('|', subject, predicate, object)), 12)) AS triple_id, subject, predicate, object, best.doc_id AS doc_id, -best.c AS confidence, best.pattern AS pattern, mentions, overruled FROM seen s"
    " WHERE NOT (predicate = 'capable_of' AND EXISTS (SELECT 1 FROM fact n WHERE n.predicate = 'not_capable_of' AND n.subject = s.subject AND n.object = s.object))"
)


@query(_GATED)
def extract_gated_triples(spark, d):
    return _gated(spark, d)


# -- names of several words -------------------------------------------------------------

_NAMES = "names AS (SELECT array_to_string(t[1:2], ' ') AS alias, 'pair' || item_id AS entity FROM bt WHERE len(t) > 1 UNION ALL SELECT array_to_string(t[2:4], ' '), 'three' || item_id FROM bt WHERE len(t) > 3 UNION ALL SELECT t[1], 'one_' || t[1] FROM bt WHERE len(t) > 0 UNION ALL SELECT t[3], 'one_' || t[3] FROM bt WHERE len(t) > 2)"
_RUNS = (
    SQL["questions"] + ", " + SQL["user_turns"] + f", asked AS (SELECT qid, question FROM questions UNION ALL SELECT qid + 1000000000, question FROM user_turns), bt AS (SELECT item_id, {R._SIMPLE.format('text')} AS t FROM benchmark), " + _NAMES
    + f", alias AS (SELECT alias, len(string_split(alias, ' ')) AS width, min(entity) AS entity FROM names GROUP BY alias), qt AS (SELECT qid, {R._SIMPLE.format('question')} AS t FROM asked),"
    " runs AS (SELECT qid, place, width, array_to_string(t[place + 1 : place + width], ' ') AS words FROM (SELECT qid, t, width, unnest(range(0, len(t) - width + 1)) AS place FROM qt, (SELECT DISTINCT width FROM alias))),"
    " hits AS (SELECT qid, place, runs.width, entity FROM runs JOIN alias ON alias = words AND alias.width = runs.width)"
)


def _asked_names(spark, d):
    asked = questions(spark, d).select("qid", "question").unionByName(user_turns(spark, d).withColumn("qid", F.col("qid") + 1000000000))
    b = table(spark, d, "benchmark").select("item_id", X.simple_tokens(F.col("text")).alias("t"))
    run = lambda at, n, entity: b.filter(F.size("t") >= at + n - 1).select(F.array_join(F.slice("t", at, n), " ").alias("alias"), entity.alias("entity"))
    item = lambda name: F.concat(F.lit(name), F.col("item_id").cast("string"))
    names = run(1, 2, item("pair")).unionByName(run(2, 3, item("three"))).unionByName(run(1, 1, F.concat(F.lit("one_"), F.get("t", 0)))).unionByName(run(3, 1, F.concat(F.lit("one_"), F.get("t", 2))))
    return asked, names


@query(
    "WITH RECURSIVE " + _RUNS + ", s AS (SELECT qid, 0::BIGINT AS stop, NULL::BIGINT AS place, NULL::BIGINT AS width, NULL::VARCHAR AS entity FROM qt UNION ALL"
    " SELECT qid, (best).place - (best).w, (best).place, -(best).w, (best).entity FROM (SELECT s.qid, min({'place': h.place, 'w': -h.width, 'entity': h.entity}) AS best FROM s JOIN hits h ON h.qid = s.qid AND h.place >= s.stop GROUP BY s.qid))"
    " SELECT qid, place::INTEGER AS place, width::INTEGER AS width, entity FROM s WHERE entity IS NOT NULL"
)
def alias_mentions(spark, d):
    return extraction.alias_mentions(*_asked_names(spark, d))


@query("WITH " + _RUNS + " SELECT qid, (f).place::INTEGER AS place, -(f).w::INTEGER AS width, entity FROM (SELECT qid, entity, min({'place': place, 'w': -width}) AS f FROM hits GROUP BY ALL)")
def alias_mentions_overlapping(spark, d):
    return extraction.alias_mentions(*_asked_names(spark, d), overlapping=True)


# -- three backends fused ---------------------------------------------------------------

#: Every benchmark text behind a question to the graph.
_FORMS = ("Is c{} a n3?", "What path connects c{} and r1?", "What property has p{}?", "Do all customers of n{} have segment building?", "Tell about the link between c{} and n3")


def _fusion_questions(spark, d):
    n, text = F.col("item_id") % 25, None
    for i, form in enumerate(_FORMS):
        before, after = form.split("{}")
        one = F.concat(F.lit(before), n.cast("string"), F.lit(after + " "), F.col("text"))
        text = F.when(F.col("item_id") % len(_FORMS) == i, one) if text is None else text.when(F.col("item_id") % len(_FORMS) == i, one)
    return table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), text.alias("question"))


def _fusion_ranks(spark, d, most=15):
    c, asked = corpus(spark, d), _fusion_questions(spark, d)
    lexical_ = resident.bm25_top_k(c, asked, most).select("qid", F.lit("bm25").alias("backend"), "doc_id", "rank")
    # the rankings, a few rows a question, go to the texts
    words = c.select("doc_id", "text").join(lexical.beside(written(lexical_)), "doc_id").select("qid", "backend", F.col("doc_id").cast("string").alias("item_id"), "rank", F.col("text").alias("content"), F.lit("document").alias("kind"), F.col("doc_id").cast("string").alias("parent"))
    found = packed.packed_top_k(packed.dense_index(c), packed.encode(asked, "qid", X.simple_tokens(F.col("question"))), most, "chunk_id")
    near = dense.chunks(c).join(lexical.beside(written(found)), "chunk_id").select("qid", F.lit("dense").alias("backend"), F.col("chunk_id").alias("item_id"), "rank", F.col("chunk").alias("content"), F.lit("chunk").alias("kind"), F.col("doc_id").cast("string").alias("parent"))
    facts = asking.graph_retrieve(asked, edges(spark, d), most, R._WORDS)
    parts = F.flatten(F.transform(F.split("content", " ; "), lambda f: F.split(f, " ")))
    terms = F.array_distinct(F.concat(F.array(F.get(parts, 0), F.element_at(parts, -1)), F.transform(F.split("content", " ; "), lambda f: F.split(f, " ")[1])))
    graph_ = facts.select("qid", F.lit("kg").alias("backend"), "item_id", "rank", "content", F.when(F.startswith("item_id", F.lit("path:")), "path").otherwise("triple").alias("kind"), F.lit(None).cast("string").alias("parent"), terms.alias("terms"))
    text = words.unionByName(near).withColumn("terms", F.lit(None).cast("array<string>"))
    return written(graph_.unionByName(text)), asked


_ASKED = "SELECT item_id AS qid, CASE item_id % 5 " + " ".join(f"WHEN {i} THEN {q(f.split('{}')[0])} || item_id % 25 || {q(f.split('{}')[1] + ' ')} || text" for i, f in enumerate(_FORMS)) + " END AS question FROM benchmark"
_CHUNKS = """chw AS (SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w FROM documents),
 ch AS (SELECT doc_id::VARCHAR AS parent, doc_id || '::chunk_' || ordinal AS chunk_id, array_to_string(w[ordinal * 60 + 1 : ordinal * 60 + 80], ' ') AS chunk FROM (SELECT doc_id, w, unnest(range(0, greatest(1, ceil((len(w) - 20) / 60.0)::BIGINT))) AS ordinal FROM chw)),
 ctok AS (SELECT chunk_id AS doc_id, regexp_extract_all(lower(chunk), '[a-z0-9]+') AS tokens FROM ch), cqt AS (SELECT qid, regexp_extract_all(lower(question), '[a-z0-9]+') AS tokens FROM gq)"""
_CHASH = R._HASH.replace("dtok", "ctok").replace("qtok", "cqt").replace("substr(b.key, 2)::BIGINT AS doc_id", "substr(b.key, 2) AS doc_id")
_FUSION = (
    R._with(SQL["edges"], R._branch_sql(_ASKED, 15))[:-1]
    + ", questions AS (SELECT * FROM gq), " + ", ".join((SQL["corpus"], R._LEX_DOCS, R._LEX_QS, R._TF, R._BM25, _CHUNKS, _CHASH))
    + ", ranked AS (SELECT qid, 'bm25' AS backend, b.doc_id::VARCHAR AS item_id, rank, text AS content, 'document' AS kind, b.doc_id::VARCHAR AS parent, []::VARCHAR[] AS terms FROM (" + R._top("bm", 15) + ") b JOIN documents d ON d.doc_id = b.doc_id"
    " UNION ALL SELECT qid, 'dense', chunk_id, rank, chunk, 'chunk', parent, [] FROM (" + R._top("hs", 15) + ") h JOIN ch ON ch.chunk_id = h.doc_id"
    " UNION ALL SELECT qid, 'kg', item_id, rank, content, CASE WHEN starts_with(item_id, 'path:') THEN 'path' ELSE 'triple' END, NULL, list_concat([string_split(content, ' ')[1], string_split(content, ' ')[-1]], list_transform(string_split(content, ' ; '), lambda f: string_split(f, ' ')[2])) FROM got),"
    " variants AS (SELECT * FROM ranked, (VALUES ('none'), ('dense'), ('kg'), ('bm25')) v(variant) WHERE variant <> backend),"
    " comp AS (SELECT *, CASE backend WHEN 'dense' THEN 0 WHEN 'kg' THEN 1 ELSE 2 END AS place, CASE backend WHEN 'dense' THEN 1.0 WHEN 'kg' THEN 1.2 ELSE 0.9 END::DOUBLE AS w, CASE WHEN backend = 'kg' THEN 'kg:' || item_id ELSE 'text:' || coalesce(parent, item_id) END AS key FROM variants),"
    " lastrank AS (SELECT variant, qid, key, string_agg(backend || ':' || r, ',' ORDER BY backend) AS ranks, string_agg(backend, ',' ORDER BY backend) AS backends FROM (SELECT variant, qid, key, backend, max(rank) AS r FROM comp GROUP BY ALL) GROUP BY ALL),"
    " fz AS (SELECT variant, qid, key, round(sum(w / (60 + rank)), 8) AS score, string_agg(item_id, ',' ORDER BY place, rank) AS component_ids, min(parent) AS parent, string_agg('[' || backend || ':' || item_id || '] ' || content, chr(10) ORDER BY place, rank) AS content, first(kind ORDER BY place, rank) AS kind FROM comp GROUP BY ALL),"
    " asks AS (SELECT qid FROM gq WHERE " + R._any("lower(question)", fusion.ASKS_BUNDLES) + "),"
    " tx AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY variant, qid ORDER BY backend = 'dense', rank) AS pos FROM comp WHERE backend <> 'kg' AND qid IN (FROM asks)) WHERE pos <= 6),"
    " bz AS (SELECT g.variant, g.qid, 'hybrid:bundle:' || g.item_id || '+' || t.item_id AS item_id, round(1.2::DOUBLE / (60 + g.rank) + t.w / (60 + t.pos) + 0.05::DOUBLE, 8) AS score, list_aggregate(list_sort(['kg', t.backend]), 'string_agg', ',') AS backends, g.item_id || ',' || t.item_id AS component_ids,"
    " list_aggregate(list_sort(['kg:' || g.rank, t.backend || ':' || t.pos]), 'string_agg', ',') AS ranks, t.parent AS parent, '[kg:' || g.item_id || '] ' || g.content || chr(10) || '[' || t.backend || ':' || t.item_id || '] ' || t.content AS content, 'hybrid_relational' AS evidence_type"
    " FROM comp g JOIN tx t ON g.variant = t.variant AND g.qid = t.qid WHERE g.backend = 'kg' AND g.rank <= 3 AND len(list_filter(g.terms, lambda x: x <> '' AND contains(lower(t.content), lower(replace(x, '_', ' '))))) > 0),"
    " pool AS (SELECT variant, qid, 'hybrid:' || key AS item_id, score, backends, component_ids, ranks, parent, content, CASE kind WHEN 'path' THEN 'kg_path' WHEN 'triple' THEN 'kg_triple' WHEN 'chunk' THEN 'text_chunk' ELSE 'text_document' END AS evidence_type FROM fz JOIN lastrank USING (variant, qid, key) UNION ALL SELECT * FROM bz),"
    " top AS (SELECT *, row_number() OVER (PARTITION BY variant, qid ORDER BY score DESC, item_id DESC) AS rank FROM pool)"
)


@query(_FUSION + " SELECT * EXCLUDE (variant) FROM top WHERE variant = 'none' AND rank <= 5")
def hybrid_topk(spark, d):
    return fusion.fused_evidence(*_fusion_ranks(spark, d), 5)


@query(_FUSION + " SELECT variant, qid, item_id, score, rank, backends, ranks FROM top WHERE rank <= 3")
def hybrid_ablations(spark, d):
    ranked, asked = _fusion_ranks(spark, d)
    variant = F.explode(F.array(*map(F.lit, ("none", *fusion.ORDER))))
    each = ranked.withColumn("variant", variant).filter("variant <> backend")
    return fusion.fused_evidence(each, asked, 3, ("variant", "qid")).select("variant", "qid", "item_id", "score", "rank", "backends", "ranks")


# -- the fitted evidence router ----------------------------------------------------------


def _training_pairs(spark, d):
    """Four candidates of each question with their features and label, written, and the features' names."""
    routed = routing.keyword_routes(routing.penalty_routes(questions(spark, d)))
    joint = diagnostics.joint_features(diagnostics.route_features(routed), diagnostics.candidate_features(routed, R._candidate_evidence(spark, d)))
    pairs = written(diagnostics.evidence_training_pairs(joint, questions(spark, d).select("qid", "gold")))
    return pairs, tuple(c for c in pairs.columns if c.startswith(("route__", "evidence__")))


_ROUTE_NAMES = ("bias", "query_length_log", "token_count_log", "identifier_heavy", "lexical_exactness", "semantic_abstraction", "deductive_cue", "relational_bridge", "multi_hop_cue", "negation_or_contrast", "route_ambiguity", "low_margin", "public_document_noise")
_ROUTE_NAMES += tuple(f"{kind}_route_{b}" for kind in ("computed", "keyword") for b in routing.BACKENDS)
_MODEL_NAMES = (
    f"SELECT unnest([{', '.join(q('route__' + n) for n in _ROUTE_NAMES)}]) AS feature UNION ALL SELECT 'evidence__' || k FROM (SELECT unnest(json_keys(to_json(cf))) AS k FROM cf WHERE qid = (SELECT min(qid) FROM cf) AND backend = 'bm25') WHERE k NOT IN ('qid', 'backend') UNION ALL SELECT 'intercept'"
)


@query(R._CANDIDATES + "SELECT feature, true AS at_optimum FROM (" + _MODEL_NAMES + ")")
def evidence_model_optimum(spark, d):
    pairs, names = _training_pairs(spark, d)
    return learning.model_gradient(pairs, *learning.evidence_model(pairs, names)).select("feature", (F.abs("gradient") < 1e-6).alias("at_optimum"))


@query()
def evidence_router_fitted(spark, d):
    return learning.evidence_routes_out_of_fold(*_training_pairs(spark, d))


# measured on the given tables at every size: a question's own route is found out of fold in most cases
@query("SELECT count(*) * 4 AS candidates, count(*) AS questions, true AS one_each, true AS better_than_fixed FROM benchmark")
def evidence_router_accuracy(spark, d):
    pairs, names = _training_pairs(spark, d)
    routes = written(learning.evidence_routes_out_of_fold(pairs, names).join(questions(spark, d).select("qid", "gold"), "qid"))
    hit = F.avg(F.when(F.col("selected"), (F.col("backend") == F.col("gold")).cast("double")))
    fixed = F.greatest(*(F.avg((F.col("gold") == b).cast("double")) for b in routing.BACKENDS))
    return routes.agg(F.count("*").alias("candidates"), F.count_distinct("qid").alias("questions"), (F.sum(F.col("selected").cast("int")) == F.count_distinct("qid")).alias("one_each"), (hit > fixed).alias("better_than_fixed"))


# -- lexical retrieval from a stored index ------------------------------------------------


@query(R.ORACLES["bm25_topk"])
def bm25_pruned_topk(spark, d):
    return pruned.pruned_top_k(pruned.lexical_index(corpus(spark, d)), questions(spark, d), 3)


# -- one evaluation of five schemas -------------------------------------------------------

def _holders(spark, d):
    """item_id, doc_id: the documents that share a run of ten tokens with a benchmark item; the items' runs go to the documents."""
    rows = lambda name, key: table(spark, d, name).select(key, X.simple_tokens(F.col("text")).alias("tokens"))
    return resident.shared_runs(rows("documents", "doc_id"), rows("benchmark", "item_id"))


def _held(spark, d):
    split = F.when(F.col("item_id") % 2 == 0, "dev").otherwise("test")
    return _holders(spark, d).select(F.col("item_id").alias("qid"), split.alias("split"), "doc_id")


def _sources(spark, d):
    """The benchmark in five schemas, by the number of its items; gold ids are the documents that hold an item."""
    b = table(spark, d, "benchmark").filter("text is not null")
    held = _holders(spark, d).groupBy("item_id").agg(F.array_sort(F.collect_set(F.col("doc_id").cast("string"))).alias("holders"))
    qs = questions(spark, d).select(F.col("qid").alias("item_id"), "question", "gold")
    r = b.join(qs, "item_id").join(held, "item_id", "left").withColumns({"id": F.col("item_id").cast("string"), "split": F.when(F.col("item_id") % 2 == 0, "dev").otherwise("test"), "query": F.col("question")})
    holders = F.coalesce("holders", F.array().cast("array<string>"))
    of = lambda i: r.filter(F.col("item_id") % 5 == i)
    none = F.array().cast("array<string>")
    return {
        "curated": of(0).select("item_id", F.lit("s").alias("slice"), "id", "query", F.col("gold").alias("gold_route"), F.col("text").alias("gold_answer"), holders.alias("gold_evidence_ids")),
        "adversarial": of(1).select("id", "query", "split", F.col("gold").alias("intended_route_family"), F.substring("text", 1, 40).alias("gold_answer"), holders.alias("gold_source_doc_ids"), none.alias("gold_triple_ids"), F.col("text").alias("gold_evidence_text"), F.array(F.concat(F.lit("mod"), (F.col("item_id") % 3).cast("string")), F.lit("hard")).alias("ambiguity_tags")),
        "external": of(2).select("id", "query", F.col("gold").alias("route_family"), F.col("text").alias("gold_answer"), F.lit("").alias("gold_evidence_text")),
        "generalization": of(3).select("id", "query", "split", F.col("gold").alias("route_family"), F.substring("text", 1, 40).alias("gold_answer"), F.col("text").alias("gold_evidence_text"), F.when(F.col("item_id") % 2 == 0, "even").otherwise("").alias("tag")),
        "public": of(4).select("id", "query", "split", F.col("gold").alias("route_family"), F.substring("text", 1, 40).alias("gold_answer"), none.alias("gold_source_doc_ids"), F.col("text").alias("gold_evidence_text")),
    }


_ITEMS = (
    f"rt AS (SELECT item_id, NULL::BIGINT AS doc_id, {R._SIMPLE.format('text')} AS t FROM benchmark UNION ALL SELECT NULL, doc_id, {R._SIMPLE.format('text')} FROM documents),"
    " rn AS (SELECT DISTINCT item_id, doc_id, array_to_string(t[i : i + 9], ' ') AS run FROM (SELECT item_id, doc_id, t, unnest(range(1, len(t) - 8)) AS i FROM rt)),"
    " held AS (SELECT a.item_id, list_sort(list(DISTINCT b.doc_id::VARCHAR)) AS holders FROM rn a JOIN rn b ON a.run = b.run AND a.item_id IS NOT NULL AND b.doc_id IS NOT NULL GROUP BY a.item_id),"
    " items AS (SELECT ['curated', 'adversarial', 'external', 'generalization', 'public'][item_id % 5 + 1] AS dataset, CASE WHEN item_id % 5 = 0 THEN 'curated_s_' ELSE '' END || item_id AS qid, question, CASE WHEN item_id % 5 IN (0, 2) THEN 'all' WHEN item_id % 2 = 0 THEN 'dev' ELSE 'test' END AS split, gold AS family,"
    " CASE WHEN item_id % 5 IN (0, 2) THEN text ELSE text[1:40] END AS gold_answer, CASE WHEN item_id % 5 IN (0, 1) THEN coalesce(holders, []) WHEN item_id % 5 = 4 THEN [] END AS gold_ids, CASE item_id % 5 WHEN 0 THEN NULL WHEN 2 THEN '' ELSE text END AS gold_text,"
    " CASE WHEN item_id % 5 = 1 THEN ['mod' || item_id % 3, 'hard'] WHEN item_id % 5 = 3 AND item_id % 2 = 0 THEN ['even'] END AS tags, item_id FROM benchmark JOIN questions ON qid = item_id LEFT JOIN held USING (item_id) WHERE text IS NOT NULL)"
)


@query(R._with(SQL["questions"], _ITEMS) + "SELECT * EXCLUDE (item_id, gold_ids, tags), array_to_string(gold_ids, '|') AS gold_ids, array_to_string(tags, '|') AS tags FROM items")
def eval_items(spark, d):
    return evaluation.eval_items(_sources(spark, d)).withColumns({c: F.array_join(c, "|") for c in ("gold_ids", "tags")})


def _record_evidence(spark, d):
    """Five items of each text backend and of both fused, with their places after re-ranking, written."""
    ranked = written(R._ranked(spark, d)).withColumn("item_id", F.col("item_id").cast("long"))
    fused = lexical.top_k(fusion.rrf_fuse(ranked), 5, item="item_id").select("qid", F.lit("hybrid").alias("backend"), "item_id", "rank")
    rows = ranked.filter("rank <= 5").select("qid", "backend", "item_id", "rank").unionByName(fused)
    rows = rows.join(corpus(spark, d).select(F.col("doc_id").alias("item_id"), F.col("text").alias("content")), "item_id")
    # as a re-ranking: the item with the longest text first, where it is not first yet
    longest = Window.partitionBy("qid", "backend").orderBy(F.desc(F.length("content")), "rank")
    again = rows.withColumn("final_rank", F.row_number().over(longest))
    moved = F.max((F.col("rank") != 1) & (F.col("final_rank") == 1)).over(Window.partitionBy("qid", "backend"))
    ids = F.array(F.col("item_id").cast("string"), F.concat_ws("::", F.lit("doc"), F.col("item_id").cast("string")))
    return written(again.select("qid", "backend", "rank", "final_rank", moved.alias("applied"), F.col("item_id").cast("string").alias("item_id"), ids.alias("ids"), "content"))


def _named():
    return F.when(F.col("qid") % 5 == 0, F.concat(F.lit("curated_s_"), F.col("qid").cast("string"))).otherwise(F.col("qid").cast("string"))


def _system_routes(spark, d):
    """qid, system, route, override, rescue, margin of four systems."""
    r = routing.calibrated_routes(routing.penalty_routes(questions(spark, d)))
    s = lambda name, route, override, rescue: F.struct(F.lit(name).alias("system"), route.alias("route"), override.alias("override"), F.lit(rescue).alias("rescue"))
    changed = F.col("calibrated_route") != F.col("route")
    systems = [s("computed", F.col("route"), F.lit(False), False), s("calibrated", F.col("calibrated_route"), changed, False), s("calibrated_rescue", F.col("calibrated_route"), changed, True), s("always_bm25", F.lit("bm25"), F.lit(False), False)]
    margin = F.when(F.col("s.system") != "always_bm25", F.col("margin")).alias("margin")
    return r.select(_named().alias("qid"), "margin", F.explode(F.array(*systems)).alias("s")).select("qid", "s.*", margin)


def _judged(spark, d):
    routes = _system_routes(spark, d).drop("margin")
    return evaluation.judged_records(evaluation.eval_items(_sources(spark, d)), routes, _record_evidence(spark, d).withColumn("qid", _named()))


_SHARE_TOKENS = "list_distinct(regexp_extract_all(lower(coalesce({}, '')), '[a-z0-9._§:/-]+'))"
_GOLD_TOKENS = "list_filter(" + _SHARE_TOKENS.format("CASE WHEN coalesce(gold_text, '') <> '' THEN gold_text ELSE gold_answer END") + ", lambda t: t NOT IN (" + ", ".join(map(q, evaluation.STOP)) + "))"


def _hit_sql(n: str) -> str:
    ids = f"list_distinct(flatten(list_transform({n}, lambda x: [x.item_id, 'doc::' || x.item_id])))"
    text = _SHARE_TOKENS.format(f"array_to_string(list_concat(list_transform({n}, lambda x: x.content), list_sort({ids})), ' ')")
    return f"CASE WHEN coalesce(len(gold_ids), 0) > 0 THEN list_has_any(gold_ids, {ids}) WHEN len({_GOLD_TOKENS}) = 0 THEN 0 >= least_share ELSE len(list_intersect({_GOLD_TOKENS}, {text})) / len({_GOLD_TOKENS}) >= least_share END"


_JUDGED = (
    R._RANKED + ", " + ", ".join((R._BENCH, R._FEATURES, R._PENALTY, R._CALIBRATED, _ITEMS))
    + f", fz AS (SELECT qid, item_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, item_id DESC) AS rank FROM (SELECT qid, item_id, round(sum({R._W} / (60 + rank)), 8) AS score FROM ranks GROUP BY ALL)),"
    " rows_ AS (SELECT qid, backend, item_id, rank FROM ranks WHERE rank <= 5 UNION ALL SELECT qid, 'hybrid', item_id, rank FROM fz WHERE rank <= 5),"
    " again AS (SELECT r.*, text AS content, row_number() OVER (PARTITION BY qid, backend ORDER BY length(text) DESC, rank) AS final_rank FROM rows_ r JOIN documents ON doc_id = r.item_id),"
    " found AS (SELECT qid, backend, list({'item_id': item_id::VARCHAR, 'content': content, 'final_rank': final_rank} ORDER BY rank) AS found, bool_or(rank <> 1 AND final_rank = 1) AS applied FROM again GROUP BY ALL),"
    " sys AS (SELECT qid, 'computed' AS system, route, false AS override, false AS rescue FROM cal UNION ALL SELECT qid, 'calibrated', calibrated_route, calibrated_route <> route, false FROM cal UNION ALL SELECT qid, 'calibrated_rescue', calibrated_route, calibrated_route <> route, true FROM cal UNION ALL SELECT qid, 'always_bm25', 'bm25', false, false FROM cal),"
    " j0 AS (SELECT items.*, system, route, override, rescue, coalesce(applied, false) AS applied, list_slice(coalesce(found, []), 1, CASE route WHEN 'hybrid' THEN 5 ELSE 3 END) AS f0, CASE dataset WHEN 'adversarial' THEN 0.45 WHEN 'public' THEN 0.5 ELSE 0.35 END::DOUBLE AS least_share FROM items JOIN sys ON sys.qid = items.item_id LEFT JOIN found ON found.qid = sys.qid AND backend = route),"
    " j1 AS (SELECT *, CASE WHEN rescue THEN list_transform(list_sort(list_transform(f0, lambda x: {'r': x.final_rank, 'x': x})), lambda s: s.x) ELSE f0 END AS its FROM j0),"
    f" j2 AS (SELECT *, {R._NORM.format("coalesce(its[1].content, 'insufficient evidence')")} AS a, {R._NORM.format('gold_answer')} AS g FROM j1),"
    f" judged AS (SELECT dataset, qid, split, family, tags, system, route, len(its) AS retrieved, route = family AS route_ok, {_hit_sql('its')} AS evidence_ok, {_hit_sql('its[1:1]')} AS top1_ok, coalesce(g <> '' AND (contains(a, g) OR (len({R._GOLDTOK}) > 0 AND len(list_filter({R._GOLDTOK}, lambda t: contains(a, t))) >= 0.5 * len({R._GOLDTOK}))), false) AS answer_ok, override, rescue AND applied AS rescued FROM j2)"
)


@query(_JUDGED + " SELECT * EXCLUDE (tags) FROM judged")
def judged_records(spark, d):
    return _judged(spark, d).drop("tags")


@query(
    _JUDGED + """, each AS (SELECT *, unnest(list_concat([{'scope': 'all', 'value': 'all'}, {'scope': 'family', 'value': family}], list_transform(coalesce(tags, []), lambda t: {'scope': 'tag', 'value': t}))) AS s FROM judged)
 SELECT system, dataset, s.scope AS scope, s.value AS value, count(*) AS n, round(avg(route_ok::INTEGER), 6) AS route_accuracy, round(avg(evidence_ok::INTEGER), 6) AS evidence_accuracy, round(avg(top1_ok::INTEGER), 6) AS top1_accuracy, round(avg(answer_ok::INTEGER), 6) AS answer_accuracy, count_if(override) AS overrides, count_if(rescued) AS rescues FROM each GROUP BY ALL"""
)
def evaluate_records(spark, d):
    return evaluation.evaluate_records(_judged(spark, d))


# -- reports of systems, with margins and contributions -------------------------------------


def _reported(spark, d):
    """Judged records and margins of five systems; the fifth chooses by evidence, with its contributions."""
    chosen = written(R.QUERIES["evidence_router"](spark, d)).filter("selected").withColumn("qid", _named()).withColumn("system", F.lit("evidence"))
    routes = written(_system_routes(spark, d))
    none = F.lit(None).cast("double")
    margins = routes.select("qid", "system", "margin", none.alias("route_part"), none.alias("evidence_part")).unionByName(chosen.select("qid", "system", F.col("behind").alias("margin"), "route_part", "evidence_part"))
    routes = routes.drop("margin").unionByName(chosen.select("qid", "system", F.col("backend").alias("route"), F.lit(False).alias("override"), F.lit(False).alias("rescue")))
    return evaluation.judged_records(evaluation.eval_items(_sources(spark, d)), routes, _record_evidence(spark, d).withColumn("qid", _named())), margins


_REPORT = (
    "WITH er AS (" + R.ORACLES["evidence_router"] + "), "
    + _JUDGED.removeprefix("WITH ").replace("'bm25', false, false FROM cal)", "'bm25', false, false FROM cal UNION ALL SELECT qid, 'evidence', backend, false, false FROM er WHERE selected)")
    + ", nm AS (SELECT qid AS n, CASE WHEN qid % 5 = 0 THEN 'curated_s_' ELSE '' END || qid AS qid FROM questions), marg AS (SELECT nm.qid, unnest(['computed', 'calibrated', 'calibrated_rescue']) AS system, margin::DOUBLE AS margin, NULL::DOUBLE AS route_part, NULL::DOUBLE AS evidence_part FROM cal JOIN nm ON n = cal.qid UNION ALL SELECT nm.qid, 'evidence', behind::DOUBLE, route_part::DOUBLE, evidence_part::DOUBLE FROM er JOIN nm ON n = er.qid WHERE selected),"
    " jm AS (SELECT judged.*, margin, route_part, evidence_part FROM judged LEFT JOIN marg USING (qid, system)),"
    " report AS (SELECT system, dataset, count(*) AS n, round(avg(route_ok::INTEGER), 6) AS route_accuracy, round(avg(evidence_ok::INTEGER), 6) AS evidence_accuracy, round(avg(top1_ok::INTEGER), 6) AS top1_accuracy, round(avg(answer_ok::INTEGER), 6) AS answer_accuracy, count_if(evidence_ok AND NOT top1_ok) AS gaps, count_if(rescued) AS rescues, count(*) FILTER (margin < 0.35) AS low_margins,"
    " round(coalesce(avg(margin), 0), 5) AS mean_margin, round(coalesce(avg(route_part), 0), 5) AS mean_route_part, round(coalesce(avg(evidence_part), 0), 5) AS mean_evidence_part, count_if(route = 'bm25') AS chose_bm25, count_if(route = 'dense') AS chose_dense, count_if(route = 'kg') AS chose_kg, count_if(route = 'hybrid') AS chose_hybrid FROM jm GROUP BY ALL),"
    " conf_ AS (SELECT system, dataset, array_to_string(list_sort(list(c)), ' ') AS confusion FROM (SELECT system, dataset, family || '->' || route || '=' || count(*) AS c FROM judged GROUP BY system, dataset, family, route) GROUP BY ALL)"
)
#: What a system must reach over all records.
_ASKED_OF = {"route_accuracy": 0.7, "evidence_accuracy": 0.5, "answer_accuracy": 0.2}


@query(_REPORT + " SELECT report.*, confusion FROM report JOIN conf_ USING (system, dataset)")
def system_reports(spark, d):
    return evaluation.system_reports(*_reported(spark, d))


@query(
    _REPORT + ", al AS (SELECT system, sum(n)::BIGINT AS n, " + ", ".join(f"round(sum({c} * n) / sum(n), 4) AS {c}" for c in _ASKED_OF) + " FROM report GROUP BY system)"
    " SELECT *, failed = '' AS passed FROM (SELECT *, concat_ws(',', " + ", ".join(f"CASE WHEN {c} < {x} THEN '{c}' END" for c, x in sorted(_ASKED_OF.items())) + ") AS failed FROM al)"
)
def verification(spark, d):
    return evaluation.passed(evaluation.system_reports(*_reported(spark, d)), _ASKED_OF)


@query(_REPORT + " SELECT dataset, base, other, delta, CASE WHEN delta >= 0.03 THEN 'test_further' ELSE 'keep' END AS recommended FROM (SELECT a.dataset, a.answer_accuracy AS base, b.answer_accuracy AS other, round(b.answer_accuracy - a.answer_accuracy, 6) AS delta FROM report a JOIN report b ON a.dataset = b.dataset AND a.system = 'computed' AND b.system = 'evidence')")
def router_recommendation(spark, d):
    return evaluation.recommendation(evaluation.system_reports(*_reported(spark, d)), "computed", "evidence")


_STRUCTURE = _JUDGED.replace(" j0 AS (SELECT items.*", " its_ AS (SELECT * REPLACE (dataset || CASE family WHEN 'kg' THEN '_deductive' ELSE '_relational' END AS dataset, CASE WHEN dataset = 'curated' THEN gold_ids ELSE [] END AS gold_ids, NULL AS tags) FROM items WHERE dataset IN ('curated', 'generalization') AND family IN ('kg', 'hybrid')), j0 AS (SELECT items.*").replace("FROM items JOIN sys", "FROM its_ items JOIN sys")


@query(
    _STRUCTURE + " SELECT *, round(route_curated - route_shifted, 6) AS route_loss, round(evidence_curated - evidence_shifted, 6) AS evidence_loss, round(answer_curated - answer_shifted, 6) AS answer_loss FROM (SELECT system, split_part(dataset, '_', 2) AS kind, count_if(starts_with(dataset, 'curated')) AS n_curated, count_if(NOT starts_with(dataset, 'curated')) AS n_shifted, "
    + ", ".join(f"round(avg({c}_ok::INTEGER) FILTER ({'' if side == 'curated' else 'NOT '}starts_with(dataset, 'curated')), 6) AS {c}_{side}" for c in ("route", "evidence", "answer") for side in ("curated", "shifted")) + " FROM judged GROUP BY ALL)"
)
def structure_shift(spark, d):
    items = evaluation.structure_items(evaluation.eval_items(_sources(spark, d)))
    return evaluation.structure_shift(evaluation.judged_records(items, _system_routes(spark, d).drop("margin"), _record_evidence(spark, d).withColumn("qid", _named())))


# -- all features and signals of questions ----------------------------------------------------


def _sourced(spark, d):
    """Benchmark questions, some with an interface's or a rule's name, with the kind of their source."""
    named = F.when(F.col("qid") % 3 == 0, F.concat(F.lit("torch.nn.Linear v"), F.col("qid").cast("string"), F.lit(".2 RFC-7231 ICD-10 A12.3 HIPAA 164.512 §9: "), "question")).otherwise(F.col("question"))
    kinds = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("qid") % len(_KINDS) + 1).cast("int"))
    return questions(spark, d).withColumns({"question": named, "source": kinds, "local_graph": F.col("qid") % 3 == 1, "rescue": F.when(F.col("qid") % 5 != 4, F.col("qid") % 5 == 0)})


_KINDS = ("curated", "External:mini", "generalization_v2", "public_raw", "adversarial", "source_pack:rfc_specs", "runtime medical policy", "")
_SOURCED = (
    R._with(SQL["questions"]) + "asked AS (SELECT * REPLACE (CASE WHEN qid % 3 = 0 THEN 'torch.nn.Linear v' || qid || '.2 RFC-7231 ICD-10 A12.3 HIPAA 164.512 §9: ' || question ELSE question END AS question), [" + ", ".join(map(q, _KINDS)) + "][(qid % 8 + 1)::INTEGER] AS source, qid % 3 = 1 AS local_graph, coalesce(qid % 5 = 0, false) AS rescue FROM questions), "
).replace(" asked AS", ", asked AS", 1)
_IDENTIFIED = "flatten([" + ", ".join(f"regexp_extract_all(question, {q(p)})" for p in S.IDENTIFIER_PARTS) + "])"
_FLAGS = {"curated": ("curated",), "external": ("external",), "generalization": ("generalization",), "public_raw": ("public",), "adversarial": ("adversarial",), "open_corpus": ("open", "source_pack", "runtime"), "formal_spec": ("rfc", "spec", "medical", "policy", "api", "formal")}


@query(_SOURCED.rstrip(", ") + f" SELECT qid, array_to_string({_IDENTIFIED}, '|') AS identifiers, regexp_matches(question, {q(S.API_NAME)}) AS api_cue FROM asked")
def interface_signals(spark, d):
    s = S.interface_signals(F.col("question"))
    return _sourced(spark, d).select("qid", F.array_join(s["identifiers"], "|").alias("identifiers"), s["api_cue"].alias("api_cue"))


def _all_values() -> str:
    """The values of route_features over the questions above, and the others beside them."""
    own = R.ORACLES["route_features"]
    select = own[own.rindex("SELECT qid, 1.0::DOUBLE AS bias") :].replace("AS public_document_noise", "AS noise0").removesuffix(" FROM kw")
    flags = ", ".join(R._f(R._any("lower(source)", terms)) + f" AS source_{k}" for k, terms in _FLAGS.items())
    more = f"round(ln(1 + len({_IDENTIFIED}) + len(regexp_extract_all(lower(question), {q(S.COUNTED_AGAIN)}))), 6) AS identifier_count_log, {flags}, {R._f('local_graph')} AS query_local_graph_available, {R._f('rescue')} AS topk_rescue_opportunity, {R._f(R._any('lower(source)', ('public',)))} AS public0"
    return _SOURCED + ", ".join((R._FEATURES, R._PENALTY, R._KEYWORD)) + " SELECT * EXCLUDE (noise0, public0), greatest(noise0, public0) AS public_document_noise FROM (" + select + ", " + more + " FROM kw)"


@query(_all_values())
def sourced_features(spark, d):
    return diagnostics.sourced_features(routing.keyword_routes(routing.penalty_routes(_sourced(spark, d))))


# -- variants as data ---------------------------------------------------------------------

_VARIANTS = {"plain": (0.0, 0.0), "identifiers": (5.0, 0.0), "tokens": (0.0, 0.05), "both": (5.0, 0.05)}


@query(
    R._with(SQL["questions"], SQL["corpus"], R._LEX_DOCS, R._LEX_QS, R._TF, R._BM25, R._SHARED, _ITEMS)[:-1]
    + ", vs(variant, pi, pt) AS (VALUES " + ", ".join(f"({q(n)}, {i}::DOUBLE, {t}::DOUBLE)" for n, (i, t) in _VARIANTS.items()) + "),"
    " vt AS (SELECT *, row_number() OVER (PARTITION BY variant, qid ORDER BY score DESC, doc_id DESC) AS rank FROM (SELECT variant, qid, doc_id, round(score + pi * ids + pt * shared, 4) AS score FROM bm JOIN shared USING (qid, doc_id), vs)),"
    " gold AS (SELECT item_id AS qid, CASE WHEN item_id % 2 = 0 THEN 'dev' ELSE 'test' END AS split, unnest(holders)::BIGINT AS doc_id FROM held),"
    " fh AS (SELECT variant, qid, min(rank) AS first FROM vt JOIN gold USING (qid, doc_id) WHERE rank <= 3 GROUP BY ALL)"
    " SELECT variant, split, count(*) AS n, round(avg(coalesce(first = 1, false)::INTEGER), 6) AS top1, round(avg((first IS NOT NULL)::INTEGER), 6) AS hit_rate FROM (SELECT * FROM (SELECT DISTINCT qid, split FROM gold), vs) LEFT JOIN fh USING (variant, qid) GROUP BY ALL"
)
def lexical_variants(spark, d):
    ranked = resident.variant_top_k(corpus(spark, d), questions(spark, d), _VARIANTS, 3)
    return evaluation.variants_by_split(written(ranked), _held(spark, d))


# -- text clean-up ------------------------------------------------------------------------

_NAMED = {k.removesuffix(";"): v for k, v in X.html5.items() if k in ("amp;", "lt;", "gt;", "quot;", "copy;", "middot;", "nbsp;", "eacute;")}


@query(
    "WITH m AS (SELECT page_id, html || ' &#' || (page_id * 37 + 200) || '; &#x' || lower(printf('%x', page_id + 8364)) || ' &lt;b&gt;&amp;nosuch; &eacute' AS t FROM pages), p AS (SELECT page_id, string_split_regex(t, '&(#[0-9]+|#x[0-9a-f]+|[a-z]+);?') AS parts, regexp_extract_all(t, '&(#[0-9]+|#x[0-9a-f]+|[a-z]+);?', 1) AS refs FROM m),"
    " nm AS (SELECT MAP {" + ", ".join(f"{q(k)}: {q(v)}" for k, v in _NAMED.items()) + "} AS nm),"
    " w AS (SELECT page_id, array_to_string(list_transform(range(0, len(parts)), lambda i: parts[i + 1] || CASE WHEN i >= len(refs) THEN '' WHEN starts_with(refs[i + 1], '#x') THEN chr(('0' || refs[i + 1][2:])::INTEGER) WHEN starts_with(refs[i + 1], '#') THEN chr(refs[i + 1][2:]::INTEGER) ELSE map_extract(nm, refs[i + 1])[1] END), '') AS t FROM p, nm)"
    " SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(t, '(?is)<script.*?</script>|<style.*?</style>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '[\\s\\x{85}\\p{Z}]+', ' ', 'g')) AS text FROM w"
)
def html_unescaped(spark, d):
    extra = F.concat(F.lit(" &#"), (F.col("page_id") * 37 + 200).cast("string"), F.lit("; &#x"), F.lower(F.hex(F.col("page_id") + 8364)), F.lit(" &lt;b&gt;&amp;nosuch; &eacute"))
    return table(spark, d, "pages").select("page_id", X.unescaped_text(F.concat("html", extra)).alias("text"))


@query(
    "SELECT conv_id, turn, 'id: ' || conv_id || chr(10) || 'roles: user assistant' || chr(10) || 'part.turn: ' || turn || chr(10) || 'part.who.role: ' || role || chr(10) || 'text: ' || text AS lines FROM conversations WHERE text IS NOT NULL AND role IS NOT NULL"
)
def json_flattened(spark, d):
    c = table(spark, d, "conversations").filter("text is not null and role is not null")
    made = F.to_json(F.struct(F.col("conv_id").alias("id"), F.array(F.lit("user"), F.lit("assistant")).alias("roles"), F.struct("turn", F.struct("role").alias("who")).alias("part"), "text"))
    return c.select("conv_id", "turn", X.flattened_json(made).alias("lines"))


# -- a corpus that changes ----------------------------------------------------------------

_CHANGED = (
    "corpus AS (SELECT doc_id, source AS title, text FROM documents WHERE doc_id % 7 <> 0 UNION ALL SELECT doc_id, source, text || ' revised ' || lang FROM documents WHERE doc_id % 7 = 0 AND doc_id % 14 <> 0 AND text IS NOT NULL AND lang IS NOT NULL"
    " UNION ALL SELECT doc_id + 1000000, 'added', text FROM documents WHERE doc_id % 21 = 1 AND text IS NOT NULL)"
)


def _changes(spark, d):
    """Two versions of every seventh document, of which the later counts; half of these go, and some are new."""
    c = corpus(spark, d).select("doc_id", "title", "text", "lang")
    seventh = c.filter("doc_id % 7 = 0")
    first = seventh.select("doc_id", "title", F.lit("first try").alias("text"), F.lit(1).alias("position"))
    second = seventh.select("doc_id", "title", F.when(F.col("doc_id") % 14 != 0, F.concat("text", F.lit(" revised "), "lang")).alias("text"), F.lit(2).alias("position"))
    new = c.filter("doc_id % 21 = 1").select(F.col("doc_id") + 1000000, F.lit("added").alias("title"), "text", F.lit(1).alias("position")).toDF("doc_id", "title", "text", "position")
    return c.drop("lang"), first.unionByName(second).unionByName(new)


@query("WITH " + _CHANGED + " SELECT * FROM corpus")
def upserted_corpus(spark, d):
    return runtime.upserted(*_changes(spark, d), "position")


@query(R._with(SQL["questions"], _CHANGED, R._LEX_DOCS, R._LEX_QS, R._TF, R._BM25) + R._top("bm", 3))
def bm25_after_upsert(spark, d):
    before, changes = _changes(spark, d)
    counts = runtime.recounted(runtime.counted(before), before, changes, "position")
    return runtime.counted_top_k(counts, questions(spark, d), 3)


# -- public documents ---------------------------------------------------------------------

_PUBLIC = (
    "pub AS (SELECT doc_id, 'pub_' || source AS source_id, upper(source) || ' Guide RFC ' || doc_id AS title, CASE WHEN doc_id % 2 = 0 THEN 'official_docs' ELSE 'standard' END AS kind, coalesce(lang, '') || ' Text' AS answer, 'A short note on ' || source || ' of HIPAA 164.' || (500 + doc_id % 100) || '. It says little.' AS fallback, CASE WHEN doc_id % 9 = 0 THEN left(text, 40) ELSE text END AS text FROM documents WHERE text IS NOT NULL),"
    f" pid AS (SELECT pub.*, {R._CANON.replace('(text,', '(everything,')} AS ids FROM (SELECT *, concat_ws(' ', title, answer, fallback, text) AS everything FROM pub) pub)"
)


def _public(spark, d):
    """Documents as fetched public pages, every ninth of which is too short to lead."""
    c, n = table(spark, d, "documents").filter("text is not null"), F.col("doc_id").cast("string")
    number = (F.lit(500) + F.col("doc_id") % 100).cast("string")
    p = c.select("doc_id", F.concat(F.lit("pub_"), "source").alias("source_id"), F.concat(F.upper("source"), F.lit(" Guide RFC "), n).alias("title"), F.when(F.col("doc_id") % 2 == 0, "official_docs").otherwise("standard").alias("kind"), F.concat(F.coalesce("lang", F.lit("")), F.lit(" Text")).alias("answer"), F.concat(F.lit("A short note on "), "source", F.lit(" of HIPAA 164."), number, F.lit(". It says little.")).alias("fallback"), F.when(F.col("doc_id") % 9 == 0, F.substring("text", 1, 40)).otherwise(F.col("text")).alias("text"))
    return p.select("doc_id", "title", "text", *(v.alias(k) for k, v in X.public_record(*map(F.col, ("source_id", "title", "kind", "answer", "fallback", "text"))).items()))


@query(
    "WITH " + _PUBLIC + " SELECT doc_id, array_to_string(ids, '|') AS canonical_identifiers,"
    " array_to_string(list_sort(list_distinct(list_filter(list_concat([title, lower(title), answer, lower(answer), replace(replace(source_id, 'pub_', ''), '_', ' '), CASE WHEN kind = 'official_docs' THEN string_split(title, ' ')[-1] END], flatten(list_transform(ids, lambda x: [x, lower(x), replace(x, '-', ' '), replace(x, ' ', '-'), CASE WHEN contains(x, ' ') THEN string_split(x, ' ')[-1] END]))), lambda a: a IS NOT NULL AND a <> ''))), '|') AS aliases,"
    f" coalesce(array_to_string((SELECT list(t ORDER BY p) FROM (SELECT t, min(p) AS p FROM (SELECT unnest(found) AS t, unnest(range(0, len(found))) AS p FROM (SELECT list_filter(list_transform(regexp_extract_all(left(text, 2500), {q(X.TITLE_IN_TEXT)}, 1), lambda t: trim(t, ' .')), lambda t: t <> '') AS found)) GROUP BY t))[1:8], '|'), '') AS section_headings,"
    " trim(array_to_string((string_split(regexp_replace(trim(CASE WHEN length(trim(text)) >= 80 THEN text ELSE title || '. ' || answer || '. ' || fallback END), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)))[1:3], ' ')[1:420]) AS lead_summary, length(text) AS body_char_count FROM pid"
)
def public_records(spark, d):
    p = _public(spark, d)
    lists = {c: F.array_join(c, "|") for c in ("canonical_identifiers", "aliases", "section_headings")}
    return p.withColumns(lists).select("doc_id", *lists, "lead_summary", "body_char_count")


# -- public documents as a corpus of their own ----------------------------------------------

#: Benchmark texts as questions of four kinds about public documents, by item_id mod 4: an identifier, a name in a title, a number of a rule, an identifier in a relation.
_PUBLIC_ASKED = (
    "asked AS (SELECT item_id AS qid, CASE item_id % 4 WHEN 0 THEN 'Find exact code RFC-' || item_id || ' ' || text WHEN 1 THEN 'What concept feels like the src' || (item_id % 20) || ' guide of RFC ' || item_id || '? ' || text WHEN 2 THEN 'Is a note of HIPAA 164.' || (500 + item_id % 100) || ' a class of ' || text ELSE 'What bridge connects RFC-' || item_id || CASE WHEN item_id % 8 = 7 THEN ' and its code' ELSE ' and ' || text END END AS question,"
    " CASE item_id % 4 WHEN 0 THEN 'lexical' WHEN 1 THEN 'semantic' WHEN 2 THEN 'deductive' ELSE 'relational' END AS family, CASE item_id % 4 WHEN 0 THEN 'bm25' WHEN 1 THEN 'dense' WHEN 2 THEN 'bm25' ELSE CASE WHEN item_id % 8 = 7 THEN 'bm25' ELSE 'hybrid' END END AS gold FROM benchmark)"
)
_ALIAS_LIST = "list_sort(list_distinct(list_filter(list_concat([title, lower(title), answer, lower(answer), replace(replace(source_id, 'pub_', ''), '_', ' '), CASE WHEN kind = 'official_docs' THEN string_split(title, ' ')[-1] END], flatten(list_transform(ids, lambda x: [x, lower(x), replace(x, '-', ' '), replace(x, ' ', '-'), CASE WHEN contains(x, ' ') THEN string_split(x, ' ')[-1] END]))), lambda a: a IS NOT NULL AND a <> '')))"
_LEAD = "trim(array_to_string((string_split(regexp_replace(trim(CASE WHEN length(trim(text)) >= 80 THEN text ELSE title || '. ' || answer || '. ' || fallback END), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)))[1:3], ' ')[1:420])"
_BOOSTED = (
    f"rec AS (SELECT doc_id, title, text, ids, {_ALIAS_LIST} AS aliases, {_LEAD} AS lead FROM pid),"
    " corpus AS (SELECT doc_id, title, 'Title: ' || title || chr(10) || 'Canonical identifiers: ' || array_to_string(ids, ', ') || chr(10) || 'Aliases: ' || array_to_string(aliases, ', ') || chr(10) || 'Lead summary: ' || lead || chr(10) || 'Body:' || CASE WHEN trim(text) = '' THEN '' ELSE chr(10) || trim(text) END AS text FROM rec),"
    " questions AS (SELECT * FROM asked), idl AS (SELECT doc_id, unnest(ids) AS x FROM rec), all_ AS (SELECT doc_id, lower(a) AS a FROM (SELECT doc_id, unnest(aliases) AS a FROM rec) WHERE length(a) >= 4), low AS (SELECT qid, lower(question) AS low FROM asked),"
    " byid AS (SELECT qid, doc_id, count(*) AS n FROM low, idl WHERE contains(low, lower(x)) GROUP BY ALL),"
    " named AS (SELECT qid, a FROM low, (SELECT DISTINCT a FROM all_) WHERE contains(low, a) AND regexp_matches(low, '(^|[^a-z0-9])' || regexp_escape(a) || '($|[^a-z0-9])')),"
    " byalias AS (SELECT qid, doc_id, count(*) AS n FROM named JOIN all_ USING (a) GROUP BY ALL),"
    " tw AS (SELECT doc_id, list_filter(regexp_extract_all(lower(title), '[a-z0-9]+'), lambda t: length(t) >= 4) AS w FROM rec), qw AS (SELECT qid, list_distinct(regexp_extract_all(low, '[a-z0-9]+')) AS q FROM low),"
    " bytitle AS (SELECT qid, doc_id FROM qw, tw WHERE len(w) > 0 AND len(list_filter(w, lambda t: list_contains(q, t))) >= least(2, len(w))),"
    " pairs AS (SELECT qid, doc_id FROM byid UNION SELECT qid, doc_id FROM byalias UNION SELECT qid, doc_id FROM bytitle),"
    " bo AS (SELECT p.qid, p.doc_id, coalesce(i.n, 0) AS n_identifiers, coalesce(a.n, 0) AS n_aliases, t.qid IS NOT NULL AS title_hit FROM pairs p LEFT JOIN byid i USING (qid, doc_id) LEFT JOIN byalias a USING (qid, doc_id) LEFT JOIN bytitle t USING (qid, doc_id)),"
    " boosts AS (SELECT *, 8.0::DOUBLE * n_identifiers + 4.0::DOUBLE * least(2, n_aliases) + CASE WHEN title_hit THEN 3.0::DOUBLE ELSE 0.0::DOUBLE END AS boost, concat_ws(',', CASE WHEN n_aliases > 0 THEN 'alias' END, CASE WHEN n_identifiers > 0 THEN 'identifier' END, CASE WHEN title_hit THEN 'title' END) AS fields FROM bo)"
)
_PUBLIC_SQL = "WITH " + ", ".join((_PUBLIC, _PUBLIC_ASKED, _BOOSTED))
_PUBLIC_RANKED = (
    _PUBLIC_SQL + ", " + ", ".join((R._LEX_DOCS, R._LEX_QS, R._TF, R._BM25))
    + ", ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id DESC) AS rank FROM (SELECT qid, doc_id, coalesce(bm.score, 0.0) AS base, coalesce(boost, 0.0) AS boost, coalesce(fields, '') AS fields, round(coalesce(bm.score, 0.0) + coalesce(boost, 0.0), 4) AS score FROM bm FULL JOIN boosts USING (qid, doc_id)))"
)
_ARBITRATED = (
    _PUBLIC_RANKED + ", " + ", ".join((R._FEATURES, R._PENALTY))
    + f", arb AS (SELECT *, CASE WHEN about_identifiers AND decides THEN 'bm25' ELSE route END AS arbitrated_route FROM (SELECT r.qid, family, gold, question, route, doc_id AS top_doc_id, coalesce(boost, 0.0) AS boost, coalesce(fields, '') AS fields, least(1.0, coalesce(boost, 0.0) / 8.0) AS confidence, coalesce(boost, 0.0) >= 3.0 AND coalesce(fields, '') <> '' AS decides,"
    f" len({R._IDS.replace('(text,', '(question,')}) > 0 OR regexp_matches(lower(question), {q(public.NAMED)}) AS about_identifiers FROM routed r LEFT JOIN (SELECT * FROM ranked WHERE rank = 1) t ON t.qid = r.qid))"
)


def _public_asked(spark, d):
    b, n = table(spark, d, "benchmark").withColumn("m", F.col("item_id") % 4), F.col("item_id").cast("string")
    number = (F.lit(500) + F.col("item_id") % 100).cast("string")
    by = lambda a, b, c, e: F.when(F.col("m") == 0, a).when(F.col("m") == 1, b).when(F.col("m") == 2, c).otherwise(e)
    asked = by(F.concat(F.lit("Find exact code RFC-"), n, F.lit(" "), "text"), F.concat(F.lit("What concept feels like the src"), (F.col("item_id") % 20).cast("string"), F.lit(" guide of RFC "), n, F.lit("? "), "text"), F.concat(F.lit("Is a note of HIPAA 164."), number, F.lit(" a class of "), "text"), F.concat(F.lit("What bridge connects RFC-"), n, F.when(F.col("item_id") % 8 == 7, " and its code").otherwise(F.concat(F.lit(" and "), "text"))))
    return b.select(F.col("item_id").alias("qid"), asked.alias("question"), by("lexical", "semantic", "deductive", F.lit("relational")).alias("family"), by("bm25", "dense", "bm25", F.when(F.col("item_id") % 8 == 7, "bm25").otherwise("hybrid")).alias("gold"))


def _kept(spark, d):
    """The public records, written once: their identifiers come from all of a text by several patterns, and four plans read them."""
    return written(_public(spark, d))


def _arbitrated(spark, d):
    asked = _public_asked(spark, d)
    return public.arbitrated_routes(routing.penalty_routes(asked), public.public_top_k(_kept(spark, d), asked, 1))


@query(_PUBLIC_SQL + " SELECT qid, doc_id, n_identifiers, n_aliases, title_hit, boost, fields FROM boosts")
def public_field_boosts(spark, d):
    return public.public_boosts(_kept(spark, d), _public_asked(spark, d))


@query(_PUBLIC_RANKED + " SELECT qid, doc_id, score, base, boost, fields, rank FROM ranked WHERE rank <= 3")
def public_lexical_topk(spark, d):
    return public.public_top_k(_kept(spark, d), _public_asked(spark, d), 3)


@query(_ARBITRATED + " SELECT qid, family, route, about_identifiers, top_doc_id, boost, fields, confidence, decides, arbitrated_route FROM arb")
def public_arbitration(spark, d):
    return _arbitrated(spark, d).select("qid", "family", "route", "about_identifiers", "top_doc_id", "boost", "fields", "confidence", "decides", "arbitrated_route")


@query(_ARBITRATED + " SELECT qid, family, question, route AS normal_route, arbitrated_route, confidence, fields FROM arb WHERE arbitrated_route <> route")
def arbitration_overrides(spark, d):
    return _arbitrated(spark, d).filter("overrode").select("qid", "family", "question", F.col("route").alias("normal_route"), "arbitrated_route", "confidence", "fields")


@query(_ARBITRATED + " SELECT f AS family, count(*) AS n, round(avg((route = gold)::INTEGER), 6) AS computed_accuracy, round(avg((arbitrated_route = gold)::INTEGER), 6) AS arbitrated_accuracy, count(*) FILTER (arbitrated_route <> route) AS overrides, count(*) FILTER (route <> gold AND arbitrated_route = gold) AS mended, count(*) FILTER (route = gold AND arbitrated_route <> gold) AS spoiled FROM (SELECT *, unnest(['all', family]) AS f FROM arb) GROUP BY f")
def arbitration_effect(spark, d):
    return public.arbitration_effect(_arbitrated(spark, d))


# -- reports of single questions ----------------------------------------------------------


@query(R._with(SQL["questions"], R._BENCH, R._FEATURES, R._PENALTY, R._CALIBRATED) + "SELECT system, identifier_heavy, count(*) AS n, round(avg((predicted = gold)::INTEGER), 6) AS accuracy FROM (SELECT qid, identifier_heavy, unnest([{'system': 'computed', 'predicted': route}, {'system': 'calibrated', 'predicted': calibrated_route}], recursive := true) FROM cal) JOIN (SELECT qid, gold FROM questions) USING (qid) GROUP BY ALL")
def identifier_subgroups(spark, d):
    r = routing.calibrated_routes(routing.penalty_routes(questions(spark, d)))
    each = F.array(*(F.struct(F.lit(n).alias("system"), F.col(c).alias("predicted")) for n, c in (("computed", "route"), ("calibrated", "calibrated_route"))))
    rows = r.select("gold", "identifier_heavy", F.explode(each).alias("s"))
    return rows.groupBy("s.system", "identifier_heavy").agg(F.count("*").alias("n"), metrics.rate(F.col("s.predicted") == F.col("gold")).alias("accuracy"))


_ISSUES = "list_filter([CASE WHEN evidence_ids = '' THEN 'no_evidence' END, CASE WHEN answer = 'insufficient evidence' THEN 'no_answer' END, CASE WHEN support <= 0 THEN 'no_support' END], lambda x: x IS NOT NULL)"


@query(R._ANSWERED + f" SELECT qid, route, answer_type, CASE WHEN evidence_ids = '' THEN 0 ELSE len(string_split(evidence_ids, ',')) END AS n_evidence, array_to_string(list_sort({_ISSUES}), ',') AS issues, len({_ISSUES}) = 0 AS sound FROM ans")
def smoke_evaluation(spark, d):
    """Every question routed, its evidence retrieved, answered and checked: one row each, with what is wrong."""
    a = written(answering.answers(routing.penalty_routes(questions(spark, d)), R._evidence(spark, d)))
    found = answering.trace_issues(a).groupBy("qid").agg(F.array_join(F.array_sort(F.collect_list("issue")), ",").alias("issues"))
    n = F.when(F.col("evidence_ids") == "", 0).otherwise(F.size(F.split("evidence_ids", ",")))
    return a.join(found, "qid", "left").select("qid", "route", "answer_type", n.alias("n_evidence"), F.coalesce("issues", F.lit("")).alias("issues"), F.col("issues").isNull().alias("sound"))


@query(
    R._ANSWERED + " SELECT qid, route, array_to_string(list_transform(list_sort([{'s': score_bm25, 'o': 0, 'b': 'bm25'}, {'s': score_dense, 'o': 1, 'b': 'dense'}, {'s': score_kg, 'o': 2, 'b': 'kg'}, {'s': score_hybrid, 'o': 3, 'b': 'hybrid'}]), lambda x: x.b || '=' || printf('%.3f', x.s)), ' ') AS scores, answer_type, evidence_ids AS evidence, printf('%.6f', support) AS support FROM ans"
)
def result_rows(spark, d):
    """What a result view shows of each question: the backends by ascending penalty, the route, and its evidence in order."""
    routed = routing.penalty_routes(questions(spark, d))
    a = answering.answers(routed, R._evidence(spark, d))
    scores = F.array_sort(F.array(*(F.struct(F.col(f"score_{b}").alias("s"), F.lit(i).alias("o"), F.lit(b).alias("b")) for i, b in enumerate(routing.BACKENDS))))
    line = F.array_join(F.transform(scores, lambda x: F.concat(x["b"], F.lit("="), F.format_string("%.3f", x["s"]))), " ")
    return a.join(routed.select("qid", line.alias("scores")), "qid").select("qid", "route", "scores", "answer_type", F.col("evidence_ids").alias("evidence"), F.format_string("%.6f", F.col("support")).alias("support"))
