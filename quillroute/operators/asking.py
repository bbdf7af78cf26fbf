"""From a question's words to graph look-ups: mentions, the branch that answers it, and its evidence."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.signals import UNIVERSAL, first_listed, first_whole, has_any, starts_with_any
from ..functions.text import simple_tokens
from ..sources.shared import written
from .graph import existential, membership, rendered, two_hop_paths, universal
from .lexical import SENT, beside, top_k
from .resident import ranked

# Words that ask for a path, or for a property.
PATH_WORDS = ("path", "connect", "chain", "bridge", "links")
PROPERTY_WORDS = ("what property", "what adaptation", "allows")


def mentions(questions: DataFrame, names: DataFrame) -> DataFrame:
    """qid, entity, place: graph names among a question's tokens, in order, each once.

    An equi-join on the token in place of a search of every name in every question.
    """
    t = questions.select("qid", F.posexplode(simple_tokens(F.col("question"))).alias("place", "token"))
    return names.select(F.lower("name").alias("token"), F.col("name").alias("entity")).join(beside(t), "token").groupBy("qid", "entity").agg(F.min("place").alias("place"))


def mentioned(questions: DataFrame, names: DataFrame) -> DataFrame:
    """qid, entities: mentions() as arrays in order; empty where there is none."""
    m = mentions(questions, names).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("place", "entity"))).alias("m"))
    return questions.select("qid", "question").join(m, "qid", "left").select("qid", "question", F.coalesce(F.transform("m", lambda x: x["entity"]), F.array().cast("array<string>")).alias("entities"))


@dataclass(frozen=True)
class GraphWords:
    """What words of a question mean to a graph."""

    # Classes in the order they are looked for; words for predicates and for objects, the first that occurs counts.
    classes: tuple[str, ...] = ("mammal", "bird", "animal", "vertebrate")
    predicates: dict[str, str] = field(default_factory=lambda: {"fly": "capable_of", "flying": "capable_of", "able": "capable_of", "swim": "capable_of", "swimming": "capable_of", "eat": "eats", "eats": "eats", "property": "has_property", "allows": "has_property", "feature": "has_property", "adaptation": "has_property", "produce": "produces", "produces": "produces"})
    objects: dict[str, str] = field(default_factory=lambda: {"fly": "fly", "flight": "fly", "swim": "swim", "milk": "milk", "mosquito": "mosquito"})
    #: the object of a predicate that no word above names
    other_objects: dict[str, tuple[str, str]] = field(default_factory=lambda: {"has_property": ("wing", "wings")})
    member: str = "is_a"
    able: str = "capable_of"
    feature: str = "has_property"
    inverse: tuple[str, str] = ("what eats", "eats")
    universal_object: str = "fly"


def _object(q: Column, predicate: Column, words: GraphWords) -> Column:
    out = F.lit(None).cast("string")
    for p, (part, value) in words.other_objects.items():
        out = F.when((predicate == p) & F.contains(q, F.lit(part)), value).otherwise(out)
    for part, value in reversed(words.objects.items()):
        out = F.when(F.contains(q, F.lit(part)), value).otherwise(out)
    return out


def understood(questions: DataFrame, names: DataFrame, words: GraphWords) -> DataFrame:
    """qid, question, entities, klass, predicate, target, first, second, last, branch, otherwise.

    ``branch`` is the first kind of look-up that the question asks for, ``otherwise`` the one
    that follows where a membership question finds nothing; ``lexical`` where none fits.
    """
    q, n = F.lower("question"), F.size("entities")
    d = mentioned(questions, names).withColumns({"klass": first_listed(F.col("question"), {c: c for c in words.classes}), "predicate": first_whole(F.col("question"), words.predicates)})
    d = d.withColumns({"target": _object(q, F.col("predicate"), words), "able_target": _object(q, F.coalesce("predicate", F.lit(words.able)), words), "first": F.get("entities", 0), "second": F.get("entities", 1), "last": F.when(n > 0, F.element_at("entities", -1))})
    d = d.withColumn("about", F.coalesce("klass", "first"))
    late = (
        F.when((F.startswith(q, F.lit("can ")) | F.contains(q, F.lit(" able to "))) & F.col("about").isNotNull() & F.col("able_target").isNotNull(), "existential")
        .when(F.startswith(q, F.lit(words.inverse[0])) & (n >= 1), "inverse")
        .when(F.col("predicate").isNotNull() & (n >= 1), "relation")
        .otherwise("lexical")
    )
    early = (
        F.when(has_any(q, UNIVERSAL) & F.col("predicate").isNotNull() & F.col("about").isNotNull(), "universal")
        .when(has_any(q, PROPERTY_WORDS) & (n >= 1), "properties")
        .when(has_any(q, PATH_WORDS) & (n >= 2), "path")
        .when(starts_with_any(q, ("is ", "are ")) & (n >= 2), "membership")
        .otherwise(late)
    )
    return d.withColumns({"branch": early, "otherwise": late})


def lexical_facts(asked: DataFrame, edges: DataFrame) -> DataFrame:
    """qid, item_id, score: the share of a question's tokens that a fact has, for facts that have any."""
    q = asked.select("qid", F.explode(F.array_distinct(simple_tokens(F.col("question")))).alias("token"), F.size(F.array_distinct(simple_tokens(F.col("question")))).alias("n"))
    f = edges.select(F.col("triple_id").alias("item_id"), F.explode(F.array_distinct(simple_tokens(F.concat_ws(" ", "subject", "predicate", "object")))).alias("token"))
    return q.join(f, "token").groupBy("qid", "item_id", "n").agg(F.count("*").alias("hits")).select("qid", "item_id", F.round(F.col("hits") / F.col("n"), 6).alias("score"))


def best_lexical_facts(asked: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """qid, item_id, score, rank: what top_k(lexical_facts()) gives for edges of different ids.

    Questions go to the facts and each task keeps its best: a word such as "is" makes no pairs of every question and fact.
    """
    tokens = lambda text: F.array_distinct(simple_tokens(text)).alias("tokens")
    facts = edges.select(F.col("triple_id").alias("doc_id"), tokens(F.concat_ws(" ", "subject", "predicate", "object")))
    best = ranked(facts, asked.select("qid", tokens(F.col("question"))), k, "overlap")
    return best.select("qid", F.col("doc_id").alias("item_id"), "score", "rank")


def _facts(found: DataFrame, mode: str, score: float) -> DataFrame:
    """Edges found for questions, as items."""
    return found.select("qid", F.lit(mode).alias("mode"), F.col("triple_id").alias("item_id"), rendered().alias("content"), F.lit(score).alias("score"))


def _without(asked: DataFrame, found: DataFrame) -> DataFrame:
    return asked.join(found.select("qid").distinct(), "qid", "left_anti")


def graph_retrieve(questions: DataFrame, edges: DataFrame, k: int = 3, words: GraphWords = GraphWords()) -> DataFrame:
    """qid, branch, mode, item_id, content, score, rank: each branch is one join over the questions that take it.

    A path that is not there falls back to a direct relation of its ends, a membership to a
    path of two facts and then to the branch that follows; whoever finds nothing gets facts
    by the words they share with the question. No entity, no fact: no rows.
    """
    names = edges.select(F.col("subject").alias("name")).union(edges.select("object")).distinct()
    asked = written(understood(questions, names, words))
    # questions go to the edges, never edges to the tasks
    send = F.broadcast if asked.limit(SENT + 1).count() <= SENT else (lambda d: d)
    asked = send(asked)
    of = lambda *kinds: asked.filter(F.col("branch").isin(*kinds))
    path = of("path").select("qid", F.col("first").alias("subject"), F.col("last").alias("object"))
    member = of("membership").select("qid", F.col("first").alias("subject"), F.col("second").alias("object"))
    hop = lambda ends: two_hop_paths(edges, ends).select("qid", F.lit("two_hop").alias("mode"), "item_id", "content", "score")
    paths = hop(path)
    related = _facts(send(_without(path, paths)).join(edges, ["subject", "object"]), "direct_relation", 5.5)
    direct = membership(edges, member, words.member).select("qid", F.lit("membership").alias("mode"), "item_id", "content", "score")
    indirect = hop(send(_without(member, direct)))
    settled = direct.unionByName(indirect)
    # membership questions that found nothing take the branch that follows
    kind = F.when(F.col("branch") == "membership", F.col("otherwise")).otherwise(F.col("branch"))
    late = send(_without(asked, settled)).withColumn("kind", kind)
    on = lambda kind: late.filter(F.col("kind") == kind)
    every = on("universal").select("qid", F.col("about").alias("class"), "predicate", F.coalesce("target", F.lit(words.universal_object)).alias("object"))
    some = on("existential").select("qid", F.col("about").alias("class"), F.lit(words.able).alias("predicate"), F.col("able_target").alias("object"))
    feature = on("properties").select("qid", "question", F.col("first").alias("subject"))
    able = feature.filter(F.contains(F.lower("question"), F.lit(words.universal_object))).select("qid", "subject", F.lit(words.able).alias("predicate"), F.lit(words.universal_object).alias("object"))
    eaten = on("inverse").select("qid", F.col("last").alias("object"), F.lit(words.inverse[1]).alias("predicate"))
    relation = on("relation").select("qid", F.col("first").alias("subject"), "predicate", "target")
    parts = [
        settled,
        paths,
        related,
        universal(edges, every, words.member).select("qid", F.concat(F.lit("universal_"), "kind").alias("mode"), "item_id", "content", "score"),
        existential(edges, some, words.member).select("qid", F.when(F.col("score") > 5, "existential").otherwise("property").alias("mode"), "item_id", "content", "score"),
        _facts(feature.select("qid", "subject").join(edges.filter(F.col("predicate") == words.feature), "subject"), "property", 5.0),
        _facts(able.join(edges, ["subject", "predicate", "object"]), "property", 5.0),
        _facts(eaten.join(edges, ["object", "predicate"]), "inverse_relation", 5.0),
        _facts(relation.join(edges, ["subject", "predicate"]).filter(F.col("target").isNull() | (F.col("target") == F.col("object"))), "relation", 5.0),
    ]
    # only questions without any fact fall back, so both sides are ranked apart
    found = written(top_k(reduce(DataFrame.unionByName, parts).distinct(), k, item="item_id"))
    shared = beside(written(best_lexical_facts(_without(asked, found), edges, k)))
    shared = edges.withColumnRenamed("triple_id", "item_id").join(shared, "item_id")
    both = found.unionByName(shared.select("qid", F.lit("fallback").alias("mode"), "item_id", rendered().alias("content"), "score", "rank"))
    return both.join(asked.select("qid", "branch"), "qid")


def graph_answers(questions: DataFrame, found: DataFrame) -> DataFrame:
    """qid, answer: what the rows of graph_retrieve() say about each question; without rows, that evidence is missing."""
    item = F.struct("rank", "item_id", "content", "mode")
    d = questions.join(found.groupBy("qid").agg(F.array_sort(F.collect_list(item)).alias("items")), "qid", "left")
    lead, q = F.get("items", 0), F.lower("question")
    against = F.filter("items", lambda x: x["mode"] == "universal_counterexample")
    cite = F.concat(F.lit(". [evidence: "), lead["item_id"], F.lit("]"))
    text = (
        F.when(lead["mode"] == "universal_counterexample", F.concat(F.lit("No. Counterexample evidence: "), F.array_join(F.transform(against, lambda x: x["content"]), "; "), F.lit(". [evidence: "), F.array_join(F.transform(against, lambda x: x["item_id"]), ", "), F.lit("]")))
        .when(lead["mode"] == "existential", F.concat(F.lit("Yes. Existential support in the demo KG: "), lead["content"], cite))
        .when((F.startswith(q, F.lit("is ")) | F.contains(q, F.lit("is a "))) & F.startswith(lead["item_id"], F.lit("path:")), F.concat(F.lit("Yes, indirectly: "), lead["content"], cite))
        .when(F.startswith(q, F.lit("is ")) | F.contains(q, F.lit("is a ")), F.concat(F.lit("Yes. "), lead["content"], cite))
        .when(F.contains(lead["content"], F.lit("not_capable_of")), F.concat(F.lit("No. "), lead["content"], cite))
        .otherwise(F.concat(lead["content"], cite))
    )
    return d.select("qid", F.when(F.col("items").isNull(), "insufficient evidence").otherwise(text).alias("answer"))
