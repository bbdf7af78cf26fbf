"""A graph of facts as an edge table (triple_id, subject, predicate, object, source)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EDGE = ["triple_id", "subject", "predicate", "object", "source"]


def triple_match(edges: DataFrame, patterns: DataFrame) -> DataFrame:
    """Edges that match any pattern (pid, s, p, o) where null stands for anything.

    Patterns are split by what they bind, so each part is an equi-join.
    """
    out = None
    for cols in (("s", "p", "o"), ("s", "p"), ("s", "o"), ("p", "o"), ("s",), ("p",), ("o",)):
        free = [c for c in ("s", "p", "o") if c not in cols]
        part = patterns
        for c in cols:
            part = part.filter(F.col(c).isNotNull())
        for c in free:
            part = part.filter(F.col(c).isNull())
        name = {"s": "subject", "p": "predicate", "o": "object"}
        cond = [F.col(name[c]) == F.col(c) for c in cols]
        hit = edges.join(part, cond).select("pid", *EDGE)
        out = hit if out is None else out.unionByName(hit)
    # patterns that bind nothing: every edge, dealt evenly
    salts = 64
    free = patterns.filter("s is null and p is null and o is null").select("pid", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    whole = edges.withColumn("salt", F.pmod(F.xxhash64("triple_id"), F.lit(salts)).cast("int")).join(free, "salt").select("pid", *EDGE)
    return out.unionByName(whole)


def rendered(s: str = "subject", p: str = "predicate", o: str = "object") -> Column:
    return F.concat_ws(" ", s, p, o)


def membership(edges: DataFrame, asked: DataFrame, predicate: str = "is_a", score: float = 5.0) -> DataFrame:
    """Facts that directly state the asked (qid, subject, object)."""
    return asked.join(edges.filter(F.col("predicate") == predicate), ["subject", "object"]).select("qid", F.col("triple_id").alias("item_id"), rendered().alias("content"), F.lit(score).alias("score"))


def two_hop_paths(edges: DataFrame, asked: DataFrame | None = None, score: float = 6.0) -> DataFrame:
    """All pairs of edges a -> b -> c; with ``asked`` (qid, subject, object) only between those ends.

    Both ends are bound before the edges meet, so a hub in the middle costs only the paths asked for.
    """
    first = edges.select(F.col("triple_id").alias("id1"), F.col("subject").alias("a"), F.col("predicate").alias("p1"), F.col("object").alias("b"))
    second = edges.select(F.col("triple_id").alias("id2"), F.col("subject").alias("b"), F.col("predicate").alias("p2"), F.col("object").alias("c"))
    if asked is not None:
        ends = asked.select("qid", F.col("subject").alias("a"), F.col("object").alias("c"))
        first, second = first.join(ends.drop("c"), "a"), second.join(ends.drop("a"), "c")
        # merged, so neither side, which may be all members of a class, is held whole in a task
        paths = first.join(second.hint("merge"), ["qid", "b"])
    else:
        paths = first.join(second, "b")
    keys = ["qid"] if asked is not None else []
    return paths.select(*keys, F.concat(F.lit("path:"), F.concat_ws("->", "id1", "id2")).alias("item_id"), F.concat_ws(" ; ", F.concat_ws(" ", "a", "p1", "b"), F.concat_ws(" ", "b", "p2", "c")).alias("content"), "a", "b", "c", F.lit(score).alias("score"))


def existential(edges: DataFrame, asked: DataFrame, member: str = "is_a") -> DataFrame:
    """Evidence that some member of a class has a property: asked (qid, class, predicate, object).

    Direct statements about the class score 5, members with the property 6.
    """
    direct = asked.withColumnRenamed("class", "subject").join(edges, ["subject", "predicate", "object"]).select("qid", F.col("triple_id").alias("item_id"), rendered().alias("content"), F.lit(5.0).alias("score"))
    facts = edges.select("triple_id", F.col("subject").alias("member"), "predicate", "object")
    through = _members(edges, asked, member).join(facts.hint("merge"), ["member", "predicate", "object"])
    return direct.unionByName(through.select("qid", *_through("predicate", member), F.lit(6.0).alias("score")))


def _members(edges: DataFrame, asked: DataFrame, member: str) -> DataFrame:
    """asked, for each member of its class."""
    m = edges.filter(F.col("predicate") == member).select(F.col("triple_id").alias("member_id"), F.col("subject").alias("member"), F.col("object").alias("class"))
    return asked.join(m, "class")


def _through(predicate: str, member: str) -> tuple[Column, Column]:
    """Id and text of a path: membership, then a fact about the member."""
    path = F.concat(F.lit("path:"), F.concat_ws("->", "member_id", "triple_id"))
    return path.alias("item_id"), F.concat_ws(" ; ", F.concat_ws(" ", "member", F.lit(member), "class"), F.concat_ws(" ", "member", predicate, "object")).alias("content")


def universal(edges: DataFrame, asked: DataFrame, member: str = "is_a", denial: str = "not_capable_of") -> DataFrame:
    """Members of a class that lack a property (counterexamples, 7) and those that have it (4), as paths.

    A member lacks it by a fact ``not_<predicate>``, or without such a fact by ``denial``.
    """
    facts = edges.select("triple_id", F.col("subject").alias("member"), F.col("predicate").alias("fact"), F.col("object"))
    joined = _members(edges, asked, member).join(facts.hint("merge"), ["member", "object"])
    against = F.col("fact") == F.concat(F.lit("not_"), F.col("predicate"))
    joined = joined.filter(against | F.col("fact").isin(denial) | (F.col("fact") == F.col("predicate")))
    joined = joined.withColumn("denied", F.bool_or(against).over(Window.partitionBy("qid", "member_id", "object")))
    lacks = against | (F.col("fact").isin(denial) & ~F.col("denied"))
    holds = F.col("fact") == F.col("predicate")
    one = lambda rows, kind, score: rows.select("qid", *_through("fact", member), F.lit(kind).alias("kind"), F.lit(score).alias("score"))
    return one(joined.filter(lacks), "counterexample", 7.0).unionByName(one(joined.filter(holds), "support", 4.0))


def without_property(edges: DataFrame, asked: DataFrame, member: str = "is_a") -> DataFrame:
    """Members of a class for which no fact states the property (closed world)."""
    members = edges.filter(F.col("predicate") == member).select(F.col("subject").alias("member"), F.col("object").alias("class"))
    facts = edges.select(F.col("subject").alias("member"), "predicate", "object")
    return asked.join(members, "class").join(facts, ["member", "predicate", "object"], "left_anti").select("qid", "class", "member")


def merge_graphs(left: DataFrame, right: DataFrame, tag: str) -> DataFrame:
    """Union by (subject, predicate, object): the left edge wins and keeps a note of the right source.

    One row for each fact: of a side's edges with the same fact, that of the least id counts.
    """
    keys = ["subject", "predicate", "object"]
    once = lambda d: d.groupBy(*keys).agg(F.min(F.struct("triple_id", "source")).alias("e")).select(*keys, "e.triple_id", "e.source")
    left = once(left)
    r = once(right).select(*keys, F.col("triple_id").alias("r_id"), F.col("source").alias("r_source"))
    joined = left.join(r, keys, "full_outer")
    source = F.when(F.col("source").isNotNull() & F.col("r_source").isNotNull(), F.concat("source", F.lit(f"|{tag}:"), "r_source")).otherwise(F.coalesce("source", "r_source"))
    origin = F.when(F.col("triple_id").isNull(), "right").when(F.col("r_id").isNull(), "left").otherwise("both")
    return joined.select(F.coalesce("triple_id", "r_id").alias("triple_id"), *keys, source.alias("source"), origin.alias("origin"))


def best_per_triple(found: DataFrame, order: list[str]) -> DataFrame:
    """One row per (subject, predicate, object): the highest confidence, then the first in ``order``."""
    w = Window.partitionBy("subject", "predicate", "object").orderBy(F.desc("confidence"), *order)
    return found.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def last_per_key(rows: DataFrame, key: str, position: str) -> DataFrame:
    """The last row of each key by position."""
    w = Window.partitionBy(key).orderBy(F.desc(position))
    return rows.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def _fact(number: int, name: str, predicate: str, confidence: float):
    def fact(x: Column, j: Column) -> Column:
        return F.struct(F.lit(number).alias("pattern_no"), j.alias("match_no"), F.lower(x["s"]).alias("subject"), F.lit(predicate).alias("predicate"), F.lower(x["o"]).alias("object"), F.lit(confidence).alias("confidence"), F.lit(name).alias("pattern"))

    return fact


def extract_triples(sentences: DataFrame, patterns: list[tuple[str, str, str, float]]) -> DataFrame:
    """doc_id, sentence_no, pattern_no, match_no, subject, predicate, object, confidence, pattern.

    Each pattern (name, regex with two groups, predicate, confidence) is applied to every
    row (doc_id, sentence_no, sentence); matches of all patterns come from one pass.
    """
    each = []
    for i, (name, regex, predicate, confidence) in enumerate(patterns):
        s, o = (F.regexp_extract_all("sentence", F.lit(regex), F.lit(g)) for g in (1, 2))
        each.append(F.transform(F.arrays_zip(s.alias("s"), o.alias("o")), _fact(i, name, predicate, confidence)))
    return sentences.select("doc_id", "sentence_no", F.explode(F.flatten(F.array(*each))).alias("m")).select("doc_id", "sentence_no", "m.*")


def numbered_first(rows: DataFrame, order: list[str], most: int) -> DataFrame:
    """The first ``most`` rows in a total order with a running number from 0 (an early stop)."""
    kept = rows.orderBy(*order).limit(most)
    return kept.withColumn("number", F.row_number().over(Window.orderBy(*order)) - 1)


def resolve_prefix(wanted: DataFrame, edges: DataFrame) -> DataFrame:
    """Ids of all triples that begin with a wanted prefix, or the prefix where none does.

    An equi-join: triples meet the wanted prefixes under their own beginnings, of each length that is wanted.
    """
    lengths = sorted(r["n"] for r in wanted.select(F.length("prefix").alias("n")).filter("n is not null").distinct().collect())  # as many as there are lengths
    begins = F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length("triple_id")) if lengths else F.array().cast("array<int>")
    heads = edges.select("triple_id", F.explode(begins).alias("n")).select("triple_id", F.substr("triple_id", F.lit(1), F.col("n")).alias("prefix"))
    hit = wanted.join(heads, "prefix", "left")
    return hit.groupBy("prefix").agg(F.array_sort(F.collect_set("triple_id")).alias("ids")).select("prefix", F.when(F.size("ids") > 0, F.col("ids")).otherwise(F.array("prefix")).alias("ids"))


def turtle_line(prefix: str = "ex") -> Column:
    """An edge as a line of the graph's text form."""
    name = lambda c: F.translate(F.col(c), " -", "__")
    return F.concat(F.lit(f"{prefix}:"), name("subject"), F.lit(f" {prefix}:"), name("predicate"), F.lit(f" {prefix}:"), name("object"), F.lit(" ."))


def local_graph(found: DataFrame, most: int = 80) -> DataFrame:
    """The first ``most`` different facts of extracted rows (doc_id, sentence_no, pattern_no, match_no, ...), numbered.

    A fact counts at its first place; facts about themselves are left out; a dot at the end
    of a name is dropped. The limit is the feature: a small graph for one question.
    """
    bare = lambda c: F.regexp_replace(c, r"\.+$", "")
    d = found.withColumns({"subject": bare("subject"), "object": bare("object")}).filter("subject <> object and subject <> '' and object <> ''")
    first = d.groupBy("subject", "predicate", "object").agg(F.min(F.struct("doc_id", "pattern_no", "sentence_no", "match_no")).alias("at"))
    kept = numbered_first(first.select("subject", "predicate", "object", F.col("at.doc_id").alias("doc_id"), F.col("at.pattern_no").alias("pattern_no"), F.col("at.sentence_no").alias("sentence_no"), F.col("at.match_no").alias("match_no")), ["doc_id", "pattern_no", "sentence_no", "match_no", "subject", "object"], most)
    return kept.select(F.concat_ws("_", F.lit("qlg"), F.lpad(F.col("number").cast("string"), 4, "0"), F.col("doc_id").cast("string")).alias("triple_id"), "subject", "predicate", "object", "doc_id")


def by_mode(mode: str, curated: DataFrame, extracted: DataFrame) -> DataFrame:
    """The graph of a mode: curated, extracted, or both merged."""
    if mode == "curated":
        return curated
    if mode == "extracted":
        return extracted
    return merge_graphs(curated, extracted, "extracted").drop("origin")


def profile_facts(docs: DataFrame, profiles: DataFrame) -> DataFrame:
    """The facts of ``profiles`` (doc_id, subject, predicate, object, confidence) whose subject their document names."""
    named = F.contains(F.lower(F.concat_ws(" ", "title", "text")), F.col("subject")) | F.contains(F.col("doc_id").cast("string"), F.col("subject"))
    return docs.select("doc_id", "title", "text").join(profiles, "doc_id").filter(named).select("doc_id", "subject", "predicate", "object", "confidence")
