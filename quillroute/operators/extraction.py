"""Facts from sentences: pattern tables, a gate of known entities, denials, and names of several words in questions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import entity_form, simple_tokens


@dataclass(frozen=True)
class FactPattern:
    """A regular expression with two or three groups, and the facts that one match states as (group, predicate, group)."""

    name: str
    regex: str
    facts: tuple[tuple[int, str, int], ...]
    confidence: float
    #: a text that every match holds; sentences without it are not searched
    gate: str
    only_objects: tuple[str, ...] = ()
    never_objects: tuple[str, ...] = ()


# The usual patterns of English sentences about animals, and names in normal form.
PATTERNS = (
    FactPattern("is_a_singular", r"\b(?:a|the)?\s*([a-z]+)\s+is\s+(?:a|an)\s+([a-z_ -]+?)(?:[.;,]| and|$)", ((1, "is_a", 2),), 0.82, "is", never_objects=("capable", "supported")),
    FactPattern("are_plural", r"\b([a-z]+)s\s+are\s+([a-z]+)s?\b", ((1, "is_a", 2),), 0.72, "are"),
    FactPattern("capable_of", r"\b([a-z]+)\s+is\s+capable\s+of\s+([a-z]+)\b", ((1, "capable_of", 2),), 0.86, "capable"),
    FactPattern("can_capability", r"\b([a-z]+)s?\s+(?:can|could)\s+([a-z]+)\b", ((1, "capable_of", 2),), 0.64, "c", only_objects=("fly", "swim")),
    FactPattern("not_capable_of", r"\b([a-z]+)\s+(?:is\s+)?not\s+capable\s+of\s+([a-z]+)\b", ((1, "not_capable_of", 2),), 0.86, "capable"),
    FactPattern("eats", r"\b([a-z]+)\s+eats\s+([a-z]+)\b", ((1, "eats", 2),), 0.90, "eats"),
    FactPattern("has_property", r"\b([a-z]+)\s+has\s+(?:property\s+)?([a-z]+)\b", ((1, "has_property", 2),), 0.84, "has"),
    FactPattern("produces", r"\b([a-z]+)\s+produces\s+([a-z]+)\b", ((1, "produces", 2),), 0.88, "produces"),
    FactPattern("bridge_through", r"\b([a-z]+)\s+connects\s+to\s+([a-z]+)\s+through\s+([a-z]+)\b", ((1, "is_a", 3), (3, "is_a", 2)), 0.78, "connects"),
)
ALIASES = {
    "bats": "bat", "bat": "bat", "mammals": "mammal", "mammal": "mammal", "vertebrates": "vertebrate", "vertebrate": "vertebrate", "birds": "bird", "bird": "bird", "penguins": "penguin", "penguin": "penguin",
    "whales": "whale", "whale": "whale", "dolphins": "dolphin", "dolphin": "dolphin", "salmon": "salmon", "mosquitoes": "mosquito", "mosquito": "mosquito", "insects": "insect", "insect": "insect",
    "frogs": "frog", "frog": "frog", "eagles": "eagle", "eagle": "eagle", "owls": "owl", "owl": "owl", "ducks": "duck", "duck": "duck", "sparrows": "sparrow", "sparrow": "sparrow", "cats": "cat", "cat": "cat",
    "mice": "mouse", "mouse": "mouse", "fish": "fish", "animal": "animal", "animals": "animal", "wings": "wings", "wing": "wing", "fly": "fly", "flight": "fly", "swim": "swim", "milk": "milk", "echolocation": "echolocation",
}
CLASS_ENDINGS = (" class", " relation", " facts", " evidence", " animal")
DENIALS = {"not_capable_of": "capable_of"}


def _of_pattern(number: int, p: FactPattern) -> Column:
    """The facts that a pattern finds in the column sentence, as an array."""
    regex = f"(?i){p.regex}"
    whole = F.when(F.contains(F.lower("sentence"), F.lit(p.gate)), F.regexp_extract_all("sentence", F.lit(regex), F.lit(0))).otherwise(F.array().cast("array<string>"))

    def read(match: Column, at: Column) -> Column:
        group = {g: F.lower(F.regexp_extract(match, regex, g)) for s, _, o in p.facts for g in (s, o)}
        place = [F.struct(F.lit(number).alias("pattern_no"), at.alias("match_no"), F.lit(i).alias("fact_no")) for i in range(len(p.facts))]
        return F.array(*(F.struct(place[i].alias("place"), F.lit(p.name).alias("pattern"), group[s].alias("subject"), F.lit(predicate).alias("predicate"), group[o].alias("object"), F.lit(p.confidence).alias("confidence")) for i, (s, predicate, o) in enumerate(p.facts)))

    def fits(x: Column) -> Column:
        name = F.trim(x["object"])
        return (name.isin(*p.only_objects) if p.only_objects else F.lit(True)) & ~name.isin(*p.never_objects)

    return F.filter(F.flatten(F.transform(whole, read)), fits)


def pattern_facts(sentences: DataFrame, patterns: tuple[FactPattern, ...] = PATTERNS) -> DataFrame:
    """doc_id, sentence_no, place, pattern, subject, predicate, object, confidence of (doc_id, sentence_no, sentence).

    Subjects and objects are as found. Each pattern searches a sentence once, for whole matches,
    and only sentences with its gate; groups are read from the matches. ``place`` orders a
    sentence's facts: by pattern, match and fact. Null sentences have none.
    """
    each = [_of_pattern(number, p) for number, p in enumerate(patterns)]
    return sentences.select("doc_id", "sentence_no", F.explode(F.flatten(F.array(*each))).alias("m")).select("doc_id", "sentence_no", "m.*")


def fact_id(prefix: str = "xkg") -> Column:
    """A stable id: the fact's parts and 12 hex digits of a hash of them."""
    text = F.concat_ws("|", "subject", "predicate", "object")
    return F.concat_ws("_", F.lit(prefix), "subject", "predicate", "object", F.substring(F.md5(text), 1, 12))


def known_only(facts: DataFrame, known: DataFrame, broadcast_up_to: int = 200_000) -> DataFrame:
    """Facts whose subject and object are both in ``known`` (name).

    Names are counted first: few are sent to all tasks, more are joined by shuffles.
    """
    names = known.select("name").filter("name is not null").distinct()
    small = names.limit(broadcast_up_to + 1).count() <= broadcast_up_to
    for end in ("subject", "object"):
        side = names.withColumnRenamed("name", end)
        facts = facts.join(F.broadcast(side) if small else side, end, "left_semi")
    return facts


def gated_triples(sentences: DataFrame, known: DataFrame, patterns: tuple[FactPattern, ...] = PATTERNS, aliases: dict[str, str] | None = None, denials: dict[str, str] | None = None) -> DataFrame:
    """triple_id, subject, predicate, object, doc_id, confidence, pattern, mentions, overruled.

    One row for each fact between known entities: its best mention by confidence, then the first
    in order. Where a fact and its denial (``denials``: from the denying predicate to the denied)
    are both found, the denial stays, with the denied mentions counted in ``overruled``. Facts
    are aggregated in one step, map-side first, so a fact of all documents costs no more.
    """
    aliases, denials = ALIASES if aliases is None else aliases, DENIALS if denials is None else denials
    found = pattern_facts(sentences, patterns)
    form = lambda c: entity_form(F.col(c), aliases, CLASS_ENDINGS)
    found = known_only(found.withColumns({"subject": form("subject"), "object": form("object")}), known)
    order = F.struct((-F.col("confidence")).alias("c"), "doc_id", "sentence_no", "place", "pattern")
    facts = found.groupBy("subject", "predicate", "object").agg(F.min(order).alias("best"), F.count("*").alias("mentions"))
    # a denial and what it denies meet under the denied predicate
    denied = F.col("predicate")
    for no, yes in denials.items():
        denied = F.when(F.col("predicate") == no, yes).otherwise(denied)
    row = F.struct((F.col("predicate") == denied).alias("support"), "predicate", "best", "mentions")
    met = facts.groupBy("subject", denied.alias("about"), "object").agg(F.collect_list(row).alias("rows"))  # two rows at most for each denial
    against = F.exists("rows", lambda x: ~x["support"])
    lost = F.aggregate(F.filter("rows", lambda x: x["support"]), F.lit(0).cast("long"), lambda n, x: n + x["mentions"])
    kept = met.select("subject", "object", F.explode(F.filter("rows", lambda x: ~against | ~x["support"])).alias("r"), F.when(against, lost).otherwise(0).alias("overruled"))
    kept = kept.select("subject", F.col("r.predicate").alias("predicate"), "object", F.col("r.best").alias("best"), F.col("r.mentions").alias("mentions"), "overruled")
    return kept.select(fact_id().alias("triple_id"), "subject", "predicate", "object", F.col("best.doc_id").alias("doc_id"), (-F.col("best.c")).alias("confidence"), F.col("best.pattern").alias("pattern"), "mentions", "overruled")


def alias_mentions(questions: DataFrame, aliases: DataFrame, overlapping: bool = False, broadcast_up_to: int = 200_000) -> DataFrame:
    """qid, place, width, entity: names of one or more words in questions (qid, question), in order.

    ``aliases`` has alias and entity; of several entities of one alias the least counts. Runs of
    as many words as any alias has are joined with the aliases by their words. With ``overlapping``
    every name counts, at its first place: earlier ones first, then longer ones, each entity
    once. Without it names that overlap are settled from the left, the longest first, so a
    name beats its own parts. Null questions have none.
    """
    named = aliases.select(F.array_join(simple_tokens(F.col("alias")), " ").alias("words"), F.size(simple_tokens(F.col("alias"))).alias("width"), "entity").filter("width > 0 and entity is not null").groupBy("words", "width").agg(F.min("entity").alias("entity"))
    widths = sorted(r["width"] for r in named.select("width").distinct().collect())  # as many as there are lengths of names
    if not widths:
        return questions.sparkSession.createDataFrame([], f"qid {questions.schema['qid'].dataType.simpleString()}, place int, width int, entity string")
    t = questions.select("qid", simple_tokens(F.col("question")).alias("t"))
    runs = lambda w: F.when(F.size("t") >= w, F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("t") - w)), lambda i: F.struct(i.cast("int").alias("place"), F.lit(w).alias("width"), F.array_join(F.slice("t", i + 1, w), " ").alias("words")))).otherwise(F.array().cast("array<struct<place:int,width:int,words:string>>"))
    spread = t.select("qid", F.explode(F.flatten(F.array(*map(runs, widths)))).alias("r")).select("qid", "r.*")
    small = named.limit(broadcast_up_to + 1).count() <= broadcast_up_to
    hits = spread.join(F.broadcast(named) if small else named, ["words", "width"])
    if overlapping:
        first = hits.groupBy("qid", "entity").agg(F.min(F.struct("place", (-F.col("width")).alias("w"))).alias("f"))
        return first.select("qid", F.col("f.place").alias("place"), (-F.col("f.w")).alias("width"), "entity")
    # a question's names as one array in order of place and length, from which overlapping ones go
    kind = "struct<end:int,kept:array<struct<place:int,width:int,entity:string>>>"
    ordered = hits.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("place", (-F.col("width")).alias("w"), "entity"))).alias("m"))
    start = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<place:int,width:int,entity:string>>").alias("kept")).cast(kind)
    step = lambda s, x: F.when(x["place"] >= s["end"], F.struct((x["place"] - x["w"]).alias("end"), F.concat(s["kept"], F.array(F.struct(x["place"].alias("place"), (-x["w"]).alias("width"), x["entity"].alias("entity")))).alias("kept")).cast(kind)).otherwise(s)
    return ordered.select("qid", F.explode(F.aggregate("m", start, step)["kept"]).alias("k")).select("qid", "k.*")
