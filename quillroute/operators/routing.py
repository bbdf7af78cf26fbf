"""Routers: from a question's signals to the evidence representation that serves it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import signals as S

#: Backends in the order that breaks ties.
BACKENDS = ("bm25", "dense", "kg", "hybrid")


def first_best(scores: dict[str, Column], largest: bool = False) -> Column:
    """The backend with the least (or largest) score; of equal ones the first in order."""
    best = F.greatest(*scores.values()) if largest else F.least(*scores.values())
    out = F.lit(BACKENDS[-1])
    for b in reversed(BACKENDS[:-1]):
        out = F.when(scores[b] == best, b).otherwise(out)
    return out


def with_features(questions: DataFrame) -> DataFrame:
    return questions.withColumns(S.family_features(F.col("question")))


def penalties() -> dict[str, Column]:
    """The penalty of each backend from the four feature columns."""

    def add(flag: str, x: float) -> Column:
        return F.when(F.col(flag), F.lit(x)).otherwise(F.lit(0.0))

    raw = {
        "bm25": 1.0 + add("lexical", -0.6),
        "dense": 1.0 + add("lexical", 0.2) + add("semantic", -0.5),
        "kg": 1.0 + add("deductive", -0.6) + add("relational", -0.2),
        "hybrid": 1.0 + add("relational", -0.7),
    }
    return {b: F.round(c, 6) for b, c in raw.items()}


def penalty_routes(questions: DataFrame) -> DataFrame:
    """Adds the features, a score_<backend> each, route (least penalty) and margin to the runner-up."""
    d = with_features(questions)
    d = d.withColumns({f"score_{b}": c for b, c in penalties().items()})
    scores = {b: F.col(f"score_{b}") for b in BACKENDS}
    ordered = F.array_sort(F.array(*scores.values()))
    return d.withColumns({"route": first_best(scores), "margin": F.round(F.get(ordered, 1) - F.get(ordered, 0), 6)})


def keyword_routes(questions: DataFrame) -> DataFrame:
    """Adds keyword_<backend> (shares of the score) and keyword_route."""
    q = F.lower(F.col("question"))
    on = {
        "bm25": q.rlike(S.IDENTIFIER) | S.has_any(q, S.KEYWORD_LEXICAL),
        "hybrid": S.has_any(q, S.KEYWORD_RELATIONAL),
        "kg": S.has_any(q, S.KEYWORD_DEDUCTIVE),
        "dense": S.has_any(q, S.KEYWORD_SEMANTIC),
    }
    d = questions.withColumns({f"_on_{b}": c for b, c in on.items()})

    def f(b: str) -> Column:
        return F.col(f"_on_{b}")

    def weight(b: str, x: float) -> Column:
        return F.when(f(b), F.lit(x)).otherwise(F.lit(0.0))

    nothing = ~(f("bm25") | f("hybrid") | f("kg") | f("dense"))
    raw = {
        "bm25": weight("bm25", 3.0),
        "dense": F.when(nothing, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), weight("dense", 2.4) - F.when(f("bm25") & ~f("hybrid"), 0.8).otherwise(0.0))),
        "kg": F.greatest(F.lit(0.0), weight("kg", 2.6) - F.when(f("hybrid"), 0.8).otherwise(0.0)),
        "hybrid": weight("hybrid", 3.0),
    }
    d = d.withColumns({f"_raw_{b}": c for b, c in raw.items()})
    total = sum((F.col(f"_raw_{b}") for b in BACKENDS), F.lit(0.0))
    out = {f"keyword_{b}": F.round(F.col(f"_raw_{b}") / total, 6) for b in BACKENDS}
    out["keyword_route"] = first_best({b: F.col(f"_raw_{b}") for b in BACKENDS}, largest=True)
    return d.withColumns(out).drop(*(f"_on_{b}" for b in BACKENDS), *(f"_raw_{b}" for b in BACKENDS))


def rule_routes_v2(routed: DataFrame, source_hint: Column | None = None) -> DataFrame:
    """Adds route_v2 and rule_v2 to penalty_routes(): narrow corrections, the first that fires."""
    q = F.lower(F.col("question"))
    hint = source_hint if source_hint is not None else F.lit("")
    identifier, strong = q.rlike(S.IDENTIFIER), S.has_any(q, S.V2_STRONG) | q.rlike(S.STRONG_PATTERN)
    fired = F.when(S.has_any(q, S.V2_RELATIONAL), "relational")
    fired = fired.when(S.has_any(q, S.V2_DEDUCTIVE) & ~strong, "deductive")
    fired = fired.when(identifier & S.has_any(q, S.V2_AMBIGUOUS) & ~strong, "ambiguous_identifier")
    fired = fired.when(identifier & strong, "strong_identifier")
    fired = fired.when(hint.isin("source_pack:rfc_specs", "source_pack:medical_codes", "source_pack:cs_api_docs") & identifier, "source_prior")
    fired = fired.when((F.col("margin") < 0.15) & F.col("semantic") & ~F.col("lexical"), "low_margin")
    d = routed.withColumn("rule_v2", F.coalesce(fired, F.lit("none")))
    r = F.col("rule_v2")
    route = F.when(r == "relational", "hybrid").when(r == "deductive", "kg").when(r.isin("ambiguous_identifier", "low_margin"), "dense").when(r.isin("strong_identifier", "source_prior"), "bm25")
    return d.withColumn("route_v2", F.coalesce(route, F.col("route")))


def route_confidence(routed: DataFrame) -> DataFrame:
    """Adds runner_up, agreement, confidence_score and confidence from the penalty and keyword routers."""
    agree = (F.col("keyword_route") == F.col("route")).cast("int")
    others = {b: F.when(F.col("route") == b, F.lit(1e9)).otherwise(F.col(f"score_{b}")) for b in BACKENDS}
    d = routed.withColumns({"agreement": agree, "runner_up": first_best(others)})
    d = d.withColumn("confidence_score", F.round(F.col("margin") + 0.15 * F.col("agreement"), 6))
    high = (F.col("confidence_score") >= 0.65) & (F.col("margin") >= 0.35)
    medium = (F.col("confidence_score") >= 0.35) | (F.col("agreement") > 0)
    return d.withColumn("confidence", F.when(high, "high").when(medium, "medium").otherwise("low"))


def calibrated_routes(routed: DataFrame) -> DataFrame:
    """Adds the calibration signals, calibrated_route and override, to penalty_routes()."""
    d = routed.withColumns(S.calibration_signals(F.col("question")))
    r = F.col("route")
    structural = F.when(F.col("relational_cue") & (r != "hybrid"), "hybrid").when(F.col("deductive_cue") & ~F.col("explicit_kg_negation") & (r != "kg"), "kg")
    bait = F.when((r == "bm25") & F.col("semantic_cue") & F.col("misleading_exact_cue") & ~F.col("primary_identifier_query"), "dense")
    suppressed = F.when((r == "kg") & F.col("explicit_kg_negation") & F.col("identifier_heavy"), "bm25")
    name = F.when(structural.isNotNull(), "structural").when(bait.isNotNull(), "semantic_bait").when(suppressed.isNotNull(), "kg_suppression").otherwise("none")
    return d.withColumns({"calibrated_route": F.coalesce(structural, bait, suppressed, r), "override": name})


def classifier_override(routed: DataFrame, classifier: str, scores: dict[str, Column], least: float = 0.42, gap: float = 0.08) -> DataFrame:
    """Adds final_route to calibrated_routes() with a confidence: a classifier's route where it may decide.

    It may where confidence is not high, a signal of a hard boundary is on, and its score
    (``scores`` per backend, missing ones 0) is at least ``least`` and ``gap`` above the chosen route's.
    """

    def score(route: Column) -> Column:
        out = F.lit(0.0)
        for b, c in scores.items():
            out = F.when(route == b, F.coalesce(c, F.lit(0.0))).otherwise(out)
        return out

    theirs, ours = F.col(classifier), F.col("calibrated_route")
    hard = F.col("misleading_exact_cue") | F.col("explicit_kg_negation") | F.col("identifier_heavy") & (F.col("semantic_cue") | F.col("relational_cue"))
    wins = (theirs != ours) & (F.col("confidence") != "high") & hard & (score(theirs) >= least) & (F.round(score(theirs) - score(ours), 9) >= gap)
    return routed.withColumn("final_route", F.when(wins, theirs).otherwise(ours))


def explain_versions(routed: DataFrame, key: str, versions: dict[str, str]) -> DataFrame:
    """key, version, route, votes, ambiguous: every version's choice, and how many versions choose alike."""
    d = route_votes(routed, tuple(versions.values()))
    all_ = F.array(*(F.col(c) for c in versions.values()))
    each = F.explode(F.array(*(F.struct(F.lit(v).alias("version"), F.col(c).alias("route")) for v, c in versions.items())))
    d = d.select(key, "margin", "ambiguous", all_.alias("routes"), each.alias("e"))
    return d.select(key, "margin", "ambiguous", "e.version", "e.route", F.size(F.filter("routes", lambda r: r == F.col("e.route"))).alias("votes"))


def route_votes(routed: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Adds n_routes (distinct votes) and ambiguous (little margin, or votes that differ)."""
    votes = F.size(F.array_distinct(F.array(*(F.col(c) for c in columns))))
    return routed.withColumn("n_routes", votes).withColumn("ambiguous", (F.col("margin") < 0.25) | (F.col("n_routes") > 1))


def feature_ablation(questions: DataFrame, key: str) -> DataFrame:
    """For each active feature of a question: the route and margin without it."""
    base = penalty_routes(questions)
    flags = ("lexical", "semantic", "deductive", "relational")
    active = F.explode(F.array_compact(F.array(*(F.when(F.col(f), f) for f in flags))))
    d = base.select(key, *flags, F.col("route").alias("route_before"), F.col("margin").alias("margin_before"), active.alias("feature"))
    d = d.withColumns({f: F.col(f) & (F.col("feature") != f) for f in flags})
    d = d.withColumns({f"score_{b}": c for b, c in penalties().items()})
    scores = {b: F.col(f"score_{b}") for b in BACKENDS}
    ordered = F.array_sort(F.array(*scores.values()))
    d = d.withColumns({"route_after": first_best(scores), "margin_after": F.round(F.get(ordered, 1) - F.get(ordered, 0), 6)})
    return d.select(key, "feature", "route_before", "route_after", "margin_before", "margin_after", (F.col("route_before") != F.col("route_after")).alias("changed"))


def long_features(frame: DataFrame, key: str, names: tuple[str, ...]) -> DataFrame:
    """key, feature, value: the named columns unpivoted as doubles."""
    return frame.select(key, *(F.col(n).cast("double").alias(n) for n in names)).unpivot(key, list(names), "feature", "value")


def linear_scores(features: DataFrame, weights: DataFrame, key: str) -> DataFrame:
    """key, label, score = sum of weight x value; ``weights`` (label, feature, weight) is a model's table."""
    return features.join(weights, "feature").groupBy(key, "label").agg(F.round(F.sum(F.col("weight") * F.col("value")), 6).alias("score"))


def linear_contributions(features: DataFrame, weights: DataFrame, key: str) -> DataFrame:
    """The terms of linear_scores() that are not zero."""
    d = features.join(weights, "feature").withColumn("contribution", F.round(F.col("weight") * F.col("value"), 6))
    return d.filter("contribution <> 0").select(key, "label", "feature", "contribution")


def best_label(scores: DataFrame, key: str) -> DataFrame:
    """key, route, margin: the label with the highest score, ties by the order of backends."""
    order = F.array_position(F.array(*(F.lit(b) for b in BACKENDS)), F.col("label"))
    w = Window.partitionBy(key).orderBy(F.desc("score"), order)
    d = scores.withColumns({"rn": F.row_number().over(w), "next": F.lead("score").over(w)})
    return d.filter("rn = 1").select(key, F.col("label").alias("route"), F.round(F.col("score") - F.col("next"), 6).alias("margin"))


def tune(decisions: DataFrame, config: str, route: str, gold: str, changed: str) -> DataFrame:
    """The best configuration: most right routes, then fewest overrides, then name. One row per config is compared."""
    per = decisions.groupBy(config).agg(F.round(F.avg((F.col(route) == F.col(gold)).cast("double")), 6).alias("accuracy"), F.count_if(changed).alias("overrides"))
    return per.orderBy(F.desc("accuracy"), "overrides", config).limit(1)


def feature_effects(questions: DataFrame, key: str) -> DataFrame:
    """key, feature, backend, delta: what each active feature adds to each penalty."""
    # The penalty table's deltas.
    deltas = (("lexical", "bm25", -0.6), ("lexical", "dense", 0.2), ("semantic", "dense", -0.5), ("deductive", "kg", -0.6), ("relational", "hybrid", -0.7), ("relational", "kg", -0.2))
    rows = F.array(*(F.struct(F.lit(f).alias("feature"), F.lit(b).alias("backend"), F.lit(x).alias("delta"), F.col(f).alias("active")) for f, b, x in deltas))
    d = with_features(questions).select(key, F.explode(rows).alias("e")).select(key, "e.*")
    return d.filter("active").select(key, "feature", "backend", "delta")


def parse_reply(reply: Column, fallback: Column) -> Column:
    """The route named in a model's JSON reply, the fallback if there is none that is known."""
    named = F.lower(F.from_json(F.regexp_extract(reply, r"(?s)\{.*\}", 0), "route string")["route"])
    return F.when(named.isin(*BACKENDS), named).otherwise(fallback)


def seeded_route(key: Column, seed: int) -> Column:
    """A random but repeatable route."""
    return F.element_at(F.array(*(F.lit(b) for b in BACKENDS)), (F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(4)) + 1).cast("int"))
