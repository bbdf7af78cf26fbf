from pyspark.sql import functions as F

from quillroute.operators import extraction as X


def sentences(spark, texts):
    return spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "doc_id int, sentence_no int, sentence string")


def known(spark):
    return spark.createDataFrame([(v,) for v in set(X.ALIASES.values())] + [(None,)], "name string")


def facts(df):
    return {(r["subject"], r["predicate"], r["object"]): r for r in df.collect()}


def test_usual_patterns_between_known_entities(spark):
    texts = ["A bat is a mammal.", "Penguins are birds", "The bat is capable of flight; a car is a vehicle", "Bats can swim and bats can run", "owl EATS mice", "bat connects to vertebrate through mammal", "penguin is not capable of fly", None, "", "A bat is a supported animal."]
    got = facts(X.gated_triples(sentences(spark, texts), known(spark)))
    assert set(got) == {("bat", "is_a", "mammal"), ("penguin", "is_a", "bird"), ("bat", "capable_of", "fly"), ("bat", "capable_of", "swim"), ("owl", "eats", "mouse"), ("mammal", "is_a", "vertebrate"), ("penguin", "not_capable_of", "fly")}
    bat = got["bat", "is_a", "mammal"]
    assert (bat["pattern"], bat["confidence"], bat["mentions"], bat["doc_id"]) == ("is_a_singular", 0.82, 2, 0)
    assert got["mammal", "is_a", "vertebrate"]["pattern"] == "bridge_through"
    assert bat["triple_id"].startswith("xkg_bat_is_a_mammal_") and len(bat["triple_id"].rsplit("_", 1)[1]) == 12


def test_a_denial_wins_over_support(spark):
    texts = ["penguins can fly", "penguin is capable of flight", "penguin is not capable of flight", "duck is capable of flight"]
    got = facts(X.gated_triples(sentences(spark, texts), known(spark)))
    assert set(got) == {("penguin", "not_capable_of", "fly"), ("duck", "capable_of", "fly")}
    assert got["penguin", "not_capable_of", "fly"]["overruled"] == 2 and got["duck", "capable_of", "fly"]["overruled"] == 0


def test_nothing_known_and_no_sentences(spark):
    none = spark.createDataFrame([], "name string")
    assert X.gated_triples(sentences(spark, ["a bat is a mammal"]), none).count() == 0
    assert X.gated_triples(sentences(spark, []), known(spark)).count() == 0


def test_plan_gates_by_a_broadcast_of_checked_size(spark):
    s = sentences(spark, ["a bat is a mammal"])
    few = X.known_only(X.pattern_facts(s), known(spark))._jdf.queryExecution().toString()
    many = X.known_only(X.pattern_facts(s), known(spark), 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "BroadcastHashJoin" in few and "broadcast" not in many


def test_the_longer_name_beats_its_parts(spark):
    asked = spark.createDataFrame([(1, "Is the emperor penguin a bird of prey?"), (2, "penguin emperor, Bird"), (3, None), (4, "of prey bird of prey bird")], "qid int, question string")
    names = [("penguin", "penguin"), ("emperor penguin", "emperor"), ("bird", "bird"), ("bird of prey", "raptor"), ("of prey", "hunting"), ("penguin", "zzz"), ("prey bird of", "odd"), ("", "x")]
    aliases = spark.createDataFrame(names, "alias string, entity string")
    rows = lambda df: sorted(tuple(r) for r in df.select("qid", "place", "width", "entity").collect())
    want = [(1, 2, 2, "emperor"), (1, 5, 3, "raptor"), (2, 0, 1, "penguin"), (2, 2, 1, "bird"), (4, 0, 2, "hunting"), (4, 2, 3, "raptor"), (4, 5, 1, "bird")]
    for most in (200_000, 2):
        assert rows(X.alias_mentions(asked, aliases, broadcast_up_to=most)) == want
    every = X.alias_mentions(asked.filter("qid = 1"), aliases, overlapping=True)
    assert [r["entity"] for r in every.orderBy("place", F.desc("width")).collect()] == ["emperor", "penguin", "raptor", "bird", "hunting"]
    assert X.alias_mentions(asked, aliases.limit(0)).collect() == []
