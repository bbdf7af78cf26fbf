import hashlib
import random
import re

import pytest

from quillroute.llm import decontamination as D

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
ITEMS = "item_id long, text string, n_words long, items string"


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(texts, items):
    windows = []
    for i, t in items:
        w = WORD.findall(low(t or ""))
        windows += [(i, tuple(w[k : k + 10])) for k in range(max(1, len(w) - 9))] if w else []
    for t in texts:
        w = WORD.findall(low(t or ""))
        hit, found = set(), set()
        for i, x in windows:
            for k in range(len(w) - len(x) + 1):
                if tuple(w[k : k + len(x)]) == x:
                    hit |= set(range(k, k + len(x)))
                    found.add(i)
        found.discard(None)
        yield len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)


def passages(seed):
    r = random.Random(seed)
    words = ["the", "Of", "été", "ÉTÉ", "x1", "a", "naïve", "bb", "日本", "Ab"]
    items = [(i, r.choice([" ", ", ", "\n\t"]).join(r.choices(words, k=r.choice([3, 9, 10, 11, 25])))) for i in range(30)]
    items += [(7, "repeated id " + items[3][1]), (None, items[4][1]), (50, None), (51, ""), (52, "!!! ..."), (53, items[5][1])]
    texts = [None, "", "... --", "the"]
    for _ in range(40):
        parts = [" ".join(r.choices(words, k=r.randrange(0, 12))) for _ in range(3)]
        parts.insert(r.randrange(3), (r.choice(items)[1] or "").upper() if r.random() < 0.5 else "")
        texts.append(r.choice(["; ", "-", " "]).join(parts))
    return texts + [items[0][1] * 2000], items


@pytest.mark.parametrize("automaton_bytes", [3_000_000, 2_000])
def test_against_brute_force(spark, docs_of, automaton_bytes):
    """With one automaton, and with patterns dealt over several."""
    texts, items = passages(automaton_bytes)
    benchmark = spark.createDataFrame([(i, t, 1, "x") for i, t in items], ITEMS)
    got = D.contamination_report(docs_of(texts, extra=True), benchmark, D.DecontaminationParams(automaton_bytes=automaton_bytes)).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == list(brute(texts, items))


def test_spans_are_places_in_the_given_text(spark, docs_of):
    item = "one two three four five six seven eight nine ten eleven"
    text = "Été: ONE, two\nthree (four) five six seven eight nine ten – x; eleven one"
    benchmark = spark.createDataFrame([(1, item, 1, "x")], ITEMS)
    row = D.contamination(docs_of([text]), benchmark).first()
    assert [text[s["begin"] : s["end"]] for s in row["spans"]] == ["ONE, two\nthree (four) five six seven eight nine ten"]
    assert [r["text"] for r in D.without_passages(docs_of([text, None]), benchmark).orderBy("doc_id").collect()] == ["Été:  – x; eleven one", None]


def test_empty_tables(spark, docs_of):
    none = spark.createDataFrame([], ITEMS)
    assert D.contamination_report(docs_of([]), none).collect() == []
    assert [tuple(r)[1:3] for r in D.contamination_report(docs_of(["a b"]), none).collect()] == [(2, 0)]


def test_questions_and_answers(spark, docs_of):
    qa = spark.createDataFrame([(1, "what is seen", "the blue whale")], "item_id long, question string, answer string")
    rows = D.contamination(docs_of(["what is seen here", "a blue whale", "see the blue whale"]), qa, columns=("question", "answer")).orderBy("doc_id").collect()
    assert [r["n_hit"] for r in rows] == [3, 0, 3]
