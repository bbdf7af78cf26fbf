import re

from quillroute.llm import licenses as N

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def ascii_lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def brute(text, table):
    low = ascii_lower(text or "")
    words = WORD.findall(low)
    starts = []
    base = set()
    for phrase, label in N.BASE_PHRASES:
        p = phrase.split()
        hits = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        starts += hits
        if hits:
            base.add(label)
    plain = re.sub(r"(?a)\s+(?:(?:[*#;]+|//+|--+)\s+)*", " ", low)
    found = []
    for i, r in enumerate(table):
        if r.keyword in plain:
            found += [(m.start(), m.end(), r.priority, i, r.label) for m in re.finditer(r.pattern.replace(r"\b", r"(?a:\b)"), plain)]
    kept = []
    for x in found:
        inside = [y for y in found if y[0] <= x[0] and y[1] >= x[1]]
        better = lambda y: y[2] < x[2] or y[2] == x[2] and ((y[1] - y[0], -y[3]) > (x[1] - x[0], -x[3]))
        if not any(better(y) for y in inside):
            kept.append(x)
    labels = sorted(base | {x[4] for x in kept})
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(labels)


TEXTS = [
    "Licensed under the MIT License. CC BY CC BY 4.0 and the General Public License, all rights reserved",
    None,
    "",
    "   ",
    "general public license all rights reserved all rights reserved",
    "GNU Lesser General Public License version 2.1 or GPL-2.0-only; SPDX-License-Identifier: Apache-2.0",
    "Creative Commons Attribution-NonCommercial-ShareAlike CC BY-NC-SA Copyright (c) 2020 Some Rights Reserved",
    "permission is hereby granted, free of charge, to any person obtaining a copy of the software",
    "no licence here, only ccby words and über-general  public\tlicense İ",
    "mit license mit license bsd license new bsd 3-clause license apache license, version 2.0",
    "cc by 😀 cc by",
    "all rights reserved " * 300,
    "/*\n * Published by\n * the Free   Software\tFoundation\n *\n * Redistribution and\n// use in source and binary forms\n */",
    "Creative Commons\nAttribution -- NonCommercial # # # \n * * mit\u00a0license " + "* " * 30_000 + "copyright  2020 " * 200 + "x " * 5000 + "(c) 2021",
    "neither the name of\nanyone may\n endorse or promote; mit license (c) 2020 copyright (c) 2020, cc by-nc-sa 4.0 cc-by-sa-4.0",
]


def test_against_brute_force(spark, docs_of):
    table = N.rules()
    assert len(table) > 250
    out = {r["doc_id"]: r for r in N.license_report(docs_of(TEXTS, extra=True)).collect()}
    for i, t in enumerate(TEXTS):
        r = out[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"]) == brute(t, table), (i, t)
        assert 0 <= r["score"] <= 1


def test_many_detections_take_little_time(spark, docs_of):
    text = "copyright 2020 all rights reserved " * 4_000
    (row,) = N.scan(docs_of([text])).collect()
    spans = [(d["begin"], d["end"], d["label"]) for d in row["detections"]]
    assert spans == [s for i in range(4_000) for s in ((35 * i, 35 * i + 14, "copyright"), (35 * i + 15, 35 * i + 34, "reserved"))]


def test_plan_is_native(spark, docs_of):
    plan = N.license_report(docs_of(TEXTS))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange|Join", plan)


def test_rules_fit_their_keywords(spark, docs_of):
    assert all(r.keyword == r.keyword.lower() for r in N.rules())
    gate = N._prefilter_words(N.rules())
    assert all(any(g in r.keyword for g in gate) for r in N.rules())
    assert N.license_report(docs_of([])).count() == 0


def test_repeated_rows(spark, docs_of):
    out = N.license_report(docs_of([(1, "cc by"), (1, "cc by"), (None, "x")])).collect()
    assert len(out) == 3 and [r["n_base"] for r in out if r["doc_id"] == 1] == [1, 1]
