import html
import json
import random

from pyspark.sql import functions as F

from quillroute.functions import text as X


def test_references_are_decoded_as_the_standard_library_does(spark):
    r = random.Random(2)
    forms = ["&#{};", "&#{}", "&#x{:x};", "&#X{:X}"]
    numbers = [0, 1, 9, 10, 11, 13, 65, 127, 128, 129, 150, 159, 160, 233, 8364, 0xD800, 0xFDD0, 0xFFFE, 0x1F600, 0x10FFFF, 0x110000, 10**12]
    texts = [f.format(n) for f in forms for n in numbers]
    names = r.sample(sorted(html.entities.html5), 150)
    texts += ["&" + n for n in names] + ["&" + n + "x" for n in names[:40]] + ["a & b &&amp;amp; &notit; &unknown; &; &#; &#x; &# 5;", "", "no reference", "&lt;&gt;&ampx;"]
    texts += ["".join(r.choices(["&", "#", "x", "41", ";", "amp", "lt", " ", "copy", "é", "not"], k=12)) for _ in range(200)]
    rows = spark.createDataFrame(list(enumerate([*texts, None])), "i int, t string").select("i", X.unescaped(F.col("t")).alias("u")).orderBy("i").collect()
    assert rows[-1]["u"] is None
    assert [(t, r["u"]) for t, r in zip(texts, rows, strict=False)] == [(t, html.unescape(t)) for t in texts]


def test_text_in_the_usual_order(spark):
    raw = "&lt;b&gt;bold&lt;/b&gt; <script>x &amp; y</script><p>a&nbsp;b&#8364;</p>"
    assert spark.range(1).select(X.unescaped_text(F.lit(raw)).alias("t")).first()["t"] == "bold a b€"


def test_nested_json(spark):
    value = {"title": "T", "n": 3, "tags": ["a", "b", 1] + ["z"] * 30, "in": {"x": 1, "deep": {"y": "q", "z": {"k": 1}}}, "none": None, "odd": "[not json"}
    texts = [json.dumps(value), "[1, {\"a\": 2}]", "plain {text}", "{broken", "{}", None]
    got = [r["t"] for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", X.flattened_json(F.col("t")).alias("t")).orderBy("i").collect()]
    assert got[0].split("\n") == ["title: T", "n: 3", "tags: a b 1 " + " ".join(["z"] * 17), "in.x: 1", "in.deep.y: q", 'in.deep.z: {"k":1}', "odd: [not json"]
    assert got[1] == '1\n{"a":2}' and got[2] == "plain {text}" and got[3] == "{broken" and got[5] is None
