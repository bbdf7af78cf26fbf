from pyspark.sql import functions as F

from quillroute.functions import text as X


def one(spark, column, **values):
    d = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())) if values else spark.range(1)
    return d.select(column.alias("x")).first()["x"]


def test_identifiers_stay_whole(spark):
    t = one(spark, X.lexical_tokens(F.col("s")), s="See torch.nn.CrossEntropyLoss in RFC 7231, section 9 and pre-train § 12")
    assert "torch.nn.crossentropyloss" in t and "torch_nn_crossentropyloss" in t
    assert "rfc-7231" in t and t.count("9") == 2 and "pretrain" in t and "§12" in t
    assert one(spark, X.identifier_tokens(F.array(*map(F.lit, ["§12", "164.512", "abc", "rfc-7231", "x1"]))), s="") == ["164.512", "rfc-7231", "x1", "§12"]


def test_chunks_cover_the_text(spark):
    words = [str(i) for i in range(205)]
    d = spark.createDataFrame([(1, " ".join(words)), (2, ""), (3, "a b")], "doc_id long, text string")
    from quillroute.operators.dense import chunks

    got = {}
    for r in chunks(d, 80, 20).collect():
        got.setdefault(r["doc_id"], []).append((r["ordinal"], r["chunk"]))
    assert [c.split()[0] for _, c in sorted(got[1])] == ["0", "60", "120", "180"][: len(got[1])]
    assert sorted(got[1])[-1][1].split()[-1] == "204"
    assert got[2] == [(0, "")] and got[3] == [(0, "a b")]


def test_plain_text_snippets_and_ids(spark):
    assert one(spark, X.plain_text(F.col("s")), s="<p>a &lt;b&gt;<script>x</script>\n <b>c</b> &amp; d</p>") == "a <b> c & d"
    assert len(one(spark, X.snippet(F.col("s")), s="x" * 500)) == 240
    assert one(spark, X.stable_id(F.col("s"), F.col("t")), s="My File.txt", t="body").startswith("oc_my_file_txt_")
    assert one(spark, X.url_title(F.col("s")), s="http://a.b/some-good_page/") == "Some Good Page"
    assert one(spark, X.identifiers(F.col("s")), s="RFC 7231 and rfc, ICD-10 J18.9, torch.nn.Loss") == ["ICD-10 J18.9", "RFC-7231", "torch.nn.Loss"]
    assert one(spark, X.source_part(F.col("s"), 5), s="a:b") == "unknown"


def test_identifiers_in_normal_form(spark):
    text = "RFC 7231, rfc 2616 and RFC-9110; ICD10 E11.9, ICD-10-CM  I10, ICD 10 J45; 45  CFR 164.512; HIPAA  164.502; torch.nn.Linear"
    got = spark.range(1).select(X.identifiers(F.lit(text)).alias("i")).first()["i"]
    assert {"RFC-7231", "RFC-9110", "ICD-10 E11.9", "ICD-10 I10", "ICD-10 J45", "45 CFR 164.512", "HIPAA 164.502", "torch.nn.Linear"} <= set(got)


def test_public_records(spark):
    text = "Getting Started guide for all. Tools and more. . .Getting Started again. Getting Started here" + " x" * 20
    record = X.public_record(*map(F.lit, ("pub_rfc_7231", "The HTTP Docs", "official_docs", "RFC 7231", "Nothing else", text)))
    got = spark.range(1).select(*(v.alias(k) for k, v in record.items())).first()
    assert got["section_headings"][:2] == ["Getting Started guide for", "Tools and"] and len(got["section_headings"]) == 3
    assert {"Docs", "rfc 7231", "RFC-7231", "RFC 7231", "the http docs"} <= set(got["aliases"]) and got["aliases"] == sorted(got["aliases"])
    assert got["lead_summary"].startswith("Getting Started guide for all. Tools and more.")
    short = X.public_record(*map(F.lit, ("pub_a", "T", "standard", "A", "Fallback text. Two. Three", "too short")))
    assert spark.range(1).select(short["lead_summary"].alias("l")).first()["l"] == "T. A. Fallback text."


def test_sentences_and_headings_keep_the_digits_of_their_place(spark):
    d = spark.createDataFrame([("0 a. 1 b1; 23.5 c2.  3", "#0\n# Part 1\nChapter 2\n3")], "t string, h string")
    r = d.select(X.sentences(F.col("t")).alias("s"), X.headings(F.col("h")).alias("h")).first()
    assert r["s"] == ["0 a.", "1 b1;", "23.5 c2.", "3"] and r["h"] == ["0", "Part 1", "Chapter 2"]
