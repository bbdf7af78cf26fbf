import math

from pyspark.sql import functions as F

from quillroute.functions import signals as S
from quillroute.operators import diagnostics, routing


def test_identifiers_and_interfaces(spark):
    texts = ["RFC-7231 or RFC7231, ICD-10 A12.3; 45 CFR 164.512 §9", "use torch.nn.Linear", "sklearn only", "Sklearn, rfc-7231", "plain words. No more", "", None]
    s = S.interface_signals(F.col("t"))
    got = [tuple(r) for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(s["identifiers"], s["api_cue"]).collect()]
    assert got == [
        (["RFC-7231", "RFC7231", "ICD-10 A12.3", "164.512", "§9", "A12.3"], True),
        (["torch.nn.Linear"], True),
        ([], True),
        ([], False),
        ([], False),
        ([], False),
        ([], False),
    ]


def test_all_features(spark):
    rows = [(1, "RFC-7231 in torch.nn", "Source_Pack:rfc", True, None), (2, "plain", None, None, True), (3, "plain", "public_raw", False, False)]
    asked = spark.createDataFrame(rows, "qid int, question string, source string, local_graph boolean, rescue boolean")
    routed = routing.keyword_routes(routing.penalty_routes(asked))
    got = {r["qid"]: r.asDict() for r in diagnostics.sourced_features(routed).collect()}
    assert len(got[1]) == 1 + 31
    # RFC-7231 and torch.nn count in both lists
    assert got[1]["identifier_count_log"] == round(math.log1p(4), 6)
    assert (got[1]["source_open_corpus"], got[1]["source_formal_spec"], got[1]["source_curated"], got[1]["query_local_graph_available"], got[1]["topk_rescue_opportunity"]) == (1.0, 1.0, 0.0, 1.0, 0.0)
    assert sum(v for k, v in got[2].items() if k.startswith("source_")) == 0 and got[2]["topk_rescue_opportunity"] == 1.0
    assert (got[2]["public_document_noise"], got[3]["public_document_noise"]) == (0.0, 1.0)
    plain = {r["qid"]: r.asDict() for r in diagnostics.route_features(routed).collect()}
    assert all(got[i][k] == v for i, r in plain.items() for k, v in r.items() if k != "public_document_noise")
