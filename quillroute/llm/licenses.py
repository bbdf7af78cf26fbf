"""License scans: ordered signature rules over whole texts, in DataFrame functions only.

A rule is a hand-written regular expression with a label, a priority and a keyword. A text
is first tested for any keyword (cheap substring tests); only rules whose keyword occurs are
run, and only on texts that pass. The rules read the text with every run of white space, and
the comment marks that stand free in it, as one blank, so that line breaks do not hide a
notice. Every detection is an interval of that text. A detection
that lies within a detection of a better rule (lower priority number; of equals the longer,
then the earlier rule) is suppressed, so ``the MIT license`` inside ``the MIT license (MIT)``
counts once. Everything is a projection: no shuffle, no Python on the executors.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The phrases of the base detection and their labels.
BASE_PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    keyword: str
    pattern: str
    label: str
    priority: int
    weight: float


# Families: label stem, the keyword that gates them, how the name is written (a regex), versions.
_FAMILIES: tuple[tuple[str, str, str, tuple[str, ...]], ...] = (
    ("apache", "apache", r"apache(?: software)?", ("1.0", "1.1", "2.0")),
    ("mit", "mit", r"(?:the )?mit(?:/x11| \(expat\))?", ()),
    ("x11", "x11", r"x11", ()),
    ("bsd", "bsd", r"(?:new |modified |simplified |revised |original )?bsd(?:[ -](?:2|3|4|zero|two|three|four)[ -]clause)?", ()),
    ("isc", "isc", r"isc", ()),
    ("gpl", "gpl", r"(?:gnu )?gpl", ("1", "2", "3", "1.0", "2.0", "3.0")),
    ("lgpl", "lgpl", r"(?:gnu )?lgpl", ("2", "2.1", "3", "3.0")),
    ("agpl", "agpl", r"(?:gnu )?agpl", ("1", "3", "3.0")),
    ("gfdl", "free documentation", r"gnu free documentation", ("1.1", "1.2", "1.3")),
    ("mpl", "mozilla public", r"mozilla public", ("1.0", "1.1", "2.0")),
    ("epl", "eclipse public", r"eclipse public", ("1.0", "2.0")),
    ("edl", "eclipse distribution", r"eclipse distribution", ("1.0",)),
    ("cddl", "common development and distribution", r"common development and distribution", ("1.0", "1.1")),
    ("cpl", "common public", r"common public", ("1.0",)),
    ("ipl", "ibm public", r"ibm public", ("1.0",)),
    ("eupl", "european union public", r"european union public", ("1.0", "1.1", "1.2")),
    ("artistic", "artistic", r"(?:perl )?artistic", ("1.0", "2.0")),
    ("bsl", "boost software", r"boost software", ("1.0",)),
    ("busl", "business source", r"business source", ("1.0", "1.1")),
    ("sspl", "server side public", r"server side public", ("1",)),
    ("elastic", "elastic", r"elastic", ("1.0", "2.0")),
    ("zlib", "zlib", r"zlib(?:/libpng)?", ()),
    ("libpng", "libpng", r"libpng", ("2.0",)),
    ("openssl", "openssl", r"openssl", ()),
    ("php", "php", r"php", ("3.0", "3.01")),
    ("python", "python", r"python(?: software foundation)?", ("2.0",)),
    ("ruby", "ruby", r"ruby", ()),
    ("unlicense", "unlicense", r"unlicense", ()),
    ("wtfpl", "wtfpl", r"wtfpl", ("2",)),
    ("ofl", "open font", r"(?:sil )?open font", ("1.0", "1.1")),
    ("odbl", "open database", r"open database", ("1.0",)),
    ("odc-by", "open data commons attribution", r"open data commons attribution", ("1.0",)),
    ("pddl", "public domain dedication and", r"public domain dedication and", ("1.0",)),
    ("ogl", "open government", r"open government", ("1.0", "2.0", "3.0")),
    ("postgresql", "postgresql", r"postgresql", ()),
    ("upl", "universal permissive", r"universal permissive", ("1.0",)),
    ("afl", "academic free", r"academic free", ("1.1", "1.2", "2.0", "2.1", "3.0")),
    ("osl", "open software", r"open software", ("1.0", "2.0", "2.1", "3.0")),
    ("ms-pl", "microsoft public", r"microsoft public", ()),
    ("ms-rl", "microsoft reciprocal", r"microsoft reciprocal", ()),
    ("ncsa", "ncsa", r"(?:university of illinois/)?ncsa(?: open source)?", ()),
    ("w3c", "w3c", r"w3c(?: software(?: notice and)?)?", ()),
    ("cecill", "cecill", r"cecill(?:-b|-c)?", ("1.0", "1.1", "2.0", "2.1")),
    ("apsl", "apple public source", r"apple public source", ("1.0", "1.1", "1.2", "2.0")),
    ("qpl", "q public", r"q public", ("1.0",)),
    ("lppl", "latex project public", r"latex project public", ("1.0", "1.1", "1.2", "1.3c")),
    ("npl", "netscape public", r"netscape public", ("1.0", "1.1")),
    ("rpl", "reciprocal public", r"reciprocal public", ("1.1", "1.5")),
    ("mulan", "mulan", r"mulan(?: permissive(?: software)?)?", ("1", "2")),
    ("openrail", "openrail", r"(?:bigscience )?openrail(?:-m)?", ()),
)

# SPDX-like identifiers that stand alone: each is a rule of its own.
_IDENTIFIERS = """
apache-1.0 apache-1.1 apache-2.0 mit-0 bsd-1-clause bsd-2-clause bsd-3-clause bsd-4-clause 0bsd gpl-1.0-only gpl-1.0-or-later
gpl-2.0-only gpl-2.0-or-later gpl-3.0-only gpl-3.0-or-later lgpl-2.0-only lgpl-2.0-or-later lgpl-2.1-only lgpl-2.1-or-later
lgpl-3.0-only lgpl-3.0-or-later agpl-3.0-only agpl-3.0-or-later gfdl-1.3-only mpl-1.1 mpl-2.0 epl-1.0 epl-2.0 cddl-1.0
cddl-1.1 eupl-1.2 bsl-1.0 busl-1.1 sspl-1.0 cc0-1.0 cc-by-1.0 cc-by-2.0 cc-by-2.5 cc-by-3.0 cc-by-4.0 cc-by-sa-2.0
cc-by-sa-2.5 cc-by-sa-3.0 cc-by-sa-4.0 cc-by-nc-3.0 cc-by-nc-4.0 cc-by-nd-3.0 cc-by-nd-4.0 cc-by-nc-sa-3.0 cc-by-nc-sa-4.0
cc-by-nc-nd-3.0 cc-by-nc-nd-4.0 ofl-1.1 odbl-1.0 odc-by-1.0 pddl-1.0 ogl-uk-3.0 afl-3.0 osl-3.0 upl-1.0 artistic-2.0
""".split()

# Notices: keyword, pattern, label, priority, weight.
_NOTICES: tuple[tuple[str, str, str, int, float], ...] = (
    ("permission is hereby granted", r"permission is hereby granted,? free of charge,? to any person obtaining a copy", "mit", 10, 1.0),
    ("redistribution and use", r"redistribution and use in source and binary forms", "bsd", 10, 1.0),
    ("endorse or promote", r"neither the name [^.\n]{0,200}? endorse or promote", "bsd-3-clause", 9, 1.0),
    ("permission to use, copy, modify", r"permission to use, copy, modify,? and(?:/or)? distribute this software", "isc", 10, 1.0),
    ("free software foundation", r"published by the free software foundation", "gpl", 15, 0.9),
    ("general public license", r"gnu lesser general public license", "lgpl", 8, 1.0),
    ("general public license", r"gnu library general public license", "lgpl", 8, 1.0),
    ("general public license", r"gnu affero general public license", "agpl", 8, 1.0),
    ("general public license", r"(?:gnu )?general public license,? (?:as published|version|v)", "gpl", 12, 1.0),
    ("general public license", r"(?:gnu )?general public license", "gpl", 20, 0.9),
    ("creative commons", r"creative commons attribution[ -]noncommercial[ -]sharealike", "cc-by-nc-sa", 5, 1.0),
    ("creative commons", r"creative commons attribution[ -]noncommercial[ -]no ?deriv(?:ative)?s", "cc-by-nc-nd", 5, 1.0),
    ("creative commons", r"creative commons attribution[ -]noncommercial", "cc-by-nc", 6, 1.0),
    ("creative commons", r"creative commons attribution[ -]share ?alike", "cc-by-sa", 6, 1.0),
    ("creative commons", r"creative commons attribution[ -]no ?deriv(?:ative)?s", "cc-by-nd", 6, 1.0),
    ("creative commons", r"creative commons attribution", "cc-by", 7, 1.0),
    ("creative commons", r"creative commons (?:zero|cc0)", "cc0", 6, 1.0),
    ("creative commons", r"creative commons", "creative-commons", 30, 0.6),
    ("creativecommons.org", r"creativecommons\.org/licenses/by-nc-sa", "cc-by-nc-sa", 4, 1.0),
    ("creativecommons.org", r"creativecommons\.org/licenses/by-nc-nd", "cc-by-nc-nd", 4, 1.0),
    ("creativecommons.org", r"creativecommons\.org/licenses/by-nc", "cc-by-nc", 5, 1.0),
    ("creativecommons.org", r"creativecommons\.org/licenses/by-sa", "cc-by-sa", 5, 1.0),
    ("creativecommons.org", r"creativecommons\.org/licenses/by-nd", "cc-by-nd", 5, 1.0),
    ("creativecommons.org", r"creativecommons\.org/licenses/by", "cc-by", 6, 1.0),
    ("creativecommons.org", r"creativecommons\.org/publicdomain/zero", "cc0", 4, 1.0),
    ("cc by", r"\bcc by-nc-sa\b", "cc-by-nc-sa", 5, 1.0),
    ("cc by", r"\bcc by-nc-nd\b", "cc-by-nc-nd", 5, 1.0),
    ("cc by", r"\bcc by-nc\b", "cc-by-nc", 6, 1.0),
    ("cc by", r"\bcc by-sa\b", "cc-by-sa", 6, 1.0),
    ("cc by", r"\bcc by-nd\b", "cc-by-nd", 6, 1.0),
    ("cc by", r"\bcc by(?: [1-4]\.\d)?\b", "cc-by", 7, 0.9),
    ("cc-by", r"\bcc-by-nc-sa\b", "cc-by-nc-sa", 5, 1.0),
    ("cc-by", r"\bcc-by-nc-nd\b", "cc-by-nc-nd", 5, 1.0),
    ("cc-by", r"\bcc-by-nc\b", "cc-by-nc", 6, 1.0),
    ("cc-by", r"\bcc-by-sa\b", "cc-by-sa", 6, 1.0),
    ("cc-by", r"\bcc-by-nd\b", "cc-by-nd", 6, 1.0),
    ("cc-by", r"\bcc-by\b", "cc-by", 7, 0.9),
    ("cc0", r"\bcc0\b", "cc0", 7, 0.9),
    ("public domain", r"(?:released|dedicated|placed|is) (?:in|into|to) the public domain", "public-domain", 10, 0.9),
    ("public domain", r"public domain", "public-domain", 30, 0.5),
    ("rights reserved", r"all rights reserved", "reserved", 20, 0.9),
    ("rights reserved", r"some rights reserved", "some-rights-reserved", 20, 0.7),
    ("rights reserved", r"no rights reserved", "cc0", 20, 0.7),
    ("proprietary", r"proprietary and confidential", "proprietary", 10, 0.9),
    ("proprietary", r"proprietary license", "proprietary", 12, 0.8),
    ("without permission", r"(?:may|must) not be (?:reproduced|copied|distributed) [^.\n]{0,120}?without permission", "proprietary", 14, 0.8),
    ("non-commercial", r"for non-commercial (?:use|purposes) only", "non-commercial", 12, 0.8),
    ("personal use", r"for personal use only", "non-commercial", 14, 0.6),
    ("copyright", r"copyright (?:\(c\) |© )?(?:19|20)\d\d", "copyright", 40, 0.4),
    ("copyright", r"copyright notice", "copyright", 40, 0.3),
    ("(c)", r"\(c\) (?:19|20)\d\d", "copyright", 41, 0.3),
    ("©", r"© ?(?:19|20)\d\d", "copyright", 41, 0.3),
    ("spdx-license-identifier", r"spdx-license-identifier:\s*[a-z0-9.+-]+", "spdx", 35, 0.9),
    ("as is", r"provided [\"']?as is[\"']?,? without (?:any )?warranty", "warranty-disclaimer", 45, 0.3),
)


def rules() -> list[Rule]:
    """All rules in their order; the position is the last tie-break."""
    out: list[Rule] = []
    word = r"(?:licen[sc]e|licen[sc]ed?)"
    for stem, keyword, name, versions in _FAMILIES:
        for v in versions:
            dots = v.replace(".", r"\.")
            out.append(Rule(keyword, rf"\b{name} {word},? (?:version |v\.? ?)?{dots}\b", f"{stem}-{v}", 10, 1.0))
            out.append(Rule(keyword, rf"\b{name}[ -](?:version |v\.? ?)?{dots}\b", f"{stem}-{v}", 12, 0.9))
        out.append(Rule(keyword, rf"\blicensed under (?:the )?(?:terms of the )?{name}\b", stem, 14, 0.9))
        out.append(Rule(keyword, rf"\b{name} {word}\b", stem, 16, 0.8))
    for i in _IDENTIFIERS:
        out.append(Rule(i, rf"(?<![a-z0-9.+-]){i.replace('.', chr(92) + '.')}(?![a-z0-9+-])", i, 3, 1.0))
    out += [Rule(*n) for n in _NOTICES]
    return out


def _prefilter_words(table: list[Rule]) -> list[str]:
    """The fewest keywords that every rule's keyword contains."""
    words = sorted({r.keyword for r in table}, key=lambda w: (len(w), w))
    kept: list[str] = []
    for w in words:
        if not any(k in w for k in kept):
            kept.append(w)
    return kept


def _lower_ascii(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def _blanks(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def scan(docs: DataFrame, table: list[Rule] | None = None) -> DataFrame:
    """doc_id, text statistics, base detections and the detections of the rules, per row.

    Null texts count as empty and match nothing; repeated rows are scanned one by one; only
    doc_id and text are read, so the names of other columns cannot clash.
    """
    table = rules() if table is None else table
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _lower_ascii(F.coalesce(F.col("text"), F.lit(""))).alias("low"))
    d = d.withColumn("plain", F.regexp_replace("low", _GAPS, " "))
    # every word between two blanks of its own, so that neighbouring phrases share none
    d = d.withColumn("words", F.concat(F.lit(" "), F.trim(F.regexp_replace("low", r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "  ")), F.lit(" ")))
    d = d.withColumn("words", F.when(F.col("words") == "  ", "").otherwise(F.col("words")))
    columns = {"n_words": _blanks(F.col("words")) / 2}
    for i, (phrase, _) in enumerate(BASE_PHRASES):
        inner = F.lit(f" {phrase.replace(' ', '  ')} ")
        size = phrase.count(" ") + 1
        there = F.contains(F.col("words"), inner)
        before = F.substring_index("words", f" {phrase.replace(' ', '  ')} ", 1)
        after = F.substring_index("words", f" {phrase.replace(' ', '  ')} ", -1)
        n = (F.length("words") - F.length(F.replace(F.col("words"), inner, F.lit("")))) / F.length(inner)
        columns |= {f"n{i}": F.when(there, n).otherwise(0), f"first{i}": F.when(there, _blanks(before) / 2), f"last{i}": F.when(there, F.col("n_words") - _blanks(after) / 2 - size)}
    first, rest = {"n_words": columns.pop("n_words").cast("long")}, {k: v.cast("long") for k, v in columns.items()}
    d = d.withColumns(first).withColumns(rest)
    k = range(len(BASE_PHRASES))
    base = F.array_compact(F.array(*(F.when(F.col(f"n{i}") > 0, label) for i, (_, label) in enumerate(BASE_PHRASES))))
    found = _detections(F.col("plain"), table)
    return d.select(
        "doc_id", "n_words",
        sum((F.col(f"n{i}") for i in k), F.lit(0)).cast("long").alias("n_base"),
        F.least(*(F.col(f"first{i}") for i in k)).alias("first_word"),
        F.greatest(*(F.col(f"last{i}") for i in k)).alias("last_word"),
        F.array_sort(F.array_distinct(base)).alias("base"),
        found.alias("detections"),
    )


#: Free-standing comment marks and the white space around them: one blank for the rules.
_GAPS = r"\s++(?:(?:[*#;]++|//++|--++)\s++)*+"
_POWERS = [1 << i for i in range(31)]
_DETECTION = "array<struct<begin:int,end:int,priority:int,position:int,label:string,weight:double>>"


def _bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), 0)


def _running_sums(a: Column) -> Column:
    """Running sums of an array that a lambda variable holds: log2(n) passes, by doubling the reach."""
    steps = F.filter(F.array(*map(F.lit, _POWERS)), lambda d: d < F.size(a))
    return F.aggregate(steps, a, lambda acc, d: F.transform(acc, lambda x, i: x + F.coalesce(F.get(acc, i - d), F.lit(0))))


def _starting_before(detections: Column, value: Column) -> Column:
    """How many of the detections, sorted by begin, begin before ``value``: a binary search."""
    steps = F.filter(F.array(*map(F.lit, reversed(_POWERS))), lambda d: d <= F.size(detections))
    return F.aggregate(steps, F.lit(0), lambda n, d: F.when(F.get(detections, n + d - 1)["begin"] < value, n + d).otherwise(n))


def _live(text: Column, table: list[Rule]) -> Column:
    """Positions of the rules that match: keywords first, then literal patterns, which Spark compiles once."""
    gated: dict[str, list[int]] = {}
    for i, r in enumerate(table):
        gated.setdefault(r.keyword, []).append(i)
    groups = (F.when(F.contains(text, F.lit(k)), F.array_compact(F.array(*(F.when(F.rlike(text, F.lit(table[i].pattern)), F.lit(i)) for i in group)))) for k, group in gated.items())
    return F.flatten(F.array_compact(F.array(*groups)))


def _detections(text: Column, table: list[Rule]) -> Column:
    """Detections that no better one contains, by begin: array of (begin, end, priority, position, label, weight).

    Time grows with the number of detections times its logarithm, and with how many overlap.
    """
    gate = reduce(or_, (F.contains(text, F.lit(w)) for w in _prefilter_words(table)), F.lit(False))
    schema = "array<struct<pattern:string,label:string,priority:int,weight:double>>"
    spec = F.from_json(F.lit(json.dumps([{"pattern": r.pattern, "label": r.label, "priority": r.priority, "weight": r.weight} for r in table])), schema)

    def measured(position: Column) -> Column:
        pattern = F.get(spec, position)["pattern"]
        sizes = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.length)
        return F.struct(position.alias("position"), sizes.alias("sizes"), F.transform(F.split(text, pattern, -1), F.length).alias("gaps"))

    def spans(m: Column) -> Column:
        r = F.get(spec, m["position"])
        steps = F.transform(m["sizes"], lambda size, i: size + F.get(m["gaps"], i))
        return F.transform(
            F.arrays_zip(_bind(steps, _running_sums).alias("end"), m["sizes"].alias("size")),
            lambda z: F.struct((z["end"] - z["size"]).alias("begin"), z["end"].alias("end"), r["priority"].alias("priority"), m["position"].alias("position"), r["label"].alias("label"), r["weight"].alias("weight")),
        )

    def better(y: Column, x: Column) -> Column:
        within = (y["begin"] <= x["begin"]) & (y["end"] >= x["end"])
        longer = (y["end"] - y["begin"]) - (x["end"] - x["begin"])
        return within & ((y["priority"] < x["priority"]) | (y["priority"] == x["priority"]) & ((longer > 0) | (longer == 0) & (y["position"] < x["position"])))

    def unsuppressed(found: Column) -> Column:
        # only detections that begin at most the longest one's length before x ends can contain x
        def kept(longest: Column) -> Column:
            def alone(x: Column) -> Column:
                first, last = _starting_before(found, x["end"] - longest), _starting_before(found, x["begin"] + 1)
                return ~F.exists(F.slice(found, first + 1, last - first), lambda y: better(y, x))

            return F.filter(found, alone)

        return _bind(F.array_max(F.transform(found, lambda x: x["end"] - x["begin"])), kept)

    found = F.flatten(F.transform(F.transform(_live(text, table), measured), spans))
    return F.when(gate, _bind(F.array_sort(found.cast(_DETECTION)), unsuppressed))


def license_report(docs: DataFrame, table: list[Rule] | None = None) -> DataFrame:
    """The digest of scan(): labels joined by commas, and the best weight as score."""
    s = scan(docs, table)
    s = s.withColumn("detections", F.coalesce("detections", F.array().cast(_DETECTION)))
    labels = F.array_sort(F.array_distinct(F.concat("base", F.transform("detections", lambda x: x["label"]))))
    weight = F.aggregate("detections", F.lit(0.0), lambda a, x: F.greatest(a, x["weight"]))
    return s.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.greatest(weight, F.when(F.size("base") > 0, 0.9).otherwise(0.0)).alias("score"),
    )
