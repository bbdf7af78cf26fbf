"""What a question shows about the evidence it needs: boolean Columns over its text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import AFTER, BEFORE

# Marker lists and patterns of the four question families.
LEXICAL = ("section", "identifier", "code", "exact", "bm25", "rfc", "jsonb", "torch.nn", "sklearn.")
DEDUCTIVE = ("can", "are all", "every", "property", "membership", "class", "able to", "produce", "two-hop", "eats")
RELATIONAL = ("relation", "path", "between", "multi-hop", "chain", "connect", "connects", "bridge")
SEMANTIC = ("similar", "feels like", "concept", "meaning", "about")
IDENTIFIER = r"§\s*\d+|" + BEFORE + r"(\d+\.\d+|rfc[- ]?\d+|jsonb_[a-z0-9_]+|[a-z]+-\d+|[a-z]+(\.[a-z0-9_]+){2,})" + AFTER
MEMBERSHIP = r"^(is|are)\s+(a|an)?\s*[\p{L}\p{N}_]+\s+(a|an)\s+[\p{L}\p{N}_]+"
# Substrings of the keyword router.
KEYWORD_LEXICAL = ("rfc", "icd", "hipaa", "section", "torch.nn", "sklearn.", "numpy.", "postgresql", "jsonb", "u.s.c", "find")
KEYWORD_DEDUCTIVE = ("can a", "can an", "are all", "is a", "is an", "what property", "able to", "counterexample", "what eats")
KEYWORD_RELATIONAL = ("bridge", "connects", "connect", "relation connects", "between", "path", "multi-hop", "chain")
KEYWORD_SEMANTIC = ("feels like", "which idea", "which concept", "which term", "which condition", "called", "meaning", "concept", "describes")
# Substrings of the second rule version.
V2_AMBIGUOUS = ("feels like", "concept", "meaning", "describes", "not", "rather than", "metaphor", "idea")
V2_RELATIONAL = ("bridge", "connect", "connects", "between", "path", "relation")
V2_DEDUCTIVE = ("can a", "can an", "are all", "is a", "is an", "what property", "able to")
V2_STRONG = ("rfc", "icd", "hipaa", "torch.nn", "§", "jsonb", "u.s.c")
STRONG_PATTERN = BEFORE + r"[a-z]+-\d+" + AFTER + r"|§\d+"
# Substrings of the calibration signals.
CAL_SEMANTIC = ("concept", "idea", "process", "model", "condition", "explains", "feels", "meaning", "view", "why", "how", "rather than")
CAL_MISLEADING = (" not ", "despite", "although", "even if", "rather than", "instead of")
CAL_RELATIONAL = ("bridge", "connects", "connection", "relation connects", "what relation")
CAL_DEDUCTIVE_STARTS = ("can a ", "can an ", "are all ", "is a ", "is an ", "what property")
CAL_DEDUCTIVE = ("closed-world", "closed world", " what property")
CAL_NO_GRAPH = ("do not route", "not route", "substring to kg")
UNIVERSAL = ("are all", "do all", "can all", "every ", "all ")
NEGATIONS = ("not", "despite", "although", "even if", "rather than", "instead of")


def marker_pattern(markers: tuple[str, ...]) -> str:
    """Any marker with no letter or digit next to it, as one alternation."""
    escaped = "|".join(m.replace(".", r"\.") for m in markers)
    return rf"(^|[^a-z0-9])({escaped})($|[^a-z0-9])"


def has_any(text: Column, terms: tuple[str, ...]) -> Column:
    """Whether any term occurs as a substring."""
    out = F.contains(text, F.lit(terms[0]))
    for t in terms[1:]:
        out = out | F.contains(text, F.lit(t))
    return out


def starts_with_any(text: Column, terms: tuple[str, ...]) -> Column:
    out = F.startswith(text, F.lit(terms[0]))
    for t in terms[1:]:
        out = out | F.startswith(text, F.lit(t))
    return out


def family_features(question: Column) -> dict[str, Column]:
    """lexical, semantic, deductive, relational; semantic holds when nothing else does."""
    q = F.lower(question)
    lexical = q.rlike(marker_pattern(LEXICAL)) | q.rlike(IDENTIFIER)
    deductive = q.rlike(marker_pattern(DEDUCTIVE)) | q.rlike(MEMBERSHIP)
    relational = q.rlike(marker_pattern(RELATIONAL))
    semantic = q.rlike(marker_pattern(SEMANTIC))
    return {"lexical": lexical, "semantic": semantic | ~(lexical | deductive | relational), "deductive": deductive, "relational": relational}


def calibration_signals(question: Column) -> dict[str, Column]:
    q = F.lower(question)
    semantic, relational = has_any(q, CAL_SEMANTIC), has_any(q, CAL_RELATIONAL)
    deductive = has_any(q, CAL_DEDUCTIVE) | starts_with_any(q, CAL_DEDUCTIVE_STARTS)
    identifier = q.rlike(IDENTIFIER)
    return {
        "identifier_heavy": identifier,
        "semantic_cue": semantic,
        "misleading_exact_cue": has_any(q, CAL_MISLEADING),
        "relational_cue": relational,
        "deductive_cue": deductive,
        "explicit_kg_negation": has_any(q, CAL_NO_GRAPH),
        "primary_identifier_query": identifier & ~semantic & ~relational & ~deductive,
    }


def negated_words(question: Column, per_span: int = 6) -> Column:
    """Content words behind a negation up to the next punctuation, at most ``per_span`` of each kind in order, sorted."""
    from .text import content_words

    q = F.lower(question)
    spans = F.flatten(F.array(*(F.regexp_extract_all(q, F.lit(rf"{m}\s+([^,?.;:]+)"), F.lit(1)) for m in NEGATIONS)))
    picked = F.flatten(F.transform(spans, lambda s: F.slice(F.array_sort(content_words(s)), 1, per_span)))
    return F.array_sort(F.array_distinct(picked))


def first_listed(text: Column, terms: dict[str, str], ending: str = "s?") -> Column:
    """The value of the first listed term that occurs as a word (optionally with a plural s); null if none does."""
    from .text import AFTER, BEFORE

    out = F.lit(None).cast("string")
    for term, value in reversed(terms.items()):
        out = F.when(F.lower(text).rlike(BEFORE + term + ending + AFTER), value).otherwise(out)
    return out


def first_whole(text: Column, terms: dict[str, str]) -> Column:
    """first_listed() without plurals."""
    return first_listed(text, terms, "")


def choice(raw: Column) -> Column:
    """An A/B/Tie choice however written; null for anything else."""
    x = F.lower(F.trim(raw))
    return F.when(x == "a", "A").when(x == "b", "B").when(x == "tie", "Tie")


def rating(raw: Column, low: int = 1, high: int = 3) -> Column:
    """A rating on a scale, 0 where it is missing or off the scale."""
    x = raw.try_cast("int")
    return F.when(x.between(low, high), x).otherwise(0)


def unknown_tags(tags: Column, allowed: tuple[str, ...]) -> Column:
    return F.array_sort(F.array_except(tags, F.array(*(F.lit(a) for a in allowed))))


def source_flags(source: Column) -> dict[str, Column]:
    """Which kinds of corpus a source string names."""
    s = F.lower(source)
    kinds = {"curated": ("curated",), "external": ("external",), "generalization": ("generalization",), "public_raw": ("public",), "adversarial": ("adversarial",), "open_corpus": ("open", "source_pack", "runtime"), "formal_spec": ("rfc", "spec", "medical", "policy", "api", "formal")}
    return {f"source_{k}": has_any(s, v) for k, v in kinds.items()}


# What counts as an identifier in a question, what names a programming interface, and the identifiers that count once more as a feature.
IDENTIFIER_PARTS = (r"\bRFC-?\d+\b", r"\bICD-10\s+[A-Z]\d{2}\.\d\b", r"\b\d{3}\.\d{3}\b", r"§\d+", r"\b[a-zA-Z_]\w*\.[\w.]+\b")
API_NAME = r"\b[a-zA-Z_]\w*\.[\w.]+\b|\bsklearn\b|\bdataclasses\b"
COUNTED_AGAIN = r"\b(?:rfc-?\d+|icd-10\s+[a-z]\d{2}\.\d|hipaa\s+\d{3}\.\d{3}|[a-z_]+\.[\w.]+)\b"


def named_identifiers(question: Column) -> Column:
    """The identifiers of a question by kind and then place, repeated ones too; none for a null question."""
    found = F.flatten(F.array(*(F.regexp_extract_all(question, F.lit(p), F.lit(0)) for p in IDENTIFIER_PARTS)))
    return F.coalesce(found, F.array().cast("array<string>"))


def interface_signals(question: Column) -> dict[str, Column]:
    """The two signals beside calibration_signals(): the identifiers, and whether a programming interface is named."""
    return {"identifiers": named_identifiers(question), "api_cue": F.coalesce(question.rlike(API_NAME), F.lit(False))}
