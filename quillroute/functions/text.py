"""Text functions as Column expressions: tokens, chunks, normal forms, snippets, stable ids.

Every function takes and returns Columns and stays inside built-in expressions.
"""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# Token and identifier patterns of the lexical index.
TOKEN = r"§?[a-z0-9]+(?:[._\-:/§][a-z0-9]+)*"
IDENTIFIER_TOKEN = r"^(?:§\d+|\d+(?:\.\d+)+|[a-z]+\d+(?:\.\d+)*|[a-z]+(?:[._\-:/§][a-z0-9]+)+)$"
WORD = r"[a-z0-9]+"
#: What stands around a whole word, in classes that all engines know.
BEFORE, AFTER = r"(^|[^\p{L}\p{N}_])", r"([^\p{L}\p{N}_]|$)"


def simple_tokens(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def raw_lexical_tokens(text: Column) -> Column:
    """The tokens of lexical_tokens() as they are written, without their other spellings."""
    return F.regexp_extract_all(F.replace(F.lower(text), F.lit("§ "), F.lit("§")), F.lit(TOKEN), F.lit(0))


def lexical_tokens(text: Column) -> Column:
    """Tokens that keep formal identifiers whole, with the spellings they are looked up by.

    A hyphenated token also counts without hyphens, a dotted one (that is no number) with
    underscores, ``rfc 7231`` also as ``rfc-7231``, and the token after ``section`` twice.
    Repetitions stay: they are term frequencies.
    """
    raw = raw_lexical_tokens(text)

    def spelled(all_: Column) -> Column:
        def spellings(t: Column, i: Column) -> Column:
            following = F.get(all_, i + 1)
            return F.array_compact(
                F.array(
                    t,
                    F.when(F.contains(t, F.lit("-")), F.replace(t, F.lit("-"), F.lit(""))),
                    F.when(F.contains(t, F.lit(".")) & F.replace(t, F.lit("."), F.lit("")).rlike("[^0-9]"), F.replace(t, F.lit("."), F.lit("_"))),
                    F.when((t == "rfc") & following.rlike("^[0-9]+$"), F.concat(F.lit("rfc-"), following)),
                    F.when(t == "section", following),
                )
            )

        return F.flatten(F.transform(all_, spellings))

    # in an array of one, so that a token that looks at the next does not have the whole text matched again
    return F.flatten(F.transform(F.array(raw), spelled))


def identifier_tokens(tokens: Column) -> Column:
    """The distinct tokens that are identifiers, sorted."""
    return F.array_sort(F.array_distinct(F.filter(tokens, lambda t: t.rlike(IDENTIFIER_TOKEN))))


# Words that the evidence measures leave out.
STOPWORDS = ("the", "a", "an", "and", "or", "to", "of", "in", "is", "are", "what", "which", "not", "with", "also")
GOLD_STOPWORDS = ("the", "a", "an", "and", "or", "to", "of", "in")
CONTENT_TOKEN = r"[a-z0-9._§:/-]+"


def content_words(text: Column, longer_than: int = 2, stop: tuple[str, ...] = STOPWORDS) -> Column:
    """Distinct tokens of some length that are no stop words."""
    words = F.regexp_extract_all(F.lower(text), F.lit(CONTENT_TOKEN), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > longer_than) & ~w.isin(*stop)))


def words(text: Column) -> Column:
    """White-space separated words; an empty text has none."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def chunk_spans(n_words: Column, size: int, overlap: int) -> Column:
    """Numbers of the chunks that a text of ``n_words`` words falls into."""
    stride = max(1, size - overlap)
    last = F.greatest(F.lit(0), F.ceil((n_words - F.lit(overlap)) / F.lit(stride)).cast("int") - 1)
    return F.sequence(F.lit(0), last)


def chunk_text(all_words: Column, number: Column, size: int, overlap: int) -> Column:
    return F.array_join(F.slice(all_words, number * max(1, size - overlap) + 1, F.lit(size)), " ")


def sentences(text: Column, ends: str = ".;") -> Column:
    """Trimmed sentences, cut at white space behind one of ``ends``."""
    # F.trim itself would get the place as its second argument, and trim that number's digits
    parts = F.transform(F.split(text, rf"(?<=[{ends}])\s+"), lambda s: F.trim(s))
    return F.filter(parts, lambda s: s != "")


#: Character references that plain-text conversion knows by name; & is last.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&nbsp;", " "), ("&amp;", "&"))


def plain_text(markup: Column) -> Column:
    """Markup to text: scripts, styles and tags out, named references decoded, white space collapsed."""
    out = F.regexp_replace(markup, r"(?is)<script.*?</script>|<style.*?</style>", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]+>", " ")
    for name, char in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def headings(text: Column, most: int = 20) -> Column:
    """Lines that look like headings: ``#`` lines, or short lines of plain words with a capital first."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
    marked = F.filter(lines, lambda x: x.rlike(r"^#") | x.rlike(r"^[A-Z][A-Za-z0-9 /:-]{3,80}$"))
    return F.slice(F.transform(marked, lambda x: F.trim(F.regexp_replace(x, r"^#+", ""))), 1, most)


def snippet(text: Column, limit: int = 240) -> Column:
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.substring(text, 1, limit - 3), F.lit("...")))


def snippet_around(text: Column, term: Column, limit: int = 320, lead: int = 90) -> Column:
    """``limit`` characters that begin ``lead`` before the first hit of ``term``; the start without a hit."""
    at = F.call_function("instr", F.lower(text), F.lower(term))
    begin = F.greatest(F.lit(1), F.when(at > 0, at - lead).otherwise(1))
    return F.substr(text, begin, F.lit(limit))


def match_form(text: Column) -> Column:
    """The form in which answers are compared."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9§._:/ -]+", " "), r"\s+", " "))


def url_title(url: Column) -> Column:
    """The last part of a URL's path as a title."""
    tail = F.element_at(F.split(F.regexp_replace(url, r"[?#].*$|/+$", ""), "/"), -1)
    return F.initcap(F.trim(F.translate(tail, "-_", "  ")))


def stable_id(seed: Column, text: Column, prefix: str = "oc_") -> Column:
    """prefix + the end of the seed as a slug + a hash of seed and the text's beginning."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(seed), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")
    digest = F.substring(F.sha1(F.concat(seed, F.lit("\n"), F.substring(text, 1, 500))), 1, 12)
    return F.concat(F.lit(prefix), F.when(slug == "", F.lit("document")).otherwise(F.call_function("right", slug, F.lit(40))), F.lit("_"), digest)


def source_part(source: Column, index: int, default: str = "unknown") -> Column:
    """Part ``index`` (from 0) of a colon-separated source string."""
    return F.coalesce(F.nullif(F.split_part(source, F.lit(":"), F.lit(index + 1)), F.lit("")), F.lit(default))


#: Identifier forms in running text, as they are canonically written.
IDENTIFIER_FORMS = (r"RFC[ -]?\d+", r"ICD[- ]?10(?:[- ]?CM)? +[A-Z]\d\d(?:\.\d+)?", r"45 +CFR +\d\d\d\.\d\d\d", r"HIPAA +\d\d\d\.\d\d\d", r"§ ?\d+", r"[a-z_]+(?:\.[a-zA-Z_]+)+", r"\d+\.\d+\.\d+\.\d+")


# How identifiers are written, and their normal form.
NORMAL_FORMS = (
    (r"(?i)\bRFC\s+(\d+)\b", "RFC-$1"),
    (r"(?i)\bICD[- ]?10(?:[- ]?CM)?\s+([A-Z]\d{2}(?:\.\d+)?)\b", "ICD-10 $1"),
    (r"(?i)\b45\s+CFR\s+(\d{3}\.\d{3})\b", "45 CFR $1"),
    (r"(?i)\bHIPAA\s+(\d{3}\.\d{3})\b", "HIPAA $1"),
)


def normal_identifier(x: Column) -> Column:
    """An identifier in its normal form: single blanks, and one spelling for RFC, ICD, CFR and HIPAA numbers."""
    x = F.regexp_replace(F.trim(x), r"\s+", " ")
    for written, form in NORMAL_FORMS:
        x = F.regexp_replace(x, written, form)
    return x


def identifiers(text: Column) -> Column:
    """Distinct canonical identifiers of a text, sorted."""
    found = F.flatten(F.array(*(F.regexp_extract_all(text, F.lit(f), F.lit(0)) for f in IDENTIFIER_FORMS)))
    return F.array_sort(F.array_distinct(F.transform(found, normal_identifier)))


def alias_forms(ids: Column) -> Column:
    """Spellings under which identifiers are also looked up: lower case, blank for hyphen and the reverse, last part."""
    forms = F.flatten(F.transform(ids, lambda x: F.array(x, F.lower(x), F.replace(x, F.lit("-"), F.lit(" ")), F.replace(x, F.lit(" "), F.lit("-")), F.element_at(F.split(x, " "), -1))))
    return F.array_sort(F.array_distinct(F.filter(forms, lambda x: x != "")))


def lead_summary(text: Column, sentences_: int = 3, limit: int = 420) -> Column:
    return F.trim(F.substring(F.array_join(F.slice(F.split(F.trim(text), r"(?<=[.!?])\s+"), 1, sentences_), " "), 1, limit))


def node_name(x: Column) -> Column:
    """A name in the text form of a graph."""
    return F.translate(x, " -", "__")


def public_text(markup: Column, cap: int = 5000) -> Column:
    """plain_text() without URLs, cut at ``cap`` characters (the cap is the feature: a fetched page's lead)."""
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(plain_text(markup), r"https?://\S+", " "), r"\s+", " ")), 1, cap)


def entity_form(name: Column, aliases: dict[str, str], endings: tuple[str, ...] = ()) -> Column:
    """A name in normal form: cleaned, without class words at its end, alias resolved, singular by a dropped s."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), r"^(?:an?|the)\s+", ""), r"[^a-z0-9_ -]+", " "))
    clean = F.regexp_replace(clean, r"\s+", " ")
    if endings:
        clean = F.regexp_replace(clean, "(" + "|".join(endings) + ")$", "")
    table = F.create_map(*(F.lit(x) for kv in aliases.items() for x in kv)) if aliases else F.create_map().cast("map<string,string>")
    singular = F.when(F.endswith(clean, F.lit("s")), F.try_element_at(table, F.regexp_replace(clean, "s$", "")))
    return F.coalesce(F.try_element_at(table, clean), singular, F.replace(clean, F.lit(" "), F.lit("_")))


def resource_name(namespace: str, name: Column) -> Column:
    return F.concat(F.lit(namespace), F.url_encode(F.replace(name, F.lit(" "), F.lit("_"))))


def provenance(triple_id: Column) -> Column:
    return F.when(F.startswith(triple_id, F.lit("xkg_")), "extracted").when(F.startswith(triple_id, F.lit("mixed_")), "mixed").otherwise("curated")


def evidence_ids(item_id: Column, metadata: Column, keys: tuple[str, ...] = ("component_ids", "triple_id", "path_id", "parent_doc_id", "chunk_id")) -> Column:
    """All ids an evidence item stands for: its own and the comma-separated ones of some metadata."""
    parts = F.flatten(F.array(F.array(item_id), *(F.split(F.coalesce(F.try_element_at(metadata, F.lit(k)), F.lit("")), ",") for k in keys)))
    return F.array_sort(F.array_distinct(F.filter(parts, lambda x: x != "")))


# -- character references and nested JSON ------------------------------------------------

_REFERENCE = r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);?"


def _mapped(table: dict) -> Column:
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))


def _numeric(n: Column) -> Column:
    """The character of a number: Windows' own for 128 to 159, the replacement character for what is none."""
    windows = {}
    for code in range(128, 160):
        try:
            windows[code] = bytes([code]).decode("cp1252")
        except UnicodeDecodeError:  # five numbers have no character there
            windows[code] = chr(code)
    none = n.isNull() | (n == 0) | ((n >= 0xD800) & (n <= 0xDFFF)) | (n > 0x10FFFF)
    # control characters and numbers that are no characters vanish
    control = ((n >= 1) & (n <= 8)) | (n == 11) | ((n >= 14) & (n <= 31)) | (n == 127) | ((n >= 0xFDD0) & (n <= 0xFDEF)) | (n.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
    char = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    return F.when(none, "�").when(n.between(128, 159), F.element_at(_mapped(windows), n)).when(control, "").otherwise(char)


def _decoded(reference: Column) -> Column:
    """One character reference as text: by number, by name, or by the longest old name that begins it; else as it is."""
    names = {k: v for k, v in html5.items() if k.endswith(";")}
    old = {k: v for k, v in html5.items() if not k.endswith(";")}
    body = F.substring(reference, 2, 1 << 20)
    digits = F.rtrim(F.substring(reference, 3, 1 << 20), F.lit(";"))
    is_hex = F.lower(F.substring(digits, 1, 1)) == "x"
    # more digits than any character has: beyond the last one
    short = F.when(is_hex, F.ltrim(F.substring(digits, 2, 1 << 20), F.lit("0"))).otherwise(F.ltrim(digits, F.lit("0")))
    number = F.when(F.length(short) > 8, F.lit(1 << 40)).when(short == "", F.lit(0)).when(is_hex, F.conv(short, 16, 10).cast("long")).otherwise(F.try_to_number(short, F.lit("99999999")).cast("long"))
    begins = F.regexp_extract(body, "^(" + "|".join(sorted(old, key=lambda k: (-len(k), k))) + ")", 1)
    by_old = F.concat(F.element_at(_mapped(old), begins), F.substr(body, F.length(begins) + 1, F.lit(1 << 20)))
    by_name = F.try_element_at(_mapped(names), body)
    return F.when(F.startswith(reference, F.lit("&#")), _numeric(number)).otherwise(F.coalesce(by_name, F.when(begins != "", by_old), reference))


def unescaped(text: Column) -> Column:
    """All character references decoded, named and numeric, with or without a semicolon, in one expression.

    The names come from the standard library. Texts without an ampersand are left as they are.
    """
    parts, found = F.split(text, _REFERENCE, -1), F.regexp_extract_all(text, F.lit(_REFERENCE), F.lit(0))
    woven = F.zip_with(parts, found, lambda a, b: F.concat(a, F.when(b.isNull(), "").otherwise(_decoded(b))))
    return F.when(F.contains(text, F.lit("&")), F.array_join(woven, "")).otherwise(text)


def unescaped_text(markup: Column) -> Column:
    """Markup to text in the order of the usual clean-up: references decoded first, then scripts, styles and tags out."""
    out = F.regexp_replace(unescaped(markup), r"(?is)<script.*?</script>|<style.*?</style>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"(?s)<[^>]+>", " "), r"(?U)\s+", " "))


def flattened_json(raw: Column, most: int = 20, depth: int = 3) -> Column:
    """A JSON object as ``key: value`` lines: lists by their first ``most`` items, objects inside by dotted keys, ``depth`` deep.

    A list at the top is a line for each of its first 100 items. Other text stays as it is; null members go.
    """

    def listed(value: Column) -> Column:
        return F.array_join(F.slice(F.from_json(value, "array<string>"), 1, most), " ")

    def lines(text: Column, prefix: Column | None, left: int) -> Column:
        entries = F.filter(F.map_entries(F.from_json(text, "map<string,string>")), lambda e: e["value"].isNotNull())

        def line(e: Column) -> Column:
            key = e["key"] if prefix is None else F.concat(prefix, F.lit("."), e["key"])
            is_list, is_object = F.startswith(e["value"], F.lit("[")), F.startswith(e["value"], F.lit("{"))
            one = F.array(F.concat(key, F.lit(": "), F.when(is_list, F.coalesce(listed(e["value"]), e["value"])).otherwise(e["value"])))
            return F.when(is_object, F.coalesce(lines(e["value"], key, left - 1), one)).otherwise(one) if left > 1 else one

        return F.flatten(F.transform(entries, line))

    items = F.array_join(F.slice(F.from_json(raw, "array<string>"), 1, 100), "\n")
    return F.when(F.startswith(F.ltrim(raw), F.lit("{")), F.coalesce(F.array_join(lines(raw, None, depth), "\n"), raw)).when(F.startswith(F.ltrim(raw), F.lit("[")), F.coalesce(items, raw)).otherwise(raw)


# -- public documents ---------------------------------------------------------------------

# What a title in running text looks like, where it is looked for, how many count, and the kind whose title's last word is a name.
TITLE_IN_TEXT = r"(?:^|\. )([A-Z][A-Za-z0-9 /-]{4,60}) [A-Za-z0-9_]"
TITLE_WITHIN, MOST_TITLES, NAMED_KIND = 2500, 8, "official_docs"


def section_titles(text: Column) -> Column:
    """The first 8 different titles in the first 2,500 characters of a cleaned text: capitalized runs at the start or behind a full stop."""
    found = F.transform(F.regexp_extract_all(F.substring(text, 1, TITLE_WITHIN), F.lit(TITLE_IN_TEXT), F.lit(1)), lambda t: F.trim(F.regexp_replace(t, r"^[ .]+|[ .]+$", "")))
    return F.slice(F.array_distinct(F.filter(found, lambda t: t != "")), 1, MOST_TITLES)


def lead_or(text: Column, fallback: Column, least: int = 80, limit: int = 420) -> Column:
    """lead_summary() of a text of at least ``least`` characters, of the fallback otherwise."""
    chosen = F.when(F.length(F.trim(F.coalesce(text, F.lit("")))) >= least, text).otherwise(fallback)
    return lead_summary(chosen, 3, limit)


def source_aliases(source_id: Column, title: Column, answer: Column, kind: Column, ids: Column) -> Column:
    """Names under which a public document is looked up: its title, answer and id, spellings of its identifiers, sorted."""
    own = F.array(title, F.lower(title), answer, F.lower(answer), F.replace(F.replace(source_id, F.lit("pub_"), F.lit("")), F.lit("_"), F.lit(" ")), F.when(kind == NAMED_KIND, F.element_at(F.split(title, " "), -1)))
    spelled = F.flatten(F.transform(ids, lambda x: F.array(x, F.lower(x), F.replace(x, F.lit("-"), F.lit(" ")), F.replace(x, F.lit(" "), F.lit("-")), F.when(F.contains(x, F.lit(" ")), F.element_at(F.split(x, " "), -1)))))
    return F.array_sort(F.array_distinct(F.filter(F.concat(own, spelled), lambda a: a.isNotNull() & (a != ""))))


def public_record(source_id: Column, title: Column, kind: Column, answer: Column, fallback: Column, text: Column) -> dict[str, Column]:
    """What is known of a public document beside its text: identifiers, aliases, titles, lead and size."""
    ids = identifiers(F.concat_ws(" ", title, answer, fallback, text))
    whole = F.concat(title, F.lit(". "), answer, F.lit(". "), fallback)
    return {"canonical_identifiers": ids, "aliases": source_aliases(source_id, title, answer, kind, ids), "section_headings": section_titles(text), "lead_summary": lead_or(text, whole), "body_char_count": F.length(text)}
