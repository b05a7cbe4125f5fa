"""Text expressions: columns in, columns out, all of them built-in functions."""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestrand.functions import lexicon as L


def texts(words: tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, words))


def any_of(conditions: Iterable[Column]) -> Column:
    return functools.reduce(operator.or_, conditions)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, also where it is used inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def all_matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def squeeze(text: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def match_form(text: Column) -> Column:
    """Lower case without punctuation, single spaces."""
    return squeeze(F.regexp_replace(F.lower(text), r"(?U)[^\w\s]", ""))


# --- words -------------------------------------------------------------------------------------


def tokens(text: Column) -> Column:
    """Words for retrieval, repeated as in the text: a letter, then letters, digits or hyphens; over two characters; no stopword."""
    words = all_matches(F.lower(text), "[a-z][a-z0-9-]+")
    return F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*L.STOPWORDS))


def specific(words: Column) -> Column:
    """The distinct words that aren't too general to support a citation."""
    return F.array_except(words, texts(L.GENERIC_TOKENS))


def search_terms(text: Column, stop: tuple[str, ...] = L.TEXT_TERM_STOPWORDS) -> Column:
    """Distinct terms of over three characters, no stopword."""
    words = all_matches(F.lower(text), r"[a-z][\w-]+")
    return F.array_except(F.filter(words, lambda w: F.length(w) > 3), texts(stop))


def web_tokens(text: Column) -> Column:
    return F.array_except(all_matches(F.lower(text), "[a-z0-9]{3,}"), texts(L.WEB_STOPWORDS))


def phrases(text: Column, most: int = 4) -> Column:
    """Overlapping runs of words, longest first, then left to right; of runs equal but for case the first."""

    def runs(words: Column, k: int) -> Column:
        last = F.size(words) - (k - 1)
        return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(words, i, F.lit(k)), " "))).otherwise(F.array().cast("array<string>"))

    return let(all_matches(text, "[A-Za-z][A-Za-z'’-]*"), lambda w: first_of_each(F.concat(*[runs(w, k) for k in range(most, 0, -1)]), F.lower))


def first_of_each(items: Column, key) -> Column:
    """Items in order, without those whose key an earlier one has."""
    keyed = F.transform(items, lambda x: F.struct(x.alias("x"), key(x).alias("k")))

    def firsts(pairs: Column) -> Column:
        keys = F.transform(pairs, lambda p: p["k"])
        return let(keys, lambda ks: F.transform(F.filter(pairs, lambda p, i: F.array_position(ks, p["k"]) == i + 1), lambda p: p["x"]))

    return let(keyed, firsts)


def without_possessive(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), r"(?i)(?:'s|’s)$", "")


def has_trade_intent(text: Column) -> Column:
    words = F.transform(all_matches(text, "[A-Za-z][A-Za-z’-]*"), lambda w: without_possessive(F.lower(w)))
    return F.arrays_overlap(words, texts(L.TRADE_HINTS))


def topic_terms(text: Column, drop: Column, most: int = 3) -> Column:
    """The first distinct words that name a topic; ``drop`` is an array of phrases (place, country, codes) taken out before."""
    lowered = F.lower(F.regexp_replace(text, "’", "'"))
    cut = F.aggregate(drop, lowered, lambda acc, p: F.when(p.isNull() | (p == ""), acc).otherwise(_without_phrase(acc, F.lower(p))))
    words = F.transform(all_matches(cut, "[a-z][a-z'-]{2,}"), without_possessive)
    return F.slice(F.array_except(words, texts((*L.QUERY_FILLER, *L.STRUCTURAL_TERMS, *L.TRADE_HINTS))), 1, most)


def _without_phrase(text: Column, phrase: Column) -> Column:
    quoted = F.concat(F.lit(r"\b\Q"), phrase, F.lit(r"\E(?:'s)?\b"))
    return F.regexp_replace(text, quoted, F.lit(" "))


def expanded_queries(text: Column, place: Column, country: Column, terms: Column) -> Column:
    """Search variants of a question; itself only if it shows no interest in trade or has no focus."""
    base = squeeze(text)
    of_place = lambda t: [F.concat_ws(" ", place, t, F.lit(x)) for x in ("export destinations", "trade partners", "export markets")]
    of_country = lambda t: [F.concat_ws(" ", country, t, F.lit(x)) for x in ("exports top destinations", "export markets")]
    each = lambda t: F.concat(F.array(*of_place(t)), F.when(country.isNotNull(), F.array(*of_country(t))).otherwise(F.array().cast("array<string>")))
    by_term = F.when(F.size(terms) > 0, F.flatten(F.transform(terms, each))).otherwise(each(F.lit(None).cast("string")))
    wide = first_of_each(F.concat(by_term, F.array(base)), F.lower)
    return F.when(base == "", F.array().cast("array<string>")).when(has_trade_intent(base) & place.isNotNull(), wide).otherwise(F.array(base))


# --- documents ---------------------------------------------------------------------------------


def truncate_at_references(text: Column) -> Column:
    """The text before the first line that is a references heading, its end trimmed; the whole text without one."""
    heading = r"(?im)^(?:#{1,6}\s*)?(?:references|bibliography|literature cited)\s*$"
    at = F.regexp_instr(text, F.lit(heading))
    return F.when(at > 0, F.regexp_replace(F.substring(text, F.lit(1), at - 1), r"\s+$", "")).otherwise(text)


def is_reference_heading(heading: Column) -> Column:
    h = F.trim(heading)
    return F.lower(h).isin(*L.REFERENCE_HEADINGS) | h.rlike(r"^(?:(?:18|19|20)\d{2}|\d{3,})\.")


def is_reference_text(text: Column) -> Column:
    """Whether a passage reads like bibliography entries: five rules over counts of years, authors, terms and page references."""
    t = squeeze(text)
    n = lambda p: F.regexp_count(t, F.lit(p))
    years, authors = n(r"(?:\(|\b)(?:18|19|20)\d{2}(?:\)|\.)"), n(r"\b[A-Z][A-Za-z'`.-]+,\s*(?:[A-Z]\.\s*){1,3}")
    terms = n(r"(?i)\b(?:doi|proceedings|thesis|dissertation|editors?|university|press|journal|rome|fao|pages?)\b")
    url, page = t.rlike(r"(?i)https?://|doi[:/]"), t.rlike(r"(?i)\bpages?\s+\d")
    lead = t.rlike(r"^(?:(?:[A-Z]\.\s*)?(?:18|19|20)\d{2}\.|\d{3,}\.\s+[A-Z])")
    rules = (
        terms >= 3, lead & ((terms >= 1) | page | (years >= 1)), page & (terms >= 2),
        (authors >= 2) & ((years >= 1) | (terms >= 1) | page), (years >= 2) & ((terms >= 1) | url | page),
    )
    return (t != "") & any_of(rules)


def tidy(text: Column) -> Column:
    """Single blanks, none before punctuation or at line ends; line ends stay."""
    t = F.regexp_replace(text, "[ \\t]+", " ")
    t = F.regexp_replace(t, r" +([.,;:!?)])", "$1")
    return F.regexp_replace(t, r"(?m) +$", "")


def xml_text(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def xml_attribute(text: Column) -> Column:
    return F.replace(F.replace(xml_text(text), F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&apos;"))


def without_controls(text: Column) -> Column:
    """For spreadsheets: no control characters, surrogates or non-characters."""
    return F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\uD800-\uDFFF￾￿]", "")


def _excerpt_parts(text: Column, anchor: Column) -> Column:
    # a word's tokens don't depend on its neighbours, so they are found once
    return F.struct(squeeze(text).alias("compact"), F.split(squeeze(text), " ").alias("words"), specific(tokens(anchor)).alias("wanted"))


def _window(most: int) -> tuple[int, int]:
    """Words in a window, and between the starts of two."""
    size = max(30, min(60, most // 6))
    return size, max(10, size // 3)


def _best_start(v: Column, most: int) -> Column:
    size, step = _window(most)
    found = F.transform(v["words"], lambda w: F.filter(tokens(w), lambda t: ~t.isin(*L.GENERIC_TOKENS)))

    def window(per_word: Column, start: Column) -> Column:
        def score(distinct: Column) -> Column:
            shared = F.size(F.array_intersect(v["wanted"], distinct))
            none = shared == 0
            return F.struct(F.when(none, -1).otherwise(shared).alias("shared"), F.when(none, -1.0).otherwise(shared / F.greatest(F.lit(1), F.size(distinct))).alias("density"), F.when(none, F.lit(0)).otherwise(-start).alias("first"))

        return let(F.array_distinct(F.flatten(F.slice(per_word, start + 1, F.lit(size)))), score)

    return -let(found, lambda f: F.array_max(F.transform(F.sequence(F.lit(0), F.size(v["words"]) - 1, F.lit(step)), lambda s: window(f, s))))["first"]


def excerpt_start(text: Column, anchor: Column, most: int = 300) -> Column:
    """The word, from 0, at which :func:`excerpt` begins."""
    whole = lambda v: (F.length(v["compact"]) <= most) | (F.size(v["wanted"]) == 0)
    return let(_excerpt_parts(text, anchor), lambda v: F.when(whole(v), 0).otherwise(_best_start(v, most)))


def excerpt(text: Column, anchor: Column, most: int = 300) -> Column:
    """The window of words that shares most with the anchor, cut to ``most`` characters at a word; the start without an anchor."""
    size, _ = _window(most)
    trim_end = lambda c: F.regexp_replace(c, r"\s+$", "")

    def cut(v: Column, start: Column) -> Column:
        part = F.array_join(F.slice(v["words"], start + 1, F.lit(size)), " ")
        short = F.when(F.length(part) > most, trim_end(F.regexp_replace(F.substring(part, 1, most), r" [^ ]*$", ""))).otherwise(part)
        return F.concat(F.when(start > 0, "...").otherwise(""), short, F.when(start + size < F.size(v["words"]), "...").otherwise(""))

    plain = lambda v: F.concat(trim_end(F.substring(v["compact"], 1, most)), F.lit("..."))
    body = lambda v: F.when(F.length(v["compact"]) <= most, v["compact"]).when(F.size(v["wanted"]) == 0, plain(v)).otherwise(let(_best_start(v, most), lambda s: cut(v, s)))
    return let(_excerpt_parts(text, anchor), body)


# --- names, keys, labels -----------------------------------------------------------------------


def confidence(score: Column, backend: str = "tfidf") -> Column:
    high, medium, low = (0.70, 0.60, 0.50) if backend == "embeddings" else (0.15, 0.08, 0.03)
    return F.when(score >= high, "High").when(score >= medium, "Medium").when(score >= low, "Low").otherwise("Very Low")


def short_authors(authors: Column, most: int = 60) -> Column:
    parts = F.split(authors, " and ")
    return F.when((F.length(authors) > most) & (F.size(parts) > 2), F.concat(F.get(parts, F.lit(0)), F.lit(" et al."))).otherwise(authors)


def result_key(title: Column, snippet: Column, url: Column) -> Column:
    """What makes two web results the same: the url without case and end slashes, else title and snippet."""
    u = F.regexp_replace(F.lower(F.trim(F.coalesce(url, F.lit("")))), "/+$", "")
    t = F.concat(squeeze(F.lower(F.coalesce(title, F.lit("")))), F.lit("|"), squeeze(F.lower(F.coalesce(snippet, F.lit("")))))
    return F.when(u != "", F.concat(F.lit("url:"), u)).otherwise(F.concat(F.lit("text:"), t))


#: Latin letters with their base letters.
_MARKED = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿĀāĂăĄąĆćČčĎďĒēĘęĚěĞğĪīĹĺĽľŃńŇňŌōŐőŔŕŘřŚśŞşŠšŢţŤťŪūŮůŰűŹźŻżŽž"
_BASE = "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyyAaAaAaCcCcDdEeEeEeGgIiLlLlNnNnOoOoRrRrSsSsSsTtTtUuUuUuZzZzZz"


def without_marks(text: Column) -> Column:
    """Latin letters without diacritics; combining marks go."""
    return F.regexp_replace(F.translate(text, _MARKED, _BASE), r"\p{M}+", "")


def link_form(text: Column) -> Column:
    """For record linkage: no marks, tags or entities, lower case, letters, digits and single spaces."""
    t = F.regexp_replace(F.regexp_replace(without_marks(text), "&amp;|\\\\&", "and"), "<[^>]+>", " ")
    return squeeze(F.regexp_replace(F.lower(t), "[^a-z0-9 ]+", " "))


def file_key(name: Column) -> Column:
    """ASCII letters and digits of a file name without its extension."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(name), r"[^\x00-\x7F]", ""), r"\.[a-z0-9]+$", ""), "[^a-z0-9]+", "")


def surname_forms(author: Column) -> Column:
    """The last word of a name in link form, its hyphened pieces and these joined."""
    words = F.split(F.trim(F.regexp_replace(F.lower(without_marks(author)), "[^a-z -]+", "")), " +")
    last = F.element_at(words, -1)
    return F.array_distinct(F.filter(F.concat(F.array(F.replace(last, F.lit("-"), F.lit(""))), F.split(last, "-")), lambda w: F.length(w) > 0))


def doi_of(text: Column) -> Column:
    """Lower case without the resolver's address."""
    return F.lower(F.regexp_replace(F.trim(text), r"(?i)^https?://(?:dx\.)?doi\.org/", ""))


def first_doi(text: Column) -> Column:
    found = F.regexp_extract(text, r"(?i)\b(10\.\d{4,9}/[^\s\"<>]+)", 1)
    return F.nullif(F.regexp_replace(found, r"[.,;:)\]]+$", ""), F.lit(""))


def keyword_set(text: Column, separators: str = r"[;,|]") -> Column:
    """Sorted distinct keywords: lower case, trimmed, without end dots."""
    words = F.transform(F.split(text, separators), lambda w: F.regexp_replace(squeeze(F.lower(w)), r"[. ]+$", ""))
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: w != "")))


def cache_key(*columns: Column) -> Column:
    """Twenty hexadecimal digits that stand for the values."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("\x00")) for c in columns]), 256), 1, 20)


def clean_candidate(text: Column) -> Column:
    t = F.regexp_replace(F.regexp_replace(text, r"\[[^\]]+\]", " "), "[*`]", " ")
    return F.regexp_replace(squeeze(t), "[.,;:]+$", "")


def is_direct_location(text: Column) -> Column:
    """One to eight words and no hedging."""
    t = F.lower(F.trim(text))
    hedged = any_of(F.contains(t, F.lit(x)) for x in L.LOCATION_HEDGES)
    return ~hedged & F.regexp_count(t, F.lit("[A-Za-z][A-Za-z'’-]*")).between(1, 8)


def names_unsupported_scope(text: Column) -> Column:
    """Whether a text is about places below the regions that can be mapped."""
    return text.rlike(r"(?i)\b(?:city|cities|municipalit(?:y|ies)|municipal|town|village|watersheds?|(?:river\s+)?basin|protected\s+area|(?:national\s+)?nature\s+reserve|(?:national\s+)?park|reserve|conservation\s+area)\b")


def clamp(value: Column) -> Column:
    """A number between 0 and 1; 0 for what is none."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(value.try_cast("double"), F.lit(0.0))))


def evidence_ids(items: Column, known: Column) -> Column:
    """Distinct ids like W2 in order, of those that are known."""
    ids = F.transform(items, lambda x: F.regexp_extract(F.upper(x), r"W\d+", 0))
    return F.filter(F.array_distinct(ids), lambda x: F.array_contains(known, x))


def json_object(text: Column) -> Column:
    """The JSON object in a reply, as text: bare, fenced, between the outer braces, or cut off and closed again; null if none parses."""
    t = F.trim(F.regexp_replace(text, r"^\s+|\s+$", ""))
    fenced = F.regexp_extract(t, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    inner = F.regexp_extract(t, r"(?s)(\{.*\})", 1)
    raw = F.regexp_extract(t, r"(?s)(\{.*)$", 1)
    lacks = lambda a, b: F.regexp_count(raw, F.lit(a)) - F.regexp_count(raw, F.lit(b))
    braces, brackets = lacks(r"\{", r"\}"), lacks(r"\[", r"\]")
    cut = F.regexp_replace(F.regexp_replace(raw, r',\s*"[^"]*"\s*:\s*$', ""), r",\s*$", "")
    closed = F.concat(cut, F.repeat(F.lit("]"), F.greatest(F.lit(0), brackets)), F.repeat(F.lit("}"), F.greatest(F.lit(0), braces)))
    repaired = F.when((braces > 0) | (brackets > 0), closed)
    valid = lambda c: F.when(c.startswith("{") & F.try_parse_json(c).isNotNull(), c)
    return F.coalesce(valid(t), valid(fenced), valid(inner), valid(repaired))


# --- licences ----------------------------------------------------------------------------------

# Licences under which full texts may be shipped, and those that classes tell apart.
SHIPPED = ("cc-by", "cc-by-sa", "cc-by-nc", "cc-by-nc-sa", "cc0", "pd", "public-domain")
PERMISSIVE = ("cc-by", "cc-by-sa", "cc0", "pd", "public-domain")
RESTRICTED = ("cc-by-nc", "cc-by-nd", "cc-by-nc-sa", "cc-by-nc-nd")


def _low(c: Column) -> Column:
    return F.trim(F.lower(F.coalesce(c, F.lit(""))))


def _or(c: Column, other: str) -> Column:
    return F.when(c == "", other).otherwise(c)


def ship_decision(licence: Column, status: Column, doi: Column, version: Column) -> Column:
    """struct(ship, reason): whether a paper's text may be shipped."""
    lic, st, ver = _low(licence), _low(status), _low(version)
    say = lambda ship, *why: F.struct(F.lit(ship).alias("ship"), F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in why]).alias("reason"))
    ok = lic.isin(*SHIPPED)
    return (
        F.when(F.coalesce(doi, F.lit("")) == "", say("No", "No DOI"))
        .when(ok & st.isin("gold", "hybrid"), say("Yes", st, " OA, ", lic))
        .when(ok & (st == "green") & (ver == "publishedversion"), say("Yes", "green OA published version, ", lic))
        .when(ok & (st == "green"), say("No", "green OA but only ", _or(ver, "unknown"), " version available"))
        .when(ok, say("No", "OA status ", _or(st, "unknown"), " unclear despite license ", lic))
        .when(lic.endswith("-nd"), say("No", "ND license (", lic, ") prohibits derivative chunks/embeddings"))
        .when(st == "bronze", say("No", "bronze OA, free to read but no license to redistribute"))
        .when(st == "closed", say("No", "closed access (subscription only)"))
        .when(st == "green", say("No", "green OA without permissive license (", _or(lic, "none"), ")"))
        .when(lic != "", say("No", "non-permissive license (", lic, ")"))
        .otherwise(say("No", "no license info, oa_status=", _or(st, "unknown")))
    )


def redistribution_class(ok: Column, status: Column, licence: Column, version: Column) -> Column:
    """Yes, Maybe or No for redistribution inside a package."""
    st, lic, ver = _low(status), _low(licence), _low(version)
    limited = any_of(lic.startswith(x) for x in RESTRICTED)
    open_, green = st.isin("gold", "hybrid"), st == "green"
    return (
        F.when(~F.coalesce(ok, F.lit(False)), "No")
        .when(open_ & lic.isin(*PERMISSIVE), "Yes").when(open_ & (lic != ""), "Maybe")
        .when(green & (ver == "publishedversion") & lic.isin(*PERMISSIVE), "Yes").when(green & (lic.isin(*PERMISSIVE) | limited), "Maybe")
        .otherwise("No")
    )
