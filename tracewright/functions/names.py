"""Names of emitters, platforms and nations: aliases, tokens, canonical forms and matching rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewright.functions.fixed import MAKERS, NATION_TERMS, NO_PLATFORM_LABELS, PLATFORM_LABELS, UNKNOWN_GRAPH_NATIONS, UNKNOWN_NATIONS
from tracewright.functions.values import squeeze, strip

_PUNCTUATION = "-_/[]()."


def texts(values: list[str]) -> Column:
    return F.array(*(F.lit(v) for v in values)) if values else F.array().cast("array<string>")


def distinct_lower(items: Column) -> Column:
    """The items without those whose lower-case form came before; blank ones go."""
    return F.aggregate(
        F.filter(items, lambda x: x.isNotNull() & (x != "")),
        F.array().cast("array<string>"),
        lambda kept, x: F.when(F.exists(kept, lambda k: F.lower(k) == F.lower(x)), kept).otherwise(F.concat(kept, F.array(x))),
    )


def _variants(t: Column) -> Column:
    """Search forms of a name: without punctuation, without a short last suffix, its last two words, its last word."""
    numbered = F.regexp_replace(t, r"(?i)\bn[-\s]?([0-9]+)", "N$1")
    compact = strip(F.regexp_replace(F.regexp_replace(F.regexp_replace(numbered, r"[\[\]]", " "), "[-_/]+", " "), r"(?U)\s+", " "))
    family = F.regexp_replace(compact, r"(?i)\b(N[0-9]+\s+\S+?)(?:\s+[A-Z]{1,3})$", "$1")
    words = F.filter(F.split(compact, " "), lambda w: w != "")
    n = F.size(words)
    return F.array(
        F.when((compact != "") & (compact != t), compact),
        F.when(family != compact, family),
        F.when(n >= 2, F.array_join(F.slice(words, F.greatest(n - 1, F.lit(1)), 2), " ")),
        F.when((n >= 1) & (F.length(F.try_element_at(words, F.lit(-1))) > 1), F.try_element_at(words, F.lit(-1))),
    )


def emitter_aliases(name: Column) -> Column:
    """The name, what its brackets hold, what stands before them, and search forms; distinct in lower case."""
    t = strip(F.coalesce(name, F.lit("")))
    bracket = t.contains("[") & t.contains("]")
    after = F.substring_index(F.substr(t, F.instr(t, "[") + F.lit(1)), "]", 1)
    inner = strip(after)
    before = strip(F.substring_index(t, "[", 1))
    in_brackets = F.when(bracket, F.concat(F.array(inner, before), _variants(inner))).otherwise(F.array().cast("array<string>"))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(distinct_lower(F.concat(F.array(t), in_brackets, _variants(t))))


def semantic_tokens(aliases: Column) -> Column:
    """Distinct runs of two and more letters or digits over all aliases; n- counts as n anywhere."""
    tokens = F.flatten(F.transform(aliases, lambda a: F.regexp_extract_all(F.replace(F.lower(a), F.lit("n-"), F.lit("n")), F.lit("([a-z0-9]+)"), F.lit(1))))
    return F.array_distinct(F.filter(tokens, lambda t: F.length(t) > 1))


def match_terms(aliases: Column) -> Column:
    """Lower-case aliases with punctuation as single spaces, distinct."""
    terms = F.transform(aliases, lambda a: squeeze(F.regexp_replace(F.lower(a), r"[-_/\[\]().]", " ")))
    return F.array_distinct(F.filter(terms, lambda t: t != ""))


def spaced(name: Column) -> Column:
    """A node's name in lower case with punctuation as spaces, which are not squeezed."""
    return F.translate(F.lower(name), _PUNCTUATION, " " * len(_PUNCTUATION))


def emitter_match(name: Column, terms: Column, tokens: Column) -> tuple[Column, Column]:
    """Which terms and which tokens a spaced name matches."""
    long_enough = F.length(F.replace(name, F.lit(" "), F.lit(""))) >= 3
    exact = F.filter(terms, lambda a: (name == a) | F.contains(name, a) | (F.contains(a, name) & long_enough))
    return exact, F.filter(tokens, lambda t: F.contains(name, t))


def emitter_matches(exact: Column, matched: Column, tokens: Column) -> Column:
    """An alias, or at least two tokens (one, where there is only one)."""
    n = F.size(tokens)
    return (F.size(exact) > 0) | (F.size(matched) >= F.when(n > 0, F.least(F.lit(2), n)).otherwise(1))


def safe_substring(alias: Column, name: Column) -> Column:
    """Whether an alias of at least three letters or digits is part of the name."""
    return (F.length(F.regexp_replace(F.lower(alias), "[^a-z0-9]", "")) >= 3) & F.contains(name, alias)


def canonical_name(name: Column) -> Column:
    """A maker's name before a designation goes; the designation's family keeps its spelling."""
    t = squeeze(F.coalesce(name, F.lit("")))
    out = F.lit(None).cast("string")
    for pattern, family in MAKERS:
        d = F.regexp_replace(strip(F.regexp_extract(t, pattern, 1)), r"\s+", "-")
        formed = F.when(F.startswith(F.lower(d), F.lit(family.lower())), F.concat(F.lit(family), F.substring(d, len(family) + 1, 1 << 20))).otherwise(d)
        out = F.coalesce(out, F.when(t.rlike(pattern), formed))
    return F.coalesce(out, t)


def upper_text(c: Column) -> Column:
    return F.upper(squeeze(F.coalesce(c, F.lit(""))))


def is_country(c: Column, countries: list[str]) -> Column:
    """Whether the text, upper-cased and squeezed, is one of countries."""
    return upper_text(c).isin(countries)


def is_unknown_nation(c: Column) -> Column:
    return F.lower(strip(F.coalesce(c, F.lit("")))).isin(UNKNOWN_NATIONS)


def nation_terms(countries: list[str]) -> dict[str, str]:
    """Words for nations: the fixed ones, then each country's own name in title case."""
    return {c: c.title() for c in countries} | NATION_TERMS


def nation_in_text(c: Column, terms: dict[str, str]) -> Column:
    """The nation that the longest term in the text stands for (of equal length the first by alphabet), or null."""
    t = F.concat(F.lit(" "), squeeze(F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), "[^A-Z0-9]+", " ")), F.lit(" "))
    ordered = sorted(terms, key=lambda x: (-len(x), x))
    # Terms with anything but letters, digits and spaces cannot match a text of those.
    pairs = F.array(*(F.struct(F.lit(f" {x} ").alias("term"), F.lit(terms[x]).alias("nation")) for x in ordered if all(ch.isascii() and (ch.isalnum() or ch == " ") for ch in x)))
    return F.try_element_at(F.filter(pairs, lambda p: F.contains(t, p["term"])), F.lit(1))["nation"]


def variant_without_nation(variant: Column, fallback: Column, terms: dict[str, str]) -> tuple[Column, Column]:
    """The variant's name and null; where it names a nation, the fallback and the nation."""
    t = strip(F.coalesce(variant, F.lit("")))
    nation = nation_in_text(t, terms)
    return F.when(nation.isNotNull(), fallback).otherwise(F.coalesce(F.nullif(t, F.lit("")), fallback)), nation


def label_set(labels: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.coalesce(labels, F.array().cast("array<string>")), lambda x: F.upper(strip(x))), lambda x: x != ""))


def valid_candidate(platform: Column, variant: Column, nation: Column, operator: Column, country: Column) -> Column:
    """Whether the labels of a graph row's platform, variant, operator and country fit their roles."""

    def can_be_platform(labels: Column) -> Column:
        s = label_set(labels)
        return (F.size(s) == 0) | (~F.arrays_overlap(s, texts(NO_PLATFORM_LABELS)) & F.arrays_overlap(s, texts(PLATFORM_LABELS)))

    unknown = F.upper(strip(F.coalesce(nation, F.lit("")))).isin(UNKNOWN_GRAPH_NATIONS)
    c = label_set(country)
    fits = ((F.size(c) == 0) | F.array_contains(c, "COUNTRY")) & ~F.array_contains(label_set(operator), "SENSOR")
    return can_be_platform(platform) & can_be_platform(variant) & (unknown | fits)


def relationship_types(types: list[str] | None) -> list[str]:
    """The types in upper case, distinct, in order; one that is no name is an error."""
    import re

    out: list[str] = []
    for raw in types or []:
        t = str(raw).strip().upper()
        if not re.fullmatch(r"[A-Z][A-Z0-9_]*", t):
            raise ValueError(f"not a relationship type: {raw!r}")
        if t not in out:
            out.append(t)
    return out


def number_in_text(c: Column, units: list[str]) -> Column:
    """The number next to the first unit that has one, else the first number; thousands commas are left out."""
    number = r"([-+]?[0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?)"
    found = [F.nullif(F.regexp_extract(c, rf"(?i){number}\s*{u}\b", 1), F.lit("")) for u in units]
    found.append(F.nullif(F.regexp_extract(c, number, 1), F.lit("")))
    return F.replace(F.coalesce(*found), F.lit(","), F.lit("")).try_cast("double")


def upper_bound(values: list[Column], units: list[str]) -> Column:
    """From lists of texts, in order: the first list whose first number is positive gives it; else null (unknown)."""
    firsts = [F.try_element_at(F.filter(F.transform(v, lambda x: number_in_text(x, units)), lambda x: x.isNotNull()), F.lit(1)) for v in values]
    return F.coalesce(*(F.when(x > 0, x) for x in firsts))


def evidence_path_id(paths: Column) -> Column:
    """Items of a path joined by >, paths by |, empty paths left out."""
    return F.coalesce(F.array_join(F.filter(F.transform(paths, lambda p: F.array_join(p, ">")), lambda p: p != ""), "|"), F.lit(""))
