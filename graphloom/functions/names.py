"""Column functions on entity names: normal forms, validity, types, issues, compounds."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words and patterns by which names are judged.
JOB_TITLES = ("ceo", "pdg", "dg", "director", "directeur", "président", "president", "manager", "chairman", "vice-president", "vp", "cfo", "cto")
EXTRACTED_JOB_TITLES = (*JOB_TITLES, "board member")
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
SENTENCE_WORDS = ("the", "in", "of", "and", "bought", "sold", "dans", "pour", "avec")
DOMAINS = ("com", "tn", "org", "net", "fr")
COMPANY_WORDS = ("group", "groupe", "holding", "sa", "sarl", "suarl", "bank", "banque", "telecom", "industries")
PERSON_TITLES = ("mr", "m.", "mrs", "mme", "dr", "prof", "président", "directeur", "pdg", "ceo", "dg")
LABEL_TYPES = {"PER": "Person", "PERSON": "Person", "ORG": "Company", "ORGANIZATION": "Company", "LOC": "Location", "GPE": "Location"}
KEPT_ACRONYMS = ("BNA", "STB", "UIB", "BH", "BIAT", "ATB", "BT", "PGH", "SFBT", "STIL", "RCD", "PDG", "DG")
RESOLVER_SUFFIXES = ("sa", "sarl", "suarl", "holding", "groupe", "group")
REGISTRY_SUFFIXES = (*RESOLVER_SUFFIXES, "ltd", "llc", "inc", "corp")
LINKER_SUFFIXES = (*RESOLVER_SUFFIXES, "bank", "banque", "company", "companie", "société", "societe")
MERGER_SUFFIXES = ("sa", "sarl", "holding", "group", "groupe", "bank", "banque", "company", "société")
COMPOUND_PATTERNS = (r"(?i)\band\b", r"(?i)\bet\b", r"(?i)\bor\b", r"(?i)\bou\b", "[/,]")

_MONTHS = "|".join(MONTHS)
CITATION = r"(?U)^[\w\s]+ \d{4}[a-z]?$"
TWO_AUTHORS = r"(?U)^[\w\s]+ and [\w\s]+ \d{4}$"
DATED = rf"(?U)\b(in|on|from)\s+\d+\s+({_MONTHS})"
FULL_DATE = rf"(?U)\b\d{{1,2}}\s+({_MONTHS})\s+\d{{4}}\b"
NUMBERED = r"(?U)^(company|investor|shareholders?|entity)\s*\d+$"
NUMBERED_SINGULAR = r"(?U)^(company|investor|shareholder|entity)\s*\d+$"


def strip(c: Column) -> Column:
    """White space of any kind off both ends (trim takes only spaces)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def spaces(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def normalized(c: Column, suffixes: tuple[str, ...] = RESOLVER_SUFFIXES, dotted: bool = True, strict: bool = False) -> Column:
    """Lower case without legal suffixes, marks and doubled spaces.

    dotted: s.a. and s.a.r.l. go where a word follows the dot, as published; strict: they go everywhere."""

    def bare(out: Column) -> Column:
        if strict:
            out = F.regexp_replace(out, r"(?U)\bs\.a\.r\.l\.?|\bs\.a\.?(?=\s|$)", "")
        for word in suffixes:
            out = F.regexp_replace(out, rf"(?U)\b{word}\b", "")
        if dotted and not strict:
            out = F.regexp_replace(out, r"(?U)\bs\.a\.\b", "")
            out = F.regexp_replace(out, r"(?U)\bs\.a\.r\.l\.\b", "")
        return out

    # what a suffix leaves holds no other that wasn't there before, so names without any need no search
    out = once(strip(F.lower(c)), lambda low: F.when(_any([low.contains(w) for w in (*suffixes, "s.a")]), bare(low)).otherwise(low))
    out = F.regexp_replace(out, r"[^\p{L}\p{N}_\s]", "")
    return F.trim(F.regexp_replace(out, r"(?U)\s+", " "))


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def valid_mention(name: Column) -> Column:
    """Whether a surface form found by entity recognition can be an entity."""

    def bad(t: Column, low: Column) -> Column:
        sentence = (spaces(t) >= 5) & _any([low.contains(w) for w in SENTENCE_WORDS])
        numbered = _any([t.rlike(CITATION), t.rlike(TWO_AUTHORS), low.rlike(DATED), low.rlike(NUMBERED), low.rlike(r"^[a-z]\d+$")])
        # all patterns ask for a digit
        return _any([F.length(t) < 2, F.length(t) > 100, low.isin(*JOB_TITLES), sentence, t.rlike(r"\p{Nd}") & numbered, low.isin(*DOMAINS)])

    return F.coalesce(~once(strip(name), lambda t: once(F.lower(t), lambda low: bad(t, low))), F.lit(False))


def valid_extracted_name(name: Column) -> Column:
    """Whether a name given by a relation provider can be an entity."""
    t = strip(name)
    low = F.lower(t)
    bad = [F.length(t) < 2, F.length(t) > 100, low.isin(*EXTRACTED_JOB_TITLES), spaces(t) >= 5, t.rlike(CITATION), low.rlike(NUMBERED_SINGULAR), low.rlike(FULL_DATE)]
    return F.coalesce(~_any(bad), F.lit(False))


def entity_type(name: Column, label: Column) -> Column:
    """Type of a mention by words in it, else by its label; null: none."""
    labels = F.create_map(*[F.lit(x) for kv in LABEL_TYPES.items() for x in kv])
    other = F.try_element_at(labels, label)

    def by_words(low: Column) -> Column:
        company = _any([low.contains(w) for w in COMPANY_WORDS])
        kind = F.when(low.contains("bank") | low.contains("banque"), "Bank").when(low.contains("group") | low.contains("groupe"), "Group").otherwise("Company")
        titled = F.arrays_overlap(F.split(low, r"(?U)\s+"), F.array(*map(F.lit, PERSON_TITLES)))
        return F.when(company, kind).when(titled, "Person")

    return F.coalesce(once(F.lower(name), by_words), other)


def issue_of(name: Column) -> Column:
    """The first of the quality issues that a stored name has, else null."""
    t = strip(name)
    low = F.lower(t)
    return (
        F.when(low.isin(*JOB_TITLES), "job_titles")
        .when((F.length(t) <= 2) & ~F.upper(t).isin(*KEPT_ACRONYMS), "too_short")
        .when(F.length(t) > 100, "too_long")
        .when(t.rlike(CITATION), "citations")
        .when(low.rlike(DATED), "references")
        .when(spaces(t) >= 5, "sentence_like")
        .when(low.rlike(NUMBERED), "generic_numbered")
    )


def compound_parts(name: Column, acronyms: tuple[str, ...] = ()) -> Column:
    """The names that a compound one consists of; an array of the name itself where it is none."""
    def parts(pattern: str) -> Column:
        return F.filter(F.transform(F.split(name, "(?U)" + pattern, -1), strip), lambda x: x != "")

    split = F.coalesce(*[F.when(F.size(parts(p)) >= 2, parts(p)) for p in COMPOUND_PATTERNS])
    kept = F.filter(split, lambda x: (F.length(x) >= 2) | F.upper(x).isin(*(acronyms or ("",))))
    return F.when(split.isNotNull() & (F.size(kept) > 0), kept).otherwise(F.array(name))


def slug(title: Column) -> Column:
    return F.lower(F.regexp_replace(F.substring(title, 1, 50), r"[^\p{L}\p{N}]", "_"))


def alias_kind(alias: Column) -> Column:
    return F.when(alias.rlike(r"[؀-ۿ]"), "translation").otherwise("variant")


def cache_key(name: Column, kind: Column) -> Column:
    return F.concat(F.lower(name), F.lit(":"), kind)
