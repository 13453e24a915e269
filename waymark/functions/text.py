"""Column expressions for text: cleaning, keys, comparisons, truncation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(column: Column | str) -> Column:
    """without spaces at either end; blank becomes null."""
    return F.nullif(F.btrim(column), F.lit(""))


def differs(a: Column, b: Column) -> Column:
    """null-safe inequality, never null."""
    return ~a.eqNullSafe(b)


def same_folded(column: Column | str, value: str) -> Column:
    """equality without regard to case."""
    return F.lower(column) == F.lower(F.lit(value))


def contains_folded(column: Column | str, part: str) -> Column:
    """literal containment without regard to case; % and _ have no meaning."""
    return F.contains(F.lower(column), F.lower(F.lit(part)))


def address_key(street: Column, city: Column, postcode: Column) -> Column:
    """one comparable key for an address: case and spacing ignored, nulls as empty."""
    joined = F.concat(F.coalesce(street, F.lit("")), F.lit("|"), F.coalesce(city, F.lit("")), F.lit("|"), F.coalesce(postcode, F.lit("")))
    return F.lower(F.regexp_replace(F.btrim(joined), r"\s+", " "))


def name_key(column: Column | str) -> Column:
    """Letters and digits alone, in lower case."""
    return F.lower(F.regexp_replace(column, r"[^\p{L}\p{N}]", ""))


def squeeze(column: Column | str) -> Column:
    """Each run of white space, no-break spaces too, as one space."""
    return F.regexp_replace(column, r"[\s ]+", " ")


def content_hash(column: Column | str) -> Column:
    """SHA-256 of the text, in hexadecimal."""
    return F.sha2(F.col(column) if isinstance(column, str) else column, 256)


def content_key(prefix: str, when: Column, digest: Column, suffix: str = ".html") -> Column:
    """The object key of a page: prefix, UTC date, digest."""
    return F.concat(F.lit(prefix + "/"), F.date_format(when, "yyyy/MM/dd"), F.lit("/"), digest, F.lit(suffix))


def fingerprint(group: Column | str, values: Sequence[Column], url: Column, excerpt: Column, length: int = 20) -> Column:
    """The first characters of a SHA-256 over group, stripped values, address and excerpt, each with its length.

    Lengths keep the form injective: no two different facts write the same text.
    """
    parts = [F.coalesce(F.btrim(v), F.lit("")) for v in (F.lit(group) if isinstance(group, str) else group, *values, url, excerpt)]
    return F.substring(F.sha2(F.concat(*[F.concat(F.char_length(p).cast("string"), F.lit(":"), p) for p in parts]), 256), 1, length)


def prompt_fingerprint(version: Column, prompt: Column, model: Column) -> Column:
    """16 characters of a SHA-256 over three texts parted by NUL."""
    return F.substring(F.sha2(F.concat(version, F.lit("\x00"), prompt, F.lit("\x00"), model), 256), 1, 16)


#: Street words that are written short.
STREET_WORDS = {
    "NORTH": "N", "SOUTH": "S", "EAST": "E", "WEST": "W", "NORTHEAST": "NE", "NORTHWEST": "NW", "SOUTHEAST": "SE", "SOUTHWEST": "SW",
    "STREET": "ST", "ROAD": "RD", "AVENUE": "AVE", "BOULEVARD": "BLVD", "DRIVE": "DR", "COURT": "CT", "CIRCLE": "CIR", "HIGHWAY": "HWY", "LANE": "LN", "PLACE": "PL", "TERRACE": "TER", "PARKWAY": "PKWY",
    "FIRST": "1ST", "SECOND": "2ND", "THIRD": "3RD", "FOURTH": "4TH", "FIFTH": "5TH", "SIXTH": "6TH", "SEVENTH": "7TH", "EIGHTH": "8TH", "NINTH": "9TH", "TENTH": "10TH", "SEVENTEENTH": "17TH",
}


def postal_street(column: Column | str) -> Column:
    """A street in upper case up to its unit, words in their short form."""
    bare = F.regexp_replace(F.upper(column), r"(?s)(,|#|\(|\b(SUITE|STE|BLDG|BUILDING|APT|UNIT)\b).*$", "")
    short = F.create_map(*[F.lit(x) for pair in STREET_WORDS.items() for x in pair])
    return F.array_join(F.transform(F.regexp_extract_all(bare, F.lit("([A-Z0-9]+)"), 1), lambda w: F.coalesce(F.try_element_at(short, w), w)), " ")


def truncate_words(column: Column | str, most: int) -> Column:
    """At most `most` characters, cut at the last space that leaves something, with an ellipsis if cut."""
    text = F.btrim(column)
    head = F.substring(text, 1, most)
    at_space = F.regexp_extract(head, r"(?s)^(.*\S)\s+\S*$", 1)
    return F.when(F.char_length(text) <= most, text).otherwise(F.concat(F.when(at_space != "", at_space).otherwise(head), F.lit("…")))


#: Names of languages as they are written, and the name that is kept.
LANGUAGE_NAMES = {
    "mandarin": "Mandarin", "國語": "Mandarin", "国语": "Mandarin", "普通話": "Mandarin", "普通话": "Mandarin", "cantonese": "Cantonese", "粵語": "Cantonese", "粤语": "Cantonese", "廣東話": "Cantonese",
    "taiwanese": "Taiwanese", "台語": "Taiwanese", "台语": "Taiwanese", "chinese": "Chinese", "中文": "Chinese", "english": "English", "spanish": "Spanish", "español": "Spanish", "korean": "Korean",
    "vietnamese": "Vietnamese", "tagalog": "Tagalog", "filipino": "Tagalog", "japanese": "Japanese",
}


def language_list(column: Column | str, aliases: dict[str, str] = LANGUAGE_NAMES) -> Column:
    """A list split at ; , / 、 or "and", trimmed, aliases resolved, other names with a capital, each once in order of first mention, joined by ;. Null gives an empty text."""
    named = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair]) if aliases else F.expr("cast(map() as map<string,string>)")
    column = F.col(column) if isinstance(column, str) else column
    parts = F.filter(F.transform(F.split(F.coalesce(column, F.lit("")), r"[;,/、]|\band\b"), lambda p: F.btrim(p)), lambda x: x != "")
    capital = lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1 << 30))
    return F.array_join(F.array_distinct(F.transform(parts, lambda x: F.coalesce(F.try_element_at(named, F.lower(x)), capital(x)))), ";")


def clock_times(column: Column | str) -> Column:
    """The times of a schedule as sorted HH:MM, null if one of them names neither am nor pm."""
    found = F.regexp_extract_all(F.lower(column), F.lit(r"(\d{1,2}(?::\d{2})?\s*(?:[ap]\.?m\.?)?)"), 1)

    def to_24(t: Column) -> Column:
        hour = F.regexp_extract(t, r"^(\d{1,2})", 1).try_cast("int")
        minute = F.coalesce(F.nullif(F.regexp_extract(t, r":(\d{2})", 1), F.lit("")), F.lit("00"))
        pm = t.contains("p")
        hour = hour % 12 + F.when(pm, 12).otherwise(0)
        return F.concat(F.lpad(hour.cast("string"), 2, "0"), F.lit(":"), minute)

    whole = F.forall(found, lambda t: t.rlike(r"[ap]\.?m")) & (F.size(found) > 0)
    return F.when(whole, F.array_sort(F.array_distinct(F.transform(found, to_24))))


def same_value(field: str, a: Column, b: Column) -> Column:
    """Equality as a field means it: phones by their last ten digits, addresses of pages without scheme, www and final slash, numbers within 1e-6, other text folded and trimmed."""
    if field == "phone":
        digits = lambda c: F.right(F.regexp_replace(c, r"\D", ""), F.lit(10))
        return digits(a) == digits(b)
    if field in ("website", "facebook_url", "url"):
        return page_key(a) == page_key(b)
    if field in ("latitude", "longitude"):
        return F.abs(a.try_cast("double") - b.try_cast("double")) <= 1e-6
    return F.lower(F.btrim(a)) == F.lower(F.btrim(b))


def page_key(url: Column | str) -> Column:
    """A page's address without scheme, www, query, fragment and final slashes, in lower case."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.btrim(url)), r"^https?://(www\.)?", ""), r"([?#].*)?$|/+([?#].*)?$", "")


def host(url: Column | str) -> Column:
    """The host of an address without www, null if there is none."""
    return F.nullif(F.regexp_extract(F.lower(url), r"^[a-z]+://(?:www\.)?([^/?#:]+)", 1), F.lit(""))


#: Words of a name that say nothing about which place it is.
STOP_WORDS = ("the", "of", "and", "a", "in", "at", "for", "inc")


def name_tokens(name: Column | str, city: Column | None = None) -> Column:
    """The set of a name's words without apostrophes, stop words and the words of its city."""
    words = lambda c: F.filter(F.split(F.regexp_replace(F.regexp_replace(F.lower(c), "['’]", ""), r"[^a-z0-9]+", " "), " "), lambda w: w != "")
    out = F.array_except(words(name), F.array(*[F.lit(w) for w in STOP_WORDS]))
    return F.array_sort(out if city is None else F.array_except(out, F.coalesce(words(city), F.expr("cast(array() as array<string>)"))))


def same_name(a: Column, b: Column) -> Column:
    """Token sets with a Jaccard index of 0.6 or more, or at least two shared tokens of which one set consists."""
    shared = F.size(F.array_intersect(a, b))
    near = shared >= 0.6 * F.size(F.array_union(a, b))
    within = (shared >= 2) & ((F.size(F.array_except(a, b)) == 0) | (F.size(F.array_except(b, a)) == 0))
    return F.coalesce((shared > 0) & (near | within), F.lit(False))


#: What may not stand in a published text.
PATTERNS = {
    "phone": r"(?<!\d)(?:\+?1[-. ]?)?\(?\d{3}\)?[-. ]\d{3}[-. ]\d{4}(?!\d)",
    "email": r"[\w.+-]+@[\w-]+\.[\w.]+",
    "copyright": r"(?i)(©|&copy;|\bcopyright\b)",
    "iso_date": r"\b\d{4}-\d{2}-\d{2}\b",
}


def matches(pattern: str, column: Column | str) -> Column:
    """Whether a text holds the named pattern; null counts as no."""
    return F.coalesce(F.rlike(column, F.lit(PATTERNS[pattern])), F.lit(False))


def first_rule(column: Column | str, rules: Sequence[tuple[str, str]], default: str | None = None) -> Column:
    """The label of the first pattern that a text holds."""
    out = F.lit(default)
    for pattern, label in reversed(rules):
        out = F.when(F.rlike(column, F.lit(pattern)), F.lit(label)).otherwise(out)
    return out


def link_kinds(page: Column | str, needles: dict[str, Sequence[str]]) -> Column:
    """The kinds of pages that a page links to: a kind's needle stands in the last segment of a link's path."""
    last = F.transform(F.regexp_extract_all(F.lower(page), F.lit(r'href\s*=\s*"([^"#?]*)'), 1), lambda u: F.regexp_extract(u, r"([^/]*)/*$", 1))
    kinds = [F.when(F.exists(last, lambda s, ws=words: F.array_contains(F.transform(F.array(*[F.lit(w) for w in ws]), lambda w: F.contains(s, w)), True)), F.lit(kind)) for kind, words in needles.items()]
    return F.array_compact(F.array(*kinds))


def occurrences(text: Column, part: Column) -> Column:
    """How often a part stands in a text, without overlaps; an empty part never does."""
    return F.when(F.char_length(part) > 0, ((F.char_length(text) - F.char_length(F.replace(text, part, F.lit("")))) / F.char_length(part)).cast("int")).otherwise(0)


def locate_once(excerpt: Column, text: Column) -> Column:
    """Start, end (from 0) and status of an excerpt that stands once in a text, exactly or else without regard to case."""
    exact, folded = occurrences(text, excerpt), occurrences(F.lower(text), F.lower(excerpt))
    status = F.when(exact == 1, "exact").when(exact > 1, "ambiguous").when(folded == 1, "folded").when(folded > 1, "ambiguous").otherwise("missing")
    start = F.when(status == "exact", F.instr(text, excerpt) - 1).when(status == "folded", F.instr(F.lower(text), F.lower(excerpt)) - 1)
    return F.struct(status.alias("status"), start.alias("start"), (start + F.char_length(excerpt)).alias("end"))
