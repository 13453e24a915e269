"""Column expressions that label a row by its name, denomination or tax record."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from waymark.functions.text import first_rule

#: Starts of words by which a denomination is out of scope, and words that keep it in scope.
OUT_OF_SCOPE = (
    "jewish", "judaism", "synagogue", "kabbalah", "islam", "muslim", "mosque", "ahmadi", "hindu", "krishna", "vaishnav", "buddhist", "zen", "sikh", "jain", "baha", "bahá",
    "taoist", "confucian", "shinto", "tenrikyo", "zoroastrian", "pagan", "wicca", "shaman", "voodoo", "vodou", "eckankar", "falun gong", "scientolog", "spiritualist", "spiritist",
    "spiritual science", "religious science", "unitarian universalist", "ethical", "rastafari",
)
IN_SCOPE_AFTER_ALL = ("messianic", "jews for jesus", "hebrew christian")

#: Patterns of a name and denomination with the language and culture they tell; the first that fits counts.
CULTURES = (
    (r"iglesia|primera\b|segundo\b|nueva\b|cristo\b|dios\b|señor\b|espiritu\b|sagrada\b|virgen\b|nuestra\b|evangelio\b|parroquia\b|templo\b|catedral\b|hispana|hispanica|latina|latino|española|español", "Spanish", "Hispanic/Latino"),
    (r"korean|한국|코리안", "Korean", "Korean"),
    (r"chinese|mandarin|cantonese|中文|华人|taiwanese|台灣|台湾", "Chinese", "Chinese"),
    (r"vietnamese|viet\b|việt", "Vietnamese", "Vietnamese"),
    (r"filipino|pilipino|tagalog|philippine", "Filipino", "Filipino"),
    (r"portuguesa|brasileira|brasil\b|lusitano|lusitana|portuguese", "Portuguese", "Brazilian/Portuguese"),
    (r"haitian|haïtien|haitien|francophone|française|creole", "Haitian Creole", "Haitian"),
    (r"\barabic\b|\barab\b", "Arabic", "Arab"),
    (r"ethiopian|eritrean|amharic|oromo", "Amharic", "East African"),
    (r"\bhmong\b", "Hmong", "Hmong"),
    (r"\bhindi\b|\bpunjabi\b|\btelugu\b|\btamil\b|\bmalayalam\b|\bsouth asian\b", "Hindi", "South Asian"),
    (r"\bjapanese\b", "Japanese", "Japanese"),
    (r"\bame\b(?!\s*zion\s+lutheran|\s*zion\s+methodist)|african methodist episcopal|national baptist|progressive national|national missionary baptist|colored methodist|c\.m\.e\.|mount zion\b|\bame zion\b", "English", "African American"),
    (r"\bswahili\b|\bafrican\b(?!\s+methodist)", "Swahili", "African"),
)

#: Classes and words of a tax file's rows.
OTHER_CLASSES = ("X30", "X40", "X50", "X70")
OTHER_WORDS = r"\b(SYNAGOGUE|JEWISH|CHABAD|TORAH|BETH|ISLAMIC|MASJID|MOSQUE|MUSLIM|BUDDHIS\w*|DHARMA|ZEN|SANGHA|HINDU|VEDANTA|SIKH|GURDWARA|JAIN|BAHAI|WICCA\w*|PAGAN|SCIENTOLOGY|SPIRITUALIST|TAOIST|UNITARIAN\w*)\b"
GATHERING_WORDS = r"\b(CHURCH|IGLESIA|PARISH|CONGREGATION|CHAPEL|FELLOWSHIP|ASSEMBLY|TABERNACLE|CATHEDRAL|BAPTIST|LUTHERAN|METHODIST|PRESBYTERIAN|EPISCOPAL|PENTECOSTAL|CALVARY|VINEYARD|ADVENTIST|NAZARENE|COVENANT|ORTHODOX|IGREJA|EGLISE|TEMPLO|MINISTERIO|CENTRO CRISTIANO|KOREAN|CHINESE|VIETNAMESE)\b"
AGENCY_WORDS = r"\b(FOUNDATION|SCHOOL|ACADEMY|COLLEGE|SEMINARY|UNIVERSITY|CAMP|RADIO|HOSPITAL|PRESCHOOL|DAYCARE|CHILD CARE|HOUSING|THRIFT|AUXILIARY|ENDOWMENT|TRUST|ASSOCIATION|CONFERENCE|DIOCESE|PRESBYTERY|SYNOD|DISTRICT|COUNCIL|NETWORK|ALLIANCE OF)\b"
MAILBOX = r"^(P\s*O\s*BOX|POST OFFICE BOX|BOX\s+\d|PMB)"
UNIT = r"\b(APT|UNIT|STE|SUITE|PMB|SPC|TRLR)\b|#"


def in_scope(denomination: Column | str) -> Column:
    """whether a denomination is in scope; null and blank are."""
    folded = F.lower(F.coalesce(denomination, F.lit("")))
    return folded.rlike("|".join(IN_SCOPE_AFTER_ALL)) | ~folded.rlike(f"(^|[^a-z])({'|'.join(OUT_OF_SCOPE)})")


def says_something(*columns: Column | str) -> Column:
    """whether one of these is neither null, blank nor an empty JSON value."""
    told = [F.coalesce(~F.btrim(c).isin("", "[]", "false", "0"), F.lit(False)) for c in columns]
    out = told[0]
    for t in told[1:]:
        out = out | t
    return out


def culture(name: Column, denomination: Column) -> Column:
    """The language and culture of the first pattern that name and denomination hold, both null if there is none."""
    both = F.concat_ws(" ", name, F.coalesce(denomination, F.lit("")))
    labels: list[Column] = [first_rule(both, [(f"(?i){p}", c[k]) for p, *c in CULTURES]) for k in (0, 1)]
    return F.struct(labels[0].alias("language"), labels[1].alias("culture"))


def is_charity_of_interest(subsection: Column, foundation: Column, ntee: Column, activity: Column, name: Column) -> Column:
    """a tax file's row of a religious body that isn't of another religion by its class or name."""
    religious = (foundation == "10") | ntee.startswith("X2") | activity.startswith("001")
    return F.coalesce((subsection == "03") & religious & ~F.left(ntee, F.lit(3)).isin(*OTHER_CLASSES) & ~name.rlike(OTHER_WORDS), F.lit(False))


def is_mailbox(street: Column) -> Column:
    """whether an address is a box or names a unit."""
    bare = F.replace(F.upper(street), F.lit("."), F.lit(""))
    return bare.rlike(MAILBOX) | bare.rlike(UNIT)


def is_gathering(name: Column) -> Column:
    """whether a name is that of a congregation and not of an agency beside it."""
    return name.rlike(GATHERING_WORDS) & ~name.rlike(AGENCY_WORDS)


def title_case(column: Column | str) -> Column:
    """A capital at the start of each run of letters, also after an apostrophe or digit; other letters small."""
    runs = F.regexp_extract_all(F.lower(column), F.lit(r"(\p{L}+|\P{L}+)"), 1)
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.substring(r, 2, 1 << 30))), "")


def either_holds(a: Column, b: Column) -> Column:
    """Whether one text holds the other, case aside; blank ones hold nothing."""
    x, y = F.lower(F.btrim(a)), F.lower(F.btrim(b))
    return F.coalesce((x != "") & (y != "") & (F.contains(x, y) | F.contains(y, x)), F.lit(False))


def any_of(text: Column, parts: Sequence[str]) -> Column:
    """Whether a text holds one of the parts, case aside."""
    return F.coalesce(F.exists(F.array(*[F.lit(p.lower()) for p in parts]), lambda p: F.contains(F.lower(text), p)), F.lit(False))
