"""String cleaning as column expressions. Null stays null unless a function says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: words and patterns whose results must stay equal to what dispatch staff see today
#: Spoken or written street suffix -> municipal abbreviation; the vocabulary table overrides them.
SUFFIXES = {
    "AVENUE": "AVE", "AVE": "AVE", "STREET": "ST", "ST": "ST", "ROAD": "RD", "RD": "RD", "DRIVE": "DR", "DR": "DR",
    "BOULEVARD": "BLVD", "BLVD": "BLVD", "HIGHWAY": "HWY", "HWY": "HWY", "WAY": "WAY", "CRESCENT": "CRES", "CRES": "CRES", "COURT": "CRT", "CRT": "CRT",
    "PLACE": "PL", "PL": "PL", "LANE": "LANE",
}
#: Order matters: the first type that fits is taken. (type, routing class, beginnings, contained words)
UNIT_TYPES = (
    ("Squad", "light", ("SQ",), ("SQUAD",)),
    ("Light Attack Vehicle", "light", ("LAV",), ()),
    ("Ladder", "heavy", ("TOWER", "PLATFORM", "L"), ("LADDER",)),
    ("Water Tender", "heavy", ("WT", "T"), ("TENDER", "TANKER")),
    ("Engine", "general", ("E",), ("ENGINE", "PUMPER")),
    ("Rescue", "general", ("R",), ("RESCUE",)),
    ("Quint", "general", ("Q",), ("QUINT",)),
    ("Chief", "light", ("C",), ("COMMAND",)),
    ("Medic", "light", ("M",), ("MEDIC",)),
    ("Specialty", "light", ("S",), ("SPECIALTY",)),
)
#: Beginnings of units that are kept at a hall whose number they do not carry, or carry beside other digits.
HOME_HALLS = {"2": "E2|L2|R2|SQ2|T2|WT2", "3": "E3|Q5|H3|HT3|S3|SQ3", "4": "E4|T4|WT4|LAV4|SQ4"}
HALLS = ("1", "2", "3", "4")
#: Of an address for lookups: what may stand at its edges, the city tail, a unit before and after it, and its street types.
ADDRESS_EDGE = r"^[ ,.\-]+|[ ,.\-]+$"
CITY_TAIL = r"(^|\b|,)\s*(COQUITLAM|PORT COQUITLAM|PORT MOODY|BC|BRITISH COLUMBIA)\b.*$"
UNIT_BEFORE = r"^\s*(?:UNIT|APT|STE|SUITE|#)\.?\s*#?\s*\d+[\w-]*[,\-\s]+"
UNIT_AFTER = r"[,\-\s]+\s*(?:UNIT|APT|STE|SUITE|#)\.?\s*#?\s*\d+[\w-]*[,\-\s]*$"
LOOKUP_TYPES = (("AVE?", "AVE"), ("RD?", "RD"), ("ST?", "ST"), ("DR?", "DR"), ("HWY?", "HIGHWAY"), ("BLVD?", "BLVD"), ("CRT?", "CRT"), ("PL?", "PL"))
#: What is cut after a comma.
POSTAL_CODE = r"(?i),\s*[A-Z]\d[A-Z]\s*\d[A-Z]\d"
REGIONS = ("BC|British Columbia", "Canada", "Coquitlam", "Port Coquitlam", "Port Moody")
#: Of a civic address: separators of an intersection, a unit as "7-12 Oak", before, anywhere, and alone after the street type.
CROSSING_WORDS = r"(?i)\s+(?:AND|AT|/|@)\s+"
UNIT_DASH = r"^\d+[-/]\s*(\d+\s+[A-Za-z])"
UNIT_LEAD = r"(?i)^(?:UNIT|APT|STE|SUITE|BAY|BLDG|BUILDING|#)\s*\w+(?:[-/\s]+|\s+-\s+)(\d{1,5}\s+[A-Za-z])"
UNIT_WITHIN = r"(?i)\s+(?:UNIT|APT|SUITE|STE|BAY|BLDG|BUILDING|LOT|WHSE|WAREHOUSE|PHASE|PH|COMP|RM|ROOM|FL|FLOOR|#)\s*[\w-]+"
UNIT_LAST = r"(?i)(\b(?:AVE|AVENUE|ST|STREET|RD|ROAD|WAY|DR|DRIVE|CRT|COURT|BLVD|BOULEVARD|CRES|CRESCENT|PL|PLACE|LANE|LN|HWY|HIGHWAY))\s+(?:#\w+|\d+[A-Za-z]?|[A-Za-z])$"
#: Of a house and street: the block mark, and the unit that ends the text.
BLOCK_WORDS = r"(?i)\b(block|blk)\b"
BLOCK_OR_OF = r"(?i)\b(block|blk|of)\b"
UNIT_TAIL = r"(?i)\b(number|num|unit|suite|apt|apartment|#)\s+\w+\b.*"
# ---- end of fixed values


def blank_to_null(c: Column) -> Column:
    """CLN-01: blank, nan, none, <null>, null become null."""
    return F.when(~F.lower(F.trim(c)).isin("", "nan", "none", "<null>", "null"), c)


def safe_int(c: Column) -> Column:
    """CLN-02: integer through a float; anything else is null."""
    return c.try_cast("double").try_cast("int")


def safe_bool(c: Column) -> Column:
    """CLN-02: YES, Y, TRUE, 1 are true; null and the rest are false."""
    return F.coalesce(F.upper(F.trim(c)).isin("YES", "Y", "TRUE", "1"), F.lit(False))


def _suffix_map(suffixes: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in suffixes.items() for x in kv])


def street_name(c: Column, suffixes: dict[str, str] = SUFFIXES) -> Column:
    """CLN-03: upper case without , . BLOCK BLK OF; the last of two or more words is abbreviated. Null is empty."""
    s = F.upper(F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), "[,.]", ""))
    words = F.filter(F.split(F.regexp_replace(s, r"\b(?:BLOCK|BLK|OF)\b", ""), r"\s+"), lambda w: w != "")
    last = F.try_element_at(words, F.lit(-1))
    short = F.coalesce(F.try_element_at(_suffix_map(suffixes), last), last)
    return F.when(F.size(words) > 1, F.concat(F.array_join(F.slice(words, 1, F.size(words) - 1), " "), F.lit(" "), short)).otherwise(F.array_join(words, " "))


def intersection_key(a: Column, b: Column) -> Column:
    """CLN-05: both normal forms, sorted."""
    return F.array_join(F.array_sort(F.array(street_name(a), street_name(b))), " & ")


def intersection_parts(c: Column) -> Column:
    """CLN-06: array of the two streets of an intersection text before its first comma; null if it is none."""
    head = F.trim(F.substring_index(c, ",", 1))
    parts = F.filter(F.transform(F.split(head, r"(?i)\s+(?:and|&|/|near|at|@)\s+|\s*[/&@]\s*"), lambda w: F.trim(w)), lambda w: w != "")
    return F.when(F.size(parts) >= 2, F.slice(parts, 1, 2))


def house_and_street(c: Column, suffixes: dict[str, str] = SUFFIXES) -> Column:
    """CLN-07: struct(house, street, street_type, has_block); null without a leading number.

    The last word is the type: abbreviated if the suffixes have it, else as it is; a lone word is a type only if they have it.
    """
    s = F.trim(F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace(c, UNIT_TAIL, "")), BLOCK_OR_OF, ""), r"\s+", " "))
    house, name, last = (F.regexp_extract(s, r"^(\d+)\s+(.*?)(\S+)$", i) for i in (1, 2, 3))
    short = F.try_element_at(_suffix_map(suffixes), F.upper(last))
    lone = name == ""
    street = F.when(~lone, F.trim(name)).when(short.isNull(), last).otherwise("")
    kind = F.coalesce(short, F.when(lone, "").otherwise(F.upper(last)))
    return F.when(s.rlike(r"^\d+\s+\S"), F.struct(house.alias("house"), street.alias("street"), kind.alias("street_type"), c.rlike(BLOCK_WORDS).alias("has_block")))


def near_clause(c: Column) -> Column:
    """CLN-08: the street after "near", up to "use", "map" or the end; null without one."""
    got = F.trim(F.regexp_extract(c, r"(?i)\bnear\s+(.+?)(?:\s+use\b|\s+map\b|\s*$)", 1))
    return F.when(got != "", got)


def lookup_address(c: Column) -> Column:
    """CLN-09: address for lookups, without city tail and unit, with standard street types (lone letters included)."""
    s = F.upper(F.coalesce(c, F.lit("")))
    for pattern in (ADDRESS_EDGE, CITY_TAIL, ADDRESS_EDGE, UNIT_BEFORE, UNIT_AFTER, ADDRESS_EDGE):
        s = F.regexp_replace(s, pattern, "")
    for spelling, kind in LOOKUP_TYPES:
        s = F.regexp_replace(s, rf"\b{spelling}\b", kind)
    return F.regexp_replace(F.regexp_replace(s, r"\s+", " "), ADDRESS_EDGE, "")


def without_region(c: Column) -> Column:
    """CLN-10: cuts postal code, province, country and city after a comma."""
    s = F.regexp_replace(c, POSTAL_CODE, "")
    for tail in REGIONS:
        s = F.regexp_replace(s, rf"(?i),\s*(?:{tail})\b.*", "")
    return F.trim(s)


def civic_address(c: Column) -> Column:
    """CLN-11: the civic address of a unit address, and one spelling of intersection separators. Null is empty."""
    s = F.trim(F.coalesce(c, F.lit("")))
    s = F.regexp_replace(F.regexp_replace(s, CROSSING_WORDS, " & "), r"\s*&\s*", " & ")
    for pattern, kept in ((UNIT_DASH, "$1"), (UNIT_LEAD, "$1"), (UNIT_WITHIN, "")):
        s = F.regexp_replace(s, pattern, kept)
    return F.trim(F.regexp_replace(F.trim(s), UNIT_LAST, "$1"))


def training_text(c: Column, seconds: Column | None = None) -> Column:
    """CLN-16: lower case, no punctuation, single spaces; a recording above 25 s repeats its text."""
    s = F.trim(F.regexp_replace(F.translate(F.lower(c), ".,!?;:\"'", ""), r"\s+", " "))
    return s if seconds is None else F.when(seconds > 25, F.concat_ws(" ", s, s)).otherwise(s)


def merge_units(a: Column, b: Column) -> Column:
    """CLN-19: units of the first list, then the second's new ones, compared without case."""
    units = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), r"\s*,\s*"), lambda u: u != "")
    low = lambda u: F.lower(u)
    fresh = F.filter(units(b), lambda u: ~F.array_contains(F.transform(units(a), low), F.lower(u)))
    return F.array_join(F.concat(units(a), fresh), ", ")


def _fits(u: Column, starts: tuple[str, ...], inside: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for s in starts:
        out = out | u.startswith(s)
    for s in inside:
        out = out | u.contains(s)
    return out


def unit_type(c: Column) -> Column:
    """CLN-20: apparatus type of a unit code."""
    u, out = F.upper(F.trim(c)), F
    for name, _, starts, inside in UNIT_TYPES:
        out = out.when(_fits(u, starts, inside), name)
    return out.otherwise("Apparatus")


def unit_class(c: Column) -> Column:
    """CLN-20: routing class; light types are tested before heavy ones, the rest is general."""
    u = F.upper(F.trim(c))
    light = [x for x in UNIT_TYPES if x[1] == "light"]
    out = F.when(_fits(u, tuple(s for x in light for s in x[2]), tuple(s for x in light for s in x[3])), "light")
    heavy = [x for x in UNIT_TYPES if x[1] == "heavy"]
    return out.when(_fits(u, tuple(s for x in heavy for s in x[2]), ("LADDER", "TOWER", "PLATFORM", "TENDER", "TANKER")), "heavy").otherwise("general")


def unit_hall(c: Column) -> Column:
    """CLN-20: home hall of a unit; hall 1 when nothing says otherwise."""
    u, out = F.upper(F.trim(c)), F
    for hall, starts in HOME_HALLS.items():
        out = out.when(u.rlike(f"^({starts})"), hall)
    n = F.regexp_extract(u, r"\d+", 0)
    return out.when(n.isin(*HALLS), n).otherwise("1")


def confidence(base: Column, lat: Column, lng: Column, units: Column, grid: Column, channel: Column, placeholder: Column) -> Column:
    """FN-06: struct(score, verify). Missing coordinates, units, grid and channel cost 30, 20, 15 and 15; below 90 asks for a check."""
    empty = lambda c: F.coalesce(F.lower(F.trim(c)).isin("", "none"), F.lit(True))
    none = units.isNull() | (F.size(units) == 0) | ((F.size(units) == 1) & (units[0] == "Unknown Unit"))
    cost = F.when(lat.isNull() | lng.isNull(), 30.0).otherwise(0.0) + F.when(none, 20.0).otherwise(0.0) + F.when(empty(grid), 15.0).otherwise(0.0) + F.when(empty(channel), 15.0).otherwise(0.0)
    score = F.when(placeholder, F.lit(100.0)).otherwise(F.greatest(F.lit(0.0), F.coalesce(base, F.lit(0.0)) - cost))
    return F.struct(score.alias("score"), (~placeholder & (score < 90)).alias("verify"))
