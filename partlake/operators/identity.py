"""Whether two descriptions can be one kind of part: component types, part numbers, specific and generic words.

A description's profile is columns of sets, made once for each row; a verdict on a pair is set operations on two profiles.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col
#: Component types with the phrases that name them, and a type's parent.
TYPES = {
    "filter": ["FILTER", "FILTER ELEMENT", "FILTER CARTRIDGE"],
    "nozzle": ["NOZZLE", "SPRAY NOZZLE"],
    "sensor": ["SENSOR"],
    "proximity_sensor": ["PROXIMITY SENSOR", "PROXIMITY SWITCH", "PROXIMITY", "INDUCTIVE SENSOR"],
    "valve": ["VALVE"],
    "wrench": ["WRENCH", "SPANNER"],
    "bearing": ["BEARING"],
    "bolt": ["BOLT", "SCREW", "STUD"],
    "nut": ["NUT"],
    "seal": ["SEAL", "GASKET", "O-RING", "ORING"],
    "hose": ["HOSE"],
    "belt": ["BELT", "V-BELT"],
    "pump": ["PUMP"],
    "motor": ["MOTOR"],
    "gearbox": ["GEARBOX", "GEAR BOX"],
    "cable": ["CABLE"],
    "relay": ["RELAY"],
    "fuse": ["FUSE"],
    "contactor": ["CONTACTOR"],
    "coupling": ["COUPLING"],
    "chain": ["CHAIN"],
    "spring": ["SPRING"],
}
PARENTS = {"proximity_sensor": "sensor"}
#: Machines whose names hold a part's word, and words that say little.
CONTEXTS = ["FILTER PRESS", "PRESS FILTER"]
GENERIC = [
    "FILTER", "PRESS", "ASSY", "ASSEMBLY", "SPARE", "SPARES", "PART", "PARTS", "SET", "KIT", "STD", "STANDARD", "TYPE", "MODEL",
    "NEW", "GENUINE", "ORIGINAL", "ITEM", "FOR", "OF", "AND", "THE", "WITH", "TO", "IN", "ON", "NO", "NUMBER", "NOS", "PN", "P/N",
    "MAKE", "MAKER", "CODE", "ANDRITZ", "SKF", "FAG", "NSK", "SIEMENS", "ABB", "FLSMIDTH", "METSO", "SANDVIK", "GRUNDFOS",
]
#: Units of a specification, the least length of a part number, and the text similarity that is enough.
UNITS = ["MM", "CM", "M", "KW", "HP", "V", "A", "KV", "IN", "BAR", "MPA", "KPA", "PSI", "RPM", "HZ", "KG", "G", "L", "ML", "MICRON", "UM", "DEG", "NM", "MTR", "PCS"]
PART_NUMBER = 6
TEXT_FLOOR = 0.65

WORD = "[A-Z0-9]+(?:[-/.][A-Z0-9]+)*"
_UNIT = f"(?:{'|'.join(UNITS)})"
SPECIFICATION = rf"^(?:\d+(?:[.\-/]\d+)?{_UNIT}|\d+(?:\.\d+)?(?:X\d+(?:\.\d+)?)+{_UNIT}?|M\d+(?:X\d+(?:\.\d+)?)?)$"


def singular(word: Column) -> Column:
    """Plain words without a plural's ending; words with digits and short ones as they are."""
    plain = (F.length(word) > 3) & ~word.rlike("[0-9]")
    short = lambda n: F.substring(word, F.lit(1), F.length(word) - n)
    return F.when(plain & word.rlike("(?:CH|SH|X|SS|Z)ES$"), short(2)).when(plain & word.rlike("S$") & ~word.rlike("(?:SS|US|IS)$"), short(1)).otherwise(word)


def one(word: str) -> str:
    """``singular`` of a vocabulary word."""
    if len(word) <= 3 or re.search("[0-9]", word):
        return word
    if re.search("(?:CH|SH|X|SS|Z)ES$", word):
        return word[:-2]
    return word[:-1] if word.endswith("S") and not re.search("(?:SS|US|IS)$", word) else word


def compact(word: Column) -> Column:
    return F.regexp_replace(word, "[-/.]", "")


def is_part_number(word: Column) -> Column:
    """Long enough, with a digit, and not a measure or a thread."""
    return (F.length(compact(word)) >= PART_NUMBER) & word.rlike("[0-9]") & ~word.rlike(SPECIFICATION)


def phrases_of(names: dict[str, list[str]]) -> dict[str, str]:
    """Each phrase in singular words and what it names, longest first."""
    found = [(" ".join(map(one, re.findall(WORD, p))), name) for name, ps in names.items() for p in ps]
    return dict(sorted(found, key=lambda x: (-len(x[0].split()), x[1], x[0])))


def profile(text: Column) -> dict[str, Column]:
    """words, types, numbers, distinctive and generic of a description; empty sets of an unknown one.

    Machines' names are set aside first, then component phrases are found from left to right, longest first, none twice in
    the same words. Words that name the type are no evidence of their own.
    """
    words = F.coalesce(F.regexp_extract_all(F.upper(text), F.lit(WORD), 0), F.array().cast("array<string>"))
    line = F.concat(F.lit(" "), F.array_join(F.transform(words, singular), " "), F.lit(" "))
    for phrase in phrases_of({"": CONTEXTS}):
        line = F.regexp_replace(line, f"(?<= ){re.escape(phrase)}(?= )", phrase.replace(" ", "~"))
    kinds = phrases_of(TYPES)
    pattern = f"(?<= )(?:{'|'.join(map(re.escape, kinds))})(?= )"
    named = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])
    types = F.array_distinct(F.transform(F.regexp_extract_all(line, F.lit(pattern), 0), lambda p: named[p]))
    rest = F.filter(F.split(F.regexp_replace(line, pattern, " "), "[ ~]+"), lambda w: F.length(w) > 1)
    common = sorted({one(w) for term in GENERIC for w in [term, *re.findall(WORD, term)]} | set(GENERIC))
    return {
        "words": words,
        "types": types,
        "numbers": F.array_distinct(F.transform(F.filter(words, is_part_number), compact)),
        "distinctive": F.array_distinct(F.transform(F.filter(rest, lambda w: ~w.isin(common)), lambda w: F.when(is_part_number(w), compact(w)).otherwise(w))),
        "generic": F.array_distinct(F.filter(F.split(F.trim(F.translate(line, "~", " ")), " "), lambda w: w.isin(common))),
    }


def with_profile(rows: DataFrame, text: str, prefix: str) -> DataFrame:
    """Adds ``prefix`` + each part of the profile."""
    return rows.withColumns({f"{prefix}{name}": column for name, column in profile(c(text)).items()})


def related(types: Column) -> Column:
    """The types, their parents and their children."""
    pairs = [*PARENTS.items(), *((b, a) for a, b in PARENTS.items())]
    return F.array_union(types, F.array_compact(F.array(*[F.when(F.array_contains(types, a), b) for a, b in pairs])))


def verdict(same_group: Column, similarity: Column, floor: float = TEXT_FLOOR, group_floor: float | None = TEXT_FLOOR) -> Column:
    """The status of a pair with t_ and d_ profiles. Equal words count as text similarity 1 where it is unknown."""
    t, d = (lambda name: c(f"t_{name}")), (lambda name: c(f"d_{name}"))
    some = lambda x: F.size(x) > 0
    text = F.coalesce(similarity, F.when(some(t("words")) & (t("words") == d("words")), 1.0))
    both = some(t("types")) & some(d("types"))
    fit = both & F.arrays_overlap(related(t("types")), d("types"))
    specific = F.arrays_overlap(t("distinctive"), d("distinctive"))
    hollow = some(t("distinctive")) & some(d("distinctive")) & ~specific & F.arrays_overlap(t("generic"), d("generic"))
    near = F.coalesce(text >= (group_floor if group_floor is not None else 0.0), F.lit(False))
    in_group = (
        F.when(fit & (near | specific), "CONFIRMED_GROUP_COMPONENT_TYPE")
        .when(~fit & near & hollow, "INSUFFICIENT_GENERIC_OVERLAP")
        .when(~fit & near, "CONFIRMED_GROUP_TEXT")
        .otherwise("INSUFFICIENT_GROUP_ONLY")
    )
    return (
        F.when(both & ~fit, "REJECTED_COMPONENT_CONFLICT")
        .when(F.arrays_overlap(t("numbers"), d("numbers")), "CONFIRMED_PART_NUMBER")
        .when(F.coalesce(same_group, F.lit(False)), F.lit("CONFIRMED_GROUP_UNVERIFIED") if group_floor is None else in_group)
        .when(text.isNull(), "INSUFFICIENT_NO_TEXT")
        .when(text < floor, "INSUFFICIENT_TEXT")
        .otherwise("CONFIRMED_TEXT")
    )


def passed(status: Column) -> Column:
    return status.startswith("CONFIRMED")
