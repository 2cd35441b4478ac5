"""Names and free text as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Trailing type words of a place's own name.
TYPE_WORDS = ("privy", "campsite", "shelter", "shelters", "group")
#: Eight compass points.
POINTS = ("north", "northeast", "east", "southeast", "south", "southwest", "west", "northwest")
#: Tags of springs and other water.
WATER_TAGS = (("natural", "spring", "spring"), ("amenity", "drinking_water", "tap"), ("man_made", "water_well", "well"))


def normal_name(name: Column) -> Column:
    """Lower case, everything but letters and digits as one blank; '' for null."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9]+", " "))


def base_name(name: Column) -> Column:
    """The normal name without trailing type words and numbers, however many."""
    return F.trim(F.regexp_replace(normal_name(name), r"((^| )(" + "|".join(TYPE_WORDS) + r"|[0-9]+))+$", ""))


def structure_name(name: Column, short: dict[str, str], generic: tuple[str, ...]) -> Column:
    """What tells one structure from another: apostrophes closed up, short forms written out, generic words dropped."""
    flat = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(name), "&", " and "), "['’]", ""), "[^a-z0-9]+", " ")
    long = F.create_map(*[F.lit(x) for kv in short.items() for x in kv])
    words = F.transform(F.split(F.trim(flat), " "), lambda w: F.coalesce(long[w], w))
    return F.array_join(F.filter(words, lambda w: ~w.isin(*generic)), " ")


def names_agree(a: Column, b: Column) -> Column:
    """Equal in normal form, or one inside the other; an empty name agrees with nothing."""
    x, y = normal_name(a), normal_name(b)
    return (x != "") & (y != "") & ((x == y) | F.contains(x, y) | F.contains(y, x))


def capacity(raw: Column) -> Column:
    """Struct (value, reason), exactly one set: a number, 'ns/mc' (shelter and campsite), or 'n+m' and 'no/mn' with equal halves; else why not."""
    v = F.lower(F.trim(raw))
    plain_number = F.regexp_extract(v, r"^([0-9]+)$", 1)
    split = F.regexp_extract(v, r"^([0-9]+)\s*s\s*/\s*[0-9]+\s*c$", 1)
    two = r"^([0-9]+)\s*(?:\+\s*([0-9]+)|o\s*/\s*([0-9]+)\s*n)$"
    a, b = F.regexp_extract(v, two, 1), F.concat(F.regexp_extract(v, two, 2), F.regexp_extract(v, two, 3))
    number = F.when(plain_number != "", plain_number.cast("int"))
    both = F.when((a != "") & (a.cast("int") == b.cast("int")), a.cast("int"))
    value = F.coalesce(F.when(number > 0, number), F.when(split != "", split.cast("int")), both)
    reason = F.when(value.isNotNull(), F.lit(None).cast("string")).when(number == 0, F.lit("zero")).when(a != "", F.lit("two structures")).otherwise(F.lit("no number"))
    return F.struct(value.alias("value"), reason.alias("reason"))


def mile_query(text: Column) -> Column:
    """The mile of a query such as 'mile 123.4', 'mi 7' or '123.4'; null for anything else."""
    found = F.regexp_extract(F.trim(text), r"(?i)^(?:mile|mi)?\s*([0-9]+(?:\.[0-9]+)?)$", 1)
    return F.when(found != "", found.cast("double"))


def strip_html(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, "<[^>]*>", " "), r"\s+", " "))


def sentences_without(text: Column, pattern: str) -> Column:
    """The sentences of a note that don't match a pattern, joined; null if none is left."""
    kept = F.array_join(F.filter(F.split(F.trim(text), r"(?<=[.!?])\s+"), lambda s: ~s.rlike(pattern)), " ")
    return F.when(kept != "", kept)


def joined(items: Column) -> Column:
    """'a', 'a and b', 'a, b and c'; null for none."""
    n = F.size(items)
    most = F.array_join(F.slice(items, 1, F.greatest(n - 1, F.lit(1))), ", ")
    return F.when(n == 1, F.get(items, F.lit(0))).when(n > 1, F.concat(most, F.lit(" and "), F.element_at(items, -1)))


def arc_middle(left: Column, right: Column) -> Column:
    """Middle bearing of the arc from left to right; no arc if both are 0; equal bearings are a full turn."""
    arc = F.pmod(right - left, F.lit(360))
    full = F.when(arc == 0, F.lit(360)).otherwise(arc)
    return F.when((left == 0) & (right == 0), F.lit(None).cast("double")).otherwise(F.pmod(left + full / 2, F.lit(360.0)))


def compass(bearing: Column) -> Column:
    """Nearest of the eight points."""
    return F.get(F.array(*map(F.lit, POINTS)), (F.floor(F.pmod(bearing, F.lit(360)) / 45.0 + 0.5) % 8).cast("int"))


def licence_allowed(licence: Column) -> Column:
    """Public domain, or attribution licences (share-alike or not) from version 4 on."""
    v = F.lower(F.trim(licence))
    version = F.regexp_extract(v, r"^cc-by(-sa)?-([0-9]+(?:\.[0-9]+)?)$", 2)
    return F.coalesce((v == "cc0") | v.rlike(r"^pd(-|$)") | F.when(version != "", version.cast("double") >= 4).otherwise(F.lit(False)), F.lit(False))


def classified(tags: list[tuple[Column, str, str]]) -> Column:
    """The class of the first matching tag."""
    return F.coalesce(*[F.when(col == value, F.lit(name)) for col, value, name in tags])


def mapped(value: Column, known: dict[str, str], deferred: tuple[str, ...]) -> Column:
    """Struct (value, state): mapped, deferred (kept back knowingly) or unmapped."""
    look = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    out = look[value]
    return F.struct(out.alias("value"), F.when(out.isNotNull(), F.lit("mapped")).when(value.isin(*deferred), F.lit("deferred")).otherwise(F.lit("unmapped")).alias("state"))


def decoded(value: Column, domain: dict[str, str], aliases: dict[str, str]) -> Column:
    """A coded value from its code, its label or an alias; null if it is none of them."""
    v = F.lower(F.trim(value.cast("string")))
    code = F.create_map(*[F.lit(x) for k, name in domain.items() for x in (k.lower(), k)])
    label = F.create_map(*[F.lit(x) for k, name in domain.items() for x in (name.lower(), k)])
    other = F.create_map(*[F.lit(x) for k, name in aliases.items() for x in (k.lower(), name)])
    return F.coalesce(code[v], label[v], other[v])


def digest_key(content: Column, length: int = 32) -> Column:
    return F.concat(F.lit("sha256-"), F.substring(F.sha2(content, 256), 1, length))


def surrogate_key(*parts: Column) -> Column:
    """md5 over the parts; a null part is told apart from an empty one."""
    return F.md5(F.concat_ws("-", *[F.coalesce(p.cast("string"), F.lit("_null_")) for p in parts]))
