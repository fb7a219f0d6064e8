"""Version and firmware columns."""

import re
from functools import reduce

from pyspark.sql import Column, functions as F

from vulnloom import fixed_values as V
from vulnloom.functions import let
from vulnloom.functions.names import in_product_line

_BLANKS = " \t\r\n"


def _cut(text, pattern, group=1):
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _strip(text):
    return F.btrim(text, F.lit(_BLANKS))


def _any(tests):
    return reduce(lambda a, b: a | b, tests)


def _all_of(text, pattern, group=1):
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _plain_word(pattern):
    """The first plain word of a pattern, lower-cased, without which no text can match; None if it has none."""
    found = re.search("[A-Za-z]{2,}", re.sub(r"\\[bsdw]|\[.*?\]|\(\?i\)|\w\?", " ", pattern))
    return found and found.group(0).lower()


def _where(low, words, found):
    """``found`` where the lower-cased text holds one of the words, else nothing; the pattern behind it is not tried in vain."""
    return F.when(_any([F.contains(low, F.lit(w)) for w in words]), found) if words else found


def models(text: Column) -> Column:
    """Distinct hardware models in pattern order, in their display form."""
    return let(F.lower(text), lambda low: _models(text, low))


def _models(text, low):
    found = []
    for pattern in V.MODEL_PATTERNS:
        word = _plain_word(pattern)
        hits = _where(low, [word] if word else [], _all_of(text, "(?i)" + pattern))
        if "iDRAC" in pattern:
            found.append(F.transform(hits, lambda m: F.concat(F.lit("iDRAC"), m)))
        elif r"\d" in pattern:
            found.append(F.transform(hits, F.upper))
        elif "XPS" in pattern:
            found.append(F.transform(hits, F.upper))
        else:
            found.append(F.transform(hits, lambda m: F.initcap(F.lower(m))))
    return F.array_distinct(F.coalesce(F.flatten(F.array_compact(F.array(*found))), F.array().cast("array<string>")))


def firmware_type(text: Column) -> Column:
    low = F.lower(text)
    has = lambda word: F.contains(low, F.lit(word))
    return (
        F.when(has("onefs") | has("operating environment") | low.rlike(r"\boe\b"), "OS")
        .when(has("bios"), "BIOS").when(has("idrac"), "iDRAC")
        .when(has("firmware") | low.rlike(r"\bfw\b"), "Firmware").otherwise("Software")
    )


def is_valid_version(version: Column, kind: Column) -> Column:
    """Enough dotted parts for the firmware type, and a major part of 1 or more."""
    parts = F.split(version, r"\.")
    needed = F.when(kind.isin(V.THREE_PART_TYPES), 3).otherwise(2)
    major = F.get(parts, F.lit(0)).try_cast("int")
    return F.coalesce((F.size(parts) >= needed) & (major >= 1), F.lit(False))


def version_tuple(version: Column) -> Column:
    """Integer array that compares like a version; a part that is no number counts as 0."""
    return F.transform(F.split(version, r"\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(0)))


def padded_tuple(version: Column, width) -> Column:
    """Version array padded with zeros to ``width`` parts, so 9.8 equals 9.8.0.0; longer ones stay whole."""
    parts = version_tuple(version)
    return F.concat(parts, F.array_repeat(F.lit(0), F.greatest(F.lit(width) - F.size(parts), F.lit(0))))


def compared(left: Column, right: Column) -> Column:
    """-1, 0 or 1: order of two versions, both padded to the longer one."""
    def padded(a, b):
        width = F.greatest(F.size(F.split(left, r"\.")), F.size(F.split(right, r"\.")))
        x, y = padded_tuple(a, width), padded_tuple(b, width)
        return F.when(x < y, -1).when(x > y, 1).otherwise(0)
    return F.when(left.isNotNull() & right.isNotNull(), padded(left, right))


def anchors(text: Column, kind: Column) -> Column:
    """Array of (qualifier, version) found in advisory text.

    A closed range gives a lower and an upper bound.  Plain versions count only when no
    bound is written.  A hardware type without any usable version gets ``unversioned``.
    """
    return let(F.lower(text), lambda low: _anchors(text, low, kind))


#: Words of which one occurs in every text that a bound's pattern matches, a row for each pattern.
_RANGE_WORDS = [["to"], ["between"], ["from"]]
_LOWER_WORDS = [["and"], ["onward"], ["or"]]
_UPPER_WORDS = [["prior"], ["before", "earlier"], ["and"]]


def _anchors(text, low, kind):
    def tag(mark):
        return lambda v: F.struct(F.lit(mark).alias("qualifier"), v.alias("version"))

    pieces = []
    for pattern, words in zip(V.RANGE_PATTERNS, _RANGE_WORDS, strict=True):
        pairs = F.arrays_zip(_all_of(text, pattern, 1).alias("low"), _all_of(text, pattern, 2).alias("high"))
        ordered = F.filter(pairs, lambda p: version_tuple(p["high"]) >= version_tuple(p["low"]))
        pieces.append(_where(low, words, F.flatten(F.transform(ordered, lambda p: F.array(tag(">=")(p["low"]), tag("<=")(p["high"]))))))
    for pattern, words in zip(V.LOWER_BOUND_PATTERNS, _LOWER_WORDS, strict=True):
        pieces.append(_where(low, words, F.transform(_all_of(text, pattern), tag(">="))))
    for (pattern, mark), words in zip(V.UPPER_BOUND_PATTERNS, _UPPER_WORDS, strict=True):
        pieces.append(_where(low, words, F.transform(_all_of(text, pattern), tag(mark))))
    bounds = F.flatten(F.array_compact(F.array(*pieces)))
    plain = F.transform(_all_of(text, V.VERSION_TOKEN), tag(""))
    usable = lambda found: F.array_distinct(F.filter(found, lambda a: is_valid_version(a["version"], kind)))
    chosen = let(bounds, lambda b: usable(F.when(F.size(b) > 0, b).otherwise(plain)))
    unversioned = F.array(tag("")(F.lit("unversioned")))
    return let(chosen, lambda valid: F.when(
        (F.size(valid) == 0) & kind.isin(V.UNVERSIONED_TYPES), unversioned).otherwise(valid))


def is_noise_entry(text: Column) -> Column:
    low = F.lower(_strip(text))
    noise = (
        (F.length(_strip(text)) < 4)
        | _any([low.startswith(p) for p in V.ENTRY_NOISE_PREFIXES])
        | _any([F.contains(low, F.lit(k)) for k in V.ENTRY_NOISE_KEYWORDS])
        | low.rlike(V.ENTRY_NOISE_NUMERIC)
    )
    return F.coalesce(noise, F.lit(True))


def is_generic_name(name: Column) -> Column:
    low = F.lower(_strip(name))
    return F.coalesce(~low.rlike(V.KNOWN_NAME_WORDS) | low.rlike(V.GENERIC_NAME_PATTERN), F.lit(True))


def split_entry(raw: Column) -> Column:
    """Struct (product, version, qualifier) of an affected-product entry."""
    text = _strip(raw)
    for prefix in V.ENTRY_PREFIXES:
        text = F.regexp_replace(text, prefix, "")
    return let(text, _split_clean_entry)


def _split_clean_entry(text: Column) -> Column:
    def as_struct(product, version, qualifier):
        return F.struct(_strip(product).alias("product"), _strip(version).alias("version"),
                        F.lit(qualifier).alias("qualifier"))

    steps = []
    for pattern, mark in V.ENTRY_QUALIFIER_PATTERNS:
        product = _cut(text, pattern, 1)
        steps.append(F.when(product.isNotNull(), as_struct(product, F.regexp_extract(text, pattern, 2), mark)))
    product = _cut(text, V.ENTRY_SPLIT, 1)
    steps.append(F.when(F.length(_strip(product)) >= 3,
                        as_struct(product, F.regexp_extract(text, V.ENTRY_SPLIT, 2), "")))
    return F.coalesce(*steps, as_struct(text, F.lit(""), ""))


def canonical_name(name: Column) -> Column:
    text = _strip(name)
    known = [F.when(text.rlike("(?i)" + p), F.lit(canonical)) for p, canonical in V.CANONICAL_NAMES]
    rest = F.regexp_replace(F.regexp_replace(text, r"^\*\s+", ""), r"^-\s+", "")
    return F.coalesce(*known, rest)


def version_type(name: Column, version: Column) -> Column:
    text = F.lower(F.concat_ws(" ", name, version))
    has = lambda word: F.contains(text, F.lit(word))
    return (
        F.when(has("bios"), "SOFTWARE").when(has("firmware") | has(" fw "), "FIRMWARE")
        .when(has("idrac"), "HARDWARE")
        .when(text.rlike(V.SERVER_MODEL) & has("poweredge"), "HARDWARE").otherwise("SOFTWARE")
    )


def default_product_name(line: Column) -> Column:
    """Product name implied by a line label."""
    head = F.trim(F.substring_index(F.trim(F.substring_index(line, "(", 1)), "/", 1))
    return F.when(F.lower(head).startswith("dell"), head).otherwise(F.concat(F.lit("Dell "), head))


def _no_versions():
    return F.array().cast(
        "array<struct<product_name:string,version_type:string,version_number:string,"
        "qualifier:string,confidence:double>>")


def entry_versions(raw: Column, line: Column) -> Column:
    """At most one version struct from an entry, if it is a product of the line."""
    return let(split_entry(raw), lambda parts: let(
        canonical_name(parts["product"]), lambda name: _entry_version(raw, line, parts, name)))


def _entry_version(raw, line, parts, name) -> Column:
    keep = (
        ~is_noise_entry(raw) & (parts["version"] != "") & ~is_generic_name(parts["product"])
        & (F.length(name) >= 3) & in_product_line(name, line)
    )
    found = F.struct(
        name.alias("product_name"), version_type(name, parts["version"]).alias("version_type"),
        parts["version"].alias("version_number"), parts["qualifier"].alias("qualifier"),
        F.lit(0.95).alias("confidence"),
    )
    return F.when(keep, F.array(found)).otherwise(_no_versions())


def text_versions(text: Column, line: Column) -> Column:
    """Version structs from free text, accepted patterns only, first hit per number."""
    name = default_product_name(line)

    def describe(kind, confidence):
        return lambda v: F.struct(
            name.alias("product_name"), F.lit(kind).alias("version_type"), v.alias("version_number"),
            F.lit("").alias("qualifier"), F.lit(confidence).alias("confidence"))

    pieces = [
        F.transform(_all_of(text, "(?i)" + pattern), describe(kind, confidence))
        for pattern, kind, confidence in V.TEXT_VERSION_PATTERNS if confidence >= 0.90
    ]
    numbers = lambda found: F.transform(found, lambda v: v["version_number"])
    first = let(F.concat(*pieces), lambda found: F.filter(
        found, lambda v, i: F.array_position(numbers(found), v["version_number"]) == i + 1))
    keep = ~is_noise_entry(text) & in_product_line(name, line)
    return F.when(keep, first).otherwise(_no_versions())


def version_key(line: Column, name: Column, number: Column) -> Column:
    return F.concat_ws("::", line, name, number)


def split_version_key(key: Column) -> Column:
    """Struct (line, product, version); a key without exactly three parts is UNKNOWN."""
    parts = F.split(key, "::")
    part = lambda i: F.when(F.size(parts) == 3, F.get(parts, F.lit(i))).otherwise("UNKNOWN")
    return F.struct(part(0).alias("product_line"), part(1).alias("product_name"), part(2).alias("version_number"))


def in_range(version: Column, written: Column) -> Column:
    """Whether a version lies in a written range; an unreadable range gives false."""
    low = F.lower(written)
    start, end = _cut(low, V.CLOSED_RANGE, 1), _cut(low, V.CLOSED_RANGE, 2)
    below = _cut(low, V.STRICT_UPPER)
    upto = F.coalesce(_cut(low, V.INCLUSIVE_UPPER, 1), _cut(low, V.INCLUSIVE_UPPER, 2))
    numbers = _all_of(low, V.ANY_VERSION)
    test = (
        F.when(start.isNotNull(), (compared(version, start) >= 0) & (compared(version, end) <= 0))
        .when(below.isNotNull(), compared(version, below) < 0)
        .when(upto.isNotNull(), compared(version, upto) <= 0)
        .when(F.size(numbers) == 1, compared(version, F.get(numbers, F.lit(0))) <= 0)
    )
    return F.coalesce(test, F.lit(False))
