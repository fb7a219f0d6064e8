"""Product-name columns: cleaning, noise tests, product lines, title extraction."""

import re
from functools import reduce

from pyspark.sql import Column, functions as F

from vulnloom import fixed_values as V
from vulnloom.functions import let

_NAME_EDGES = " ,.;:-—"
_BLANKS = " \t\r\n"


def _cut(text, pattern, group=1):
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _strip(text):
    return F.btrim(text, F.lit(_BLANKS))


def _any(tests):
    return reduce(lambda a, b: a | b, tests)


def normalize_name(name: Column) -> Column:
    return F.btrim(F.regexp_replace(F.coalesce(name, F.lit("")), r"\s+", " "), F.lit(_NAME_EDGES))


def is_valid_name(name: Column) -> Column:
    low = F.lower(name)
    bad = (
        (F.length(name) > 80) | (F.length(name) < 2) | low.isin(V.NAME_REJECT_EXACT)
        | _any([name.startswith(p) for p in V.NAME_REJECT_PREFIXES])
        | _any([F.contains(low, F.lit(s.lower())) for s in V.NAME_REJECT_SUBSTRINGS])
        | ~name.rlike("[A-Za-z]")
    )
    return F.coalesce(~bad, F.lit(False))


def is_invalid_title_name(name: Column) -> Column:
    bad = (
        (F.length(name) < 2) | (F.length(name) > 150) | name.isin(V.TITLE_NAME_INVALID_EXACT)
        | _any([F.contains(name, F.lit(s)) for s in V.TITLE_NAME_INVALID_SUBSTRINGS])
    )
    return F.coalesce(bad, F.lit(True))


def is_noise_product(name: Column) -> Column:
    words = F.size(F.filter(F.split(name, r"\s+"), lambda w: w != ""))
    noise = (
        (name == "") | F.lower(_strip(name)).isin(V.PRODUCT_NOISE_PHRASES)
        | (name.rlike(V.NOISE_PREFIX) & (words <= 3))
    )
    return F.coalesce(noise, F.lit(True))


def recover_product(name: Column, title: Column) -> Column:
    """The name itself, or for a noise phrase the product named in the title, or null."""
    head = F.get(F.split(title, V.TITLE_STOP_WORDS, 2), F.lit(0))
    recovered = let(_strip(_cut(head, V.TITLE_RECOVER, 0)), lambda found: F.when(~is_noise_product(found), found))
    return F.when(is_noise_product(name), recovered).otherwise(name)


def title_product(title: Column) -> Column:
    """The vendor phrase of a title, cleaned, or null."""
    return let(normalize_name(_cut(title, V.TITLE_VENDOR_PHRASE)), lambda found: F.when(is_valid_name(found), found))


def products_of_advisory(affected: Column, title: Column) -> Column:
    """Sorted distinct product names: structured entries first, else the title phrase."""
    def entry_name(item):
        raw = F.coalesce(F.nullif(item["name"], F.lit("")), item["model"], F.lit(""))
        checked = lambda name: F.when(is_valid_name(name), let(
            recover_product(name, title), lambda kept: F.when(is_valid_name(kept), kept)))
        return let(normalize_name(raw), checked)

    none = F.array().cast("array<string>")
    named = F.coalesce(F.array_sort(F.array_distinct(F.array_compact(F.transform(affected, entry_name)))), none)
    from_title = lambda: F.array_compact(F.array(title_product(title)))
    return let(named, lambda listed: F.when(F.size(listed) > 0, listed).otherwise(from_title()))


def products_from_title(title: Column) -> Column:
    """Products named by a title, through the ordered title patterns."""
    return let(F.regexp_replace(title, V.TITLE_ID_PREFIX, ""), _products_of_clean_title)


def _products_of_clean_title(clean: Column) -> Column:
    none = F.array().cast("array<string>")

    def step(found, give):
        return let(found, lambda x: F.when(x.isNotNull(), give(x)))

    one = lambda text: F.array(_strip(text))

    def parts(text, separator, shortest):
        pieces = F.transform(F.split(text, separator), _strip)
        return F.filter(pieces, lambda p: F.length(p) >= shortest)

    def head(word):
        piece = _strip(F.get(F.split(clean, word), F.lit(0)))
        return F.when(F.contains(clean, F.lit(word)) & (piece != ""), F.array(piece))

    last = F.when(F.contains(clean, F.lit("Dell")), F.coalesce(head(" for "), head(" Security"), head(" Multiple"), none))
    joined_by = lambda word, separator, shortest: lambda x: F.when(
        F.contains(x, F.lit(word)), parts(x, separator, shortest)).otherwise(F.array(x))
    return F.coalesce(
        step(_cut(clean, V.TITLE_VULN_EMC), one), step(_cut(clean, V.TITLE_VULN_DELL), one),
        step(_strip(_cut(clean, V.TITLE_UPDATE_FOR)), joined_by(" and ", " and ", 1)),
        step(_strip(_cut(clean, V.TITLE_BEFORE_UPDATE)), joined_by(",", ",", 4)),
        step(_cut(clean, V.TITLE_UPDATE_DELL), one), step(_cut(clean, V.TITLE_UPDATE_ADVISORY), one), last, none)


def _joined(patterns):
    return "(?i)" + "|".join(f"(?:{p})" for p in patterns)


def _word(pattern):
    """The first plain word of a pattern, lower-cased: text without it cannot match."""
    return re.search("[A-Za-z0-9]{2,}", re.sub(r"\\[bsd]|\(\?<!\w+\)|\w\?", " ", pattern)).group(0).lower()


_LINE_WORDS = {name: sorted({_word(p) for p in patterns}) for name, patterns in V.PRODUCT_LINES.items()}


def product_lines(text: Column) -> Column:
    """Every product line whose patterns occur in the text, in the fixed order.

    One projection without join or UDF.  A pattern runs only on text that holds its word.
    """
    def hits(low):
        return F.array_compact(F.array(*[
            F.when(_any([F.contains(low, F.lit(w)) for w in _LINE_WORDS[name]]) & text.rlike(_joined(p)), F.lit(name))
            for name, p in V.PRODUCT_LINES.items()]))

    return F.coalesce(let(F.lower(text), hits), F.array().cast("array<string>"))


def in_product_line(text: Column, line: Column) -> Column:
    """Whether the text matches the patterns of the line held by another column."""
    test = F.lit(False)
    for name, patterns in V.PRODUCT_LINES.items():
        test = F.when(line == name, text.rlike(_joined(patterns))).otherwise(test)
    return F.coalesce(test, F.lit(False))


def resolve_line(name: Column, title: Column) -> Column:
    """One product line: aliases on the name, then patterns on the name, then on the title."""
    alias = F.coalesce(*[F.when(name.rlike("(?i)" + p), F.lit(line)) for p, line in V.PRODUCT_ALIASES])
    first = lambda text: F.get(product_lines(text), F.lit(0))
    return F.when(name != "", F.coalesce(alias, first(name), first(F.concat_ws("\n", title, name))))


def series_name(name: Column) -> Column:
    """The name without list bullets and without trailing dotted versions."""
    text = F.regexp_replace(_strip(name), V.LEADING_BULLET, "")
    return _strip(F.regexp_replace(text, "(?:" + V.TRAILING_VERSION + r")+$", ""))


def anchor(text: Column) -> Column:
    """Link anchor: letters, digits and CJK kept, everything else one dash."""
    dashed = F.regexp_replace(F.lower(text), r"[^\w一-鿿]+", "-")
    return F.btrim(F.regexp_replace(dashed, "-+", "-"), F.lit("-"))
