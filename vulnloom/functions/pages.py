"""Advisory-page columns: text, titles, sections, remediation tables."""

from functools import reduce

from pyspark.sql import Column, functions as F

from vulnloom import fixed_values as V
from vulnloom.functions import let

_BLANKS = " \t\r\n"
_ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]


def _cut(text, pattern, group=1):
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _strip(text):
    return F.btrim(text, F.lit(_BLANKS))


def _unescape(text):
    return reduce(lambda t, pair: F.replace(t, F.lit(pair[0]), F.lit(pair[1])), _ENTITIES, text)


def _lines(text):
    return F.filter(F.transform(F.split(text, "\n"), _strip), lambda x: x != "")


def html_to_text(html: Column) -> Column:
    """Visible text, one piece per line, without scripts, styles and page furniture."""
    text = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    text = F.regexp_replace(text, r"(?i)<!doctype[^>]*>", "")
    for tag in ("script", "style", "nav", "footer", "header"):
        text = F.regexp_replace(text, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "\n")
    text = _unescape(F.regexp_replace(text, r"(?s)<[^>]+>", "\n"))
    return F.array_join(_lines(text), "\n")


def is_error_page(text: Column, advisory_id: Column) -> Column:
    """Blocked, missing, very short or off-topic page."""
    head, low = F.lower(F.substring(text, 1, 2000)), F.lower(text)
    signature = reduce(lambda a, b: a | b, [F.contains(head, F.lit(s)) for s in V.ERROR_SIGNATURES])
    topic = reduce(lambda a, b: a | b, [F.contains(low, F.lit(k)) for k in V.ADVISORY_KEYWORDS])
    own_id = (advisory_id != "") & F.contains(low, F.lower(advisory_id))
    size = F.length(text)
    return F.coalesce((signature & (size < 3000)) | (size < 500) | ~(F.coalesce(own_id, F.lit(False)) | topic), F.lit(True))


def page_title(text: Column, advisory_id: Column) -> Column:
    """First of the first ten lines that looks like a title, else the first line."""
    fits = lambda x: (
        (F.length(x) > 15) & (F.length(x) < 300)
        & (F.contains(F.upper(x), F.lit("DSA")) | F.contains(x, F.lit("Dell")) | F.contains(x, F.lit("Security")))
    )
    picked = lambda lines: F.coalesce(
        F.get(F.filter(F.slice(lines, 1, 10), fits), F.lit(0)), F.substring(F.get(lines, F.lit(0)), 1, 200))
    return F.coalesce(let(_lines(text), picked), advisory_id)


def page_summary(text: Column) -> Column:
    """Summary section with blanks collapsed, else the page, 500 characters at most."""
    squeeze = lambda t: _strip(F.regexp_replace(t, r"\s+", " "))
    section = F.nullif(squeeze(_cut(text, V.SUMMARY_SECTION)), F.lit(""))
    return F.substring(F.coalesce(section, squeeze(text)), 1, 500)


def _cells(row):
    raw = F.regexp_extract_all(row, F.lit(r"(?is)<t[hd]\b[^>]*>(.*?)</t[hd]\s*>"), F.lit(1))
    return F.transform(raw, lambda c: _strip(_unescape(F.regexp_replace(c, r"(?s)<[^>]+>", ""))))


def _column_of(headers, groups):
    """Zero-based index of the first header that holds every word of one group, or null."""
    hit = lambda h: reduce(lambda a, b: a | b, [
        reduce(lambda a, b: a & b, [F.contains(h, F.lit(w)) for w in words]) for words in groups])
    flags = F.transform(headers, hit)
    return F.nullif(F.array_position(flags, True), F.lit(0).cast("bigint")).cast("int") - 1


def remediation_rows(html: Column) -> Column:
    """Array of (product, affected, remediated) from the first table with product rows."""
    tables = F.regexp_extract_all(html, F.lit(r"(?is)<table\b[^>]*>(.*?)</table\s*>"), F.lit(1))

    def rows_of(table):
        rows = F.transform(
            F.regexp_extract_all(table, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr\s*>"), F.lit(1)), _cells)
        return let(rows, lambda r: let(places(r), lambda p: named_rows(r, p)))

    def places(rows):
        headers = F.transform(F.get(rows, F.lit(0)), F.lower)
        product = _column_of(headers, [("product",)])
        affected = _column_of(headers, [("affected", "version"), ("vulnerable", "version"), ("version", "affected")])
        fixed = _column_of(headers, [
            ("remediat", "version"), ("fixed", "version"), ("patched", "version"), ("remediation",)])
        return F.struct(product.alias("product"), affected.alias("affected"), fixed.alias("fixed"))

    def named_rows(rows, at):
        product, affected, fixed = at["product"], at["affected"], at["fixed"]
        pick = lambda cells, i: F.coalesce(F.when(i.isNotNull(), F.get(cells, i)), F.lit(""))
        body = F.slice(rows, 2, F.greatest(F.size(rows), F.lit(1)))
        named = F.transform(body, lambda c: F.struct(
            pick(c, product).alias("product"), pick(c, affected).alias("affected"), pick(c, fixed).alias("remediated")))
        none = F.array().cast("array<struct<product:string,affected:string,remediated:string>>")
        return F.when(product.isNotNull() & (F.size(rows) > 1),
                      F.filter(named, lambda r: r["product"] != "")).otherwise(none)

    return F.get(F.filter(F.transform(tables, rows_of), lambda r: F.size(r) > 0), F.lit(0))


def remediation_rows_from_text(text: Column) -> Column:
    """The same rows read from plain text.

    Within the remediation section a product line opens a row; the first version line
    after it is the affected range, the last further one the remediated version.
    """
    section = _strip(_cut(text, V.REMEDIATION_SECTION))
    return let(_lines(section), lambda lines: let(_below_header(lines), _rows_of_lines))


def _below_header(lines: Column) -> Column:
    header = F.array_position(F.transform(lines, lambda x: x.rlike(V.TABLE_HEADER_LINE)), True).cast("int")
    return F.slice(lines, F.coalesce(header, F.lit(0)) + 1, F.greatest(F.size(lines), F.lit(1)))


def _rows_of_lines(body: Column) -> Column:
    known = lambda x: reduce(lambda a, b: a | b, [
        F.contains(F.lower(x), F.lit(k.lower())) for k in V.TABLE_PRODUCT_KEYWORDS])
    versioned = lambda x: x.rlike(V.VERSION_LINE)
    found = F.array_compact(F.transform(body, lambda x, i: F.when(known(x) & ~versioned(x), i + 1)))
    return let(found, lambda places: _rows_between(body, places, versioned))


def _rows_between(body: Column, places: Column, versioned) -> Column:
    ends = F.concat(F.slice(places, 2, F.greatest(F.size(places), F.lit(1))), F.array(F.size(body) + 1))

    def row(place, i):
        lines = F.filter(F.slice(body, place + 1, F.get(ends, i) - place - 1), versioned)
        return let(lines, lambda told: F.struct(
            F.get(body, place - 1).alias("product"), F.coalesce(F.get(told, F.lit(0)), F.lit("")).alias("affected"),
            F.when(F.size(told) > 1, F.element_at(told, -1)).otherwise("").alias("remediated")))

    return F.when(F.size(places) > 0, F.transform(places, row))


def solution_text(rows: Column) -> Column:
    """One line per remediation row that says anything about versions."""
    told = F.filter(rows, lambda r: (r["affected"] != "") | (r["remediated"] != ""))
    return F.array_join(F.transform(told, lambda r: F.concat(
        r["product"], F.lit(": "), r["affected"], F.lit(" -> "), r["remediated"])), "\n")


def keyword_products(text: Column) -> Column:
    """Vendor product families named anywhere in the text, in keyword order."""
    low = F.lower(text)
    return F.array_compact(F.array(*[
        F.when(F.contains(low, F.lit(k.lower())), F.lit(f"Dell {k}")) for k in V.TEXT_PRODUCT_KEYWORDS]))


def solution_sentence(text: Column) -> Column:
    """First sentence with the first solution keyword the text holds, else a stock sentence."""
    sentences = F.split(text, r"[.!?]")
    holds = lambda k: lambda s: F.contains(F.lower(s), F.lit(k))
    steps = [_strip(F.get(F.filter(sentences, holds(k)), F.lit(0))) for k in V.SOLUTION_KEYWORDS]
    return F.coalesce(*steps, F.lit(V.SOLUTION_DEFAULT))


def preview(text: Column, size: int = 200) -> Column:
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)


def escape_html(text: Column) -> Column:
    for mark, entity in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")]:
        text = F.replace(text, F.lit(mark), F.lit(entity))
    return text
