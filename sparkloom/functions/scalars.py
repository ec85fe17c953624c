"""Scalar functions as Column expressions; none needs a Python UDF.

Blank means null, or the empty string where said: web forms don't tell the two
apart. White space is ASCII white space. Lengths count code points.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .json import strict_json

#: C0 controls other than tab, line feed and carriage return, and delete.
CONTROLS = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
_CONTROL_CHARACTERS = "".join(map(chr, [*range(9), 0x0B, 0x0C, *range(0x0E, 0x20), 0x7F]))
_BLANKS = " \t\n\x0b\x0c\r"
#: The entities that markup must write for these characters, ampersand first.
ENTITIES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"))


def first_filled(*columns: Column) -> Column:
    """The first argument that is neither null nor empty, else null."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns))


def clean_text(text: Column, limit: int = 3000) -> Column:
    """Text without control characters and outer white space, cut to ``limit``; null becomes empty."""
    kept = F.translate(F.coalesce(text, F.lit("")), _CONTROL_CHARACTERS, "")
    return F.substring(F.btrim(kept, F.lit(_BLANKS)), 1, limit)


def escape_markup(text: Column) -> Column:
    """Text with the five markup characters written as entities."""
    for character, entity in ENTITIES:
        text = F.replace(text, F.lit(character), F.lit(entity))
    return text


def collapse_space(text: Column) -> Column:
    """Runs of white space as one space, without outer ones; null becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def trim_description(text: Column, limit: int = 160) -> Column:
    """Collapsed text of at most ``limit`` characters: longer ones lose the word that the cut falls into and end in an ellipsis."""
    flat = collapse_space(text)
    cut = F.regexp_replace(F.substring(flat, 1, limit - 3), r"\s+\S*$", "")
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(cut, F.lit("…")))


def slugify(text: Column) -> Column:
    """Lower-case ASCII letters and digits joined by hyphens; other scripts leave nothing."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def initials(text: Column, n: int = 2) -> Column:
    """The first ``n`` ASCII letters or digits in upper case."""
    return F.upper(F.substring(F.regexp_replace(text, "[^A-Za-z0-9]", ""), 1, n))


def title_base(title: Column) -> Column:
    """A page title without what follows the first `` |``."""
    return F.regexp_replace(title, r"(?s) \|.*$", "")


def normalize_route(route: Column) -> Column:
    """A route with one leading slash, without leading hash marks, query and outer slashes."""
    bare = F.split_part(F.regexp_replace(F.coalesce(route, F.lit("")), "^#+", ""), F.lit("?"), F.lit(1))
    return F.concat(F.lit("/"), F.regexp_replace(bare, "^/+|/+$", ""))


def localized_path(locale: Column, route: Column) -> Column:
    """``locale/`` followed by the route's segments, each with a slash."""
    bare = F.substring(normalize_route(route), 2, 1 << 30)
    return F.concat(locale, F.lit("/"), F.when(bare == "", "").otherwise(F.concat(bare, F.lit("/"))))


def canonical_url(site: str, locale: Column, route: Column) -> Column:
    """The localized path on a site (a base url that ends in a slash)."""
    return F.concat(F.lit(site), localized_path(locale, route))


def localized_url(locale: Column, route: Column) -> Column:
    """The localized path followed by the route's own query, from its first question mark on."""
    return F.concat(localized_path(locale, route), F.regexp_extract(F.coalesce(route, F.lit("")), r"(?s)(\?.*)$", 1))


def parsed_or(text: Column, schema: str, fallback: Column) -> Column:
    """JSON text as a value of a type, or ``fallback`` where it is null, empty, broken or of another type."""
    return F.coalesce(F.try_variant_get(strict_json(text), "$", schema), fallback)


def segments(route: Column) -> Column:
    """The route's parts that aren't empty."""
    return F.filter(F.split(route, "/"), lambda x: x != "")


def depth(route: Column) -> Column:
    return F.size(segments(route))


def base_prefix(route: Column) -> Column:
    """The way up from a localized page to the site's root."""
    return F.repeat(F.lit("../"), depth(route) + 1)


def sitemap_priority(route: Column) -> Column:
    """1.0 for the root, 0.8 one level below, 0.7 deeper."""
    return F.when(depth(route) == 0, "1.0").when(depth(route) == 1, "0.8").otherwise("0.7")


def change_frequency(route: Column) -> Column:
    """The root changes weekly, other pages monthly."""
    return F.when(depth(route) == 0, "weekly").otherwise("monthly")


def is_active(current: Column, route: Column) -> Column:
    """Whether a menu's route is the current page or lies above it; the root is active only as itself."""
    return (current == route) | ((route != "/") & F.startswith(current, F.concat(route, F.lit("/"))))


def padded_ordinal(position: Column) -> Column:
    """A position with at least two digits; longer numbers stay whole."""
    return F.format_string("%02d", position)


def encode_component(text: Column) -> Column:
    """Percent-encoding for one component of a url: spaces as %20, and ``!'()~`` left as they are."""
    out = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    for code, character in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(character))
    return out


def is_email(text: Column) -> Column:
    return F.coalesce(F.rlike(text, F.lit(r"^\S+@\S+\.\S+\z")), F.lit(False))


def is_year(text: Column) -> Column:
    return F.coalesce(F.rlike(text, F.lit(r"^[0-9]{4}\z")), F.lit(False))


def first_match(text: Column, cases: Sequence[tuple[str, Sequence[str]]], default: str | None = "") -> Column:
    """The name of the first case that has a term which the text contains, whatever its letters' case."""
    low, out = F.lower(text), None
    for name, terms in cases:
        hit = None
        for term in terms:
            found = low.contains(term.lower())
            hit = found if hit is None else hit | found
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def label(code: Column, labels: Mapping[str, str]) -> Column:
    """The code's label, or the code itself where it has none or an empty one."""
    if not labels:
        return code
    table = F.create_map(*(F.lit(x) for pair in labels.items() for x in pair))
    return first_filled(F.try_element_at(table, code), code)


def reference_code(kind: Column, key: Column, year: int, brand: str = "REF") -> Column:
    """A reference with a prefix for the kind, the year, and five characters that the key determines."""
    prefix = F.when(kind.contains("Tuning"), "TUNE").when(kind.contains("Engine"), "ENG").when(kind.contains("Parts"), "PART").otherwise("WEB")
    code = F.substring(F.conv(F.substring(F.md5(key.cast("string")), 1, 10), 16, 36), 1, 5)
    return F.concat_ws("-", F.lit(brand), prefix, F.lit(str(year)), F.lpad(code, 5, "0"))


def message(lines: Sequence[Column], fields: Column, labels: Mapping[str, str], last: str, skip: Sequence[str] = ("consent",)) -> Column:
    """Text of a hand-off: head lines, one ``label: value`` for each filled field, a blank line and a last one.

    ``fields`` maps names to lists of values, which are joined by `` | ``.
    """
    filled = F.filter(F.map_entries(fields), lambda e: ~e["key"].isin(*skip) & (F.array_join(e["value"], "") != ""))
    rows = F.transform(filled, lambda e: F.concat(label(e["key"], labels), F.lit(": "), F.array_join(e["value"], " | ")))
    return F.array_join(F.concat(F.array(*lines), rows, F.array(F.lit(""), F.lit(last))), "\n")


def fill_template(template: Column, values: Column) -> Column:
    """A template with every ``{{NAME}}`` replaced by its value from a map, entry by entry: a value that holds a later name is filled too."""
    return F.aggregate(F.map_entries(values), template, lambda text, e: F.replace(text, F.concat(F.lit("{{"), e["key"], F.lit("}}")), e["value"]))


def json_script(value: Column) -> Column:
    """A struct as JSON that is safe inside a script element; nulls are written."""
    return F.replace(F.to_json(value, {"ignoreNullFields": "false"}), F.lit("<"), F.lit("\\u003c"))


def sprite_offsets(position: Column, columns: int = 5, rows: int = 10) -> tuple[Column, Column]:
    """Percentages across and down at which a numbered tile (from 1) of a sheet lies."""
    at = position - 1
    return F.round((at % columns) / (columns - 1) * 100, 4), F.round(F.floor(at / columns) / (rows - 1) * 100, 4)


def item_href(kind: Column, folder: str, special: Mapping[str, str]) -> Column:
    """The page of an item by its slug: one of its own for the special ones, else ``/folder/slug``."""
    out = F.concat(F.lit(f"/{folder}/"), kind)
    for slug, page in special.items():
        out = F.when(kind == slug, F.lit(page)).otherwise(out)
    return out
