"""JSON that keeps its types: strict parsing, and values as web forms' scripts read them.

Values are variants. Repeated keys need the session setting that
``sources.session.json_settings`` makes: the last one counts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space that JSON allows around a value.
_SPACE = " \t\n\r"
_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"
#: Lists inside lists that are written out; what is deeper stays JSON.
_DEEPEST = 3


#: JSON of what scripts take for false, of whole numbers (the point and zeros go), and of fractions of at most 15 digits that they write the same way.
_FALSY, _WHOLE, _FRACTION = r'^(null|false|""|-?0(\.0+)?([eE][+-]?[0-9]+)?)\z', r"^(0|-?[1-9][0-9]{0,14})(\.0+)?\z", r"^-?(0|[1-9][0-9]{0,8})\.[0-9]{0,5}[1-9]\z"


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it stands there."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strict_json(text: Column) -> Column:
    """The text as a variant; null if it isn't one JSON value with nothing after it.

    A parser stops at the end of the first value, so the text is read as the
    one element of a list. Only a bracket in the text could close that list
    early; such a text must be readable as a member of an object as well.
    """
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    member = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    filled = F.btrim(text, F.lit(_SPACE)) != ""
    element = lambda v, n: F.try_variant_get(v, f"$[{n}]", "variant")
    single = _once(listed, lambda v: F.when(element(v, 1).isNull(), element(v, 0)))
    return F.when(filled & (~F.contains(text, F.lit("]")) | member.isNotNull()), single)


def is_object(text: Column) -> Column:
    """Whether strict JSON text is an object."""
    return F.startswith(F.ltrim(text, F.lit(_SPACE)), F.lit("{"))


def member(value: Column, path: str) -> Column:
    return F.try_variant_get(value, f"$.{path}", "variant")


def _plain_number(value: Column) -> Column:
    """A number as scripts write it: plain digits from 1e-6 to 1e21, no fraction if it is whole, a short exponent beyond."""
    double = F.try_variant_get(value, "$", "double")
    size = F.abs(double)
    digits = F.regexp_replace(double.try_cast("decimal(38,22)").cast("string"), r"0+\z", "")
    beyond = F.regexp_replace(F.regexp_replace(double.cast("string"), r"(\.0)?E([0-9])", "e+$2"), r"(\.0)?E-", "e-")
    return F.when((size < 1e21) & (double == F.rint(double)), double.try_cast("decimal(22,0)").cast("string")).when((size >= 1e-6) & (size < 1e15), digits).otherwise(beyond)


def text_of(value: Column, separator: str = ",", depth: int = _DEEPEST) -> Column:
    """A value as text: null and absent as nothing, lists joined (lists inside them by commas), objects as scripts show them.

    The first sign of its JSON, which is written once, tells its type.
    """
    if depth:
        listed = F.try_variant_get(value, "$", "array<variant>")
        joined = F.array_join(F.transform(listed, lambda x: text_of(x, ",", depth - 1)), separator)
    else:
        joined = F.to_json(value)
    begins = lambda j, sign: F.startswith(j, F.lit(sign))
    return _once(F.to_json(value), lambda j: (
        F.when(begins(j, '"'), F.try_variant_get(value, "$", "string")).when(j.isNull() | (j == "null"), "").when(begins(j, "t") | begins(j, "f"), j).when(F.rlike(j, F.lit(_WHOLE)), F.substring_index(j, ".", 1))
        .when(begins(j, "["), joined).when(begins(j, "{"), "[object Object]").when(F.rlike(j, F.lit(_FRACTION)), j).otherwise(_plain_number(value))
    ))


def is_truthy(value: Column) -> Column:
    """False for null, false, zero and the empty string, true for all else, empty lists and objects included."""
    return F.coalesce(~F.rlike(F.to_json(value), F.lit(_FALSY)), F.lit(False))


def number_of_text(text: Column) -> Column:
    """Text as a number: blank is 0, ``Infinity`` infinite, and what isn't a decimal number is null."""
    bare = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return (
        F.when(bare == "", 0.0).when(F.rlike(bare, F.lit(_NUMBER)), bare.try_cast("double"))
        .when(bare.isin("Infinity", "+Infinity"), float("inf")).when(bare == "-Infinity", float("-inf"))
    )


def number_of(value: Column, text: Column) -> Column:
    """A value, of which ``text`` is the text, as a number: what is falsy is 0, true is 1, and text counts as ``number_of_text`` says."""
    return F.when(~is_truthy(value), 0.0).when(F.to_json(value) == "true", 1.0).otherwise(number_of_text(text))


def with_members(rows: DataFrame, members: Column, name: str) -> DataFrame:
    """``rows`` with ``name``: the members of an object, given as a map, as a list of (key, value).

    Whole numbers come first, then the others as they stand; a repeated key
    stands where it stood first, with its last value. Each step is a projection
    of its own, so that none is computed once for every member.
    """
    number = lambda key: F.when(F.rlike(key, F.lit(r"^(0|[1-9][0-9]{0,8})\z")), key.cast("int"))
    rows = rows.withColumn("__entries", F.map_entries(members)).withColumn("__keys", F.transform("__entries", lambda e: e["key"])).withColumn("__own", F.array_distinct("__keys"))
    rows = rows.withColumn("__back", F.reverse("__keys")).withColumn("__behind", F.reverse("__entries"))
    last = F.transform("__own", lambda k: F.element_at("__behind", F.array_position("__back", k).cast("int")))
    rows = rows.withColumn("__once", F.when(F.size("__own") == F.size("__keys"), F.col("__entries")).otherwise(last))
    placed = F.transform("__own", lambda k, i: F.struct(F.coalesce(number(k), F.lit(1 << 30)).alias("n"), i.alias("i")))
    numbered = F.rlike(F.array_join("__own", "\n"), F.lit(r"(^|\n)[0-9]+(\n|\z)"))
    rows = rows.withColumn("__places", F.when(numbered, F.array_sort(placed)))
    sorted_ = F.transform("__places", lambda x: F.element_at("__once", (x["i"] + 1).cast("int")))
    return rows.withColumn(name, F.coalesce(sorted_, F.col("__once"))).drop("__entries", "__keys", "__own", "__back", "__behind", "__once", "__places")
