import pytest
from pyspark.sql import functions as F

from sparkloom.functions import json
from sparkloom.functions import scalars as S


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(("text", "limit", "wanted"), [(None, 10, ""), ("  a\x00b\x1f \n", 10, "ab"), ("abcdef", 3, "abc"), ("a\tb", 10, "a\tb"), ("\x7f", 5, "")])
def test_clean_text(spark, text, limit, wanted):
    assert one(spark, S.clean_text(F.lit(text).cast("string"), limit)) == wanted


def test_escape_markup_starts_with_the_ampersand(spark):
    assert one(spark, S.escape_markup(F.lit("<a href=\"x\">&'"))) == "&lt;a href=&quot;x&quot;&gt;&amp;&#39;"


@pytest.mark.parametrize(("text", "wanted"), [("a  b\n c", "a b c"), ("x" * 160, "x" * 160), (("word " * 40).strip(), ("word " * 31).strip() + "…"), (None, ""), ("", "")])
def test_trim_description(spark, text, wanted):
    assert one(spark, S.trim_description(F.lit(text).cast("string"))) == wanted


@pytest.mark.parametrize(("text", "wanted"), [("Hello, World!", "hello-world"), ("--A--", "a"), ("مرحبا", ""), ("a_b  c", "a-b-c"), (None, "")])
def test_slugify(spark, text, wanted):
    assert one(spark, S.slugify(F.lit(text).cast("string"))) == wanted


@pytest.mark.parametrize(("route", "wanted"), [("/", "/"), ("", "/"), (None, "/"), ("#/a/b/?q=1", "/a/b"), ("a//", "/a"), ("/a/b/c", "/a/b/c")])
def test_normalize_route(spark, route, wanted):
    assert one(spark, S.normalize_route(F.lit(route).cast("string"))) == wanted


def test_paths(spark):
    assert one(spark, S.localized_path(F.lit("en"), F.lit("/"))) == "en/"
    assert one(spark, S.canonical_url("https://x.org/", F.lit("ar"), F.lit("/a/b"))) == "https://x.org/ar/a/b/"
    assert one(spark, S.base_prefix(F.lit("/a/b"))) == "../../../"
    assert [one(spark, S.sitemap_priority(F.lit(r))) for r in ("/", "/a", "/a/b", "/a/b/c")] == ["1.0", "0.8", "0.7", "0.7"]
    assert [one(spark, S.change_frequency(F.lit(r))) for r in ("/", "/a")] == ["weekly", "monthly"]
    assert [one(spark, S.is_active(F.lit("/a/b"), F.lit(r))) for r in ("/", "/a", "/a/b", "/ab")] == [False, True, True, False]


def test_small_ones(spark):
    assert one(spark, S.initials(F.lit("- x-y z"))) == "XY"
    assert one(spark, S.title_base(F.lit("A | B | C"))) == "A"
    assert [one(spark, S.padded_ordinal(F.lit(n))) for n in (1, 12, 123)] == ["01", "12", "123"]
    assert one(spark, S.encode_component(F.lit("a b!'()~*&é"))) == "a%20b!'()~*%26%C3%A9"
    assert [one(spark, S.is_email(F.lit(x).cast("string"))) for x in ("a@b.c", "a@b", "a b@c.d", "a@b.c\n", None)] == [True, False, False, False, False]
    assert [one(spark, S.is_year(F.lit(x).cast("string"))) for x in ("1999", "199", "19999", "2024\n", None)] == [True, False, False, False, False]
    assert one(spark, S.first_filled(F.lit(""), F.lit(None).cast("string"), F.lit("x"))) == "x"
    assert one(spark, S.label(F.lit("a"), {"a": ""})) == "a"
    assert one(spark, S.first_match(F.lit("an old feature"), [("gone", ["Old Feature"])])) == "gone"
    assert one(spark, S.first_match(F.lit("Dealer review"), [("green", ["dealer"]), ("amber", ["review"])])) == "green"
    assert one(spark, S.reference_code(F.lit("Engine Build"), F.lit(7), 2024)).startswith("REF-ENG-2024-")


def test_template_is_filled_in_order(spark):
    values = F.create_map(F.lit("A"), F.lit("[{{B}}]"), F.lit("B"), F.lit("b"))
    assert one(spark, S.fill_template(F.lit("{{A}} {{B}} {{C}}"), values)) == "[b] b {{C}}"


def test_json_script_keeps_nulls_and_hides_markup(spark):
    assert one(spark, S.json_script(F.struct(F.lit("<x>").alias("a"), F.lit(None).cast("string").alias("b")))) == '{"a":"\\u003cx>","b":null}'


def test_sprite(spark):
    across, down = S.sprite_offsets(F.lit(12))
    assert (one(spark, across), one(spark, down)) == (25.0, pytest.approx(22.2222))


@pytest.mark.parametrize("route, wanted", [("/a/b?x=1?y", "en/a/b/?x=1?y"), ("?q", "en/?q"), (None, "en/"), ("/a#b", "en/a#b/")])
def test_localized_url_keeps_the_query(spark, route, wanted):
    assert one(spark, S.localized_url(F.lit("en"), F.lit(route).cast("string"))) == wanted


@pytest.mark.parametrize("text, wanted", [('[{"a":1}]', [1]), ("", []), (None, []), ("{broken", []), ('{"a":1}', []), ("[]", [])])
def test_parsed_or_fallback(spark, text, wanted):
    found = one(spark, S.parsed_or(F.lit(text).cast("string"), "array<struct<a:int>>", F.array().cast("array<struct<a:int>>")))
    assert [x.a for x in found] == wanted


@pytest.mark.parametrize("text, written, given", [
    ("0", "0", False), ("-0.0", "0", False), ("0e9", "0", False), ("2.0", "2", True), ("2.50", "2.5", True), ("0.000001", "0.000001", True), ("0.0000001", "1e-7", True), ("1e3", "1000", True), ("1e21", "1e+21", True),
    ("-0.5", "-0.5", True), ("123456789012345678", "123456789012345680", True), ("123456789.123456", "123456789.123456", True), ('[1,2.0,[3.5,null,"x"],{}]', "1,2,3.5,,x,[object Object]", True),
    ("[]", "", True), ("{}", "[object Object]", True), ("null", "", False), ("false", "false", False), ('"null"', "null", True), ('"0"', "0", True), ('""', "", False), ('" "', " ", True),
])
def test_values_are_written_and_taken_for_true_as_scripts_do(spark, text, written, given):
    value = F.parse_json("t")
    assert spark.createDataFrame([(text,)], "t string").select(json.text_of(value), json.is_truthy(value)).first()[:] == (written, given)
