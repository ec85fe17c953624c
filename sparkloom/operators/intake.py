"""Form submissions: cleansing, an ordered decision, fields as rows, and a keyed basket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import json
from ..functions.scalars import clean_text
from ..sources.session import json_settings

#: Limits of the intake.
MOST_BYTES, LEAST_MILLISECONDS, MOST_FIELDS, MOST_NAMES = 32_000, 1200, 80, 15
#: Request types that are taken, beside those of the pattern.
TYPES = (
    "Website Enquiry", "General Enquiry", "General Quote", "Workshop Consultation", "Online Tuning Compatibility Review",
    "Engine Build Enquiry", "Parts Enquiry", "Brand / Parts Enquiry", "Project Consultation", "Technical Enquiry",
    "MHD Online Tuning", "Porsche COBB Online Tuning", "GM HP Tuners Online Tuning",
)
TYPE_PATTERN = r"^[A-Za-z0-9/&+.,() -]{2,100} Enquiry\z"
#: Fields that don't belong to the answers.
RESERVED = ("website", "startedAt")

#: Fixed value: the kind of form that sends its owner's chosen items.
QUOTE = "General Quote"

#: Columns of a submission; ``body`` is the raw text, so that broken JSON stays a case.
SUBMISSION = T.StructType([T.StructField(n, T.StringType()) for n in ("submission_id", "method", "host", "origin", "content_length", "body")])


def valid_type(kind: Column) -> Column:
    return F.coalesce(kind.isin(*TYPES) | F.rlike(kind, F.lit(TYPE_PATTERN)), F.lit(False))


def origin_host(origin: Column) -> Column:
    """Host and port of an absolute url in lower case; null if it can't be read as one."""
    return F.nullif(F.lower(F.regexp_extract(origin, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@\s]*@)?([^/?#\s]+)(?:[/?#]\S*)?$", 1)), F.lit(""))


def decide(submissions: DataFrame, now_ms: Column, configured: Column | None = None, delivered: Column | None = None) -> DataFrame:
    """``submissions`` with ``status``, ``code`` and, where the form was taken and delivered, its ``ref``: the first condition that holds decides.

    ``now_ms`` is an argument, so that a decision can be repeated; ``configured``
    and ``delivered`` tell whether a backend is there and whether it took the
    form (both true if left out). Text that isn't a number never passes a
    comparison of numbers.

    The body must be one JSON value and nothing after it; of a repeated key the
    last counts. Its values keep their types: null, false, 0 and the empty
    string aren't given where a field gives way to the next; an empty list is
    blank, but is given. The body is parsed once, in a projection below the
    decision.
    """
    json_settings(submissions.sparkSession)
    text = F.coalesce(F.nullif(F.col("body"), F.lit("")), F.lit("{}"))
    parsed = submissions.withColumns({
        "__body": json.strict_json(text), "__object": json.is_object(text), "__sent": clean_text(F.col("origin"), 500), "__asked": F.lower(clean_text(F.col("host"), 255)),
        "__ok": F.lit(True) if configured is None else configured, "__done": F.lit(True) if delivered is None else delivered,
    })
    names = ("website", "startedAt", "ref", "type", *(f"fields.{n}" for n in ("name", "phone", "vehicle", "message", "modifications", "engineDetails")))
    parsed = parsed.withColumn("__values", F.array(*(json.member(F.col("__body"), n) for n in names)))
    parsed = parsed.withColumn("__texts", F.transform("__values", lambda v: json.text_of(v)))  # one expression for all values
    text_at = {n.rpartition(".")[2]: F.col("__texts")[i] for i, n in enumerate(names)}
    words = F.when(json.is_truthy(F.col("__values")[7]), text_at["message"]).when(json.is_truthy(F.col("__values")[8]), text_at["modifications"]).otherwise(text_at["engineDetails"])
    parsed = parsed.withColumns({
        "__origin": origin_host(F.col("__sent")), "__started": json.number_of(F.col("__values")[1], text_at["startedAt"]), "__ref": clean_text(text_at["ref"], 80), "__words": words,
        **{f"__{n}": text_at[n] for n in ("website", "type", "name", "phone", "vehicle")},
    })
    started = F.coalesce(F.col("__started"), F.lit(0.0))
    given = lambda name, limit: clean_text(F.col(name), limit) != ""
    filled = (F.col("__ref") != "") & valid_type(clean_text(F.col("__type"), 120)) & given("__name", 200) & given("__phone", 200) & given("__vehicle", 300) & given("__words", 3000)
    other = F.col("__origin").isNull() | ((F.col("__asked") != "") & (F.col("__origin") != F.col("__asked")))
    steps = [
        (F.coalesce(F.col("method") != "POST", F.lit(True)), 405, "method_not_allowed"),
        ((F.col("__sent") != "") & other, 403, "origin_not_allowed"),
        (F.coalesce(json.number_of_text(F.col("content_length")), F.lit(0.0)) > MOST_BYTES, 413, "payload_too_large"),
        (F.col("__body").isNull(), 400, "invalid_json"),
        (~F.col("__object"), 400, "invalid_payload"),
        (given("__website", 120), 202, "accepted"),
        ((started != 0) & (now_ms - started < LEAST_MILLISECONDS), 429, "submission_too_fast"),
        (~F.coalesce(filled, F.lit(False)), 400, "missing_or_invalid_required_fields"),
        (~F.col("__ok"), 503, "backend_not_configured"),
        (~F.coalesce("__done", F.lit(False)), 502, "delivery_failed"),
    ]
    out = None
    for holds, status, code in steps:
        value = F.struct(F.lit(status).alias("status"), F.lit(code).alias("code"))
        out = F.when(holds, value) if out is None else out.when(holds, value)
    decided = parsed.withColumn("__out", out.otherwise(F.struct(F.lit(200).alias("status"), F.lit("accepted").alias("code"))))
    # a list of one, so that a filter on the decision isn't moved below it and doesn't repeat it for every condition
    whole = F.explode(F.array(F.struct("__out.status", "__out.code", F.when(F.col("__out.status") == 200, F.col("__ref")).alias("ref")))).alias("__whole")
    return decided.select(*(F.col(f"`{c}`") for c in submissions.columns), whole).select(*(F.col(f"`{c}`") for c in submissions.columns), "__whole.*")


def delivery(mode: Column, api_ok: Column) -> Column:
    """What becomes of a form: ``delivered`` by the endpoint, ``handed_off`` as a message, or ``failed``.

    Fixed values: mode ``api`` never hands off, ``auto`` does if the endpoint
    fails, any other mode always does.
    """
    delivered = F.coalesce(api_ok, F.lit(False))
    return F.when(mode == "api", F.when(delivered, "delivered").otherwise("failed")).when((mode == "auto") & delivered, "delivered").otherwise("handed_off")


def merged_fields(entries: DataFrame, key: str, pos: str = "pos") -> DataFrame:
    """Form entries (key, name, value, pos) as one row per name: cleaned values in order, joined.

    A blank first value gives way to the next one; a blank that follows a
    filled value is kept in its place.
    """
    pairs = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("pos"), clean_text(F.col("value")).alias("value"))))
    values = F.transform(pairs, lambda x: x["value"])
    first = F.coalesce(F.array_position(F.transform(values, lambda v: v != ""), F.lit(True)), F.lit(0)).cast("int")
    kept = F.when(first > 0, F.slice(values, first, F.greatest(F.size(values) - first + 1, F.lit(0)))).otherwise(F.array().cast("array<string>"))
    rows = entries.where(~F.col("name").isin("files", *RESERVED)).groupBy(key, "name").agg(F.min(pos).alias("pos"), kept.alias("values"))
    return rows.withColumn("value", F.array_join("values", ", "))


def _first_files(entries: DataFrame, key: str, pos: str) -> DataFrame:
    """The first ``MOST_NAMES`` attached files of each form, kept so by each task before they meet."""
    files = entries.where((F.col("name") == "files") & (F.coalesce("value", F.lit("")) != "")).select(key, F.col(pos).alias("pos"), clean_text(F.col("value")).alias("value"))
    nth = F.row_number().over(Window.partitionBy(key).orderBy("pos", "value"))
    return files.withColumn("nth", nth).where(F.col("nth") <= MOST_NAMES)


def attached_names(entries: DataFrame, key: str, pos: str = "pos") -> DataFrame:
    """``names``: of each form the first ``MOST_NAMES`` names of attached files, in order."""
    pairs = F.array_sort(F.collect_list(F.struct("nth", "value")))
    return _first_files(entries, key, pos).groupBy(key).agg(F.transform(pairs, lambda x: x["value"]).alias("names"))


def submitted_fields(entries: DataFrame, forms: DataFrame, items: DataFrame, key: str, owner: str, pos: str = "pos") -> DataFrame:
    """``key``, ``name``, ``nth``, ``value``: all that a form sends, an element of a list a row.

    Its entries as ``merged_fields`` has them, the names of its first attached
    files, and what the form adds: ``context`` and ``platform`` where ``forms``
    (key, kind, context, platform, owner) has them, and for a quote its owner's
    chosen ``items`` (owner, kind, title, details, pos) as ``selectedItems``. A
    field that the form adds replaces an entry of its name. Elements stay rows,
    so that no owner's items meet in one list.
    """
    given = lambda name: forms.where(F.coalesce(name, F.lit("")) != "").select(key, F.lit(name).alias("name"), F.lit(1).alias("nth"), F.col(name).alias("value"))
    named = merged_fields(entries, key, pos).select(key, "name", F.posexplode("values").alias("at", "value")).select(key, "name", (F.col("at") + 1).alias("nth"), "value")
    files = _first_files(entries, key, pos).select(key, F.lit("files").alias("name"), "nth", "value")
    quotes = forms.where(F.col("kind") == QUOTE).select(key, owner)
    line = F.concat(F.col("kind"), F.lit(": "), F.col("title"), F.lit(" — "), F.col("details"))
    chosen = items.select(owner, line.alias("value"), F.row_number().over(Window.partitionBy(owner).orderBy(pos)).alias("nth"))
    picked = quotes.join(chosen, owner).select(key, F.lit("selectedItems").alias("name"), "nth", "value")
    added = files.unionByName(given("context")).unionByName(given("platform")).unionByName(picked)
    return named.join(added.select(key, "name").distinct(), [key, "name"], "left_anti").select(key, "name", "nth", "value").unionByName(added)


def field_rows(submissions: DataFrame, key: str, body: Column) -> DataFrame:
    """``key``, ``pos``, ``name``, ``value``: the fields of a submission's body, in its order, that are given and not reserved, at most eighty.

    ``body`` is JSON text whose member ``fields`` is an object; else there are
    no rows. Values keep their types until they are written out: a list is
    joined by commas and blanks, and text that only looks like a list stays as
    it is. Null, false, 0 and the empty string aren't given; an empty list is,
    and is blank. Whole numbers as names come first, of a repeated name the
    last value counts.
    """
    json_settings(submissions.sparkSession)
    text = submissions.select(F.col(key), body.alias("__body"))
    read = F.from_json(F.when(json.strict_json(F.col("__body")).isNotNull(), F.col("__body")), "fields map<string,variant>")
    rows = json.with_members(text.select(key, read.alias("__read")), F.col("__read.fields"), "__members")
    kept = F.filter("__members", lambda e: ~e["key"].isin(*RESERVED) & json.is_truthy(e["value"]))
    rows = rows.select(key, F.posexplode(F.slice(kept, 1, MOST_FIELDS)).alias("pos", "e"))
    return rows.select(key, "pos", clean_text(F.col("e.key"), 80).alias("name"), clean_text(json.text_of(F.col("e.value"), ", ")).alias("value"))


def basket_key(kind: Column, title: Column) -> Column:
    """``kind-title`` in lower case with white space as hyphens."""
    return F.regexp_replace(F.lower(F.concat_ws("-", kind, title)), r"\s+", "-")


def basket(changes: DataFrame, owner: str, item: str, order: str, action: Column) -> DataFrame:
    """What each owner's basket holds after all changes: inserting what is there changes nothing, removing it takes it out.

    An item is in if its last change puts it in; its place is that of the
    first insertion after the last removal.
    """
    changes = changes.withColumn("__out", action == "remove")
    last = Window.partitionBy(owner, item)
    gone = F.max(F.when(F.col("__out"), F.col(order))).over(last)
    live = changes.withColumn("__gone", gone).where(~F.col("__out") & (F.col("__gone").isNull() | (F.col(order) > F.col("__gone"))))
    return live.groupBy(owner, item).agg(F.min(order).alias("added"))
