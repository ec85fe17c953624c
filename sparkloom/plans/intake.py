"""Submission and basket queries, with submissions derived from events."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import catalog
from ..operators import intake as O
from ..sources import sinks
from ..sources.session import shared_folder
from ..sources.tables import keyed_state, table
from ..streaming import intake as streaming
from ..streaming import outbox, state


def _submissions(spark, sf_dir: str) -> DataFrame:
    return _submissions_of(table(spark, sf_dir, "events"))


def _submissions_of(e: DataFrame) -> DataFrame:
    """One submission per event; the number in its properties decides what is wrong with it.

    Some bodies repeat a key, are followed by something else, have a list as
    website or the number 0 as message.
    """
    k = F.get_json_object("props", "$.k").cast("long")
    words = F.when(k % 53 == 0, "0").otherwise('"m"')
    fields = F.concat(F.lit('{"name":"user '), F.col("user_id"), F.lit('","phone":'), F.col("event_id"), F.lit('.5,"vehicle":"'), F.when(k % 7 == 0, "").otherwise("v"), F.lit('","'), F.when(k % 5 == 0, "modifications").otherwise("message"), F.lit('":'), words, F.lit("}"))
    kind = F.when(k % 11 == 0, "Anfrage").when(k % 2 == 0, F.concat(F.col("event_type"), F.lit(" Enquiry"))).otherwise("General Quote")
    website = F.when(k % 13 == 0, '"spam"').when(k % 17 == 0, '" "').when(k % 3 == 0, "[]").when(k % 3 == 1, "[null]").otherwise('""')
    body = F.concat(F.lit('{"ref":"old","ref":"R-'), F.col("event_id"), F.lit('","type":"'), kind, F.lit('","website":'), website, F.lit(',"startedAt":'), k * 100, F.lit(',"fields":'), fields, F.lit("}"))
    broken = F.when(k % 2 == 0, "{broken").when(k % 3 == 0, F.concat(body, F.lit(" junk"))).otherwise(F.concat(body, F.lit("] [")))
    return e.select(
        F.col("event_id").cast("string").alias("submission_id"), F.when(F.col("event_type") == "error", "GET").otherwise("POST").alias("method"), F.lit("www.example.org").alias("host"),
        F.when(k % 19 == 0, "https://other.example.org").when(k % 23 == 0, "nonsense").when(k % 3 == 0, "https://WWW.example.org/form").otherwise("").alias("origin"),
        F.when(k % 29 == 0, "32001").when(k % 31 == 0, "many").otherwise("32000").alias("content_length"),
        F.when(k % 37 == 0, broken).when(k % 41 == 0, "[1]").otherwise(body).alias("body"), "event_id", k.alias("k"), "event_type",
    )


def intake_decision(spark, sf_dir: str) -> DataFrame:
    decided = O.decide(_submissions(spark, sf_dir), F.lit(9000), F.col("k") % 4 != 1, F.col("k") % 10 != 3)
    return decided.select("event_id", "status", "code", "ref")


INTAKE_DECISION = r"""
WITH e AS (SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events), d AS (
  SELECT event_id, CASE WHEN event_type = 'error' THEN 1 WHEN k % 19 = 0 OR k % 23 = 0 THEN 2 WHEN k % 29 = 0 THEN 3 WHEN k % 37 = 0 THEN 4 WHEN k % 41 = 0 THEN 5 WHEN k % 13 = 0 THEN 6
       WHEN k <> 0 AND 9000 - k * 100 < 1200 THEN 7 WHEN k % 11 = 0 OR k % 7 = 0 OR k % 53 = 0 THEN 8 WHEN k % 4 = 1 THEN 9 WHEN k % 10 = 3 THEN 10 ELSE 11 END AS c FROM e)
SELECT event_id, CAST([405, 403, 413, 400, 400, 202, 429, 400, 503, 502, 200][c] AS INTEGER) AS status,
       ['method_not_allowed', 'origin_not_allowed', 'payload_too_large', 'invalid_json', 'invalid_payload', 'accepted', 'submission_too_fast', 'missing_or_invalid_required_fields', 'backend_not_configured', 'delivery_failed', 'accepted'][c] AS code,
       CASE WHEN c = 11 THEN 'R-' || event_id END AS ref
FROM d
"""


def field_rows(spark, sf_dir: str) -> DataFrame:
    """Fields of every type: a repeated name, a number as name, lists, text that looks like one, and what isn't given; some bodies are followed by something else."""
    kind, k = F.col("event_type"), F.get_json_object("props", "$.k")
    body = F.concat(
        F.lit('{"fields":{"type":"old","website":"x","empty":"","zero":0,"no":false,"none":null,"user":'), F.col("user_id"), F.lit(',"several":["a, b","'), kind, F.lit('",null,[1,2.0]],"looks":"[1, 2]","blank":[],"object":{"a":1},"yes":true,"type":"'),
        kind, F.lit('","7":'), k, F.lit("}}"), F.when(F.col("event_id") % 7 == 0, " junk").otherwise(" "),
    )
    return O.field_rows(table(spark, sf_dir, "events"), "event_id", body)


FIELD_ROWS = """
WITH e AS (SELECT event_id, event_type, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_id % 7 <> 0), r AS (
  SELECT event_id, unnest(list_filter([
    CASE WHEN k <> 0 THEN {'n': '7', 'v': CAST(k AS VARCHAR)} END, {'n': 'type', 'v': event_type}, CASE WHEN user_id <> 0 THEN {'n': 'user', 'v': CAST(user_id AS VARCHAR)} END,
    {'n': 'several', 'v': 'a, b, ' || event_type || ', , 1,2'}, {'n': 'looks', 'v': '[1, 2]'}, {'n': 'blank', 'v': ''}, {'n': 'object', 'v': '[object Object]'}, {'n': 'yes', 'v': 'true'}], lambda x: x IS NOT NULL)) AS x,
    k, user_id FROM e)
SELECT event_id, CAST(row_number() OVER (PARTITION BY event_id ORDER BY list_position(['7', 'type', 'user', 'several', 'looks', 'blank', 'object', 'yes'], x.n)) - 1 AS INTEGER) AS pos, x.n AS name, x.v AS value FROM r
"""


def merged_fields(spark, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "conversations").select("conv_id", F.col("role").alias("name"), F.when(F.col("turn") % 3 == 0, "").otherwise(F.col("text")).alias("value"), F.col("turn").alias("pos"))
    return O.merged_fields(entries, "conv_id").select("conv_id", "name", "pos", "value")


MERGED_FIELDS = r"""
WITH e AS (
  SELECT conv_id, role AS name, turn AS pos, CASE WHEN turn % 3 = 0 THEN '' ELSE left(trim(regexp_replace(coalesce(text, ''), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'), E' \t\n\x0b\x0c\r'), 3000) END AS v FROM conversations
), f AS (SELECT *, min(CASE WHEN v <> '' THEN pos END) OVER (PARTITION BY conv_id, name) AS first FROM e)
SELECT conv_id, name, min(pos) AS pos, coalesce(string_agg(v, ', ' ORDER BY pos, v) FILTER (pos >= first), '') AS value FROM f GROUP BY conv_id, name
"""


def attached_names(spark, sf_dir: str) -> DataFrame:
    """A user's events are the files of one form."""
    entries = table(spark, sf_dir, "events").select("user_id", F.when(F.col("event_type") == "error", "other").otherwise("files").alias("name"), F.concat("event_type", F.lit("-"), "event_id").alias("value"), F.col("event_id").alias("pos"))
    return O.attached_names(entries, "user_id").select("user_id", F.array_join("names", "|").alias("names"))


ATTACHED_NAMES = """
SELECT user_id, string_agg(event_type || '-' || event_id, '|' ORDER BY event_id) AS names FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events WHERE event_type <> 'error') WHERE r <= 15 GROUP BY user_id
"""


def form_fields(spark, sf_dir: str) -> DataFrame:
    """What forms send: a user's events as their entries and files, their page, and for quotes what the user chose."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    entries = e.select("user_id", F.when(k % 4 == 0, "files").when(k % 4 == 1, "context").otherwise("note").alias("name"), F.concat("event_type", F.lit(" "), "event_id").alias("value"), F.col("event_id").alias("pos"))
    user = F.col("user_id")
    forms = e.select("user_id").distinct().select("user_id", F.when(user % 2 == 0, "General Quote").otherwise("Workshop").alias("kind"), F.when(user % 3 == 0, "a page").alias("context"), F.when(user % 5 == 0, "").otherwise("p").alias("platform"))
    items = e.where(k < 20).select("user_id", F.col("event_type").alias("kind"), k.cast("string").alias("title"), F.lit("d").alias("details"), F.col("event_id").alias("pos"))
    return O.submitted_fields(entries, forms, items, "user_id", "user_id")


FORM_FIELDS = """
WITH e AS (SELECT user_id, event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events), u AS (SELECT DISTINCT user_id FROM events), r AS (
  SELECT user_id, CASE k % 4 WHEN 0 THEN 'files' WHEN 1 THEN 'context' ELSE 'note' END AS name, event_type || ' ' || event_id AS value, event_id AS pos FROM e), n AS (
  SELECT *, row_number() OVER (PARTITION BY user_id, name ORDER BY pos) AS nth FROM r)
SELECT user_id, name, CAST(nth AS INTEGER) AS nth, value FROM n WHERE name = 'note' OR (name = 'files' AND nth <= 15) OR (name = 'context' AND user_id % 3 <> 0)
UNION ALL SELECT user_id, 'context', 1, 'a page' FROM u WHERE user_id % 3 = 0
UNION ALL SELECT user_id, 'platform', 1, 'p' FROM u WHERE user_id % 5 <> 0
UNION ALL SELECT user_id, 'selectedItems', CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS INTEGER), event_type || ': ' || k || ' — d' FROM e WHERE k < 20 AND user_id % 2 = 0
"""


def hand_off_text(spark, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    fields = F.create_map(F.lit("name"), F.array(F.col("user_id").cast("string")), F.lit("files"), F.array(F.col("event_type"), F.col("event_type")), F.lit("none"), F.array(F.lit("")), F.lit("consent"), F.array(F.lit("yes")))
    text = S.message([F.lit("Request"), F.concat(F.lit("Reference: "), F.col("event_id"))], fields, {"name": "Name"}, "Please review.")
    return e.select("event_id", text.alias("message"), O.origin_host(F.concat(F.lit("https://u@H"), F.col("user_id"), F.lit(":80/x?y"))).alias("host"))


HAND_OFF_TEXT = r"""
SELECT event_id, 'Request' || chr(10) || 'Reference: ' || event_id || chr(10) || 'Name: ' || user_id || chr(10) || 'files: ' || event_type || ' | ' || event_type || chr(10) || chr(10) || 'Please review.' AS message, 'h' || user_id || ':80' AS host
FROM events
"""


def basket_first(spark, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("item", O.basket_key(F.col("event_type"), F.concat(F.lit("Item  "), F.get_json_object("props", "$.k"))))
    return catalog.keep_first(e, ["user_id", "item"], ["ts", "event_id"]).select("user_id", "item", "event_id", "value")


BASKET_FIRST = """
SELECT user_id, item, event_id, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, item ORDER BY ts, event_id) AS r FROM (SELECT *, event_type || '-item-' || json_extract_string(props, '$.k') AS item FROM events)
) WHERE r = 1
"""


def basket_state(spark, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("item", F.get_json_object("props", "$.k"))
    return O.basket(e, "user_id", "item", "event_id", F.when(F.col("event_type") == "error", "remove").otherwise("add"))


BASKET_STATE = """
WITH e AS (SELECT *, json_extract_string(props, '$.k') AS item FROM events), g AS (
  SELECT user_id, item, max(event_id) AS gone FROM e WHERE event_type = 'error' GROUP BY user_id, item)
SELECT e.user_id, e.item, min(event_id) AS added FROM e LEFT JOIN g ON e.user_id = g.user_id AND e.item = g.item
WHERE event_type <> 'error' AND (gone IS NULL OR event_id > gone) GROUP BY e.user_id, e.item
"""


def basket_written(spark, sf_dir: str) -> DataFrame:
    """The baskets as keyed state, written and read back."""
    folder = f"{shared_folder(spark)}/baskets-{uuid.uuid4().hex}"
    sinks.write_state(basket_state(spark, sf_dir), folder, ["user_id", "item"])
    return keyed_state(spark, folder, "added long")


def _arriving(spark, sf_dir: str) -> DataFrame:
    return spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")


def _run(stream: DataFrame, folder: str, batch) -> None:
    stream.writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(batch).start().awaitTermination()


def basket_streamed(spark, sf_dir: str) -> DataFrame:
    """The baskets that a stream over the events' files leaves: each batch is merged into the state's buckets."""
    changes = _arriving(spark, sf_dir).select("user_id", F.get_json_object("props", "$.k").alias("item"), "event_id", F.when(F.col("event_type") == "error", "remove").otherwise("add").alias("action"))
    folder = f"{shared_folder(spark)}/baskets-{uuid.uuid4().hex}"
    held = state.VersionedState(f"{folder}/state", ("user_id", "item"), "since long", 16)
    _run(changes, folder, lambda rows, number: state.merge_basket(held, rows, number, "user_id", "item", "event_id", "action"))
    return held.rows(spark, "user_id long, item string").withColumnRenamed("since", "added")


def outbox_attempts(spark, sf_dir: str) -> DataFrame:
    """What became of every accepted submission of a stream: answers of an endpoint that refuses some and is late for some, and hand-offs by mode."""
    decided = O.decide(_submissions_of(_arriving(spark, sf_dir)), F.lit(9000)).where("status = 200").select("submission_id", "k")
    folder = f"{shared_folder(spark)}/outbox-{uuid.uuid4().hex}"
    ledger = outbox.Outbox(f"{folder}/ledger")
    mode = F.when(F.col("k") % 3 == 0, "api").when(F.col("k") % 3 == 1, "auto").otherwise("whatsapp")
    send = lambda rows: rows.select("submission_id", F.when(F.col("k") % 10 == 3, 503).otherwise(200).alias("http"), F.when(F.col("k") % 8 == 0, 7001).otherwise(7000).alias("millis"))
    _run(decided, folder, lambda rows, number: ledger.deliver(rows, number, mode, send))
    return ledger.attempts(spark).select("submission_id", "attempt", "answer", "outcome")


OUTBOX_ATTEMPTS = f"""
WITH e AS (SELECT CAST(event_id AS VARCHAR) AS submission_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events), a AS (
  SELECT submission_id, k % 3 AS mode, CASE WHEN k % 3 = 2 THEN 'none' WHEN k % 8 = 0 THEN 'late' WHEN k % 10 = 3 THEN 'refused' ELSE 'ok' END AS answer FROM e
  WHERE NOT (event_type = 'error' OR k % 19 = 0 OR k % 23 = 0 OR k % 29 = 0 OR k % 37 = 0 OR k % 41 = 0 OR k % 13 = 0 OR (k <> 0 AND 9000 - k * 100 < 1200) OR k % 11 = 0 OR k % 7 = 0 OR k % 53 = 0))
SELECT submission_id, 1 AS attempt, answer, CASE WHEN mode = 0 THEN CASE WHEN answer = 'ok' THEN 'delivered' ELSE 'failed' END WHEN mode = 1 AND answer = 'ok' THEN 'delivered' ELSE 'handed_off' END AS outcome FROM a
"""


def parsed_props(spark, sf_dir: str) -> DataFrame:
    """Stored JSON, some of it broken, blank, of another type or followed by something else, with a fallback; some repeats its key."""
    kept = F.when(F.col("event_type") == "error", F.concat(F.lit("{"), "props")).when(F.col("event_id") % 5 == 0, F.concat("props", F.lit(" x"))).when(F.col("event_id") % 4 == 0, F.concat(F.lit('{"k":-5,'), F.substring("props", 2, 1000))).when(F.col("event_type") == "view", "").when(F.col("event_id") % 9 == 0, "[1]").otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", S.parsed_or(kept, "map<string,int>", F.create_map(F.lit("k"), F.lit(-1)))["k"].alias("k"))


PARSED_PROPS = """
SELECT event_id, CASE WHEN event_type = 'error' OR event_id % 5 = 0 OR event_id % 4 <> 0 AND (event_type = 'view' OR event_id % 9 = 0) THEN -1 ELSE CAST(json_extract_string(props, '$.k') AS INTEGER) END AS k FROM events
"""


def reference_codes(spark, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "click", "GM HP Tuners Online Tuning").when(F.col("event_type") == "view", "Engine Build Enquiry").when(F.col("event_type") == "error", "Brand / Parts Enquiry").otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", S.reference_code(kind, F.col("event_id"), 2024).alias("ref"))


REFERENCE_CODES = """
SELECT event_id, 'REF-' || CASE event_type WHEN 'click' THEN 'TUNE' WHEN 'view' THEN 'ENG' WHEN 'error' THEN 'PART' ELSE 'WEB' END || '-2024-' ||
       lpad(to_base(CAST('0x' || md5(CAST(event_id AS VARCHAR))[1:10] AS BIGINT), 36)[1:5], 5, '0') AS ref
FROM events
"""


def delivery_modes(spark, sf_dir: str) -> DataFrame:
    decided = O.decide(_submissions(spark, sf_dir), F.lit(9000), F.col("k") % 4 != 1, F.col("k") % 10 != 3)
    mode = F.when(F.col("k") % 3 == 0, "api").when(F.col("k") % 3 == 1, "auto").otherwise("whatsapp")
    return decided.groupBy(mode.alias("mode"), O.delivery(mode, F.col("status") == 200).alias("outcome")).agg(F.count("*").alias("n"))


DELIVERY_MODES = f"""
SELECT mode, CASE WHEN mode = 'api' THEN CASE WHEN status = 200 THEN 'delivered' ELSE 'failed' END WHEN mode = 'auto' AND status = 200 THEN 'delivered' ELSE 'handed_off' END AS outcome, count(*) AS n
FROM (SELECT d.*, ['api', 'auto', 'whatsapp'][CAST(json_extract_string(props, '$.k') AS BIGINT) % 3 + 1] AS mode FROM ({INTAKE_DECISION}) d JOIN events ON d.event_id = events.event_id) GROUP BY 1, 2
"""


def streamed_decisions(spark, sf_dir: str) -> DataFrame:
    """The decisions of a stream over the events' files, delivered batch by batch to a table and read back."""
    events = table(spark, sf_dir, "events")
    arriving = spark.readStream.schema(events.schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    decided = O.decide(_submissions_of(arriving), F.lit(9000), F.col("k") % 4 != 1, F.col("k") % 10 != 3).select("event_id", "status", "code", "ref")
    folder = f"{shared_folder(spark)}/decisions-{uuid.uuid4().hex}"
    query = streaming.deliver(decided, f"{folder}/out", f"{folder}/checkpoint")
    query.awaitTermination()
    return spark.read.option("basePath", f"{folder}/out").schema("event_id long, code string, ref string, status int").parquet(f"{folder}/out/batch=*").select("event_id", "status", "code", "ref")


QUERIES = {
    "delivery_modes": (delivery_modes, DELIVERY_MODES),
    "streamed_decisions": (streamed_decisions, INTAKE_DECISION),
    "intake_decision": (intake_decision, INTAKE_DECISION),
    "field_rows": (field_rows, FIELD_ROWS),
    "attached_names": (attached_names, ATTACHED_NAMES),
    "form_fields": (form_fields, FORM_FIELDS),
    "merged_fields": (merged_fields, MERGED_FIELDS),
    "hand_off_text": (hand_off_text, HAND_OFF_TEXT),
    "basket_first": (basket_first, BASKET_FIRST),
    "basket_state": (basket_state, BASKET_STATE),
    "basket_written": (basket_written, BASKET_STATE),
    "basket_streamed": (basket_streamed, BASKET_STATE),
    "outbox_attempts": (outbox_attempts, OUTBOX_ATTEMPTS),
    "parsed_props": (parsed_props, PARSED_PROPS),
    "reference_codes": (reference_codes, REFERENCE_CODES),
}
