"""Line dedup: winnowed line hashes whose matches grow into repeated runs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import spans
from .repeats import Units, remove_repeats

#: Consecutive lines of the shortest run that goes, and lines of a hashed gram.
RUN, GRAM = 3, 2


def _lines(data, offsets):
    """Runs of bytes between line feeds that hold more than blanks."""
    begin, end, text = spans.split(data, offsets, spans.LINE_SEPARATORS)
    inside = np.ones(256, bool)
    inside[list(spans.WORD_SEPARATORS)] = False
    held = np.r_[0, np.cumsum(inside[data])]
    full = held[end] > held[begin]
    return begin[full], end[full], text[full]


def _kept_lines(data, offsets, begin, end, text, gone):
    """Texts without their gone lines; a line goes with what stands between it and the next one."""
    edge = np.zeros(len(data) + 1, np.int32)
    last = np.r_[text[1:] != text[:-1], True] if len(text) else np.zeros(0, bool)
    until = np.r_[begin[1:], len(data)] if len(text) else end
    until = np.where(last, offsets[1:][text], until)
    np.add.at(edge, begin[gone], 1)
    np.add.at(edge, until[gone], -1)
    stays = np.cumsum(edge[:-1]) == 0
    for at in np.flatnonzero(last & gone):  # the line feed that a text's last kept line had
        low = offsets[text[at]]
        left = np.flatnonzero(stays[low : begin[at]])
        if len(left) and data[low + left[-1]] == 0x0A:
            stays[low + left[-1]] = False
    return data[stays], np.r_[0, np.cumsum(stays)][offsets]


def remove_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, passage_words: int = 0) -> DataFrame:
    """``docs`` without lines that repeat an earlier run of ``run`` or more lines.

    Winnowing: of each ``run`` consecutive lines the least gram hash is the
    fingerprint, so equal runs always share one. The places of a fingerprint
    are joined, and each match grows from it both ways: to the ``run`` lines on
    either side that hold it, which are compared by 128 bits, and on from there
    for as long as neighbouring ones match the same earlier place in step
    (``repeats.matches``). Of matches that overlap those that reach farthest
    are taken (``repeats.factors``), and their lines go. The first copy, in the
    order of id and place, stays, and a line goes if a window of ``run`` lines
    that covers it stands at an earlier place as well. With ``passage_words``,
    a shorter run is such a window too if it holds at least so many words: a
    long passage may stand on one or two lines.

    A line is what stands between line feeds; blank lines don't count and go
    with the line before them. ``text`` is rewritten, ``n_lines`` and
    ``n_removed`` follow (replacing input columns of these names; all other
    columns stay as they are). Null texts have no lines and come out empty.
    Every row is a document of its own, so of rows that repeat an id and a text
    one keeps its lines. Null ids, and ids that are no integers, come after all
    others; rows of one id follow each other as they are read. A very long text
    is one block of its own (see ``remove_repeats`` for its memory); an empty
    table gives an empty one.
    """
    units = Units(_lines, run, max(1, run - 1) , keep_first=True, also=tuple((width, passage_words) for width in range(1, run)) if passage_words else ())
    return remove_repeats(docs, units, _kept_lines, id_col, text_col, ("n_lines", "n_removed"))


def op5_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeated_lines(docs).select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH raw AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS k FROM documents
), lines AS (
  SELECT doc_id, k, line, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) AS BIGINT) AS i FROM raw WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), windows AS (
  SELECT doc_id, i, line AS a, lead(line, 1) OVER w AS b, lead(line, 2) OVER w AS c FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), later AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, i) AS r FROM windows WHERE c IS NOT NULL) WHERE r > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2]) AS i FROM later
), marked AS (
  SELECT raw.doc_id, raw.k, raw.line, lines.i, gone.i IS NOT NULL AS out
  FROM raw LEFT JOIN lines ON raw.doc_id = lines.doc_id AND raw.k = lines.k
  LEFT JOIN gone ON gone.doc_id = lines.doc_id AND gone.i = lines.i
), filled AS (
  SELECT *, coalesce(last_value(CASE WHEN i IS NOT NULL THEN out END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY k), false) AS cut FROM marked
)
SELECT doc_id, CAST(count(i) AS BIGINT) AS n_lines, CAST(count_if(out) AS BIGINT) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT cut), '')) AS kept_sha256
FROM filled GROUP BY doc_id
"""
