"""Substring dedup: relative Lempel-Ziv factors against every reference block."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import spans
from .repeats import Units, remove_repeats

#: Words of the shortest factor that counts, and words of an indexed gram.
WINDOW, GRAM = 35, 18


def _kept_words(data, offsets, begin, end, text, gone):
    """Kept words joined by one space: the byte after a kept word is a separator and turns into it."""
    kept = np.flatnonzero(~gone)
    edge = np.zeros(len(data) + 1, np.int32)
    edge[begin[kept]] += 1
    edge[end[kept]] -= 1
    stays = np.cumsum(edge[:-1]) > 0
    follows = kept[:-1][text[kept[:-1]] == text[kept[1:]]]
    data = data.copy()
    data[end[follows]] = 0x20
    stays[end[follows]] = True
    return data[stays], np.r_[0, np.cumsum(stays)][offsets]


def remove_repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with every word removed that a repeated window of ``window`` words covers.

    Relative Lempel-Ziv: the index of all blocks tells of every window of
    ``window`` words that stands elsewhere, its own block included, one such
    place. Windows that go on in step with their places are a match. Each block
    is parsed from left to right into factors: of the matches that begin where
    the last factor ends, or before it, the one that reaches farthest is the
    next factor (``repeats.factors``). A match that crosses the border of two
    factors is thus looked at there. Every factor has at least ``window`` words
    and goes as a whole; together they hold all words of all such windows.

    Words are runs of bytes other than space and tab to carriage return, kept
    as they are. ``text`` becomes the kept words joined by one space, and the
    columns ``n_words`` and ``n_removed`` follow (replacing input columns of
    these names; all others stay). Null texts have no words and come out empty;
    texts shorter than the window stay whole. Every row is a document of its
    own: rows that repeat an id and a text repeat each other's windows. A very
    long text is one block of its own (see ``remove_repeats`` for its memory);
    an empty table gives an empty one.
    """
    units = Units(spans.split, window, max(1, window // 2 + 1), keep_first=False)
    return remove_repeats(docs, units, _kept_words, id_col, text_col, ("n_words", "n_removed"))


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeated_passages(docs).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH words AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), windows AS (
  SELECT doc_id, w, unnest(range(len(w) - 34)) AS i FROM words WHERE len(w) >= 35
), hashed AS (
  SELECT doc_id, i, md5(array_to_string(w[i + 1 : i + 35], ' ')) AS h FROM windows
), found AS (
  SELECT doc_id, i FROM hashed WHERE h IN (SELECT h FROM hashed GROUP BY h HAVING count(*) > 1)
), gone AS (
  SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(i, i + 35)) AS p FROM found) GROUP BY doc_id
), flat AS (
  SELECT words.doc_id, len(w) AS n_words, coalesce(len(ps), 0) AS n_removed,
         CASE WHEN ps IS NULL THEN array_to_string(w, ' ')
              ELSE array_to_string(list_transform(list_filter(list_zip(w, range(len(w))), lambda x: NOT list_contains(ps, x[2])), lambda x: x[1]), ' ') END AS kept
  FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id
)
SELECT doc_id, n_words, n_removed, sha256(kept) AS kept_sha256 FROM flat
"""
