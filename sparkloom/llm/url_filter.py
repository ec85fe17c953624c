"""URL filters: host and path rules, then exact membership by a cascade of Bloom filters."""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import renamed, written

#: (verdict, host, path): a rule fits its host and all subdomains where the path starts with its own.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Words of 64 bits of a level's filter at most (8 MB); keys are dealt to as many cascades as that takes.
MOST_WORDS = 1 << 20
_LEVELS = 64
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty where there is no ``://`` or the url is null."""
    part = lambda k: F.coalesce(F.regexp_extract(url, _URL, k), F.lit(""))
    return F.translate(part(1), _UPPER, _UPPER.lower()), part(2)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, as host and path in one string, and its verdict; null where none does."""
    fits = lambda h, p: ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
    ordered = sorted(rules, key=lambda x: -len(x[1] + x[2]))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, h, p in reversed(ordered):
        rule, verdict = F.when(fits(h, p), h + p).otherwise(rule), F.when(fits(h, p), name).otherwise(verdict)
    return rule, verdict


def _size(listed: int, chance: float) -> tuple[int, int]:
    """Hashes and words of a filter that lets other keys through by ``chance``."""
    hashes = max(1, math.ceil(-math.log2(chance)))
    return hashes, max(1, math.ceil(listed * hashes / math.log(2) / 64))


def _first_chance(listed: int, other: int) -> float:
    return min(0.5, math.sqrt(0.5) * listed / max(other, 1)) if listed else 0.5


class Cascade:
    """Bloom filters that tell listed keys from all other keys of a universe, without error.

    Level 1 holds the listed keys, level 2 the other keys that level 1 lets
    through, level 3 the listed keys that level 2 lets through, and so on until
    none is left. A key's class is that of the last level that holds it. A
    level is a table with one row, its bits, which Spark sends to the tasks as
    a scalar.
    """

    def __init__(self, keys: DataFrame, listed: int, other: int) -> None:
        """``keys``: distinct ``key`` (string, not null) and ``listed`` (boolean), a whole universe, with so many of each."""
        self.levels: list[tuple[DataFrame, int, int]] = []
        n, chance = listed, _first_chance(listed, other)
        while n:
            if len(self.levels) == _LEVELS:
                raise RuntimeError("the cascade does not end: keys of both classes hash alike")
            hashes, words = _size(n, chance)
            holds_listed = len(self.levels) % 2 == 0
            here = keys.where(F.col("listed") == holds_listed)
            self.levels.append((written(self._bits(here, len(self.levels), hashes, words), "level"), hashes, words))
            keys = written(keys.where(self._held(F.col("key"), len(self.levels) - 1)), "passed")
            n = keys.where(F.col("listed") != holds_listed).count()
            chance = 0.5

    @staticmethod
    def _place(key: Column, level: int, k: int, words: int) -> Column:
        return F.pmod(F.xxhash64(key, F.lit(level), F.lit(k)), F.lit(64 * words))

    def _bits(self, keys: DataFrame, level: int, hashes: int, words: int) -> DataFrame:
        place = F.explode(F.array(*(self._place(F.col("key"), level, k, words) for k in range(hashes)))).alias("p")
        bit = F.expr("shiftleft(1L, cast(p % 64 as int))")
        some = keys.select(place).select(F.floor(F.col("p") / 64).alias("word"), bit.alias("bits"))
        every = some.union(keys.sparkSession.range(words).select(F.col("id"), F.lit(0).cast("long")))
        rows = every.groupBy("word").agg(F.bit_or("bits").alias("bits"))
        return rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"]).alias("bits"))

    def _held(self, key: Column, level: int) -> Column:
        table, hashes, words = self.levels[level]
        bits, out = table.scalar(), F.lit(True)
        for k in range(hashes):
            p = self._place(key, level, k, words)
            word = F.get(bits, F.floor(p / 64).cast("int"))
            out = out & (F.call_function("getbit", word, F.pmod(p, F.lit(64)).cast("int")) == 1)
        return out

    def listed(self, key: Column) -> Column:
        """Whether a key of the universe is listed."""
        out = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(range(len(self.levels))):
            out = F.when(self._held(key, level), out).otherwise(F.lit(level % 2 == 1))
        return out


def judge_urls(pages: DataFrame, listed_hosts: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", most_words: int = MOST_WORDS) -> DataFrame:
    """Per page its id, ``host``, ``path``, ``rule`` and ``verdict`` (allow or block).

    The longest rule that fits decides; without one, a page is blocked if its
    host is in ``listed_hosts`` (column ``host``; any number of rows, repeats
    and nulls allowed) and allowed if not. The universe is all hosts of the
    pages, so no lookup errs; it is made by a union, and pages meet the list in
    filters alone, never in a join. Keys are dealt by a hash to as many cascades
    as keep every filter below ``most_words``; with several, pages are written
    by cascade first, so that each reads its own and at most one cascade's
    filters are sent at once.

    Null urls and urls without ``://`` have an empty host and path. Every page
    gives one row, repeated or not, of null id or not; other columns, whatever
    their names, are left out; very long urls are read whole; an empty table
    gives an empty one.
    """
    plain, own = renamed(pages.select(id_col, url_col))
    host, path = host_and_path(F.col(own[url_col]))
    split = plain.select(F.col(own[id_col]).alias("id"), host.alias("host"), path.alias("path"))
    seen = split.select(F.col("host").alias("key"), F.lit(False).alias("listed"), F.lit(True).alias("here"))
    given = listed_hosts.where("host IS NOT NULL").select(F.col("host").alias("key"), F.lit(True).alias("listed"), F.lit(False).alias("here"))
    keys = seen.union(given).groupBy("key").agg(F.max("listed").alias("listed"), F.max("here").alias("here")).where("here").select("key", "listed")
    keys = written(keys, "universe")
    n, other = keys.agg(F.count_if("listed"), F.count_if(~F.col("listed"))).first()
    shards = -(-_size(n, _first_chance(n, other))[1] // most_words)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)

    def judged(rows: DataFrame, cascade: Cascade) -> DataFrame:
        blocked = F.when(cascade.listed(F.col("host")), "block").otherwise("allow")
        return rows.select(F.col("id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(verdict, blocked).alias("verdict"))

    if shards == 1:
        return judged(split, Cascade(keys, n, other))
    shard = lambda key: F.pmod(F.xxhash64(key, F.lit("shard")), F.lit(shards)).cast("int").alias("shard")
    keys = written(keys.select("*", shard("key")), "universe", "shard")
    split = written(split.select("*", shard("host")), "split", "shard")
    counts = {s: (a, b) for s, a, b in keys.groupBy("shard").agg(F.count_if("listed"), F.count_if(~F.col("listed"))).collect()}  # a row per cascade
    parts = [judged(split.where(F.col("shard") == s), Cascade(keys.where(F.col("shard") == s).drop("shard"), *counts.get(s, (0, 0)))) for s in range(shards)]
    return functools.reduce(DataFrame.union, parts)


def plain_http_hosts(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """``host``: all hosts of whose pages more than half were fetched over plain http."""
    host = host_and_path(F.col(url_col))[0].alias("host")
    seen = pages.select(host, F.coalesce(F.col(url_col).startswith("http://"), F.lit(False)).alias("plain"))
    return seen.groupBy("host").agg(F.count_if("plain").alias("plain"), F.count("*").alias("n")).where("2 * plain > n").select("host")


def op2_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge_urls(pages, plain_http_hosts(pages))


OP2_SQL = r"""
WITH split AS (
  SELECT page_id, url, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages
), rules(name, h, p) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), fits AS (
  SELECT page_id, max_by(h || p, length(h || p)) AS rule, max_by(name, length(h || p)) AS name
  FROM split JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id
), listed AS (
  SELECT host FROM split GROUP BY host HAVING 2 * count_if(coalesce(starts_with(url, 'http://'), false)) > count(*)
)
SELECT split.page_id, host, path, rule, coalesce(name, CASE WHEN host IN (SELECT host FROM listed) THEN 'block' ELSE 'allow' END) AS verdict
FROM split LEFT JOIN fits ON split.page_id = fits.page_id
"""
