"""Mixing sources to target weights: Pfair windows, scheduled earliest deadline first."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import renamed, written

#: Documents in a block.
BLOCK = 16
#: What the default weights add up to, about: a source's weight is its part in so many.
PARTS = 1000
#: Documents that a bucket of the hash is to hold, about: buckets are what a source's documents are numbered in.
BUCKET = 2000
#: Slots of a schedule that is sent to all tasks; a longer one is joined like any table.
MOST_SENT = 100_000
#: Target weights of ``op7_source_mixing``; sources that aren't named have weight 2.
WEIGHTS = {"src0": 7, "src1": 5, "src2": 3, "src3": 3}
OTHERS = 2


def targets(docs: DataFrame, source: Column, weights: dict[str, int] | None, others: int) -> DataFrame:
    """``source`` and ``w``, its target weight, a whole number of at least one.

    Without ``weights`` a source's target is its part in ``PARTS`` of the square
    roots of all sources' sizes, rounded, so that large sources lead less than
    they would by size.
    """
    sizes = docs.select(source.alias("source")).groupBy("source").agg(F.count("*").alias("n"))
    if weights is None:
        total = sizes.agg(F.sum(F.sqrt("n"))).scalar()
        weight = F.round(F.lit(PARTS) * F.sqrt("n") / total)
    elif weights:
        table = F.create_map(*(F.lit(x) for pair in weights.items() for x in pair))
        weight = F.coalesce(F.try_element_at(table, F.col("source")), F.lit(others))
    else:
        weight = F.lit(others)
    return sizes.select("source", F.greatest(F.lit(1), weight).cast("long").alias("w"))


def frame_schedule(weighed: DataFrame) -> DataFrame:
    """``source``, ``w``, ``frame``, ``nth``, ``slot``: when a frame serves each source's blocks.

    The weights add up to the frame's W slots. Block i of weight w is released
    at floor(i W / w) and due at ceil((i + 1) W / w). Each slot takes, of the
    released blocks, the one due first; no slot stays idle, every block is
    served within its window, and after W slots each source has had exactly w,
    so that all repeats and no rounding adds up.

    m sources of equal weight w are scheduled as one of weight m w and take
    its blocks in turn, which keeps each of them within its own windows. So the
    fold's state has the size of the distinct weights, not of the sources.
    """
    members = weighed.select("source", "w", (F.row_number().over(Window.partitionBy("w").orderBy("source")) - 1).cast("long").alias("j"))
    groups = weighed.groupBy("w").agg(F.count("*").alias("m"))
    one = groups.agg(F.array_sort(F.collect_list(F.struct("w", "m", (F.col("w") * F.col("m")).alias("v")))).alias("s"), F.sum(F.col("w") * F.col("m")).cast("long").alias("t"))
    edf = F.expr("""
        aggregate(sequence(0L, t - 1),
          named_struct('n', transform(s, x -> 0L), 'full', cast(array() AS array<array<int>>), 'served', cast(array() AS array<int>)),
          (a, at) -> transform(
            array(array_min(filter(
              transform(s, (x, i) -> named_struct('due', (a.n[i] + 1) * t div x.v + if((a.n[i] + 1) * t % x.v > 0, 1, 0), 'i', i, 'ready', a.n[i] * t div x.v <= at)),
              x -> x.ready)).i),
            c -> named_struct(
              'n', transform(a.n, (x, i) -> if(i = c, x + 1, x)),
              'full', if(size(a.served) = 1024, concat(a.full, array(a.served)), a.full),
              'served', if(size(a.served) = 1024, array(c), concat(a.served, array(c)))))[0],
          a -> flatten(concat(a.full, array(a.served))))
    """)
    served = one.where("t > 0").select("s", "t", F.posexplode(edf).alias("slot", "i"))
    rows = served.select(F.expr("s[i].w").alias("w"), F.expr("s[i].m").alias("m"), F.col("t").alias("frame"), F.col("slot").cast("long").alias("slot"))
    turn = F.row_number().over(Window.partitionBy("w").orderBy("slot")) - 1
    rows = rows.withColumn("turn", turn).select("w", "frame", "slot", F.floor(F.col("turn") / F.col("m")).alias("nth"), F.pmod("turn", F.col("m")).cast("long").alias("j"))
    return rows.join(members, ["w", "j"]).select("source", "w", "frame", "nth", "slot")


def _dealt(docs: DataFrame, name: Column, id_col: str) -> tuple[DataFrame, DataFrame]:
    """``docs`` with ``name``, ``hash``, ``uid``, ``bucket`` and ``part``, and how many rows each (name, bucket, part) has."""
    digest = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    digits = min(8, max(1, math.ceil(math.log(max(docs.count() / BUCKET, 1), 16))))
    keyed = docs.select("*", name.alias("name"), digest.alias("hash"), F.xxhash64(*(c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind)).alias("uid"), F.substring(digest, 1, digits).alias("bucket"))
    # equal ids share a bucket: where many do, their rows are numbered, in a table that stays as it is, and dealt out by number
    parts = keyed.groupBy("name", "bucket").agg(F.count("*").alias("n")).select("name", "bucket", F.when(F.col("n") > 8 * BUCKET, F.ceil(F.col("n") / (4 * BUCKET))).otherwise(1).cast("long").alias("parts"))
    parts = written(parts, "parts")
    if (parts.agg(F.max("parts")).first()[0] or 1) == 1:
        dealt = keyed.withColumn("part", F.lit(0))
    else:
        numbered = written(keyed.withColumn("uid", F.monotonically_increasing_id()), "numbered")
        dealt = numbered.join(parts, ["name", "bucket"]).select(*keyed.columns, F.pmod(F.xxhash64("uid"), F.col("parts")).alias("part"))
    return dealt, dealt.groupBy("name", "bucket", "part").agg(F.count("*").alias("n"))


def _numbered(docs: DataFrame, name: Column, id_col: str) -> DataFrame:
    """``docs`` with ``name`` and ``rank``, a number from 0 in each name, in the order of the MD5 of the id, then the id, then a hash or number of the row."""
    dealt, sizes = _dealt(docs, name, id_col)
    before = Window.partitionBy("name").orderBy("bucket", "part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select("name", "bucket", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("name", "bucket", "part").orderBy("hash", id_col, "uid")
    ranked = dealt.withColumn("row", F.row_number().over(within) - 1).join(firsts, ["name", "bucket", "part"])
    return ranked.select(*docs.columns, "name", (F.col("first") + F.col("row")).alias("rank"))


def mix(docs: DataFrame, weights: dict[str, int] | None = None, others: int = 1, block: int = BLOCK, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """``docs`` with ``mix_block``, ``mix_release``, ``mix_deadline``, ``mix_slot`` and ``mix_place`` (place in the block).

    ``weights`` maps sources to whole target weights, which are kept exactly;
    sources that it lacks get ``others``, and weights below one count as one.
    In the order of slot and place, any source's blocks so far differ from its
    target by less than one block, as long as all sources last; when one runs
    out its slots stay empty and the others go on. All rows stay. There may be
    any number of sources; the schedule has as many slots as the weights add
    up to and is made in one task.

    A source's documents are ordered by the MD5 of their id (then id), which
    also deals them to buckets, so that no source is numbered in one task:
    rows are numbered within a bucket and buckets by their counts. A bucket
    that many null or equal ids share is dealt out further: then all rows are
    numbered in a written table, so that equal ones part as well. Null sources count
    as the empty source, null ids as the empty id; repeated rows are mixed
    each; input columns named as the new ones are replaced. Texts, empty or
    long, don't matter. An empty table gives an empty one.
    """
    new = ("mix_block", "mix_release", "mix_deadline", "mix_slot", "mix_place")
    docs, own = renamed(docs, new)
    name = F.coalesce(F.col(own[source_col]).cast("string"), F.lit(""))
    schedule = written(frame_schedule(targets(docs, name, weights, others)), "schedule").withColumnRenamed("source", "name")
    sources = schedule.groupBy("name").agg(F.first("w").alias("w"), F.first("frame").alias("frame"))
    sent = F.broadcast if schedule.count() <= MOST_SENT else lambda df: df
    ranked = _numbered(docs, name, own[id_col])
    ranked = ranked.withColumn("mix_block", F.floor(F.col("rank") / block)).withColumn("mix_place", F.pmod("rank", F.lit(block)).cast("long"))
    ranked = ranked.join(sent(sources), "name").withColumn("nth", F.pmod(F.col("mix_block"), F.col("w")))
    ranked = ranked.join(sent(schedule.select("name", "nth", "slot")), ["name", "nth"])
    i, t, w = F.col("mix_block"), F.col("frame"), F.col("w")
    ranked = ranked.withColumn("mix_release", F.expr("mix_block * frame div w")).withColumn("mix_deadline", F.expr("((mix_block + 1) * frame + w - 1) div w"))
    ranked = ranked.withColumn("mix_slot", F.floor(i / w) * t + F.col("slot"))
    return ranked.select(*own.values(), *new).toDF(*own, *new)


def op7_source_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    return mix(docs, WEIGHTS, OTHERS)


OP7_SQL = r"""
WITH RECURSIVE weighed AS (
  SELECT DISTINCT coalesce(source, '') AS source, CAST(CASE coalesce(source, '') WHEN 'src0' THEN 7 WHEN 'src1' THEN 5 WHEN 'src2' THEN 3 WHEN 'src3' THEN 3 ELSE 2 END AS BIGINT) AS w FROM documents
), members AS (
  SELECT source, w, row_number() OVER (PARTITION BY w ORDER BY source) - 1 AS j FROM weighed
), groups AS (
  SELECT w, count(*) AS m, CAST(w * count(*) AS BIGINT) AS v FROM weighed GROUP BY w
), one AS (
  SELECT list(w ORDER BY w) AS w, list(m ORDER BY w) AS m, list(v ORDER BY w) AS v, CAST(sum(v) AS BIGINT) AS t FROM groups
), edf(tick, n, c) AS (
  SELECT CAST(-1 AS BIGINT), list_transform(v, lambda x: CAST(0 AS BIGINT)), CAST(0 AS BIGINT) FROM one
  UNION ALL
  SELECT tick + 1, list_transform(range(1, len(n) + 1), lambda i: n[i] + CASE WHEN i = pick THEN 1 ELSE 0 END), pick FROM (
    SELECT tick, n, CAST(list_sort(list_filter(list_transform(range(1, len(n) + 1),
             lambda i: [CASE WHEN n[i] * t // v[i] <= tick + 1 THEN ((n[i] + 1) * t + v[i] - 1) // v[i] ELSE 9000000000000000000 END, i]), lambda x: x[1] < 9000000000000000000))[1][2] AS BIGINT) AS pick
    FROM edf, one WHERE tick + 1 < t)
), served AS (
  SELECT w[c] AS w, m[c] AS m, t AS frame, tick AS slot, row_number() OVER (PARTITION BY c ORDER BY tick) - 1 AS turn FROM edf, one WHERE tick >= 0
), schedule AS (
  SELECT source, served.w, frame, slot, turn // m AS nth FROM served JOIN members ON served.w = members.w AND turn % m = j
), ranked AS (
  SELECT doc_id, source, coalesce(source, '') AS key, row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id) - 1 AS r FROM documents
), blocks AS (
  SELECT doc_id, source, key, CAST(r // 16 AS BIGINT) AS b, CAST(r % 16 AS BIGINT) AS p FROM ranked
)
SELECT doc_id, blocks.source, b AS mix_block, CAST(b * frame // w AS BIGINT) AS mix_release, CAST(((b + 1) * frame + w - 1) // w AS BIGINT) AS mix_deadline,
       CAST(b // w * frame + slot AS BIGINT) AS mix_slot, p AS mix_place
FROM blocks JOIN schedule ON schedule.source = blocks.key AND nth = b % w
"""
